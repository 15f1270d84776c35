"""Pieces of DuckDB SQL from which the oracles of ``catalog`` are put together.

They state each operator a second time, in another engine's words: relations as CTEs, expressions
as functions of column names.
"""

from __future__ import annotations

from kinmatch.functions import text as X

DOCS = """rec AS (
  SELECT id, src, country, text, split_part(text, chr(10), 1) AS name, substr(text, length(split_part(text, chr(10), 1)) + 2) AS addr
  FROM (SELECT doc_id AS id, (doc_id % 3 + 1)::INT AS src, coalesce(lang, '') AS country, coalesce(text, '') AS text FROM documents))"""
#: The same relation over pages: it takes the place of DOCS, see ``on_pages``.
PAGES = """rec AS (
  SELECT page_id AS id, (page_id % 3 + 1)::INT AS src, regexp_extract(coalesce(url, ''), '^https?://[^/]*/([a-z]*)', 1) AS country,
         regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS name, coalesce(url, '') AS addr FROM pages)"""


def on_pages(sql: str) -> str:
    return sql.replace(DOCS, PAGES)


def fold(c: str) -> str:
    out = f"lower({c})"
    for a, b in X.LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate({out}, '{X.ACCENTED}', '{X.PLAIN}')"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '[a-z0-9]+')"


def clean(c: str) -> str:
    s = f"regexp_replace({fold(c)}, '<\\s*null\\s*>|#{{2,}}', ' ', 'g')"
    s = f"regexp_replace({s}, '\\bnull\\b', ' ', 'g')"
    return f"array_to_string({words(s)}, ' ')"


def dedup_adjacent(c: str) -> str:
    return f"list_filter({c}, lambda x, i: i = 1 OR x <> {c}[i - 1])"


def skeleton_of(folded: str) -> str:
    s = folded
    for a, b in X.SKELETON_RULES:
        s = f"replace({s}, '{a}', '{b}')"
    s = f"regexp_replace(regexp_replace({s}, '[aeiou]', '', 'g'), '[^a-z0-9 ]', ' ', 'g')"
    return f"(SELECT trim(coalesce(string_agg(c, '' ORDER BY i), '')) FROM (SELECT c, i, lag(c) OVER (ORDER BY i) AS before FROM (SELECT unnest(string_split({s}, '')) AS c, generate_subscripts(string_split({s}, ''), 1) AS i)) WHERE before IS NULL OR c <> before)"


def skeleton(c: str) -> str:
    return skeleton_of(fold(c))


def numbers(c: str) -> str:
    runs = f"regexp_extract_all({fold(c)}, '\\d+')"
    return f"list_distinct(list_transform({runs}, lambda n: CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END))"


def wb_grams(s: str, n: int) -> str:
    return (
        f"flatten(list_transform(list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: CASE WHEN length(w) + 2 <= {n} THEN [' ' || w || ' '] "
        f"ELSE list_transform(generate_series(1, length(w) + 3 - {n}), lambda i: substr(' ' || w || ' ', i, {n})) END))"
    )


def grams(s: str, n: int = 3) -> str:
    return (
        f"(CASE WHEN length({s}) = 0 THEN []::VARCHAR[] WHEN length({s}) < {n} THEN [{s}] "
        f"ELSE list_distinct(list_transform(generate_series(1, length({s}) - {n} + 1), lambda i: substr({s}, i, {n}))) END)"
    )


def jaccard(a: str, b: str) -> str:
    """Undefined where either side is empty."""
    i = f"len(list_intersect({a}, {b}))"
    u = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {i}::DOUBLE / {u} END)"


TOKENS = f"""{DOCS},
wrd AS (SELECT *, {words(fold('name'))} AS w, {words(fold('addr'))} AS aw FROM rec),
tok AS (SELECT id, src, country, name, addr, {dedup_adjacent('w')} AS tok, {dedup_adjacent('aw')} AS atok FROM wrd),
totals AS (SELECT country, count(*) AS nd, count(*) FILTER (len(tok) >= 3) AS n3, count(*) FILTER (len(atok) > 0) AS nad FROM tok GROUP BY country)"""

TOKEN_DF = f"""{TOKENS},
token_df AS (SELECT country, token, count(*) AS df FROM (SELECT DISTINCT country, id, src, unnest(tok) AS token FROM tok) GROUP BY ALL)"""


def affix(share: float = 0.003, edge: float = 0.85) -> str:
    return f"""{TOKEN_DF},
edge AS (SELECT country, token, count(*) AS edge FROM (SELECT country, unnest([tok[1], tok[-1]]) AS token FROM tok WHERE len(tok) >= 3) GROUP BY ALL),
affix AS (SELECT country, token, df, edge FROM token_df JOIN edge USING (country, token) JOIN totals USING (country)
  WHERE df >= {share} * greatest(n3, 1) AND edge::DOUBLE / df >= {edge})"""


def bigram(share: float = 0.002, edge: float = 0.85, before: str | None = None) -> str:
    return f"""{before or affix()},
big AS (SELECT country, len(tok) AS m, i AS pos, tok[i] AS first, tok[i + 1] AS second FROM (SELECT *, unnest(generate_series(1, len(tok) - 1)) AS i FROM tok WHERE len(tok) >= 2)),
bigram AS (SELECT country, first, second, count(*) AS n, count(*) FILTER (m >= 3 AND (pos = 1 OR pos = m - 1)) AS edge FROM big GROUP BY ALL),
bigrams AS (SELECT country, first, second, n, edge FROM bigram JOIN totals USING (country)
  WHERE edge > 0 AND n >= {share} * greatest(n3, 1) AND edge::DOUBLE / n >= {edge})"""


def core(share: float, edge: float, bi_share: float, bi_edge: float) -> str:
    return f"""{bigram(bi_share, bi_edge, affix(share, edge))},
al AS (SELECT country, list(token) AS a FROM affix GROUP BY country),
bl AS (SELECT country, list(first || ' ' || second) AS b FROM bigrams GROUP BY country),
cj AS (SELECT tok.*, coalesce(a, []::VARCHAR[]) AS a, coalesce(b, []::VARCHAR[]) AS b, len(tok) AS m FROM tok LEFT JOIN al USING (country) LEFT JOIN bl USING (country)),
ck AS (SELECT *, m >= 3 AND list_contains(b, tok[1] || ' ' || tok[2]) AS h, m >= 3 AND list_contains(b, tok[m - 1] || ' ' || tok[m]) AS t FROM cj),
cc AS (SELECT *, list_filter(tok, lambda w, i: NOT ((h AND i <= 2) OR (t AND i >= m - 1)) AND NOT list_contains(a, w)) AS c1,
              list_filter(tok, lambda w: NOT list_contains(a, w)) AS c2,
              list_filter(tok, lambda w, i: NOT ((h AND i <= 2) OR (t AND i >= m - 1))) AS c3 FROM ck),
core AS (SELECT id, src, country, name, addr, tok, atok, CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 WHEN len(c3) > 0 THEN c3 ELSE tok END AS core FROM cc)"""


def view_text(view: str) -> str:
    return {
        "name": clean("name"),
        "addr": clean("addr"),
        "index": f"concat_ws(' ', {clean('name')}, {clean('addr')})",
        "skeleton": skeleton_of(f"concat_ws(' ', {clean('name')}, {clean('addr')})"),
    }[view]


def view_terms(s: str, kind: str, n: int) -> str:
    if kind == "char":
        return wb_grams(s, n)
    return f"list_concat(list_filter(string_split_regex({s}, '\\s+'), lambda w: w <> ''), {wb_grams(s, n)})"


def postings(p: str, view: str, kind: str, n: int, frac: float, cap: int, min_df: int = 2) -> str:
    """CTEs {p}terms, {p}vocab, {p}post over rec."""
    return f"""{p}view AS (SELECT country, src, id, {view_text(view)} AS v FROM rec),
{p}terms AS (SELECT country, src, id, term, count(*) AS tf FROM (SELECT country, src, id, unnest({view_terms('v', kind, n)}) AS term FROM {p}view) GROUP BY ALL),
{p}n AS (SELECT country, src, count(*) AS n FROM rec WHERE src > 1 GROUP BY ALL),
{p}df AS (SELECT country, src, term, count(*) AS df FROM {p}terms WHERE src > 1 GROUP BY ALL),
{p}ok AS (SELECT country, src, term, df, n, df >= {min_df} AND df <= least({cap}, greatest(1, floor({frac}::DOUBLE * n))) AS ok FROM {p}df JOIN {p}n USING (country, src)),
{p}has AS (SELECT country, src, bool_or(ok) AS hassome FROM {p}ok GROUP BY ALL),
{p}vocab AS (SELECT country, src, term, df, ln(n::DOUBLE / df) + 1 AS idf FROM {p}ok JOIN {p}has USING (country, src) WHERE ok OR NOT hassome),
{p}raw AS (SELECT country, src, id, term, (1 + ln(tf)) * idf AS w FROM {p}terms JOIN {p}vocab USING (country, src, term)),
{p}post AS (SELECT country, src, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, src, id)) AS w FROM {p}raw)"""


def query_vectors(p: str, budget: int, min_terms: int, max_terms: int) -> str:
    return f"""{p}q0 AS (SELECT t.country, t.id AS s1, v.src, t.term, v.df, (1 + ln(t.tf)) * v.idf AS w0 FROM {p}terms t JOIN {p}vocab v ON t.country = v.country AND t.term = v.term WHERE t.src = 1),
{p}q1 AS (SELECT *, row_number() OVER x AS rn, sum(df) OVER (x ROWS UNBOUNDED PRECEDING) AS cum FROM {p}q0 WINDOW x AS (PARTITION BY country, s1, src ORDER BY df, term)),
{p}q2 AS (SELECT * FROM {p}q1 WHERE rn <= {min_terms} OR (cum <= {budget} AND rn <= {max_terms})),
{p}q AS (SELECT country, s1, src, term, df, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY country, s1, src)) AS w FROM {p}q2)"""


def top_k(p: str, k: int) -> str:
    return f"""{p}dot AS (SELECT q.country, q.s1, q.src, d.id AS cid, round(sum(q.w * d.w), 6) AS score FROM {p}q q JOIN {p}post d ON q.country = d.country AND q.src = d.src AND q.term = d.term GROUP BY ALL),
{p}rank AS (SELECT *, row_number() OVER (PARTITION BY country, s1, src ORDER BY score DESC, cid) - 1 AS rank FROM {p}dot),
{p}top AS (SELECT * FROM {p}rank WHERE rank < {k})"""


CLAIMS = """ent AS (SELECT o_orderpriority AS country, o_orderkey AS s1 FROM orders),
cl0 AS (SELECT l_orderkey AS s1, (l_suppkey % 2 + 2)::INT AS src, l_partkey AS cid, max(0.05::DOUBLE + 9.0::DOUBLE * l_discount) AS p, max((l_linestatus = 'F')::INT) AS y FROM lineitem GROUP BY ALL),
claims AS (SELECT ent.country, cl0.* FROM cl0 JOIN ent USING (s1)),
truth AS (SELECT country, s1, sum(y)::BIGINT AS n_true FROM claims GROUP BY ALL)"""


def f05(tp: str, n_pred: str, n_true: str) -> str:
    return f"(CASE WHEN {n_pred} = 0 AND {n_true} = 0 THEN 1.0::DOUBLE WHEN {n_pred} = 0 OR {n_true} = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * {tp} / (0.25::DOUBLE * {n_true} + {n_pred}) END)"


COUNTS = f"""{CLAIMS},
per AS (SELECT country, s1, count(*) AS n_pred, sum(y)::BIGINT AS tp FROM claims WHERE p >= 0.5 GROUP BY ALL),
counts0 AS (SELECT ent.country, ent.s1, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM ent LEFT JOIN per USING (country, s1) LEFT JOIN truth USING (country, s1)),
counts AS (SELECT *, {f05('tp', 'n_pred', 'n_true')} AS f05 FROM counts0)"""

LABELLED = """scored AS (SELECT d.lang AS country, d.doc_id AS id, round((d.n_chars % 97)::DOUBLE / 97.0::DOUBLE * 0.5::DOUBLE + l.quality * 0.4::DOUBLE + 0.05::DOUBLE, 6) AS p, l.quality AS y FROM documents d JOIN labels l USING (doc_id))"""

def crc32(c: str, salted: bool = False) -> str:
    """crc32 of ASCII text that is not empty, a salt after it or not: bytes through the reflected
    polynomial."""
    byte = "list_reduce(list_prepend(xor(h, ch), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    codes = f"list_transform(string_split({c}, ''), lambda z: ord(z)::BIGINT)"
    if salted:
        codes = f"list_concat({codes}, [0, 115, 97, 108, 116]::BIGINT[])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda h, ch: {byte}), 4294967295)"
