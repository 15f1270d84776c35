"""Registered queries of the linkage engine, each beside its oracle SQL where SQL can express it.

Queries bind the operators to the driver's tables (``kinmatch.sources.bindings``) and run over
whole tables and whole texts: functions of text and corpus statistics over the documents, retrieval,
features and what follows over the pages' titles and URLs, decisions and metrics over order lines.
Retrieval has the operators' own caps; only the share of documents that a term may occur in is
looser, as 2 % of some hundred records would leave no terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import kernels as K
from kinmatch.functions import text as X
from kinmatch.functions.romanise import romanised
from kinmatch.operators import augment, candidates, corpus, decide, features, index, metrics, model, splits
from kinmatch.plans import oracle_parts as O
from kinmatch.sources import bindings as B
from kinmatch.sources import tables as T
from kinmatch.sources import working

FRAC, CFG = 0.25, index.BlockingConfig()
BUDGET, K_TOP = CFG.budget, CFG.k
SPECS = {s.name: replace(s, max_df_frac=FRAC) for s in index.SPECS}
AFFIX = (0.005, 0.3, 0.005, 0.3)

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def joined(c: str) -> F.Column:
    return F.array_join(F.array_sort(c), " ")


# ---- scans and text
@query("scan_project_filter", f"WITH {O.DOCS} SELECT id, text FROM rec WHERE src = 1 AND country = 'en'")
def _(s, d):
    return B.doc_records(s, d).where("src = 1 AND country = 'en'").select("id", "text")


@query("countries_distinct", f"WITH {O.DOCS} SELECT DISTINCT country FROM rec")
def _(s, d):
    return T.countries(B.doc_records(s, d))


@query("first_rows_per_country", f"WITH {O.DOCS} SELECT country, id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY id) AS r FROM rec) WHERE r <= 5")
def _(s, d):
    return T.first_rows(B.doc_records(s, d), 5).select("country", "id")


@query("norm_fold", f"WITH {O.DOCS} SELECT id, {O.fold('text')} AS folded FROM rec")
def _(s, d):
    return B.doc_records(s, d).select("id", X.fold_latin(F.col("text")).alias("folded"))


@query("norm_tokens", f"WITH {O.TOKENS} SELECT id, array_to_string(tok, ' ') AS tokens, array_to_string(atok, ' ') AS addr_tokens FROM tok")
def _(s, d):
    return B.record_tokens(B.doc_records(s, d)).select("id", F.array_join("tok", " ").alias("tokens"), F.array_join("atok", " ").alias("addr_tokens"))


@query("norm_clean_text", f"WITH {O.DOCS} SELECT id, {O.clean('text')} AS cleaned FROM rec")
def _(s, d):
    return B.doc_records(s, d).select("id", X.clean_text(F.col("text")).alias("cleaned"))


@query("norm_skeleton", f"WITH {O.DOCS} SELECT id, {O.skeleton('text')} AS skeleton FROM rec")
def _(s, d):
    return B.doc_records(s, d).select("id", X.skeleton(F.col("text")).alias("skeleton"))


@query("norm_numbers", f"WITH t AS (SELECT page_id, coalesce(url, '') AS url FROM pages) SELECT page_id, array_to_string(list_sort({O.numbers('url')}), ' ') AS numbers FROM t")
def _(s, d):
    return B.table(s, d, "pages").select("page_id", joined(X.house_numbers(F.col("url"))).alias("numbers"))


@query("norm_domain", f"WITH t AS (SELECT page_id, regexp_extract(url, 'https?://([^/]*)', 1) AS host FROM pages) SELECT page_id, regexp_matches({O.fold('host')}, '{X.DOMAIN}') AS is_domain, regexp_extract({O.fold('host')}, '{X.DOMAIN}', 1) AS label FROM t")
def _(s, d):
    host = F.col("host")
    return B.page_records(s, d).select("page_id", X.is_domain_name(host).alias("is_domain"), F.regexp_extract(X.fold_latin(host), X.DOMAIN, 1).alias("label"))


@query("norm_aliases")
def _(s, d):
    return B.page_records(s, d).select("page_id", X.index_view(F.concat_ws(" | ", "title", "host")).alias("aliases"), X.skeleton_view(F.col("host")).alias("skeletons"))


@query("native_script_flag", f"WITH {O.DOCS} SELECT id, len(list_filter(string_split(text, ''), lambda c: ord(c) > 591)) > 0 AS native FROM rec")
def _(s, d):
    return B.doc_records(s, d).select("id", X.has_native_script(F.col("text")).alias("native"))


@query("fold_full_rows")
def _(s, d):
    from kinmatch.functions.romanise import fold_full

    return B.doc_records(s, d).select("id", fold_full("text").alias("folded"))


@query("char_ngrams_bag", f"WITH {O.DOCS}, g AS (SELECT id, unnest({O.wb_grams(O.clean('text'), 4)}) AS term FROM rec) SELECT id, term, count(*) AS tf FROM g GROUP BY ALL")
def _(s, d):
    g = B.doc_records(s, d).select("id", F.explode(X.char_wb_ngrams(X.clean_text(F.col("text")), 4)).alias("term"))
    return g.groupBy("id", "term").agg(F.count("*").alias("tf"))


@query("char_ngrams_set", f"WITH {O.DOCS}, c AS (SELECT id, {O.clean('text')} AS s FROM rec) SELECT id, array_to_string(list_sort({O.grams('s')}), '|') AS grams FROM c")
def _(s, d):
    return B.doc_records(s, d).select("id", F.array_join(F.array_sort(X.char_ngrams(X.clean_text(F.col("text")))), "|").alias("grams"))


@query("word_ngrams", f"WITH {O.DOCS}, w AS (SELECT id, {O.words(O.fold('text'))} AS w FROM rec) SELECT id, CASE WHEN len(w) < 2 THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), '|') END AS grams FROM w")
def _(s, d):
    return B.doc_records(s, d).select("id", F.array_join(X.word_ngrams(F.array_join(X.words_of(X.fold_latin(F.col("text"))), " "), 2), "|").alias("grams"))


@query(
    "abbrev_pairs",
    O.on_pages(f"""WITH {O.TOKENS}, p AS (SELECT DISTINCT unnest(tok) AS a, id FROM tok),
q AS (SELECT DISTINCT x.a AS a, y.a AS b FROM p x JOIN p y ON x.id = y.id AND x.a <> y.a)
SELECT a, b FROM q WHERE length(a) > 0 AND length(a) <= 0.7::DOUBLE * length(b) AND a[1] = b[1] AND regexp_matches(b, '^' || regexp_replace(a, '(.)', '\\1.*', 'g'))"""),
)
def _(s, d):
    """Words of one title of which one abbreviates another."""
    one = B.record_tokens(B.page_rows(s, d)).select(F.array_distinct("tok").alias("w"))
    pairs = one.select(F.explode("w").alias("a"), "w").select("a", F.explode("w").alias("b")).where("a <> b").distinct()
    return pairs.where(X.is_abbrev(F.col("a"), F.col("b")))


@query(
    "serialise_record",
    f"""WITH {O.DOCS}, c AS (SELECT *, {O.clean('name')} AS cl, trim(name, ' ') AS raw, array_to_string(list_sort({O.numbers('addr')}), ' ') AS nums FROM rec)
SELECT id, 'name: ' || raw || CASE WHEN cl <> '' AND cl <> lower(raw) THEN ' (' || cl || ')' ELSE '' END || ' | nums: ' || CASE WHEN nums = '' THEN '-' ELSE nums END
  || ' | addr: ' || CASE WHEN trim(addr, ' ') = '' THEN '-' ELSE trim(addr, ' ') END || ' | country: ' || country AS line FROM c""",
)
def _(s, d):
    return B.doc_records(s, d).select("id", X.serialise(F.col("name"), F.col("addr"), F.col("country")).alias("line"))


@query("stable_hash", f"WITH {O.DOCS}, c AS (SELECT id, 'k' || {O.clean('text')} AS s FROM rec) SELECT id, {O.crc32('s')}::BIGINT AS h FROM c")
def _(s, d):
    return B.doc_records(s, d).select("id", X.stable_hash(F.concat(F.lit("k"), X.clean_text(F.col("text")))).alias("h"))


@query("hash64_rows", f"WITH {O.DOCS}, c AS (SELECT id, 'k' || {O.clean('text')} AS s FROM rec), h AS (SELECT id, {O.crc32('s')}::HUGEINT AS hi, {O.crc32('s', salted=True)}::HUGEINT AS lo FROM c) SELECT id, (CASE WHEN hi >= 2147483648 THEN (hi - 4294967296) * 4294967296 + lo ELSE hi * 4294967296 + lo END)::BIGINT AS h FROM h")
def _(s, d):
    return B.doc_records(s, d).select("id", X.hash64(F.concat(F.lit("k"), X.clean_text(F.col("text")))).alias("h"))


@query("mask_examples")
def _(s, d):
    return B.doc_records(s, d).select("id", F.array_join(augment.masked(F.array("name", "addr")), " / ").alias("masked"))


@query("augment_rows")
def _(s, d):
    key = F.col("id").cast("string")
    return B.doc_records(s, d).select("id", augment.corrupted()("name", key).alias("noisy"), augment.shifted()("addr", key).alias("moved"))


# ---- corpus statistics
@query("corpus_idf", f"WITH {O.TOKEN_DF} SELECT country, token, df, round(ln(nd::DOUBLE / df), 6) AS idf FROM token_df JOIN totals USING (country)")
def _(s, d):
    return corpus.idf(B.record_tokens(B.doc_records(s, d))).withColumn("idf", F.round("idf", 6))


@query("corpus_max_idf", f"WITH {O.TOKENS} SELECT country, round(ln(greatest(nd, 2)), 6) AS max_idf, round(ln(greatest(nad, 2)), 6) AS addr_max_idf FROM totals")
def _(s, d):
    m = corpus.max_idf(B.record_tokens(B.doc_records(s, d)))
    return m.select("country", F.round("max_idf", 6).alias("max_idf"), F.round("addr_max_idf", 6).alias("addr_max_idf"))


@query("corpus_weight", f"WITH {O.affix(*AFFIX[:2])} SELECT t.country, t.token, round(ln(nd::DOUBLE / t.df) * CASE WHEN a.token IS NULL THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END, 6) AS weight FROM token_df t JOIN totals USING (country) LEFT JOIN affix a ON a.country = t.country AND a.token = t.token")
def _(s, d):
    rec = B.record_tokens(B.doc_records(s, d))
    w = corpus.weighted(corpus.token_df(rec).select("country", "token"), corpus.idf(rec), corpus.max_idf(rec).select("country", "max_idf"), corpus.affixes(rec, *AFFIX[:2]))
    return w.select("country", "token", F.round("weight", 6).alias("weight"))


@query("corpus_affix", f"WITH {O.affix(*AFFIX[:2])} SELECT country, token, df, edge FROM affix")
def _(s, d):
    return corpus.affixes(B.record_tokens(B.doc_records(s, d)), *AFFIX[:2])


@query("corpus_affix_bigram", f"WITH {O.bigram(*AFFIX[2:])} SELECT country, first, second, n, edge FROM bigrams")
def _(s, d):
    return corpus.affix_bigrams(B.record_tokens(B.doc_records(s, d)), *AFFIX[2:])


def _core(s, d) -> DataFrame:
    rec = B.record_tokens(B.doc_records(s, d))
    return corpus.with_core(rec, corpus.affixes(rec, *AFFIX[:2]), corpus.affix_bigrams(rec, *AFFIX[2:]))


@query("core_tokens", f"WITH {O.core(*AFFIX)} SELECT id, array_to_string(core, ' ') AS core FROM core")
def _(s, d):
    return _core(s, d).select("id", F.array_join("core", " ").alias("core"))


@query("name_freq_pct", f"WITH {O.TOKENS}, n AS (SELECT country, array_to_string(tok, ' ') AS k, count(*) AS n FROM tok GROUP BY ALL) SELECT id, round(ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + greatest(nd, 2)), 6) AS freq FROM tok JOIN n ON n.country = tok.country AND n.k = array_to_string(tok, ' ') JOIN totals ON totals.country = tok.country")
def _(s, d):
    return corpus.name_freq_pct(B.record_tokens(B.doc_records(s, d))).select("id", F.round("freq", 6).alias("freq"))


@query("affix_report_topk", f"WITH {O.affix(*AFFIX[:2])} SELECT country, token, rank, round(df::DOUBLE / nd, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY df DESC, token) AS rank FROM affix JOIN totals USING (country)) WHERE rank <= 10")
def _(s, d):
    rec = B.record_tokens(B.doc_records(s, d))
    return corpus.describe_affixes(corpus.affixes(rec, *AFFIX[:2]), corpus.country_totals(rec)).withColumn("share", F.round("share", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("corpus_partial_fit", f"WITH {O.TOKEN_DF} SELECT country, token, df FROM token_df")
def _(s, d):
    rec = B.record_tokens(B.doc_records(s, d))
    parts = [corpus.token_df(rec.where(F.col("src") == k)) for k in (1, 2, 3)]
    return corpus.merge_totals(parts, ["country", "token"])


# ---- retrieval
def _spec_sql(name: str, p: str = "") -> str:
    spec = SPECS[name]
    return O.postings(p, spec.view, spec.kind, spec.n, spec.max_df_frac, spec.max_df_abs)


def _top_sql(name: str, p: str = "") -> str:
    return f"{_spec_sql(name, p)},\n{O.query_vectors(p, BUDGET, CFG.min_query_terms, CFG.max_query_terms)},\n{O.top_k(p, K_TOP)}"


def _retrieve(s, d, name: str, rec: DataFrame | None = None) -> DataFrame:
    rec = working.cut(B.page_rows(s, d), "pages") if rec is None else rec
    got = index.retrieve(rec, SPECS[name], K_TOP, BUDGET, CFG.min_query_terms, CFG.max_query_terms)
    return got.withColumn("rank", F.col("rank").cast("long"))


@query("postings_tfidf", O.on_pages(f"WITH {O.DOCS},\n{_spec_sql('nm')} SELECT country, src, id, term, round(w, 6) AS w FROM post"))
def _(s, d):
    rec = B.page_rows(s, d)
    pool = index.terms(rec, SPECS["nm"]).where("src > 1")
    return index.postings(pool, index.vocabulary(pool, rec, SPECS["nm"])).withColumn("w", F.round("w", 6))


@query("query_prune_budget", O.on_pages(f"WITH {O.DOCS},\n{_spec_sql('nm')},\n{O.query_vectors('', BUDGET, CFG.min_query_terms, CFG.max_query_terms)} SELECT country, s1, src, term, df, round(w, 6) AS w FROM q"))
def _(s, d):
    rec = B.page_rows(s, d)
    t = index.terms(rec, SPECS["nm"])
    vocab = index.vocabulary(t.where("src > 1"), rec, SPECS["nm"])
    return index.query_vectors(t.where("src = 1"), vocab, BUDGET, CFG.min_query_terms, CFG.max_query_terms).withColumn("w", F.round("w", 6))


for _name, _short in (("topk_name", "nm"), ("topk_addr", "ad"), ("topk_nameaddr", "na"), ("topk_skeleton", "sk")):
    query(_name, O.on_pages(f"WITH {O.DOCS},\n{_top_sql(_short)} SELECT * FROM top"))(lambda s, d, v=_short: _retrieve(s, d, v))

#: Latin letters and Cyrillic ones of the same sound, for ``native_twins``.
_LATIN, _CYRILLIC = "abdefgiklmnoprstuvwcyh", "абдефгиклмнопрстуввкых"


@query("native_twins", "SELECT DISTINCT p_name AS name, p_name AS twin FROM part WHERE NOT regexp_matches(p_name, '[jqxz]')")
def _(s, d):
    """Part names in Cyrillic letters as queries against all names in Latin ones: the nearest by
    skeleton of each."""
    names = B.table(s, d, "part").select(F.col("p_name").alias("name")).distinct().where(~F.col("name").rlike("[jqxz]"))
    rows = names.select(F.crc32(F.col("name").cast("binary")).alias("id"), "name", F.lit("").alias("addr"), F.lit("all").alias("country"))
    native = rows.withColumn("name", F.translate("name", _LATIN, _CYRILLIC)).withColumn("src", F.lit(1))
    rec = working.cut(romanised(rows.withColumn("src", F.lit(2)).unionByName(native)), "twins")
    top = index.retrieve(rec, replace(SPECS["sk"], max_df_frac=1.0), 1)
    twin = rec.where("src = 2").select(F.col("id").alias("cid"), F.col("name").alias("twin"))
    own = rows.select(F.col("id").alias("s1"), "name")
    return top.join(own, "s1").join(twin, "cid").select("name", "twin")


_KEYS = f"""{O.on_pages(O.core(*AFFIX))},
ck1 AS (SELECT id, src, country, core, {O.numbers('addr')} AS nums, core[1] AS c1, array_to_string(core, ' ') AS cs FROM core WHERE len(core) > 0),
ck2 AS (SELECT *, {O.skeleton('c1')} AS sk1, array_to_string(list_sort(list_filter(string_split({O.skeleton('cs')}, ' '), lambda w: w <> '')), ' ') AS sks FROM ck1),
keys AS (SELECT DISTINCT country, src, id, key FROM (SELECT country, src, id, unnest(list_concat(list_transform(nums, lambda n: 'n:' || n || '|' || CASE WHEN sk1 = '' THEN c1 ELSE sk1 END), CASE WHEN sks <> '' THEN ['s:' || sks] ELSE []::VARCHAR[] END)) AS key FROM ck2)),
blocks AS (SELECT country, src, id, key FROM (SELECT *, row_number() OVER (PARTITION BY country, src, key ORDER BY id) AS r FROM keys WHERE src > 1) WHERE r <= 50)"""


def _page_core(s, d) -> DataFrame:
    rec = B.record_tokens(B.page_rows(s, d))
    return corpus.with_core(rec, corpus.affixes(rec, *AFFIX[:2]), corpus.affix_bigrams(rec, *AFFIX[2:]))


@query("record_keys", f"WITH {_KEYS} SELECT * FROM keys")
def _(s, d):
    return candidates.record_keys(_page_core(s, d))


@query("key_blocks_capped", f"WITH {_KEYS} SELECT country, src, id, key FROM (SELECT *, row_number() OVER (PARTITION BY country, src, key ORDER BY id) AS r FROM keys WHERE src > 1) WHERE r <= 50")
def _(s, d):
    return candidates.key_blocks(candidates.record_keys(_page_core(s, d)).where("src > 1"), 50)


_KEY_CAND = f"""{_KEYS},
kc AS (SELECT country, s1, src, cid FROM (SELECT *, row_number() OVER (PARTITION BY country, s1, src ORDER BY cid) AS r FROM (
  SELECT DISTINCT q.country, q.id AS s1, b.src, b.id AS cid FROM keys q JOIN blocks b ON q.country = b.country AND q.key = b.key WHERE q.src = 1)) WHERE r <= 20)"""


def _key_candidates(s, d) -> DataFrame:
    keys = working.cut(candidates.record_keys(_page_core(s, d)), "keys")
    return candidates.key_candidates(keys.where("src = 1"), candidates.key_blocks(keys.where("src > 1")))


@query("key_candidates", f"WITH {_KEY_CAND} SELECT * FROM kc")
def _(s, d):
    return _key_candidates(s, d)


_FUSE = f"""{_KEY_CAND},
{_top_sql('nm', 'nm_')},
{_top_sql('ad', 'ad_')},
{_top_sql('na', 'na_')},
{_top_sql('sk', 'sk_')},
lists AS (SELECT country, s1, src, cid, 'nm' AS view, score, rank FROM nm_top UNION ALL SELECT country, s1, src, cid, 'ad', score, rank FROM ad_top
  UNION ALL SELECT country, s1, src, cid, 'na', score, rank FROM na_top UNION ALL SELECT country, s1, src, cid, 'sk', score, rank FROM sk_top
  UNION ALL SELECT country, s1, src, cid, 'key', 0.0, 0 FROM kc),
fused AS (SELECT country, s1, src, cid,
  {', '.join(f"coalesce(max(score) FILTER (view = '{v}'), 0.0) AS {v}_score, coalesce(min(rank) FILTER (view = '{v}'), 999) AS {v}_rank" for v in candidates.VIEWS)},
  max((view = 'key')::INT) AS key_hit, round(coalesce(sum(1.0::DOUBLE / (60 + rank + 1)) FILTER (view <> 'key'), 0.0), 9) AS rrf, count(*) FILTER (view <> 'key') AS nret
  FROM lists GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY country, s1, src ORDER BY rrf DESC, cid) AS r FROM fused)"""


def _fused(s, d, most: int) -> DataFrame:
    """The views' lists are written one after another, so that the index of one is there at a time."""
    rec, views = working.cut(B.page_rows(s, d), "pages"), {}
    for v in candidates.VIEWS:
        start = len(working.made)
        views[v] = working.cut_last(_retrieve(s, d, v, rec), "list", start)
    got = candidates.fuse(views, _key_candidates(s, d), max_per_source=most)
    return got.withColumns({f"{v}_rank": F.col(f"{v}_rank").cast("long") for v in candidates.VIEWS} | {"nret": F.col("nret").cast("long")})


def _fused_table(s, d, columns: list[str] | None = None) -> DataFrame:
    """The fused candidates, or columns of them, from a table; the lists that they come from go."""
    start = len(working.made)
    return working.cut_last(_fused(s, d, CFG.max_per_source).select(*(columns or ["*"])), "fused", start)


#: The columns of the fused candidates that are features.
_FUSED = [*[f"{v}_{c}" for v in candidates.VIEWS for c in ("score", "rank")], "key_hit", "rrf", "nret"]


@query("fuse_rrf", f"WITH {_FUSE} SELECT * EXCLUDE (r) FROM fr WHERE r <= {CFG.max_per_source}")
def _(s, d):
    return _fused(s, d, CFG.max_per_source)


@query("fuse_capped", f"WITH {_FUSE} SELECT country, s1, src, cid, rrf FROM fr WHERE r <= 5")
def _(s, d):
    return _fused(s, d, 5).select("country", "s1", "src", "cid", "rrf")


_DENSE = """v AS (SELECT vec_id AS id, (vec_id % 3 + 1)::INT AS src, embedding AS vec, label FROM embeddings),
dot AS (SELECT q.id AS s1, p.id AS cid, q.src AS qsrc, p.src AS psrc, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.vec, p.vec), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), lambda a, b: a + b), 6) AS score FROM v q, v p WHERE q.src <> p.src AND p.src > 1)"""


@query("dense_topk", f"WITH {_DENSE} SELECT s1, cid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid) - 1 AS rank FROM dot WHERE qsrc = 1) WHERE rank < 10")
def _(s, d):
    e = B.embeddings(s, d)
    return candidates.dense_topk(e.where("src = 1"), e.where("src > 1"), 10).withColumn("rank", F.col("rank").cast("long"))


def _dense_lists(s, d) -> tuple[DataFrame, DataFrame]:
    """Candidates from vectors (rrf stands for the score), and the neighbours across sources."""
    e = B.embeddings(s, d)
    near = []
    for src, other in ((2, 3), (3, 2)):
        got = candidates.dense_topk(e.where(F.col("src") == src), e.where(F.col("src") == other), 3)
        near.append(got.select(F.lit(src).alias("src"), F.col("s1").alias("cid"), F.lit(other).alias("n_src"), F.col("cid").alias("n_cid"), F.col("rank").alias("n_rank")))
    top = candidates.dense_topk(e.where("src = 1"), e.where("src > 1"), 10)
    cand = top.select(F.lit("all").alias("country"), "s1", (F.col("cid") % 3 + 1).cast("int").alias("src"), "cid", F.col("score").alias("rrf"))
    return cand, near[0].unionByName(near[1])


@query(
    "two_hop_expand",
    f"""WITH {_DENSE},
cand AS (SELECT s1, psrc AS src, cid, score AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid) AS r FROM dot WHERE qsrc = 1) WHERE r <= 10),
near AS (SELECT s1 AS cid, psrc AS n_src, cid AS n_cid FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cid) AS r FROM dot WHERE qsrc > 1) WHERE r <= 3),
seeds AS (SELECT s1, cid FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY rrf DESC, src, cid) AS r FROM cand) WHERE r <= 5)
SELECT DISTINCT 'all' AS country, s1, n_src AS src, n_cid AS cid FROM seeds JOIN near USING (cid) WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.s1 = seeds.s1 AND c.cid = n_cid)""",
)
def _(s, d):
    return candidates.two_hop(*_dense_lists(s, d))


@query("union_candidates", f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY s1, psrc ORDER BY score DESC, cid) AS r FROM dot WHERE qsrc = 1) SELECT DISTINCT s1, cid FROM r WHERE r <= 3")
def _(s, d):
    e = B.embeddings(s, d)
    q = e.where("src = 1")
    return candidates.union_candidates(candidates.dense_topk(q, e.where("src = 2"), 3), candidates.dense_topk(q, e.where("src = 3"), 3))


# ---- joins, labels, pruning
_TRUTH = """tk AS (SELECT id, src, country, regexp_replace(lower(name), '[^a-z]', '', 'g') AS key FROM rec),
dt AS (SELECT a.id AS s1, b.src, b.id AS cid FROM tk a JOIN tk b ON a.key = b.key WHERE a.src = 1 AND b.src > 1 AND a.key <> '')"""


@query("label_left_join", f"WITH {O.CLAIMS}, t AS (SELECT s1, src, cid FROM claims WHERE y = 1) SELECT c.s1, c.src, c.cid, (t.s1 IS NOT NULL)::INT AS y FROM claims c LEFT JOIN t USING (s1, src, cid)")
def _(s, d):
    c = B.claims(s, d)
    return candidates.label(c.select("s1", "src", "cid"), c.where("y = 1"))


@query("semi_filter", f"WITH {O.CLAIMS} SELECT s1, src, cid FROM claims WHERE s1 IN (SELECT s1 FROM ent WHERE country = '1-URGENT')")
def _(s, d):
    return T.semi_filter(B.claims(s, d), B.entities(s, d).where("country = '1-URGENT'")).select("s1", "src", "cid")


@query("anti_distractors", f"WITH {O.PAGES}, {_TRUTH}, p AS (SELECT id, src FROM tk WHERE src > 1) SELECT src, id AS cid FROM p WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.src = p.src AND dt.cid = p.id)")
def _(s, d):
    pool = B.page_rows(s, d).where("src > 1").select("src", F.col("id").alias("cid"))
    return candidates.distractors(pool, B.page_truth(s, d))


@query("cluster_size", f"WITH {O.PAGES}, {_TRUTH}, n AS (SELECT s1, count(*) AS size FROM dt GROUP BY s1) SELECT id AS s1, coalesce(size, 0) AS size FROM tk LEFT JOIN n ON n.s1 = tk.id WHERE src = 1")
def _(s, d):
    return candidates.cluster_size(B.page_rows(s, d).where("src = 1").select(F.col("id").alias("s1")), B.page_truth(s, d))


@query("write_id_lists", f"WITH {O.CLAIMS}, l AS (SELECT s1, string_agg('S' || src || '-' || cid, ',' ORDER BY src, cid) AS ids, count(*) AS n FROM claims WHERE p >= 0.5 GROUP BY s1) SELECT ent.s1, coalesce(ids, '') AS ids, coalesce(n, 0) AS n FROM ent LEFT JOIN l USING (s1)")
def _(s, d):
    return T.id_lists(B.entities(s, d).select("s1"), decide.decide_threshold(B.claims(s, d), 0.5))


@query("prune_adaptive", f"WITH {O.CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, cid) AS r FROM claims) SELECT s1, src, cid FROM r WHERE r <= 1 OR (p >= 0.5 AND r <= 3)")
def _(s, d):
    return candidates.prune(B.claims(s, d), 1, 3, 0.5).select("s1", "src", "cid")


@query("mined_negatives", f"WITH {O.CLAIMS}, w AS (SELECT *, min(CASE WHEN y = 1 THEN p END) OVER (PARTITION BY s1) AS w FROM claims) SELECT s1, src, cid FROM w WHERE y = 1 OR p < 0.95::DOUBLE * w")
def _(s, d):
    c = B.claims(s, d)
    return candidates.filter_mined_negatives(c.withColumn("score", F.col("p"))).select("s1", "src", "cid")


@query("cluster_collisions", f"WITH {O.CLAIMS}, o AS (SELECT src, cid, s1 FROM (SELECT *, row_number() OVER (PARTITION BY country, src, cid ORDER BY p DESC, s1) AS r FROM claims) WHERE r = 1), p AS (SELECT DISTINCT c.s1 AS a, o.s1 AS b FROM claims c JOIN o USING (src, cid) WHERE c.s1 <> o.s1), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p) SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM q) WHERE r <= 8")
def _(s, d):
    c = B.claims(s, d)
    return candidates.collisions(c, decide.resolve_claims(c))


# ---- features
def _features(s, d, only: list[str] | None = None) -> DataFrame:
    """The pair features named, all 52 if none are, of the fused candidates of all views and keys."""
    start, rec, read = len(working.made), B.page_rows(s, d), features.reads(only)
    ranked = only is None or any(f.startswith("x_") for f in only)
    if read or ranked:
        need = None if only is None else ["country", "s1", "src", "cid", *[c for c in _FUSED if c in only or (ranked and c == "rrf")]]
        cand = _fused_table(s, d, need)
    else:
        cand = _fused(s, d, CFG.max_per_source)
    return features.featurize(cand, features.record_view(B.record_tokens(rec), AFFIX, read) if read else rec, only, start)


@query("feat_all_pairs")
def _(s, d):
    return _features(s, d)


_ABBREV = "(length({a}) > 0 AND length({a}) <= 0.7::DOUBLE * length({b}) AND {a}[1] = {b}[1] AND regexp_matches({b}, '^' || regexp_replace({a}, '(.)', '\\1.*', 'g')))"
_LONE = f"len(list_filter(list_distinct({{x}}), lambda t: NOT list_contains({{y}}, t) AND NOT list_contains({{f}}, t) AND len(list_filter({{y}}, lambda o: {_ABBREV.format(a='t', b='o')} OR {_ABBREV.format(a='o', b='t')})) = 0))"


def _feature_sql(columns: str) -> str:
    """Columns of the fused pairs, with both records as a and b."""
    return f"""WITH {_FUSE}, prs AS (SELECT * FROM fr WHERE r <= {CFG.max_per_source}),
wt AS (SELECT t.country, t.token, ln(nd::DOUBLE / t.df) * CASE WHEN x.token IS NULL THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS w FROM token_df t JOIN totals USING (country) LEFT JOIN affix x ON x.country = t.country AND x.token = t.token),
awt AS (SELECT country, token, ln(nad::DOUBLE / df) AS w FROM (SELECT country, token, count(*) AS df FROM (SELECT DISTINCT country, id, unnest(atok) AS token FROM tok) GROUP BY ALL) JOIN totals USING (country)),
nw AS (SELECT id, token, w FROM (SELECT country, id, unnest(list_distinct(tok)) AS token FROM tok) JOIN wt USING (country, token)),
aw AS (SELECT id, token, w FROM (SELECT country, id, unnest(list_distinct(atok)) AS token FROM tok) JOIN awt USING (country, token)),
nt AS (SELECT id, sum(w) AS nt FROM nw GROUP BY id), adt AS (SELECT id, sum(w) AS adt FROM aw GROUP BY id),
nsh AS (SELECT p.s1, p.src, p.cid, sum(x.w) AS nsh FROM prs p JOIN nw x ON x.id = p.s1 JOIN nw y ON y.id = p.cid AND x.token = y.token GROUP BY ALL),
ash AS (SELECT p.s1, p.src, p.cid, sum(x.w) AS ash FROM prs p JOIN aw x ON x.id = p.s1 JOIN aw y ON y.id = p.cid AND x.token = y.token GROUP BY ALL),
frq AS (SELECT country, array_to_string(tok, ' ') AS k, count(*) AS n FROM tok GROUP BY ALL),
v0 AS (SELECT core.*, {O.clean('name')} AS cl, {O.clean('addr')} AS ca, array_to_string(core, ' ') AS cs, {O.numbers('addr')} AS nums, coalesce(al.a, []::VARCHAR[]) AS al,
  ln(1.0::DOUBLE + n) / ln(1.0::DOUBLE + greatest(nd, 2)) AS freq, coalesce(nt, 0.0) AS nt, coalesce(adt, 0.0) AS adt
  FROM core JOIN totals USING (country) JOIN frq ON frq.country = core.country AND frq.k = array_to_string(core.tok, ' ') LEFT JOIN al ON al.country = core.country LEFT JOIN nt ON nt.id = core.id LEFT JOIN adt ON adt.id = core.id),
v1 AS (SELECT *, CASE WHEN cs = '' THEN cl ELSE cs END AS cn, {O.skeleton('cl')} AS sk, list_filter(list_distinct(tok), lambda t: list_contains(al, t)) AS fx,
  regexp_matches({O.fold('name')}, '{X.DOMAIN}') AS dom, (len(list_filter(string_split(name || addr, ''), lambda c: ord(c) > 591)) > 0)::INT AS nat FROM v0),
v AS (SELECT *, {O.grams("replace(cn, ' ', '')")} AS ng, {O.grams('sk')} AS sg, {O.grams("replace(ca, ' ', '')")} AS ag FROM v1),
f AS (SELECT p.s1, p.src, p.cid, a.cn AS cn_a, b.cn AS cn_b, a.ng AS ng_a, b.ng AS ng_b, a.sg AS sg_a, b.sg AS sg_b, a.ag AS ag_a, b.ag AS ag_b, a.tok AS tok_a, b.tok AS tok_b, a.atok AS atok_a, b.atok AS atok_b,
  a.nums AS x, b.nums AS y, a.fx AS fx_a, b.fx AS fx_b, a.freq AS freq_a, b.freq AS freq_b, a.nt AS nt_a, b.nt AS nt_b, a.adt AS adt_a, b.adt AS adt_b, a.dom OR b.dom AS dom, a.nat + b.nat AS nat,
  coalesce(nsh, 0.0) AS nsh, coalesce(ash, 0.0) AS ash, p.* EXCLUDE (country, s1, src, cid)
  FROM prs p JOIN v a ON a.id = p.s1 JOIN v b ON b.id = p.cid LEFT JOIN nsh ON nsh.s1 = p.s1 AND nsh.src = p.src AND nsh.cid = p.cid LEFT JOIN ash ON ash.s1 = p.s1 AND ash.src = p.src AND ash.cid = p.cid),
g AS (SELECT *, list_min(list_transform(x, lambda i: list_min(list_transform(y, lambda j: abs(substr(i, 1, 9)::BIGINT - substr(j, 1, 9)::BIGINT))))) AS gap,
  len(list_filter(x, lambda i: len(list_filter(y, lambda j: length(i) > 1 AND length(j) > 1 AND (starts_with(i, j) OR starts_with(j, i) OR ends_with(i, j) OR ends_with(j, i)))) > 0)) > 0 AS cut,
  len(x) > 0 AND len(y) > 0 AS both_n, len(atok_a) > 0 AND len(atok_b) > 0 AS addrs FROM f)
SELECT s1, src, cid, {columns} FROM g"""


#: Columns of ``featurize`` and the SQL of each, by query.
_COLUMNS = {
    "feat_edit": {
        "name_jw": "CASE WHEN cn_a = '' OR cn_b = '' THEN 0.0::DOUBLE ELSE jaro_winkler_similarity(cn_a, cn_b) END",
        "name_lev": "CASE WHEN greatest(length(cn_a), length(cn_b)) > 0 THEN 1 - levenshtein(cn_a, cn_b)::DOUBLE / greatest(length(cn_a), length(cn_b)) END",
    },
    "feat_set_similarity": {
        "name_gram_jac": O.jaccard("ng_a", "ng_b"),
        "name_skel_jac": O.jaccard("sg_a", "sg_b"),
        "name_tok_jac": O.jaccard("tok_a", "tok_b").replace("THEN len(list_intersect(tok_a, tok_b))", "THEN len(list_intersect(list_distinct(tok_a), list_distinct(tok_b)))"),
        "addr_gram_jac": f"CASE WHEN addrs THEN {O.jaccard('ag_a', 'ag_b')} END",
        "name_len_ratio": "CASE WHEN greatest(length(cn_a), length(cn_b)) > 0 THEN least(length(cn_a), length(cn_b))::DOUBLE / greatest(length(cn_a), length(cn_b)) END",
        "addr_len_ratio": "CASE WHEN addrs THEN least(len(atok_a), len(atok_b))::DOUBLE / greatest(len(atok_a), len(atok_b)) END",
        "name_tok_eq": "(len(list_filter(tok_a, lambda t: NOT list_contains(tok_b, t))) + len(list_filter(tok_b, lambda t: NOT list_contains(tok_a, t))) = 0)::INT",
        "name_tok_only_1": _LONE.format(x="tok_a", y="tok_b", f="fx_a"),
        "name_tok_only_2": _LONE.format(x="tok_b", y="tok_a", f="fx_b"),
    },
    "feat_idf_containment": {
        "name_idf_contain": "CASE WHEN least(nt_a, nt_b) > 0 THEN nsh / least(nt_a, nt_b) END",
        "name_idf_unmatched_1": "CASE WHEN nt_a > 0 THEN (nt_a - nsh) / nt_a END",
        "name_idf_unmatched_2": "CASE WHEN nt_b > 0 THEN (nt_b - nsh) / nt_b END",
        "addr_contain": "CASE WHEN addrs AND least(adt_a, adt_b) > 0 THEN ash / least(adt_a, adt_b) END",
        "addr_unmatched_1": "CASE WHEN addrs AND adt_a > 0 THEN (adt_a - ash) / adt_a END",
        "addr_unmatched_2": "CASE WHEN addrs AND adt_b > 0 THEN (adt_b - ash) / adt_b END",
        "name_freq_max": "greatest(freq_a, freq_b)",
    },
    "feat_flags": {
        "affix_rel": "CASE WHEN len(fx_a) = 0 AND len(fx_b) = 0 THEN 0 WHEN len(fx_a) = 0 OR len(fx_b) = 0 THEN 1 WHEN list_sort(fx_a) = list_sort(fx_b) THEN 2 ELSE 3 END",
        "domain_flag": "dom::INT",
        "native_flag": "nat",
        "addr_missing": "(len(atok_a) = 0)::INT + (len(atok_b) = 0)::INT",
    },
    "feat_pair_numbers": {
        "num_rel": "CASE WHEN NOT both_n THEN 0 WHEN list_has_any(x, y) THEN 1 WHEN cut THEN 2 WHEN gap <= 2 THEN 3 WHEN gap <= 20 THEN 4 ELSE 5 END",
        "num_min_diff": "CASE WHEN both_n THEN ln(1.0::DOUBLE + gap) END",
        "num_shared": "len(list_intersect(x, y))",
        "num_unmatched_1": "CASE WHEN both_n THEN len(list_filter(x, lambda i: NOT list_contains(y, i)))::DOUBLE / len(x) END",
        "num_unmatched_2": "CASE WHEN both_n THEN len(list_filter(y, lambda i: NOT list_contains(x, i)))::DOUBLE / len(y) END",
    },
    "feat_retrieval": {c: c for v in candidates.VIEWS for c in (f"{v}_score", f"{v}_rank")} | {c: c for c in ("key_hit", "rrf", "nret")},
    "feat_list_shape": {
        "x_rrf_rank": "row_number() OVER (PARTITION BY s1 ORDER BY rrf DESC, src, cid) - 1",
        "x_rrf_gap": "max(rrf) OVER (PARTITION BY s1) - rrf",
        "x_n_cands": "count(*) OVER (PARTITION BY s1)",
    },
}


def _feature_query(columns: dict[str, str]):
    def run(s, d):
        return _features(s, d, list(columns)).select("s1", "src", "cid", *[(F.round(c, 6) + 0.0).alias(c) for c in columns])

    return run


for _name, _cols in _COLUMNS.items():
    query(_name, _feature_sql(", ".join(f"round(({sql})::DOUBLE, 6) + 0.0 AS {c}" for c, sql in _cols.items())))(_feature_query(_cols))


@query("feat_token_ratio")
def _(s, d):
    """The measures of words and token sets; they have no SQL form."""
    names = ("name_tsort", "name_tset", "name_me_12", "name_me_21", "name_softtfidf", "alias_best", "addr_me")
    return _features(s, d, list(names)).select("s1", "src", "cid", *[F.round(c, 6).alias(c) for c in names])


@query(
    "feat_support",
    f"""WITH {_FUSE}, prs AS (SELECT * FROM fr WHERE r <= {CFG.max_per_source}), cg AS (SELECT id, {O.grams("replace(CASE WHEN array_to_string(core, ' ') = '' THEN " + O.clean('name') + " ELSE array_to_string(core, ' ') END, ' ', '')")} AS g, {O.grams("replace(" + O.clean('addr') + ", ' ', '')")} AS h FROM core WHERE src > 1),
b AS (SELECT country, s1, src, cid FROM prs WHERE r = 1)
SELECT t.s1, t.src, t.cid, CASE WHEN y.g IS NOT NULL THEN round({O.jaccard('x.g', 'y.g')}, 6) END AS x_support_name, CASE WHEN y.g IS NOT NULL THEN round({O.jaccard('x.h', 'y.h')}, 6) END AS x_support_addr FROM prs t JOIN cg x ON x.id = t.cid LEFT JOIN b ON b.country = t.country AND b.s1 = t.s1 AND b.src = 5 - t.src LEFT JOIN cg y ON y.id = b.cid""",
)
def _(s, d):
    return _features(s, d, ["x_support_name", "x_support_addr"]).select("s1", "src", "cid", F.round("x_support_name", 6).alias("x_support_name"), F.round("x_support_addr", 6).alias("x_support_addr"))


@query(
    "feat_numbers",
    """WITH p AS (SELECT l_orderkey AS a, l_partkey AS b, count(*) AS n, [l_partkey::VARCHAR, l_suppkey::VARCHAR] AS x, [(l_orderkey % 997)::VARCHAR] AS y FROM lineitem GROUP BY ALL),
m AS (SELECT *, list_min(list_transform(x, lambda i: list_min(list_transform(y, lambda j: abs(i::BIGINT - j::BIGINT))))) AS gap,
  len(list_filter(x, lambda i: len(list_filter(y, lambda j: length(i) > 1 AND length(j) > 1 AND (starts_with(i, j) OR starts_with(j, i) OR ends_with(i, j) OR ends_with(j, i)))) > 0)) > 0 AS cut FROM p)
SELECT a, b, x[2]::BIGINT AS c, CASE WHEN list_has_any(x, y) THEN 1 WHEN cut THEN 2 WHEN gap <= 2 THEN 3 WHEN gap <= 20 THEN 4 ELSE 5 END AS num_rel, round(ln(1.0::DOUBLE + gap), 6) AS num_min_diff, len(list_intersect(x, y)) AS num_shared FROM m""",
)
def _(s, d):
    li = B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c")).agg(F.count("*").alias("n"))
    x, y = F.array(F.col("b").cast("string"), F.col("c").cast("string")), F.array((F.col("a") % 997).cast("string"))
    return li.select("a", "b", "c", metrics.number_relation(x, y).alias("num_rel"), F.round(F.ln(1.0 + metrics.min_gap(x, y)), 6).alias("num_min_diff"), F.size(F.array_intersect(x, y)).cast("long").alias("num_shared"))


# ---- decisions
@query(
    "meta_features",
    f"""WITH {O.CLAIMS}, o AS (SELECT *, least(p, 1 - 1e-12::DOUBLE) / greatest(1 - least(p, 1 - 1e-12::DOUBLE), 1e-9::DOUBLE) AS o FROM claims)
SELECT s1, src, cid, round(p, 9) AS m_prob, row_number() OVER (PARTITION BY country, s1 ORDER BY p DESC, src, cid) - 1 AS m_rank, round(max(p) OVER e - p, 9) AS m_gap_to_best, round(p / sum(p) OVER e, 9) AS m_score_share,
  count(*) FILTER (p >= 0.5) OVER e AS m_n_strong, round(o / (1 + sum(o) OVER r), 9) AS m_excl_prob, row_number() OVER (PARTITION BY country, src, cid ORDER BY p DESC, s1) - 1 AS m_excl_rank, count(*) OVER r AS m_n_competitors,
  round(coalesce(CASE WHEN src = 2 THEN max(CASE WHEN src = 3 THEN p END) OVER e ELSE max(CASE WHEN src = 2 THEN p END) OVER e END, 0.0), 9) AS m_best_other_source
FROM o WINDOW e AS (PARTITION BY country, s1), r AS (PARTITION BY country, src, cid)""",
)
def _(s, d):
    got = decide.meta_features(B.claims(s, d))
    real = ("m_prob", "m_gap_to_best", "m_score_share", "m_excl_prob", "m_best_other_source")
    return got.select("s1", "src", "cid", *[(F.round(c, 9) if c in real else F.col(c).cast("long")).alias(c) for c in features.META_FEATURES])


@query("exclusivity", f"WITH {O.CLAIMS}, o AS (SELECT *, p / greatest(1 - p, 1e-9::DOUBLE) AS o FROM claims) SELECT s1, src, cid, round(o / (1 + sum(o) OVER (PARTITION BY country, src, cid)), 9) AS p_excl FROM o")
def _(s, d):
    return decide.exclusivity(B.claims(s, d)).select("s1", "src", "cid", F.round("p_excl", 9).alias("p_excl"))


@query("temper", f"WITH {O.CLAIMS} SELECT s1, src, cid, round(1 / (1 + pow((1 - p) / p, 1 / 0.6::DOUBLE)), 9) AS p_t FROM claims")
def _(s, d):
    return B.claims(s, d).select("s1", "src", "cid", F.round(decide.temper(F.col("p"), 0.6), 9).alias("p_t"))


@query("resolve_claims", f"WITH {O.CLAIMS} SELECT country, src, cid, s1 FROM (SELECT *, row_number() OVER (PARTITION BY country, src, cid ORDER BY p DESC, s1) AS r FROM claims) WHERE r = 1")
def _(s, d):
    return decide.resolve_claims(B.claims(s, d)).select("country", "src", "cid", "s1")


@query("uncertain_band", f"WITH {O.CLAIMS} SELECT s1, src, cid FROM claims WHERE p BETWEEN 0.1 AND 0.9")
def _(s, d):
    return decide.uncertain_band(B.claims(s, d)).select("s1", "src", "cid")


@query("decide_threshold", f"WITH {O.CLAIMS} SELECT s1, src, cid FROM claims WHERE p >= 0.6")
def _(s, d):
    return decide.decide_threshold(B.claims(s, d), 0.6).select("s1", "src", "cid")


_FOLD = "list_reduce(list_prepend([1.0::DOUBLE], list_transform({q}, lambda x: [x])), lambda acc, x: list_transform(generate_series(1, len(acc) + 1), lambda i: coalesce(acc[i], 0.0) * (1 - x[1]) + CASE WHEN i > 1 THEN acc[i - 1] ELSE 0.0 END * x[1]))"
_EXPECTED = f"""{O.CLAIMS},
lst AS (SELECT country, s1, list(p ORDER BY p DESC, src, cid) AS q FROM claims GROUP BY ALL),
kk AS (SELECT *, unnest(generate_series(0, len(q))) AS k FROM lst),
ab AS (SELECT country, s1, q, k, {_FOLD.format(q='q[1:k]')} AS a, {_FOLD.format(q='q[k + 1:len(q)]')} AS b FROM kk),
ev AS (SELECT country, s1, k, round(CASE WHEN k = 0 THEN list_product(list_transform(q, lambda x: 1 - x)) ELSE 1.25::DOUBLE * list_sum(list_transform(generate_series(1, len(a)), lambda i: list_sum(list_transform(generate_series(1, len(b)), lambda j: (i - 1) * a[i] * b[j] / (0.25::DOUBLE * (i + j - 2) + k))))) END + 1e-12::DOUBLE, 9) AS value FROM ab)"""


@query("expected_f_curve", f"WITH {_EXPECTED} SELECT country, s1, k, value FROM ev")
def _(s, d):
    return decide.expected_f(B.claims(s, d)).select("country", "s1", F.col("k").cast("long").alias("k"), "value")


@query("decide_expected_f", f"WITH {_EXPECTED} SELECT country, s1, k FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY value DESC, k) AS r FROM ev) WHERE r = 1")
def _(s, d):
    return decide.decide_expected(B.claims(s, d)).select("country", "s1", F.col("k").cast("long").alias("k"))


@query("decide_kernel", f"WITH {_EXPECTED} SELECT country, s1, k FROM (SELECT *, row_number() OVER (PARTITION BY country, s1 ORDER BY value DESC, k) AS r FROM ev) WHERE r = 1")
def _(s, d):
    return decide.decide_expected(B.claims(s, d), arrays=False).select("country", "s1", F.col("k").cast("long").alias("k"))


_GRID = ", ".join(f"({t}::DOUBLE)" for t in decide.THRESHOLDS)


@query(
    "search_rule_grid",
    f"""WITH {O.CLAIMS}, g(t) AS (VALUES {_GRID}),
pt AS (SELECT g.t, country, s1, count(*) AS n_pred, sum(y)::BIGINT AS tp FROM claims JOIN g ON p >= g.t GROUP BY ALL),
w AS (SELECT g.t, ent.country, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(n_true, 0) AS n_true FROM ent CROSS JOIN g LEFT JOIN pt ON pt.t = g.t AND pt.s1 = ent.s1 AND pt.country = ent.country LEFT JOIN truth ON truth.s1 = ent.s1 AND truth.country = ent.country)
SELECT country, t, round(avg({O.f05('tp', 'n_pred', 'n_true')}), 6) AS macro_f FROM w GROUP BY ALL""",
)
def _(s, d):
    c = B.claims(s, d)
    return decide.search_thresholds(c, B.entities(s, d), metrics.truth_sizes(c)).withColumn("macro_f", F.round("macro_f", 6))


@query("search_decision")
def _(s, d):
    c = B.claims(s, d)
    return decide.search_decision(c, B.entities(s, d), metrics.truth_sizes(c))


# ---- metrics
def _counts(s, d) -> DataFrame:
    c = B.claims(s, d)
    return metrics.entity_counts(B.entities(s, d), decide.decide_threshold(c, 0.5), metrics.truth_sizes(c))


@query("entity_f05", f"WITH {O.COUNTS} SELECT s1, n_pred, tp, n_true, round(f05, 9) AS f05 FROM counts")
def _(s, d):
    return _counts(s, d).select("s1", "n_pred", "tp", "n_true", F.round("f05", 9).alias("f05"))


_REPORT = "count(*) AS n, round(avg(f05), 6) AS macro_f05, round(sum(tp)::DOUBLE / nullif(sum(n_pred), 0), 6) AS micro_precision, round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6) AS micro_recall, count(*) FILTER (n_true = 0) AS singletons, round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE END), 6) AS singleton_accuracy, round(avg(n_pred), 6) AS avg_pred"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("macro_f05", f"WITH {O.COUNTS} SELECT country, {_REPORT} FROM counts GROUP BY country")
def _(s, d):
    return _rounded(metrics.matching_report(_counts(s, d), "country"))


@query("micro_pr", f"WITH {O.COUNTS} SELECT {_REPORT} FROM counts")
def _(s, d):
    return _rounded(metrics.matching_report(_counts(s, d)))


@query("segment_by_size", f"WITH {O.COUNTS} SELECT country, CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true <= 3 THEN '2-3' WHEN n_true <= 5 THEN '4-5' ELSE '6+' END AS bucket, {_REPORT} FROM counts GROUP BY ALL")
def _(s, d):
    return _rounded(metrics.segment_report(_counts(s, d)))


@query(
    "blocking_ceiling",
    f"""WITH {O.PAGES},\n{_top_sql('nm')},\n{_TRUTH}, pt AS (SELECT dt.s1, count(*) AS n_true, count(top.cid) AS tp FROM dt LEFT JOIN top USING (s1, src, cid) GROUP BY dt.s1),
pc AS (SELECT s1, count(*) AS n_cand FROM top GROUP BY s1), w AS (SELECT rec.id, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(n_cand, 0) AS n_cand FROM rec LEFT JOIN pt ON pt.s1 = rec.id LEFT JOIN pc ON pc.s1 = rec.id WHERE src = 1)
SELECT round(sum(tp)::DOUBLE / nullif(sum(n_true), 0), 6) AS pair_recall, round(avg(CASE WHEN n_true > 0 THEN (tp = n_true)::INT::DOUBLE END), 6) AS full_cluster_recall, round(avg(n_cand), 6) AS avg_candidates, round(avg({O.f05('tp', 'tp', 'n_true')}), 6) AS f05_ceiling, round(1 - sum(n_cand)::DOUBLE / (count(*) * (SELECT count(*) FROM rec WHERE src > 1)), 6) AS reduction_ratio FROM w""",
)
def _(s, d):
    rec = B.page_rows(s, d)
    ent = rec.where("src = 1").select(F.col("id").alias("s1"))
    return _rounded(metrics.blocking_report(ent, _retrieve(s, d, "nm"), B.page_truth(s, d), rec.where("src > 1").count()))


@query("recall_at_k", f"WITH {O.PAGES},\n{_top_sql('nm')},\n{_TRUTH}, j AS (SELECT dt.s1, dt.cid, rank FROM dt LEFT JOIN top USING (s1, src, cid)), k(k) AS (VALUES (1), (5), (10)) SELECT k.k, (SELECT count(*) FROM j WHERE rank < k.k) AS hits, (SELECT count(*) FROM j) AS total, round((SELECT count(*) FROM j WHERE rank < k.k)::DOUBLE / nullif((SELECT count(*) FROM j), 0), 6) AS recall FROM k")
def _(s, d):
    return _rounded(metrics.recall_at_k(_retrieve(s, d, "nm"), B.page_truth(s, d), (1, 5, 10)))


@query("leak_recall", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def _(s, d):
    return B.leak_pairs(s, d)


@query("ece", f"WITH {O.LABELLED}, b AS (SELECT least(floor(p * 20), 19)::INT AS bin, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM scored GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM b")
def _(s, d):
    return _rounded(metrics.expected_calibration_error(B.labelled_scores(s, d)))


@query("reliability", f"WITH {O.LABELLED} SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 4) AS mean_p, round(avg(y), 4) AS share_positive FROM scored GROUP BY 1")
def _(s, d):
    return metrics.reliability(B.labelled_scores(s, d))


@query("isotonic_calibrate")
def _(s, d):
    rows = B.labelled_scores(s, d)
    return model.calibrate(rows, model.fit_isotonic(rows)).select("country", "id", "p", "y")


_REL = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 WHEN list_has_any(x, y) THEN 1 WHEN len(list_filter(x, lambda i: len(list_filter(y, lambda j: length(i) > 1 AND length(j) > 1 AND (starts_with(i, j) OR starts_with(j, i) OR ends_with(i, j) OR ends_with(j, i)))) > 0)) > 0 THEN 2 WHEN list_min(list_transform(x, lambda i: list_min(list_transform(y, lambda j: abs(substr(i, 1, 9)::BIGINT - substr(j, 1, 9)::BIGINT))))) <= 2 THEN 3 WHEN list_min(list_transform(x, lambda i: list_min(list_transform(y, lambda j: abs(substr(i, 1, 9)::BIGINT - substr(j, 1, 9)::BIGINT))))) <= 20 THEN 4 ELSE 5 END"
_PATTERN_SQL = f"""{O.on_pages(O.TOKENS)},
{_top_sql('nm')},
{_TRUTH}, pr AS (SELECT top.country, s1, top.src, cid, score AS p, (dt.s1 IS NOT NULL)::INT AS y0 FROM top LEFT JOIN dt USING (s1, src, cid)),
pj AS (SELECT pr.*, a.name AS qn, b.name AS cn, a.addr AS qa, b.addr AS ca, list_distinct(a.tok) AS ta, list_distinct(b.tok) AS tb FROM pr JOIN tok a ON a.id = s1 JOIN tok b ON b.id = cid),
pn AS (SELECT *, {O.numbers('qa')} AS x, {O.numbers('ca')} AS y, len(list_intersect(ta, tb)) AS sh FROM pj),
pp AS (SELECT country, s1, src, cid, p, y0, CASE WHEN trim(qa) = '' OR trim(ca) = '' THEN '{metrics.ADDRESS_PATTERN}' WHEN rel <> 1 THEN [{', '.join(repr(x or '') for x in metrics.NUMBER_PATTERNS)}][rel + 1]
  WHEN regexp_matches({O.fold('cn')}, '{X.DOMAIN}') OR regexp_matches({O.fold('qn')}, '{X.DOMAIN}') THEN '{metrics.DOMAIN_PATTERN}'
  WHEN len(ta) + len(tb) = 2 * sh THEN '{metrics.WORD_PATTERNS[0]}' WHEN sh = 0 THEN '{metrics.WORD_PATTERNS[1]}' WHEN len(ta) + len(tb) - 2 * sh <= 2 THEN '{metrics.WORD_PATTERNS[2]}' ELSE '{metrics.WORD_PATTERNS[3]}' END AS pattern
  FROM (SELECT *, {_REL} AS rel FROM pn))"""


def _errors(s, d) -> DataFrame:
    """Neighbours by name with their truth; those of a cosine of 0.5 or more count as taken."""
    rec = B.page_rows(s, d)
    a = rec.select(F.col("id").alias("s1"), F.col("name").alias("name_a"), F.col("addr").alias("addr_a"))
    b = rec.select(F.col("id").alias("cid"), F.col("name").alias("name_b"), F.col("addr").alias("addr_b"))
    top = _retrieve(s, d, "nm").join(a, "s1").join(b, "cid").withColumn("p", F.col("score"))
    return candidates.label(top, B.page_truth(s, d))


@query("error_patterns", f"WITH {_PATTERN_SQL}, cnt AS (SELECT CASE WHEN y0 = 1 THEN 'false negative' ELSE 'false positive' END AS kind, pattern, count(*) AS n FROM pp WHERE (p >= 0.5) <> (y0 = 1) GROUP BY ALL) SELECT kind, pattern, n, share FROM (SELECT *, round(n / sum(n) OVER (PARTITION BY kind), 6) AS share, row_number() OVER (PARTITION BY kind ORDER BY n DESC, pattern) AS r FROM cnt) WHERE r <= 8")
def _(s, d):
    hit = _errors(s, d).where((F.col("p") >= 0.5) != (F.col("y") == 1))
    kind = F.when(F.col("y") == 1, "false negative").otherwise("false positive")
    rows = hit.select(kind.alias("kind"), metrics.error_pattern(F.col("name_a"), F.col("addr_a"), F.col("name_b"), F.col("addr_b")).alias("pattern"))
    return metrics.top_patterns(rows)


@query("error_examples", f"WITH {O.PAGES}, {_top_sql('nm')}, {_TRUTH}, e AS (SELECT top.country, s1, top.src, cid, score AS p, CASE WHEN score >= 0.5 AND dt.s1 IS NULL THEN 'false positive' WHEN score < 0.5 AND dt.s1 IS NOT NULL THEN 'false negative' END AS kind FROM top LEFT JOIN dt USING (s1, src, cid)) SELECT * FROM (SELECT kind, row_number() OVER (PARTITION BY country, kind ORDER BY CASE WHEN kind = 'false positive' THEN -p ELSE p END, s1, src, cid) AS rank, country, s1, src, cid, p FROM e WHERE kind IS NOT NULL) WHERE rank <= 5")
def _(s, d):
    return metrics.error_examples(_errors(s, d), F.col("p") >= 0.5).withColumn("rank", F.col("rank").cast("long"))


@query("blocking_by_country", f"WITH {O.PAGES}, {_top_sql('nm')}, e AS (SELECT country, count(*) FILTER (src = 1) AS entities, count(*) FILTER (src > 1) AS pool FROM rec GROUP BY country), cnt AS (SELECT country, count(*) AS raw, count(*) FILTER (rank < 5) AS pruned FROM top GROUP BY country) SELECT country, stage, entities, pairs, round(pairs::DOUBLE / entities, 6) AS average, round(1 - pairs::DOUBLE / nullif(entities * pool, 0), 6) AS reduction FROM (SELECT country, entities, pool, unnest(['raw', 'pruned']) AS stage, unnest([coalesce(raw, 0), coalesce(pruned, 0)]) AS pairs FROM e LEFT JOIN cnt USING (country) WHERE entities > 0)")
def _(s, d):
    """Candidates per country, as retrieved and after a cut at five a source."""
    rec, top = B.page_rows(s, d), working.cut(_retrieve(s, d, "nm"), "top")
    own, pool = rec.where("src = 1"), rec.where("src > 1")
    parts = [metrics.blocking_stats(own, c, pool).withColumn("stage", F.lit(name)) for name, c in (("raw", top), ("pruned", top.where("rank < 5")))]
    return _rounded(parts[0].unionByName(parts[1]))


# ---- splits
_FAMILY = f"""{O.on_pages(O.core(*AFFIX))}, f0 AS (SELECT id, country, array_to_string(core, ' ') AS cs, name FROM core),
f1 AS (SELECT id, country, array_to_string(list_sort(list_filter(string_split({O.skeleton('cs')}, ' '), lambda w: w <> '')), ' ') AS a, {O.skeleton('name')} AS b FROM f0),
f2 AS (SELECT id, country, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE '<empty>' END AS family FROM f1),
fam AS (SELECT id, country, family, ({O.crc32('family')} % 5)::INT AS fold, {O.crc32('family')} % 1000 AS sub FROM f2)"""


@query("family_folds", f"WITH {_FAMILY} SELECT country, id, family, fold FROM fam")
def _(s, d):
    return splits.families(_page_core(s, d))


@query("fold_split_roles", f"WITH {_FAMILY} SELECT country, id, CASE fold WHEN 0 THEN 'val' WHEN 1 THEN 'm1' WHEN 2 THEN 'm1' WHEN 3 THEN 'pre' ELSE CASE WHEN sub < 500 THEN 'm2' ELSE 'cal' END END AS role FROM fam")
def _(s, d):
    return splits.roles(splits.families(_page_core(s, d)))


@query("sample_by_family", f"WITH {_FAMILY}, z AS (SELECT country, family, count(*) AS m FROM fam GROUP BY ALL), c AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY country ORDER BY md5('1:' || family), family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) SELECT fam.country, id, fam.family, fold FROM fam JOIN c ON c.country = fam.country AND c.family = fam.family WHERE before < 20")
def _(s, d):
    return splits.sample_by_family(splits.families(_page_core(s, d)), 20)


@query("sample_ids", f"WITH {O.DOCS} SELECT country, id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5('1:' || id), id) AS r FROM rec) WHERE r <= 10")
def _(s, d):
    return splits.sample_ids(B.doc_records(s, d).select("country", "id"), 10)


def _nations(s, d, side: str) -> DataFrame:
    key = {"customer": "c_nationkey", "supplier": "s_nationkey"}[side]
    return B.table(s, d, side).select(F.col(key).cast("string").alias("country"))


_MIX = "kn AS (SELECT DISTINCT n_nationkey::VARCHAR AS country FROM nation WHERE n_nationkey < 20), mx AS (SELECT CASE WHEN kn.country IS NULL THEN 'LOCO' ELSE c.country END AS country, count(*) AS n FROM (SELECT c_nationkey::VARCHAR AS country FROM customer) c LEFT JOIN kn USING (country) GROUP BY ALL), wts AS (SELECT country, n::DOUBLE / sum(n) OVER () AS weight FROM mx)"


def _mix(s, d) -> DataFrame:
    known = B.table(s, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("country"))
    return splits.test_mix_weights(_nations(s, d, "customer"), known)


@query("loco_pairs", "SELECT a.r_name AS train, b.r_name AS score FROM region a JOIN region b ON a.r_name <> b.r_name")
def _(s, d):
    return splits.loco_pairs(B.table(s, d, "region").select(F.col("r_name").alias("country")))


@query("test_mix_weights", f"WITH {_MIX} SELECT country, round(weight, 9) AS weight FROM wts")
def _(s, d):
    return _mix(s, d).withColumn("weight", F.round("weight", 9))


@query("reweighted_score", f"WITH {_MIX}, sc AS (SELECT s_nationkey::VARCHAR AS country, avg(s_acctbal) AS score FROM supplier GROUP BY ALL) SELECT round(coalesce(sum(score * weight) / nullif(sum(CASE WHEN weight IS NOT NULL THEN weight END), 0), avg(score)), 4) AS score FROM sc LEFT JOIN wts USING (country)")
def _(s, d):
    sc = B.table(s, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("country")).agg(F.avg("s_acctbal").alias("score"))
    return splits.reweighted_score(sc, _mix(s, d)).select(F.round("score", 4).alias("score"))


# ---- the stack
@query("rank_model_score")
def _(s, d):
    """Fit the stack on the claims and score them: probability, meta features, calibration."""
    c = B.claims(s, d)
    feats = working.cut(features.list_features(c.withColumn("rrf", F.col("p")).drop("p")), "claims")
    role = F.element_at(F.array(*[F.lit(r) for r in ("m1", "m1", "m2", "cal", "val")]), (F.pmod(F.col("s1"), F.lit(5)) + 1).cast("int"))
    roles = B.entities(s, d).select("country", "s1", role.alias("role"))
    write = lambda df: working.cut(df, "stack")
    stack = model.fit_stack(feats, roles, ["rrf", "x_rrf_rank", "x_rrf_gap", "x_n_cands"], write=write)
    return stack.score(feats, write).select("country", "s1", "src", "cid", "p")


@query("end_to_end_lists")
def _(s, d):
    """Retrieve, fuse, score by the fused rank, prune, decide, and list per query record."""
    cand = _fused_table(s, d)
    p = F.least(F.col("rrf") * 15 + 0.5 * F.col("nm_score"), F.lit(0.99))
    pruned = candidates.prune(cand.withColumn("p", p), CFG.prune_min, CFG.prune_max, CFG.prune_eps)
    scored = decide.exclusivity(pruned).drop("p").withColumnRenamed("p_excl", "p")
    chosen = decide.apply_decision(scored, decide.decide_expected(scored, arrays=False))
    ent = B.page_rows(s, d).where("src = 1").select(F.col("id").alias("s1"))
    return T.id_lists(ent, chosen)


