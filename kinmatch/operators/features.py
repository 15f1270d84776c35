"""Pair features: record views once a record, then one narrow select over joined pairs.

Undefined features are null. Columns that built-in functions can express stay in generated code;
the fuzzy word measures run in Arrow batches, over texts that a record's lists are packed into once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import batches as K
from kinmatch.functions import text as X
from kinmatch.operators import corpus, metrics
from kinmatch.sources import working

LOCALITY_WEIGHT = 6.0

# Names and order of the features and the signs of their constraints.
#: The 52 pair features.
PAIR_FEATURES: dict[str, int] = {
    "name_jw": 1, "name_lev": 1, "name_tsort": 1, "name_tset": 1, "name_gram_jac": 1, "name_skel_jac": 1,
    "name_me_12": 1, "name_me_21": 1, "name_softtfidf": 1, "name_idf_contain": 1, "name_idf_unmatched_1": -1,
    "name_idf_unmatched_2": -1, "name_freq_max": 0, "alias_best": 1, "name_len_ratio": 0, "affix_rel": 0,
    "name_tok_jac": 1, "name_tok_only_1": -1, "name_tok_only_2": -1, "name_tok_eq": 1, "domain_flag": 0,
    "native_flag": 0, "addr_missing": 0, "addr_contain": 1, "addr_unmatched_1": -1, "addr_unmatched_2": -1,
    "addr_gram_jac": 1, "addr_me": 1, "addr_len_ratio": 0, "locality_conflict": -1, "num_rel": 0,
    "num_min_diff": -1, "num_shared": 1, "num_unmatched_1": 0, "num_unmatched_2": 0,
    "na_score": 1, "na_rank": -1, "nm_score": 1, "nm_rank": -1, "ad_score": 1, "ad_rank": -1, "sk_score": 1,
    "sk_rank": -1, "key_hit": 0, "rrf": 1, "nret": 1, "pre": 1,
    "x_support_name": 1, "x_support_addr": 1, "x_rrf_rank": 0, "x_rrf_gap": -1, "x_n_cands": 0,
}
#: The nine features of a pair's standing.
META_FEATURES: dict[str, int] = {
    "m_prob": 1, "m_rank": 0, "m_gap_to_best": -1, "m_score_share": 0, "m_n_strong": 0, "m_excl_prob": 1,
    "m_excl_rank": 0, "m_n_competitors": 0, "m_best_other_source": 1,
}


def monotone_vector(names: list[str]) -> list[int]:
    known = PAIR_FEATURES | META_FEATURES
    return [known[n] for n in names]


#: What the features read of a record's view, by feature; the others read the candidates alone.
_READS: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(("name_jw", "name_lev", "name_tsort", "name_tset", "name_len_ratio"), ("core_name",)),
    **dict.fromkeys(("name_me_12", "name_me_21", "name_softtfidf"), ("core", "tok_w")),
    **dict.fromkeys(("name_idf_contain", "name_idf_unmatched_1", "name_idf_unmatched_2"), ("tok_w",)),
    **dict.fromkeys(("name_tok_only_1", "name_tok_only_2"), ("tok", "affix")),
    **dict.fromkeys(("name_tok_jac", "name_tok_eq"), ("tok",)),
    **dict.fromkeys(("addr_contain", "addr_unmatched_1", "addr_unmatched_2", "addr_me", "locality_conflict"), ("atok", "atok_w")),
    **dict.fromkeys(("addr_missing", "addr_len_ratio"), ("atok",)),
    **dict.fromkeys(("num_rel", "num_min_diff", "num_shared", "num_unmatched_1", "num_unmatched_2"), ("nums",)),
    "name_gram_jac": ("name_grams",), "name_skel_jac": ("skel_grams",), "addr_gram_jac": ("addr_grams", "atok"), "name_freq_max": ("freq",),
    "alias_best": ("aliases",), "affix_rel": ("affix",), "domain_flag": ("domain",), "native_flag": ("native",),
    "x_support_name": ("name_grams",), "x_support_addr": ("addr_grams",),
}
_LISTED = ("x_rrf_rank", "x_rrf_gap", "x_n_cands")
_SUPPORT = ("x_support_name", "x_support_addr")

#: Queries of a block, and pool records of one: a task holds the views of both, pairs pass by.
QUERY_BLOCK, POOL_BLOCK = (1 << 10, 1 << 14), 1 << 14


def reads(only: Iterable[str] | None = None) -> list[str]:
    """The columns of ``record_view`` that the features named read; of all 52 if none are."""
    return sorted({c for f in (PAIR_FEATURES if only is None else only) for c in _READS.get(f, ())})


def _weights(rec: DataFrame, col: str, weights: DataFrame, fallback: DataFrame, affix: DataFrame | None) -> DataFrame:
    """(country, src, id, w): a map from each distinct word of a record to its weight."""
    rows = rec.select("country", "src", "id", F.explode(F.array_distinct(col)).alias("token"))
    w = corpus.weighted(rows, weights, fallback, affix)
    return w.groupBy("country", "src", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "weight")))).alias(f"{col}_w"))


def record_view(rec: DataFrame, shares: tuple[float, ...] = corpus.SHARES, columns: list[str] | None = None) -> DataFrame:
    """All derived columns of a record, or those named, written once, to be joined per pair.

    Needs ``tok`` and ``atok``; statistics are those of the records given. ``shares`` are the
    limits of affixes and of affix pairs.
    """
    wanted = lambda c: columns is None or c in columns
    start = len(working.made)
    rec = working.cut(rec, "records")
    affix, bigram = working.cut(corpus.affixes(rec, *shares[:2]), "affixes"), corpus.affix_bigrams(rec, *shares[2:])
    top = corpus.max_idf(rec)
    out = corpus.with_core(rec, affix, bigram)
    none = F.array().cast("array<string>")
    empty = F.map_from_arrays(none, F.array().cast("array<double>"))
    keys = ["country", "src", "id"]
    if wanted("freq"):
        out = corpus.name_freq_pct(out)
    if wanted("tok_w"):
        out = out.join(_weights(rec, "tok", corpus.idf(rec), top.select("country", "max_idf"), affix), keys, "left")
    if wanted("atok_w"):
        out = out.join(_weights(rec, "atok", corpus.idf(rec, "atok"), top.select("country", "addr_max_idf"), None), keys, "left")
    out = out.join(affix.groupBy("country").agg(F.array_sort(F.collect_set("token")).alias("_affix")), "country", "left")
    clean = X.clean_text(F.col("name"))
    core = F.array_join("core", " ")
    core = F.when(core == "", clean).otherwise(core)
    derived = {
        "core_name": core,
        "tok_w": F.coalesce("tok_w", empty),
        "atok_w": F.coalesce("atok_w", empty),
        "name_grams": X.char_ngrams(F.replace(core, F.lit(" "), F.lit(""))),
        "skel_grams": X.char_ngrams(X.skeleton(clean)),
        "addr_grams": X.char_ngrams(F.replace(X.clean_text(F.col("addr")), F.lit(" "), F.lit(""))),
        "affix": F.array_intersect("tok", F.coalesce("_affix", none)),
        "aliases": X.name_aliases(F.col("name")),
        "nums": X.house_numbers(F.col("addr")),
        "domain": X.is_domain_name(F.col("name")),
        "native": F.col("native") if "native" in rec.columns else (X.has_native_script(F.col("name")) | X.has_native_script(F.col("addr"))),
    }
    plain = [c for c in ("name", "addr", "tok", "atok", "core", "freq") if wanted(c)]
    view = out.select(*keys, *plain, *[c.alias(n) for n, c in derived.items() if wanted(n)])
    return working.cut_last(view, "record-view", start)


def join_views(cand: DataFrame, view: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Candidates with the views of both sides as structs ``a`` and ``b``; misses stay null.

    ``other``: (country, s1, src, o), joined too. All sides are dealt by blocks of a country's
    queries and of its pool, which hold whatever a pair meets: a record moves once for each block of
    the other side, a pair once and before it has either view. For that the plan must run
    ``working.by_block``; it gives the same rows without.
    """
    spark = view.sparkSession
    n = working.cut(view.groupBy("country").agg(F.count_if(F.col("src") == 1).alias("_q"), F.count_if(F.col("src") > 1).alias("_p")), "sizes")
    asked = n.agg(F.sum("_q")).first()[0] or 0
    size = min(QUERY_BLOCK[1], max(QUERY_BLOCK[0], asked // (2 * spark.sparkContext.defaultParallelism)))
    parts = lambda c, of: F.greatest(F.lit(1), F.ceil(F.col(c) / of)).cast("int").alias(c)
    n = n.select("country", parts("_q", size), parts("_p", POOL_BLOCK))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 2 * (n.agg(F.sum(F.col("_q") * F.col("_p"))).first()[0] or 0))

    def dealt(rows: DataFrame, query: str | None, pool: str | None) -> DataFrame:
        at = rows.join(F.broadcast(n), "country", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("_q", "_p")})
        for c, key in (("_q", query), ("_p", pool)):
            at = at.withColumn(c, F.pmod(F.xxhash64(F.col(key).cast("string")), F.col(c)).cast("int") if key else F.explode(F.sequence(F.lit(0), F.col(c) - 1)))
        return at.withColumn("_block", F.xxhash64("country", "_q", "_p")).drop("_q", "_p").repartition(spread, "_block")

    cols = ["id", *[c for c in view.columns if c not in ("country", "src", "id")]]
    a = view.where("src = 1").select("country", F.col("id").alias("s1"), F.struct(*cols).alias("a"))
    b = view.where("src > 1").select("country", "src", F.col("id").alias("cid"), F.struct(*cols).alias("b"))
    rows = dealt(cand, "s1", "cid").join(dealt(a, "s1", None).hint("shuffle_hash"), ["_block", "country", "s1"], "left")
    rows = rows.join(dealt(b, None, "cid").hint("shuffle_hash"), ["_block", "country", "src", "cid"], "left")
    if other is not None:
        rows = rows.join(dealt(other, "s1", None).hint("shuffle_hash"), ["_block", "country", "s1", "src"], "left")
    return rows.drop("_block")


def containment(w: Column) -> tuple[Column, Column, Column]:
    """(shared weight over the lighter side, unshared share of either side) of ``shared_weights``."""
    wa, wb, low = w["wa"], w["wb"], F.least(w["wa"], w["wb"])
    return F.when(low > 0, w["sa"] / low), F.when(wa > 0, (wa - w["sa"]) / wa), F.when(wb > 0, (wb - w["sb"]) / wb)


def _ratio(x: Column, y: Column) -> Column:
    return F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y))


def _named(pairs: DataFrame, features: dict[str, Column], only: Iterable[str] | None) -> DataFrame:
    return pairs.withColumns({f: c for f, c in features.items() if only is None or f in only})


def builtin_features(pairs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """The pair features of lists and weights, or those named, over ``join_views``. What compares words with
    words comes from Arrow batches, the rest is built-in functions."""
    only = PAIR_FEATURES if only is None else only
    pa, pb = _side(pairs, "a"), _side(pairs, "b")
    batches = {
        "name_w": lambda x, y: K.shared_weights(x, y, LOCALITY_WEIGHT),
        "addr_w": lambda x, y: K.shared_weights(x, y, LOCALITY_WEIGHT),
        "tok_packed": K.lone_words,
    }
    made = sorted({_PACKED[f] for f in only if _PACKED.get(f) in batches})
    pairs = pairs.withColumns({f"_{c}": batches[c](pa(c), pb(c)) for c in made})
    name_w, addr_w, lone = (F.col(f"_{c}") for c in batches)
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    c1, c2 = a("core_name"), b("core_name")
    longest = F.greatest(F.length(c1), F.length(c2))
    nc, nu1, nu2 = containment(name_w)
    ac, au1, au2 = containment(addr_w)
    most = F.greatest(addr_w["wa"], addr_w["wb"])
    missing = (F.size(a("atok")) == 0).cast("int") + (F.size(b("atok")) == 0).cast("int")
    both = missing == 0
    n1, n2 = a("nums"), b("nums")
    fa, fb = a("affix"), b("affix")
    same = (F.size(F.array_except(fa, fb)) == 0) & (F.size(F.array_except(fb, fa)) == 0)
    affix_rel = F.when((F.size(fa) == 0) & (F.size(fb) == 0), 0).when((F.size(fa) == 0) | (F.size(fb) == 0), 1).when(same, 2).otherwise(3)
    t1, t2 = a("tok"), b("tok")
    some = (F.size(n1) > 0) & (F.size(n2) > 0)
    return _named(
        pairs,
        {
            "name_lev": F.when(longest > 0, 1 - F.levenshtein(c1, c2) / longest),
            "name_gram_jac": X.jaccard_of_sets(a("name_grams"), b("name_grams")),
            "name_skel_jac": X.jaccard_of_sets(a("skel_grams"), b("skel_grams")),
            "name_idf_contain": nc, "name_idf_unmatched_1": nu1, "name_idf_unmatched_2": nu2,
            "name_freq_max": F.greatest(a("freq"), b("freq")),
            "name_len_ratio": _ratio(F.length(c1), F.length(c2)),
            "affix_rel": affix_rel,
            "name_tok_jac": X.jaccard(t1, t2),
            "name_tok_only_1": lone["only_1"],
            "name_tok_only_2": lone["only_2"],
            "name_tok_eq": ((F.size(F.array_except(t1, t2)) == 0) & (F.size(F.array_except(t2, t1)) == 0)).cast("int"),
            "domain_flag": (a("domain") | b("domain")).cast("int"),
            "native_flag": a("native").cast("int") + b("native").cast("int"),
            "addr_missing": missing,
            "addr_contain": F.when(both, ac), "addr_unmatched_1": F.when(both, au1), "addr_unmatched_2": F.when(both, au2),
            "addr_gram_jac": F.when(both, X.jaccard_of_sets(a("addr_grams"), b("addr_grams"))),
            "addr_len_ratio": F.when(both, _ratio(F.size(a("atok")), F.size(b("atok")))),
            "locality_conflict": F.when(both & (most > 0), (addr_w["la"] + addr_w["lb"]) / most),
            "num_rel": metrics.number_relation(n1, n2),
            "num_min_diff": F.when(some, F.ln(1.0 + metrics.min_gap(n1, n2))),
            "num_shared": F.size(F.array_intersect(n1, n2)),
            "num_unmatched_1": F.when(some, F.size(F.array_except(n1, n2)) / F.size(n1)),
            "num_unmatched_2": F.when(some, F.size(F.array_except(n2, n1)) / F.size(n2)),
        },
        only,
    ).drop(*[f"_{c}" for c in made])


#: Packed columns of a record's view that features from Arrow batches read, by feature.
_PACKED: dict[str, str] = {
    **dict.fromkeys(("name_jw", "name_tsort", "name_tset"), "core_name"),
    **dict.fromkeys(("name_me_12", "name_me_21", "name_softtfidf"), "core_packed"),
    "alias_best": "alias_packed", "addr_me": "atok_packed",
    **dict.fromkeys(("name_idf_contain", "name_idf_unmatched_1", "name_idf_unmatched_2"), "name_w"),
    **dict.fromkeys(("addr_contain", "addr_unmatched_1", "addr_unmatched_2", "locality_conflict"), "addr_w"),
    **dict.fromkeys(("name_tok_only_1", "name_tok_only_2"), "tok_packed"),
}
#: Those of them that read a list of the view besides.
_BOTH = {f: ("atok",) for f in ("addr_contain", "addr_unmatched_1", "addr_unmatched_2", "locality_conflict")}


def for_pairs(view: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Record views with what the features named read of them: lists that only Arrow batches read are packed."""
    only = list(PAIR_FEATURES if only is None else only)
    plain = sorted({c for f in only for c in (_BOTH.get(f, ()) if f in _PACKED else _READS.get(f, ()))})
    extra = sorted({_PACKED[f] for f in only if f in _PACKED} - set(plain))
    return view.select("country", "src", "id", *plain, *[_packed(c, F.col).alias(c) for c in extra])


def _packed(c: str, of: Callable[[str], Column]) -> Column:
    if c == "core_packed":
        return K.packed(of("core"), of("tok_w"))
    if c == "atok_packed":
        return K.packed(of("atok"), of("atok_w"), numbers=False)
    if c in ("name_w", "addr_w"):
        return K.packed_map(of("tok_w" if c == "name_w" else "atok_w"))
    if c == "tok_packed":
        return K.packed_flags(of("tok"), of("affix"))
    return K.packed_list(of("aliases")) if c == "alias_packed" else of(c)


def _side(pairs: DataFrame, side: str) -> Callable[[str], Column]:
    """Columns of one side's view; what ``for_pairs`` has not packed is packed once a pair."""
    there = pairs.schema[side].dataType.names
    return lambda c: F.col(f"{side}.{c}") if c in there else _packed(c, lambda x: F.col(f"{side}.{x}"))


def fuzzy_features(pairs: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """The pair features that need string kernels, or those named, in Arrow batches."""
    a, b = _side(pairs, "a"), _side(pairs, "b")
    only = PAIR_FEATURES if only is None else only
    got: dict[str, Column] = {}
    for f, fn in (("name_jw", K.jaro_winkler), ("name_tsort", K.token_sort), ("name_tset", K.token_set), ("alias_best", K.alias_best), ("addr_me", K.monge_elkan)):
        if f in only:
            got[f] = fn(a(_PACKED[f]), b(_PACKED[f]))
    named = {"name_me_12": "me_12", "name_me_21": "me_21", "name_softtfidf": "softtfidf"}
    if any(f in only for f in named):
        # one column, so that the three are computed at once
        pairs = pairs.withColumn("_core", K.word_measures(a("core_packed"), b("core_packed")))
        got |= {f: F.col(f"_core.{c}") for f, c in named.items()}
    return _named(pairs, got, only).drop("_core")


def list_features(cand: DataFrame) -> DataFrame:
    """Rank, gap and length of a query's candidate list."""
    w = Window.partitionBy("country", "s1")
    return cand.withColumns(
        {
            "x_rrf_rank": F.row_number().over(w.orderBy(F.col("rrf").desc(), "src", "cid")) - 1,
            "x_rrf_gap": F.max("rrf").over(w) - F.col("rrf"),
            "x_n_cands": F.count("*").over(w),
        }
    )


def support_records(cand: DataFrame, view: DataFrame) -> DataFrame:
    """(country, s1, src, o): the grams of a query's best candidate of the other source than ``src``.

    One row a query and source, so what travels is bounded by the number of lists.
    """
    best = cand.groupBy("country", "s1", "src").agg(F.max(F.struct("rrf", F.bitwise_not("cid").alias("cid"))).alias("_best"))
    best = best.select("country", "s1", (5 - F.col("src")).cast("int").alias("src"), F.bitwise_not("_best.cid").alias("_cid"), F.col("src").alias("_src"))
    grams = [c for c in ("name_grams", "addr_grams") if c in view.columns]
    theirs = view.where("src > 1").select("country", F.col("src").alias("_src"), F.col("id").alias("_cid"), F.struct(*grams).alias("o"))
    return best.join(theirs, ["country", "_src", "_cid"]).drop("_src", "_cid")


def featurize(cand: DataFrame, view: DataFrame, only: Iterable[str] | None = None, start: int | None = None) -> DataFrame:
    """(country, s1, src, cid) and the pair features, or those named; ``pre`` is null unless the rows have it.

    ``view`` has what ``reads`` tells, or keys alone where that is nothing. Features of records come
    from a table; the tables made from number ``start`` on, which only they read, go then.
    """
    only = [f for f in PAIR_FEATURES if only is None or f in only]
    if "pre" not in cand.columns:
        cand = cand.withColumn("pre", F.lit(None).cast("double"))
    rows = list_features(cand) if any(f in _LISTED for f in only) else cand
    carried = [c for c in rows.columns if c == "y" or c in only]
    rows = rows.select("country", "s1", "src", "cid", *carried)
    # records that share an id make a row each, whether or not features read them
    met = bool(reads(only)) or not view.groupBy("country", "src", "id").count().where("count > 1").isEmpty()
    if met:
        support = [f for f in _SUPPORT if f in only]
        rows = fuzzy_features(builtin_features(join_views(rows, for_pairs(view, only), support_records(cand, view) if support else None), only), only)
        rows = rows.withColumns({f: X.jaccard_of_sets(F.col(f"b.{c}"), F.col(f"o.{c}")) for f in support for c in _READS[f]})
    keep = [c for c in ("y",) if c in rows.columns]
    rows = rows.select("country", "s1", "src", "cid", *keep, *[F.col(f).cast("double").alias(f) for f in only])
    if not met:
        return rows
    with working.by_block(rows.sparkSession):
        return working.cut(rows, "features") if start is None else working.cut_last(rows, "features", start)
