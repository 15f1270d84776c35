"""Operators on small tables with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmatch.functions import text as X
from kinmatch.operators import augment, candidates, corpus, decide, features, index, metrics, model, splits
from kinmatch.plans.linkage import Linkage
from kinmatch.sources import bindings, tables, working
from kinmatch.streaming import corpus_stream

REC = "id long, src int, country string, name string, addr string"


def records(spark, rows):
    return spark.createDataFrame(rows, REC)


def small(spark):
    names = [
        ("Acme Widgets Private Limited", "12 Elm Road Springfield"),
        ("Zenith Foods Limited", "7 Oak Street Shelby"),
        ("Blue Harbour Shipping", "99 Quay Lane Portsea"),
        ("Quantum Textiles Private Limited", "41 Mill Road Weston"),
        ("Olive Garden Tools", "5 Hill Street Northam"),
        ("Silver Lining Insurance", "310 Main Street Eastham"),
    ]
    rows = [(k, 1, "X", n, a) for k, (n, a) in enumerate(names)]
    rows += [(100 + k, 2, "X", n.upper().replace("Limited", "Ltd"), a) for k, (n, a) in enumerate(names)]
    rows += [(200 + k, 3, "X", n.replace("i", "í"), a.replace("Road", "Rd")) for k, (n, a) in enumerate(names)]
    rows += [(300, 2, "Y", "Acme Widgets Private Limited", "12 Elm Road Springfield"), (301, 2, "X", "", "")]
    return records(spark, rows)


def test_twins_rank_first(spark):
    spec = index.ViewSpec("nm", "name", max_df_frac=0.5, min_df=1)
    got = index.retrieve(small(spark), spec, 3).collect()
    best = {(r.s1, r.src): r.cid for r in got if r["rank"] == 0}
    assert all(best[k, 2] == 100 + k and best[k, 3] == 200 + k for k in range(6))
    assert all(0 <= r.score <= 1.000001 for r in got) and all(r.cid != 300 for r in got)


def test_top_k_in_blocks_equals_the_join(spark, monkeypatch):
    """Blocks of few rows give what a join of all pairs gives, ties included."""
    monkeypatch.setattr(index, "POOL_BLOCK", 7)
    monkeypatch.setattr(index, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(2)
    rows = lambda m: [(c, s, i + 1000 * s, f"t{t}", float(rng.integers(1, 4)) / 7) for c in ("", "a|b") for s in (2, 3) for i in range(m) for t in rng.choice(12, 3, replace=False)]
    post = spark.createDataFrame(rows(40), "country string, src int, id long, term string, w double")
    qv = spark.createDataFrame([(c, i - 1000 * s, s, t, w) for c, s, i, t, w in rows(20)], "country string, s1 long, src int, term string, w double")
    dot = qv.join(post.withColumnRenamed("w", "pw"), ["country", "src", "term"]).groupBy("country", "s1", "src", "id").agg(F.round(F.sum(F.col("w") * F.col("pw")), 6).alias("score"))
    want: dict = {}
    for r in sorted(dot.collect(), key=lambda r: (-r.score, r.id)):
        want.setdefault((r.country, r.s1, r.src), []).append((r.id, r.score))
    top = index.top_k(qv, post, 4)
    got: dict = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.country, r.s1, r.src), []).append((r.cid, r.score))
    assert got == {x: v[:4] for x, v in want.items()}


def test_retrieval_writes_lists_and_equals_its_parts(spark, monkeypatch):
    """Lists by term, in small slices and blocks, give what rows of postings give, repeated ids and
    odd countries included; no table has a row for each posting."""
    rng = np.random.default_rng(4)
    words = [f"w{i}ord" for i in range(30)]
    rows = [(i % 50 + 100 * src, src, c, " ".join(rng.choice(words, 6)), f"{rng.integers(0, 40)} Road") for c in ("", "a|b") for src in (1, 2, 3) for i in range(60)]
    rec = records(spark, [*rows, (7, 1, "alone", "w1ord", ""), (8, 2, "pool", "w1ord", "")])
    spec, how = index.ViewSpec("na", "index", max_df_frac=0.6), (150, 3, 9)
    t = index.working.cut(index.terms(rec, spec), "terms")
    pool = t.where("src > 1")
    vocab = index.working.cut(index.vocabulary(pool, rec, spec), "vocabulary")
    want = index.top_k(index.query_vectors(t.where("src = 1"), vocab, *how).drop("df"), index.postings(pool, vocab), 4)
    made, cut = {}, index.working.cut

    def counting(df, tag):
        out = cut(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(index.working, "cut", counting)
    whole = index.retrieve(rec, spec, 4, *how).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, want.collect()))
    assert max(made.values()) < t.count() / 2
    for name, value in (("POOL_BLOCK", 7), ("QUERY_BLOCK", 5), ("SLICE", 100)):
        monkeypatch.setattr(index, name, value)
    assert sorted(map(tuple, index.retrieve(rec, spec, 4, *how).collect())) == sorted(map(tuple, whole))


def test_fused_rows_move_once(spark):
    """One exchange brings a query's rows together, for the counts and for the ranks."""
    lists = {v: spark.range(40).selectExpr("'X' AS country", "id % 4 AS s1", "2 AS src", "id AS cid", "0.5D AS score", "cast(id / 4 AS int) AS rank") for v in candidates.VIEWS}
    out = candidates.fuse(lists, None, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.s1, r.cid) for r in out.collect()) == sorted((i % 4, i) for i in range(12))


def test_tables_that_made_a_table_go(spark):
    """``cut_last`` leaves the last of the tables made since, with its rows."""
    from kinmatch.sources import working

    start = len(working.made)
    out = working.cut_last(working.cut(spark.range(5), "a").selectExpr("id + 1 AS id"), "b", start)
    assert len(working.made) == start + 1 and sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5]


def paired(spark):
    """Every query of ``small`` with every pool record and one that is missing, and the views."""
    rec = bindings.record_tokens(small(spark))
    pool = rec.where("src > 1").select("country", "src", F.col("id").alias("cid")).union(spark.createDataFrame([("X", 2, 999)], "country string, src int, cid long"))
    cand = rec.where("src = 1").select("country", F.col("id").alias("s1")).join(pool, "country").withColumn("rrf", F.lit(1.0) / (1 + F.pmod(F.col("s1") * 7 + F.col("cid"), F.lit(5))))
    for c in [f"{v}_{x}" for v in candidates.VIEWS for x in ("score", "rank")] + ["key_hit", "nret"]:
        cand = cand.withColumn(c, F.lit(0))
    return cand.localCheckpoint(), features.record_view(rec, (0.1, 0.5, 0.1, 0.5))


def test_features_in_blocks_equal_plain_joins(spark, monkeypatch):
    """Blocks of one record give what joins of pairs with both views give; so do single features."""
    cand, view = paired(spark)
    cols = [c for c in view.columns if c not in ("country", "src", "id")]
    a = view.where("src = 1").select("country", F.col("id").alias("s1"), F.struct(*cols).alias("a"))
    b = view.where("src > 1").select("country", "src", F.col("id").alias("cid"), F.struct(*cols).alias("b"))
    plain = features.fuzzy_features(features.builtin_features(features.list_features(cand).join(a, ["country", "s1"], "left").join(b, ["country", "src", "cid"], "left")))
    best: dict = {}
    for r in sorted(cand.collect(), key=lambda r: (-r.rrf, r.cid)):
        best.setdefault((r.s1, r.src), r.cid)
    grams = {r.id: (set(r.name_grams), set(r.addr_grams)) for r in view.collect()}
    names = [f for f in features.PAIR_FEATURES if f in plain.columns]
    want = {(r.s1, r.cid): tuple(r)[3:] for r in plain.select("s1", "src", "cid", *[F.col(f).cast("double") for f in names]).collect()}
    monkeypatch.setattr(features, "QUERY_BLOCK", (1, 1))
    monkeypatch.setattr(features, "POOL_BLOCK", 1)
    got = features.featurize(cand, view).collect()
    assert {(r.s1, r.cid): tuple(r[f] for f in names) for r in got} == want and len(got) == len(want) == 84
    for r in got:
        for mine, theirs, f in zip(grams.get(r.cid, ((), ())), grams.get(best[r.s1, 5 - r.src], ((), ())), ("x_support_name", "x_support_addr")):
            assert r[f] == (pytest.approx(len(mine & theirs) / len(mine | theirs)) if mine and theirs else None)
    some = ["addr_contain", "num_rel", "x_rrf_rank"]
    few = features.featurize(cand, view.select("country", "src", "id", *features.reads(some)), some)
    assert few.columns == ["country", "s1", "src", "cid", "addr_contain", "num_rel", "x_rrf_rank"]  # in the order of PAIR_FEATURES
    assert sorted(map(str, few.collect())) == sorted(str(x) for x in features.featurize(cand, view).select(*few.columns).collect())


def test_pairs_move_before_they_have_views(spark):
    """Pairs and either side's views are dealt once; no joined row moves, and none is sorted."""
    cand, view = paired(spark)
    with working.by_block(spark):
        plan = features.join_views(cand, view).select("s1", "cid", "a.name_grams", F.col("b.addr_grams").alias("h"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Exchange hashpartitioning") == 3 and plan.count("SortMergeJoin") == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_features_of_lists_read_no_views(spark):
    """What only candidates tell is joined with nothing; records of one id still make a row each."""
    cand, view = paired(spark)
    keys, some = view.select("country", "src", "id"), ["rrf", "x_rrf_rank", "x_rrf_gap", "x_n_cands"]
    got = features.featurize(cand, keys, some)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(got) == rows(features.featurize(cand, view).select(*got.columns))
    twice = keys.union(keys.where("id IN (0, 101)"))
    assert features.featurize(cand, twice, some).count() == 84 + 14 + 6 + 1


def test_query_pruning_keeps_rare_terms(spark):
    t = spark.createDataFrame([("X", 1, 1, f"t{k}", 1) for k in range(10)], "country string, src int, id long, term string, tf long")
    vocab = spark.createDataFrame([("X", 2, f"t{k}", k + 1, 1.0) for k in range(10)], "country string, src int, term string, df long, idf double")
    got = index.query_vectors(t, vocab, 10, 2, 5).collect()
    assert sorted(r.term for r in got) == ["t0", "t1", "t2", "t3"]
    assert sum(r.w**2 for r in got) == pytest.approx(1.0)
    assert index.query_vectors(t, vocab, 0, 3, 5).count() == 3


def test_cap_that_leaves_nothing_keeps_all(spark):
    rec = small(spark).where("country = 'X'")
    pool = index.terms(rec, index.SPECS[1]).where("src = 3")
    assert index.vocabulary(pool, rec, index.ViewSpec("nm", "name", max_df_frac=0.0, min_df=99)).count() == pool.select("term").distinct().count()


def test_affixes_are_found_without_a_list(spark):
    brands = "acme zenith blue quantum olive silver crimson delta".split()
    rows = [(k, 1, "X", f"{a.title()} {b.title()} Limited", "") for k, (a, b) in enumerate((a, b) for a in brands for b in brands if a != b)]
    rec = bindings.record_tokens(records(spark, rows))
    assert [r.token for r in corpus.affixes(rec).collect()] == ["limited"]
    core = corpus.with_core(rec, corpus.affixes(rec), corpus.affix_bigrams(rec)).first()
    assert core.core == core.tok[:2]
    lone = bindings.record_tokens(records(spark, [(1, 1, "X", "Limited", "")]))
    assert corpus.with_core(lone, corpus.affixes(rec), corpus.affix_bigrams(rec)).first().core == ["limited"]


def test_weights_fall_back(spark):
    rows = spark.createDataFrame([("X", "a"), ("X", "new"), ("Z", "a")], "country string, token string")
    w = spark.createDataFrame([("X", "a", 1.5)], "country string, token string, idf double")
    top = spark.createDataFrame([("X", 4.0)], "country string, max_idf double")
    aff = spark.createDataFrame([("X", "a")], "country string, token string")
    got = {(r.country, r.token): r.weight for r in corpus.weighted(rows, w, top, aff).collect()}
    assert got == {("X", "a"): pytest.approx(0.15), ("X", "new"): 4.0, ("Z", "a"): 10.0}


def lists(spark, rows):
    return spark.createDataFrame(rows, "country string, s1 long, src int, cid long, score double, rank int")


def test_fusion_counts_and_caps(spark):
    a = lists(spark, [("X", 0, 2, 10, 0.9, 0), ("X", 0, 2, 11, 0.5, 1)])
    b = lists(spark, [("X", 0, 2, 11, 0.8, 0)])
    keys = spark.createDataFrame([("X", 0, 2, 12), ("X", 0, 2, 10)], "country string, s1 long, src int, cid long")
    got = {r.cid: r for r in candidates.fuse({"nm": a, "ad": b}, keys).collect()}
    assert got[11].rrf == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and got[11].nret == 2
    assert (got[12].rrf, got[12].nret, got[12].key_hit, got[12].nm_rank, got[12].nm_score) == (0.0, 0, 1, 999, 0.0)
    assert {r.cid for r in candidates.fuse({"nm": a, "ad": b}, keys, max_per_source=2).collect()} == {10, 11}


def test_two_hop_adds_only_new_pairs(spark):
    cand = spark.createDataFrame([("X", 1, 2, 10, 0.5), ("X", 1, 3, 20, 0.4)], "country string, s1 long, src int, cid long, rrf double")
    near = spark.createDataFrame([(2, 10, 3, 20, 0), (2, 10, 3, 21, 1), (3, 20, 2, 11, 5)], "src int, cid long, n_src int, n_cid long, n_rank int")
    got = candidates.expand_two_hop(cand, near).collect()
    assert {(r.src, r.cid) for r in got} == {(2, 10), (3, 20), (3, 21)}
    assert [r.rrf for r in got if r.cid == 21] == [0.0]


def test_dense_equals_numpy(spark):
    rng = np.random.default_rng(1)
    q, p = rng.standard_normal((7, 5)), rng.standard_normal((40, 5))
    df = lambda m: spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "id long, vec array<double>")
    got = {(r.s1, r["rank"]): r.cid for r in candidates.dense_topk(df(q), df(p), 4).collect()}
    want = np.argsort(-(q @ p.T), axis=1)[:, :4]
    assert all(got[i, j] == want[i, j] for i in range(7) for j in range(4))


def test_dense_in_blocks_with_ties_and_vectors_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(candidates, "DENSE_QUERIES", 3)
    monkeypatch.setattr(candidates, "DENSE_POOL", 6)
    monkeypatch.setattr(candidates, "DENSE_ROWS", 2)
    rng = np.random.default_rng(3)
    vec = lambda m: [[float(x) for x in rng.integers(-2, 3, 3)] for _ in range(m)]
    q = [*enumerate(vec(9)), (9, [1.0, 2.0]), (10, None), (11, [1.0, None, 2.0])]
    p = [*enumerate(vec(25)), (25, [1.0, 1.0]), (26, None)]
    df = lambda rows: spark.createDataFrame(rows, "id long, vec array<float>")
    whole = lambda v: v is not None and None not in v
    want = {}
    for i, a in q:
        scored = [(sum(x * y for x, y in zip(a, b)) if whole(a) and whole(b) and len(a) == len(b) else None, j) for j, b in p]
        for r, (s, j) in enumerate(sorted(scored, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:4]):
            want[i, r] = (j, s)
    got = {(r.s1, r["rank"]): (r.cid, r.score) for r in candidates.dense_topk(df(q), df(p), 4).collect()}
    assert got == want
    assert candidates.dense_topk(df(q), df([]), 4).count() == 0 == candidates.dense_topk(df([]), df(p), 4).count()


def test_stack_computes_what_its_fits_read_once(spark):
    """With ``write`` no fit repeats the windows; the models are those of the fit without."""
    c = bindings.claims(spark, "/root/testdata/sf0.001").where("s1 % 7 < 3")
    feats = features.list_features(c.withColumn("rrf", F.col("p")).drop("p"))
    role = F.element_at(F.array(*[F.lit(r) for r in ("m1", "m2", "cal")]), (F.pmod(F.col("s1"), F.lit(3)) + 1).cast("int"))
    roles = c.select("country", "s1", role.alias("role")).distinct()
    written = []

    def write(df):
        written.append(df)
        return spark.createDataFrame(df.collect(), df.schema)

    names = ["rrf", "x_n_cands"]
    one, two = model.fit_stack(feats, roles, names), model.fit_stack(feats, roles, names, write=write)
    assert len(written) == 4
    rows = lambda s: {(r.s1, r.src, r.cid): r.p for r in s.score(feats).collect()}
    a, b = rows(one), rows(two)
    assert a.keys() == b.keys() and all(a[x] == pytest.approx(b[x], abs=1e-6) for x in a)


def test_prune(spark):
    p = [(1, 2, k, x) for k, x in enumerate((0.9, 0.8, 0.1))] + [(2, 2, k, x) for k, x in enumerate((0.9, 0.05))]
    df = spark.createDataFrame(p, "s1 long, src int, cid long, p double")
    got = sorted((r.s1, r.cid) for r in candidates.prune(df, 1, 3, 0.5).collect())
    assert got == [(1, 0), (1, 1), (2, 0)]


def claims(spark, rows):
    return spark.createDataFrame([("X", *r) for r in rows], "country string, s1 long, src int, cid long, p double")


def test_exclusivity_and_meta(spark):
    df = claims(spark, [(1, 2, 10, 0.9), (2, 2, 10, 0.6), (1, 2, 11, 0.4), (1, 3, 12, 0.2), (2, 3, 13, 0.8)])
    e = {(r.s1, r.cid): r.p_excl for r in decide.exclusivity(df).collect()}
    assert e[1, 10] == pytest.approx(0.7826, abs=1e-3) and e[2, 10] == pytest.approx(0.1304, abs=1e-3) and e[1, 11] == pytest.approx(0.4)
    m = {(r.s1, r.cid): r for r in decide.meta_features(df).collect()}
    assert [m[1, c].m_rank for c in (10, 11, 12)] == [0, 1, 2] and m[2, 10].m_n_competitors == 2 and m[2, 10].m_excl_rank == 1
    assert m[1, 12].m_best_other_source == 0.9 and m[2, 13].m_best_other_source == 0.6
    # competition is that of the whole table: filtering before changes it
    alone = decide.exclusivity(df.where("s1 = 1")).where("cid = 10").first().p_excl
    assert alone == pytest.approx(0.9) and decide.exclusivity(df).where("s1 = 1 AND cid = 10").first().p_excl < 0.8


def test_array_form_equals_kernel(spark):
    rng = np.random.default_rng(2)
    df = claims(spark, [(s, 2, k, float(rng.integers(1, 99)) / 100) for s in range(40) for k in range(int(rng.integers(1, 9)))])
    a = {r.s1: r.k for r in decide.decide_expected(df).collect()}
    assert a == {r.s1: r.k for r in decide.decide_expected(df, arrays=False).collect()}
    taken = decide.apply_decision(df, decide.decide_expected(df)).groupBy("s1").count().collect()
    assert {r.s1: r["count"] for r in taken} == {s: k for s, k in a.items() if k}


def test_owner_and_temper(spark):
    df = claims(spark, [(2, 2, 10, 0.7), (1, 2, 10, 0.8), (3, 2, 11, 0.5), (4, 2, 11, 0.5)])
    assert {r.cid: r.s1 for r in decide.resolve_claims(df).collect()} == {10: 1, 11: 3}
    got = df.select(decide.temper(F.col("p"), 1.0).alias("a"), decide.temper(F.lit(0.8), 0.5).alias("b")).first()
    assert got.a == 0.7 and got.b == pytest.approx(0.8**2 / (0.8**2 + 0.2**2))


@pytest.mark.parametrize("tp, n, t, want", [(0, 0, 0, 1), (0, 1, 0, 0), (0, 0, 1, 0), (1, 1, 2, 0.8333), (2, 3, 2, 0.7143), (3, 3, 4, 0.9375), (4, 5, 4, 0.8333), (1, 1, 4, 0.625)])
def test_f05(spark, tp, n, t, want):
    assert spark.range(1).select(metrics.f05(F.lit(tp), F.lit(n), F.lit(t)).alias("f")).first().f == pytest.approx(want, abs=1e-4)


def test_number_relation(spark):
    cases = [([], ["1"], 0), (["1795"], ["1795"], 1), (["1447"], ["447"], 2), (["616"], ["617"], 3), (["616"], ["627"], 4), (["616"], ["9999"], 5)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a array<string>, b array<string>")
    assert [r.x for r in df.select(metrics.number_relation(F.col("a"), F.col("b")).alias("x")).collect()] == [w for *_, w in cases]


def test_ceiling_and_calibration(spark):
    ent = spark.createDataFrame([(1,), (2,)], "s1 long")
    truth = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (2, 2, 3)], "s1 long, src int, cid long")
    cand = spark.createDataFrame([(1, 2, 1), (1, 2, 9), (2, 2, 3)], "s1 long, src int, cid long")
    r = metrics.blocking_report(ent, cand, truth, 10).first()
    assert (r.pair_recall, r.full_cluster_recall, r.avg_candidates) == (pytest.approx(2 / 3), 0.5, 1.5)
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    assert metrics.expected_calibration_error(flat).first().ece == 0.0


def test_splits(spark):
    rows = [(k, 1, "XY"[k % 2], f"brand{k // 3} goods", "") for k in range(60)]
    fam = splits.families(bindings.record_tokens(records(spark, rows)).withColumn("core", F.col("tok")))
    assert fam.groupBy("family").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert {r.role for r in splits.roles(fam).collect()} <= {"m1", "pre", "m2", "cal", "val"}
    got = splits.sample_by_family(fam, 5)
    whole = fam.join(got.select("country", "family").distinct(), ["country", "family"])
    assert got.count() == whole.count()
    test = spark.createDataFrame([("A",)] * 50 + [("B",)] * 30 + [("C",)] * 20, "country string")
    w = {r.country: r.weight for r in splits.test_mix_weights(test, spark.createDataFrame([("A",), ("B",)], "country string")).collect()}
    assert w == {"A": 0.5, "B": 0.3, "LOCO": 0.2}
    assert splits.loco_pairs(spark.createDataFrame([("A",), ("B",), ("C",)], "country string")).count() == 6


def test_files_round_trip(spark, tmp_path):
    names = ["NA", "NaN", "None", "NULL", "n/a Services", "inf", "-1.#IND Ltd", 'the "best" one']
    lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry"] + [f"S1-{k}\t{n}\t\tX" for k, n in enumerate(names)]
    path = tmp_path / "train_source1.tsv"
    path.write_text("\n".join(lines) + "\n")
    rec = tables.build_cache(spark, str(path), str(tmp_path / "cache"))
    assert [r.name for r in rec.orderBy("id").collect()] == names and {r.addr for r in rec.collect()} == {""}
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(path), tables.T.StructType([tables.T.StructField("other", tables.T.StringType())]))
    ent = spark.createDataFrame([(3,), (1,), (2,)], "s1 long").withColumn("row_no", F.monotonically_increasing_id())
    pairs = spark.createDataFrame([(1, 3, 7), (1, 2, 9), (1, 2, 9), (2, 1, 5)], "s1 long, src int, cid long")
    out = str(tmp_path / "out")
    assert tables.write_id_lists(tables.id_lists(ent, pairs, "row_no"), out, "matched_entity_ids", "row_no") == {"rows": 3, "non_empty": 1, "total": 2}
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert sorted(text.splitlines()[1:]) == ["S1-1\tS2-9,S3-7", "S1-2\t", "S1-3\t"] and text.startswith("source1_entity_id\tmatched_entity_ids\n") and "\r" not in text
    back = tables.explode_truth(tables.read_id_list(spark, out)).collect()
    assert sorted(map(tuple, back)) == [(1, 2, 9), (1, 3, 7)]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        rows = "\n".join(f"S1-{k}\tacme w{k % 4}\taddr\tX" for k in range(part * 5, part * 5 + 5))
        (folder / f"{part}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + rows + "\n")
    stream = tables.stream_source(spark, str(folder)).select("country", F.col("business_name").alias("name"))
    corpus_stream.start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    df, totals = corpus_stream.current(spark, str(tmp_path / "out"))
    batch = spark.createDataFrame([("X", f"acme w{k % 4}") for k in range(15)], "country string, name string")
    want = corpus.token_df(batch.withColumn("tok", X.tokens(F.col("name"))))
    rows = lambda d: sorted(tuple(r) for r in d.select("country", "token", "df").collect())
    assert rows(df) == rows(want) and totals.first().nd == 15


def test_masks_and_noise():
    assert augment.mask_fields(["Acme Road 12", "ACME zed", None]) == ["W1 Road 12", "W1 W2", None]
    rng = __import__("random").Random(1)
    for _ in range(50):
        moved = augment.shift_number("5 Elm", rng)
        assert moved.endswith(" Elm") and int(moved.split()[0]) >= 1 and moved != "5 Elm"
        assert augment.corrupt("12 some longer name here", rng)
    assert augment.shift_number("no number", rng) is None
    batches = augment.collision_batches([("a", "X", 2), ("b", "X", 2), ("c", "Y", 1), ("d", "X", 2)], {"a": ["d"]}, 4)
    assert sorted(sum(batches, [])) == ["a", "b", "c", "d"] and ["a", "d"] in batches
    v = np.ones((4, 3)) / math.sqrt(3)
    assert model.supcon_loss(v, [1, 1, 1, 1]) == pytest.approx(math.log(3)) and model.supcon_loss(v, [1, 2, 3, 4]) == 0.0


def test_chain_from_records_to_lists(spark, tmp_path):
    rec = small(spark)
    specs = tuple(index.ViewSpec(s.name, s.view, s.kind, s.n, 500, 0.9, 1) for s in index.SPECS)
    link = Linkage(specs=specs, blocking=index.BlockingConfig(k=5))
    cand = link.block(rec).cache()
    truth = spark.createDataFrame([(k, 2, 100 + k) for k in range(6)] + [(k, 3, 200 + k) for k in range(6)], "s1 long, src int, cid long")
    assert candidates.label(cand, truth).agg(F.sum("y")).first()[0] == 12
    ranker = link.prerank(candidates.label(cand, truth))
    feats = link.featurize(rec, candidates.label(link.prune(cand, ranker), truth)).cache()
    assert [c for c in feats.columns if c in features.PAIR_FEATURES] == list(features.PAIR_FEATURES) and len(features.PAIR_FEATURES) == 52
    twin = feats.where("s1 = 0 AND cid = 100").first()
    assert twin.name_jw == 1.0 and twin.num_rel == 1 and twin.addr_contain == pytest.approx(1.0) and twin.name_tok_eq == 1
    role = spark.createDataFrame([("X", k, ("m1", "m1", "m2", "m2", "cal", "cal")[k]) for k in range(6)], "country string, s1 long, role string")
    stack = link.fit(feats, role, ["name_tset", "addr_contain", "rrf"])
    scored = stack.score(feats).cache()
    taken = link.decide(scored)
    ent = rec.where("src = 1").select("country", F.col("id").alias("s1"))
    report = link.evaluate(scored, taken, ent).first()
    assert report.macro_f05 > 0.8
    assert link.write(ent, taken, str(tmp_path / "out"))["rows"] == 6
    assert taken.join(cand, ["s1", "src", "cid"], "left_anti").count() == 0
