"""Registered queries against their oracles, at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ORACLES = (
    "norm_tokens", "norm_skeleton", "norm_numbers", "corpus_idf", "corpus_affix_bigram", "core_tokens", "query_prune_budget",
    "topk_name", "key_candidates", "two_hop_expand", "label_left_join", "prune_adaptive", "feat_set_similarity", "feat_pair_numbers", "native_twins",
    "char_ngrams_set", "word_ngrams", "leak_recall", "error_patterns", "blocking_ceiling",
    "meta_features", "decide_expected_f", "search_rule_grid", "macro_f05", "family_folds", "sample_by_family",
    "test_mix_weights", "write_id_lists",
)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_items_of_any_length_are_found(spark, tmp_path):
    from kinmatch.sources import bindings

    items = [(1, "a b c d e f"), (2, "lo"), (3, "zz"), (4, "a b c d e f"), (5, "")]
    docs = [(1, "xx a b c d e f yy"), (2, "hello"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for most in (1000, 8):
        assert sorted(map(tuple, bindings.leak_pairs(spark, str(tmp_path), most).collect())) == [(1, 1), (2, 2), (4, 1)]


def test_scores_of_retrieval_write_no_table_of_pairs(spark):
    """They are the fused rows as they are: neither a table of them nor one of views is made."""
    from kinmatch.sources import working

    start = len(working.made)
    got = entry.queries()["feat_retrieval"](spark, SF)
    assert not [x for x in working.made[start:] if any(f"/{tag}-" in x for tag in ("fused", "record-view", "features"))]
    fused = entry.queries()["fuse_rrf"](spark, SF).collect()
    assert {(r.s1, r.src, r.cid): (r.rrf, r.nret, r.sk_rank) for r in got.collect()} == {(r.s1, r.src, r.cid): (round(r.rrf, 6), r.nret, r.sk_rank) for r in fused}


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
