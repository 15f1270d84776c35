"""Golden cases of the scalar functions, and brute force for the kernels."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinmatch.functions import kernels as K
from kinmatch.functions import text as X
from kinmatch.functions.romanise import fold_full, fold_text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (X.fold_latin, "Président", "president"),
        (X.fold_latin, "STRAßE Œuvre", "strasse oeuvre"),
        (X.tokens, "A A A B", ["a", "b"]),
        (X.tokens, "Alpha Beta Alpha", ["alpha", "beta", "alpha"]),
        (X.tokens, "", []),
        (X.clean_text, "<NULL>", ""),
        (X.clean_text, "##8 Foo", "8 foo"),
        (X.clean_text, "-- X", "x"),
        (X.clean_text, "null null a a", "a a"),
        (X.house_numbers, "003182 Elm", ["3182"]),
        (X.house_numbers, "4109-4111 Elm", ["4109", "4111"]),
        (X.house_numbers, "63/2275/7", ["63", "2275", "7"]),
        (X.house_numbers, "000", ["0"]),
        (X.skeleton, "Dynamic Hospitality Private Limited", "dnmk hsptlt prvt lmtd"),
        (X.has_native_script, "हिन्दी", True),
        (X.has_native_script, "Éa", False),
        (X.is_domain_name, "www.acme-foo.com", True),
        (X.is_domain_name, "Acme Pvt.Ltd", False),
        (X.name_aliases, "Acme dba Zed Foo", ["acme", "zed foo"]),
        (X.name_aliases, "blue-sky.co.uk", ["blue sky"]),
        (X.name_aliases, "Acme blue-sky.com", ["acme", "blue sky"]),
        (X.char_wb_ngrams, "ab cdef", [" ab ", " cde", "cdef", "def "]),
        (X.word_ngrams, " a  b ", ["a", "b"]),
        (X.stable_hash, "hello", 907060870),
    ],
)
def test_golden(spark, fn, value, want):
    assert one(spark, fn(F.col("v")), v=value) == want


def test_null_counts_as_empty(spark):
    df = spark.createDataFrame([(None,)], "v string")
    row = df.select(X.fold_latin(F.col("v")).alias("a"), X.tokens(F.col("v")).alias("b"), X.clean_text(F.col("v")).alias("c"), X.house_numbers(F.col("v")).alias("d")).first()
    assert tuple(row) == ("", [], "", [])


def test_char_ngrams(spark):
    got = [one(spark, X.char_ngrams(F.col("v")), v=v) for v in ("abcd", "ab", "", "aaaa")]
    assert got == [["abc", "bcd"], ["ab"], [], ["aaa"]]
    assert one(spark, X.char_wb_ngrams(F.col("v"), 3), v="ab cdef") == [" ab", "ab ", " cd", "cde", "def", "ef "]
    assert one(spark, X.char_wb_ngrams(F.col("v"), 3), v="a") == [" a "]


@pytest.mark.parametrize("a, b, want", [("rd", "road", True), ("road", "rd", False), ("abc", "xyz", False), ("", "a", False), ("pvt", "private", True)])
def test_abbreviations_agree(spark, a, b, want):
    assert one(spark, X.is_abbrev(F.col("a"), F.col("b")), a=a, b=b) is want
    assert K.abbreviates(a, b) is want


def test_unknown_views_raise():
    with pytest.raises(ValueError):
        X.make_view("nope", F.lit(""), F.lit(""))
    with pytest.raises(ValueError):
        X.analyse(F.lit(""), "nope", 3)


def test_romanised_scripts_meet_latin(spark):
    native = fold_text("डायनामिक हॉस्पिटैलिटी प्राइवेट लिमिटेड")
    assert native.isascii()
    df = spark.createDataFrame([(native, "dynamic hospitality private limited")], ["a", "b"])
    grams = [X.char_ngrams(X.skeleton(F.col(c))) for c in "ab"]
    assert df.select(X.jaccard(*grams).alias("j")).first().j > 0.4
    assert fold_text("Москва") and fold_text("Ünïté №1") and fold_text(None) == ""
    assert one(spark, fold_full(F.col("v")), v="Éa") == "ea"


@pytest.mark.parametrize("a, b, want", [([], [], None), (["x"], [], None), ([], ["x"], None), (["x"], ["x", "y"], 0.5), (["x", "x"], ["x"], 1.0)])
def test_jaccard_is_undefined_where_a_side_is_empty(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(X.jaccard(F.col("a"), F.col("b")).alias("j")).first().j == want


def test_records_in_other_scripts_get_words_and_skeletons(spark):
    from kinmatch.functions.romanise import romanised

    df = spark.createDataFrame([(1, "Москва Бар", "ул. 7"), (2, "Éa Bar", "rue 7"), (3, None, None)], "id long, name string, addr string")
    got = {r.id: r for r in romanised(df).select("id", "native", X.tokens(F.col("name")).alias("t"), X.skeleton(F.col("name")).alias("k"), X.house_numbers(F.col("addr")).alias("n")).collect()}
    assert got[1].native and not got[2].native and len(got[1].t) == 2 and got[1].k.split()[0] == "mskv" and got[1].n == ["7"]
    assert got[2].t == ["ea", "bar"] and got[3].t == []


@pytest.mark.parametrize("a, b, want", [("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("", "", 0.0), ("a", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert K.jaro_winkler_text(a, b) == pytest.approx(want, abs=1e-6)


def test_indel_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        want = 1.0 if not a and not b else 2 * row[-1] / (len(a) + len(b))
        assert K.indel_ratio(a, b) == pytest.approx(want)


def _lcs_row(row, x, b):
    out = [0]
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(out[j], row[j + 1]))
    return out


def test_token_ratios():
    assert K.token_sort_ratio("b a", "a b") == 1.0
    assert K.token_set_ratio("acme", "acme limited") == 1.0
    assert K.token_set_ratio("", "a") == 0.0
    assert K.monge_elkan_words([], ["a"], {}) is None
    assert K.monge_elkan_words(["rd"], ["road"], {}) == pytest.approx(0.8)
    assert K.soft_tfidf_words(["a", "b"], {}, ["a", "b"], {}) == pytest.approx(1.0)


def brute_expected(p, k, miss=0.0):
    order = sorted(range(len(p)), key=lambda i: -p[i])
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(p)):
        w = np.prod([p[i] if y[i] else 1 - p[i] for i in range(len(p))])
        tp = sum(y[i] for i in order[:k])
        for extra, m in ((0, 1 - miss), (1, miss)):
            n_true = sum(y) + extra
            f = 1.0 if not k and not n_true else 0.0 if not k or not n_true else 1.25 * tp / (0.25 * n_true + k)
            total += w * m * f
    return total


def test_expected_f_equals_all_subsets():
    rng = np.random.default_rng(1)
    for _ in range(60):
        p = np.sort(rng.random(rng.integers(1, 7)))[::-1]
        miss = float(rng.choice([0.0, 0.2]))
        assert K.expected_f05(p, miss) == pytest.approx([brute_expected(p, k, miss) for k in range(len(p) + 1)])


@pytest.mark.parametrize("p, k", [([0.40], 0), ([0.55], 1), ([0.90, 0.60, 0.35, 0.20], 1), ([], 0)])
def test_decisions(p, k):
    assert K.decide(np.array(p)) == k


def _names(n):
    rng, out = random.Random(7), ["", " ", "a", "ab ab", "x" * 64, "x" * 65, "ab " * 30 + "z", "ab " * 40 + "zz"]
    for _ in range(n):
        letters, most = rng.choice(["ab", "abcde", "abcdefghijk", "aé漢𝄞b"]), rng.choice([3, 8, 20])
        out.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))))
    return out


def test_batches_equal_kernels():
    from kinmatch.functions import batches as B

    rng, names = random.Random(8), _names(120)
    a, b = ([rng.choice([*names, None]) for _ in range(1500)] for _ in range(2))
    for batch, one in ((B.jaro_winkler_batch, K.jaro_winkler_text), (B.token_sort_batch, K.token_sort_ratio), (B.token_set_batch, K.token_set_ratio)):
        assert list(batch(pa.array(a, pa.string()), pa.array(b, pa.string()))) == [one(x or "", y or "") for x, y in zip(a, b)]
    a, b = ([[x for x in rng.choices(names, k=rng.randint(0, 3)) if x] for _ in range(500)] for _ in range(2))
    got = B.alias_batch(*(pa.array([B.ITEM.join(x) for x in side]) for side in (a, b))).to_pylist()
    assert got == [max((K.token_set_ratio(p, q) for p in x for q in y), default=None) for x, y in zip(a, b)]


def test_word_batches_equal_kernels():
    from kinmatch.functions import batches as B

    rng, recs = random.Random(9), []
    for s in _names(120):
        words = s.split()
        recs.append((words, {w: rng.choice([0.0, 1.5, 8 * rng.random()]) for w in words if rng.random() < 0.8}))
    recs.append((["a", "b"], {"a": 0.0, "b": 0.0}))

    pairs = [(rng.randrange(len(recs)), rng.randrange(len(recs))) for _ in range(1500)]
    got = B.words_batch(*(pa.array([B.pack(*recs[p[k]]) for p in pairs]) for k in (0, 1)))
    for (i, j), row in zip(pairs, got):
        (x, u), (y, v) = recs[i], recs[j]
        want = (K.monge_elkan_words(x, y, u), K.monge_elkan_words(y, x, v), K.soft_tfidf_words(x, u, y, v))
        assert [None if np.isnan(z) else pytest.approx(z, abs=1e-12) for z in row] == list(want)


def test_pairs_of_short_names_take_their_steps_together(monkeypatch):
    """No kernel runs once a pair, unless a text is long."""
    from kinmatch.functions import batches as B

    def alone(*_):
        raise AssertionError("one pair at a time")

    for name in ("jaro_winkler_text", "indel_ratio", "abbreviates", "token_similarity"):
        monkeypatch.setattr(K, name, alone)
    a, b = pa.array(["acme ltd", "rd"] * 500), pa.array(["acne limited", "road"] * 500)
    assert B.token_sort_batch(a, b)[1] == pytest.approx(4 / 6)
    assert B.words_batch(*(pa.array([f"{s}\x1e1.0\x1e1" for s in x.to_pylist()]) for x in (a, b)))[1] == pytest.approx([0.8, 0.8, 0.0])
    with pytest.raises(AssertionError, match="one pair"):
        B.token_sort_batch(pa.array(["x" * 65]), pa.array(["y"]))


def test_shared_and_lone_words_equal_brute_force(monkeypatch):
    """Either side's shared weight and lone words, in batches that must be halved too; no word pair is alone."""
    from kinmatch.functions import batches as B

    rng = random.Random(10)
    lists = [[w for w in s.split() if rng.random() < 0.8] for s in _names(60)] + [["rd", "12", "st"], ["road", "12", "street"], ["13", "road"]]
    weight = {w: 8 * rng.random() for x in lists for w in x}
    affix = {w: float(rng.random() < 0.3) for w in weight}
    pairs = [(rng.choice(lists), rng.choice(lists)) for _ in range(400)]
    want = {"w": [], "n": []}
    for a, b in pairs:
        x, y, row = dict.fromkeys(a), dict.fromkeys(b), []
        for p, q in ((x, y), (y, x)):
            heavy = [w for w in p if w not in q and weight[w] >= 6 and not w.isdigit()]
            row.append([sum(weight[w] for w in of) for of in (p, [w for w in p if w in q], heavy)])
        want["w"].append([z for one in zip(*row) for z in one])
        lone = lambda p, q: sum(w not in q and not affix[w] and not any(K.abbreviates(w, o) or K.abbreviates(o, w) for o in q) for w in p)
        want["n"].append([lone(x, y), lone(y, x)])
    sides = lambda of: [pa.array([B.pack(p[k], of) for p in pairs]) for k in (0, 1)]
    for cells in (B.CELLS, 4000):
        monkeypatch.setattr(B, "CELLS", cells)
        assert np.allclose(B.shared_batch(*sides(weight), 6.0), want["w"], atol=1e-12)
        assert B.lone_batch(*sides(affix)).tolist() == want["n"]
