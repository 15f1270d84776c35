"""Quality rules: base rules on document statistics, then gradient-boosted trees over them.

Statistics of every whole text are computed in Arrow batches. A document that breaks a base rule
(fewer than ``MIN_WORDS`` words, or more than ``REPEAT_PERCENT`` percent of its words in repeated
windows of ``WINDOW`` words) is rejected; the others get the verdict of trees fitted on at most
``LABELLED`` labelled documents, flattened into node arrays that score whole batches. The trees
never reward more symbols, repeats or capitals: those features are constrained.

Edge cases: a null text has no words and fails the base rules; a repeated row is judged again;
without labels of both classes the trees are a constant and the base rules alone decide; an empty
table gives no rows; columns besides doc_id and text are carried by ``keep_good`` and never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import common as C
from kinmatch.llm import trees

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Labelled documents that the trees are fitted on, at most.
LABELLED = 8_000
#: A document is rejected when its probability of good quality is below.
REJECT_BELOW = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and its constraint: -1 never raises the score as it grows.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "punct_share": 0,
    "adjacent_repeat_share": -1,
    "distinct_share": 0,
    "top_word_share": 0,
    "mean_line": 0,
    "marked_word_share": -1,
}
_DIGITS = frozenset(b"0123456789")
_UPPER_LOW = bytes(range(65, 91))
_PUNCT = b"!?.,;:"


def _repeat_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more; exact.

    Windows get ranks by doubling: a rank of 2w words is the rank of a pair of ranks of w words,
    so equal ranks are equal windows.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == n:
        return 0
    width = 1
    while width < WINDOW:
        pair = code[:-width] * (int(code.max()) + 1) + code[width:]
        uniq, code = np.unique(pair, return_inverse=True)
        if len(uniq) == len(pair):
            return 0
        width *= 2
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """(the columns of ``BASE``, the values of ``FEATURES``) of one whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    blanks = raw.count(b" ") + sum(raw.count(bytes([c])) for c in range(9, 14))
    chars = len(text) - blanks
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    dup_lines = len(lines) - len(set(lines))
    repeat = _repeat_words(words)
    base = (n, chars, symbols, dup_lines, repeat)
    if not n:
        return base, [0.0] * len(FEATURES)
    count = Counter(words)
    upper = len(raw) - len(raw.translate(None, _UPPER_LOW))
    digits = len(raw) - len(raw.translate(None, bytes(_DIGITS)))
    punct = len(raw) - len(raw.translate(None, _PUNCT))
    letters = max(1, chars)
    adjacent = sum(map(bytes.__eq__, words, words[1:]))
    marked = sum(v for w, v in count.items() if w[-1:] in (b"!", b"#", b"*", b"$", b"%", b"&", b"|"))
    return base, [
        float(np.log1p(n)),
        chars / n,
        symbols / letters,
        dup_lines / max(1, len(lines)),
        repeat / n,
        upper / letters,
        digits / letters,
        punct / letters,
        adjacent / n,
        len(count) / n,
        max(count.values()) / n,
        n / max(1, len(lines)),
        marked / n,
    ]


_STATS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in BASE], ("features", pa.list_(pa.float64())), ("y", pa.int32())])


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [statistics(t or "") for t in b.column(1).to_pylist()]
        yield pa.record_batch(
            [b.column(0), *[pa.array([g[0][i] for g in got], pa.int64()) for i in range(len(BASE))], pa.array([g[1] for g in got], pa.list_(pa.float64())), b.column(2)],
            schema=_STATS,
        )


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> trees.FlatTrees:
    """Trees for the probability of good quality, from at most ``limit`` labelled documents."""
    C.prepare(docs.sparkSession)
    sample = C.labelled(docs, labels, "quality", limit).select("doc_id", "text", "y")
    kind = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", features array<double>, y int"
    rows = sample.mapInArrow(_stats_batches, kind).orderBy("doc_id").select("features", "y").toPandas()
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return trees.fit(x, rows["y"].to_numpy(dtype=np.float64), np.array(list(FEATURES.values())))


def judge(docs: DataFrame, model: trees.FlatTrees, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base columns, base_failed, kept, probability, and the ``carry`` columns."""
    spark = docs.sparkSession
    C.prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t or "") for t in b.column(1).to_pylist()]
            x = np.array([g[1] for g in got], dtype=np.float64).reshape(-1, len(FEATURES))
            p = shared.value.probability(x)
            base = [np.array([g[0][i] for g in got], dtype=np.int64) for i in range(len(BASE))]
            n, repeat = base[0], base[4]
            failed = (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
            cols = [b.column(0), *map(pa.array, base), pa.array(failed), pa.array(~failed & (p >= REJECT_BELOW)), pa.array(p), *b.columns[2:]]
            names = ["doc_id", *BASE, "base_failed", "kept", "probability", *b.schema.names[2:]]
            yield pa.record_batch(cols, names=names)

    kept = [f"{rows.schema[f'_{k}'].dataType.simpleString()}" for k in range(len(carry))]
    kind = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, probability double"
    kind += "".join(f", _{k} {t}" for k, t in enumerate(kept))
    return rows.mapInArrow(run, kind)


def keep_good(docs: DataFrame, model: trees.FlatTrees) -> DataFrame:
    """The documents that pass, with all their columns in place."""
    judged = judge(docs, model, tuple(docs.columns)).where("kept")
    return judged.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit_rules(docs, C.table(spark, sf_dir, "labels"))
    return judge(docs, model)
