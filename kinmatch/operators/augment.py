"""Seeded noise for training pairs, masking for reports, and balanced batches."""

import random
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that say nothing about who is meant and stay readable in masked text.
PUBLIC_WORDS = frozenset(
    "private limited ltd llp llc inc incorporated corp corporation co company pvt plc lp pllc sarl sas sasu "
    "eurl sa sci snc ei ets associes road rd street st drive dr avenue ave lane ln boulevard blvd highway hwy "
    "marg nagar colony sector phase block plot floor flat door house building tower complex market rue bis "
    "allee place square no num number opp opposite near behind next above north south east west new old main "
    "cross and the of de du la le des".split()
)
# Fixed value: runs of digits and letters, Latin to U+024F and the Indic blocks.
_RUN = re.compile("[0-9A-Za-z\u00c0-\u024f\u0900-\u0dff]+")


def shift_number(addr: str, rng: random.Random, low: int = 3, high: int = 20) -> str | None:
    """The address some doors away; None without a number."""
    m = re.search(r"\d+", addr or "")
    if not m:
        return None
    move = rng.randint(low, high) * rng.choice((-1, 1))
    return f"{addr[: m.start()]}{max(1, int(m.group()) + move)}{addr[m.end() :]}"


def corrupt(text: str, rng: random.Random) -> str:
    """One of five kinds of noise, the next that applies."""
    words = text.split()

    def pad() -> str | None:
        m = re.search(r"\d+", text)
        return text[: m.start()] + m.group().zfill(6) + text[m.end() :] if m else None

    def twice() -> str | None:
        if not words:
            return None
        k = rng.randrange(len(words))
        return " ".join([*words[: k + 1], *words[k:]])

    def swap() -> str | None:
        if len(text) < 4:
            return None
        k = rng.randrange(len(text) - 1)
        return text[:k] + text[k + 1] + text[k] + text[k + 2 :]

    def shorten() -> str | None:
        if len(words) < 4:
            return None
        gone = set(rng.sample(range(len(words)), 2))
        return " ".join(w for k, w in enumerate(words) if k not in gone)

    kinds = [pad, twice, swap, shorten, lambda: "-- " + text]
    start = rng.randrange(len(kinds))
    for k in range(len(kinds)):
        got = kinds[(start + k) % len(kinds)]()
        if got is not None:
            return got
    return text


def _seeded(fn, seed: int):
    """An Arrow UDF over (text, key): the same noise for the same key, whatever the partition."""

    def run(text: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([fn(t or "", random.Random(f"{seed}:{k}")) for t, k in zip(text.to_pylist(), key.to_pylist())], pa.string())

    return F.arrow_udf(run, T.StringType())


def corrupted(seed: int = 1):
    return _seeded(corrupt, seed)


def shifted(seed: int = 1):
    return _seeded(shift_number, seed)


def mask_fields(fields: list[str | None]) -> list[str | None]:
    """Words replaced by W1, W2, ... the same word by the same name over all fields of a row."""
    names: dict[str, str] = {}

    def of(m: re.Match) -> str:
        w = m.group()
        if w.isdigit() or w.lower() in PUBLIC_WORDS:
            return w
        return names.setdefault(w.lower(), f"W{len(names) + 1}")

    return [_RUN.sub(of, f) if f else f for f in fields]


def masked(fields: Column) -> Column:
    """Masks an array of texts, row by row."""

    def run(fields: pa.Array) -> pa.Array:
        return pa.array([mask_fields(x or []) for x in fields.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(fields)


def training_pairs(cand: DataFrame, negatives: int = 3, seed: int = 1) -> DataFrame:
    """All positives, and ``negatives`` negatives for each of them, in seeded order by query."""
    w = Window.partitionBy("s1", "y").orderBy(F.xxhash64("s1", "src", "cid", F.lit(seed)))
    pos = F.sum("y").over(Window.partitionBy("s1"))
    rows = cand.withColumn("_r", F.row_number().over(w)).withColumn("_p", pos)
    return rows.where((F.col("y") == 1) | (F.col("_r") <= negatives * F.greatest("_p", F.lit(1)))).drop("_r", "_p")


def collision_batches(clusters: list[tuple[str, str, int]], hard: dict[str, list[str]], size: int, push: int = 4) -> list[list[str]]:
    """Greedy batches of clusters (cluster, country, rows): each cluster once, countries never
    mixed, up to ``push`` of a cluster's collisions drawn in beside it. One country at a time fits
    a task: use it inside a grouped function."""
    weight = {c: n for c, _, n in clusters}
    of = {c: country for c, country, _ in clusters}
    left = dict.fromkeys(c for c, _, _ in clusters)
    out: list[list[str]] = []
    while left:
        first = next(iter(left))
        country, batch, used, queue = of[first], [], 0, [first]
        rest = iter([c for c in left if of[c] == country and c != first])
        while used < size:
            c = queue.pop(0) if queue else next(rest, None)
            if c is None:
                break
            if c not in left or batch and used + weight[c] > size:
                continue
            del left[c]
            batch.append(c)
            used += weight[c]
            queue += [h for h in hard.get(c, [])[:push] if h in left and of[h] == country]
        out.append(batch)
    return out
