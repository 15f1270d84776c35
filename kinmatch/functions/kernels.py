"""String and probability kernels that built-in functions lack, one pair or list at a time; ``batches`` has
the string kernels over Arrow batches."""

from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1 << 17)
def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro-Winkler similarity with prefix weight 0.1 over up to 4 characters."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    of_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                of_a.append(ch)
                break
    m = len(of_a)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(of_a, (ch for ch, u in zip(b, used) if u)))
    jaro = (m / len(a) + m / len(b) + (m - swapped // 2) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


@lru_cache(maxsize=1 << 16)
def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (length sum); bit-parallel LCS."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    s = (1 << len(a)) - 1
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u) | (s - u)
    lcs = len(a) - (s & ((1 << len(a)) - 1)).bit_count()
    return 2 * lcs / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and each side's shared words plus its own; 1 when one
    side's words are all in the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    best = indel_ratio(left, right)
    if both:
        best = max(best, indel_ratio(both, left), indel_ratio(both, right))
    return best


@lru_cache(maxsize=1 << 16)
def abbreviates(a: str, b: str) -> bool:
    if not a or len(a) > 0.7 * len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(ch in rest for ch in a)


def token_similarity(x: str, y: str) -> float:
    """1 for equal words, 0.8 for an abbreviation, else Jaro-Winkler."""
    if x == y:
        return 1.0
    return 0.8 if abbreviates(x, y) or abbreviates(y, x) else jaro_winkler_text(x, y)


def monge_elkan_words(a: list[str], b: list[str], weight: dict[str, float]) -> float | None:
    """Weighted mean over the words of a of the best similarity in b."""
    if not a or not b:
        return None
    w = [weight.get(x, 1.0) for x in a]
    total = sum(w)
    return sum(wx * max(token_similarity(x, y) for y in b) for wx, x in zip(w, a)) / total if total else None


def soft_tfidf_words(a: list[str], wa: dict[str, float], b: list[str], wb: dict[str, float], theta: float = 0.9) -> float | None:
    """Cosine of weighted word sets in which words of similarity ``theta`` count as shared."""
    x, y = sorted(set(a)), sorted(set(b))
    if not x or not y:
        return None
    size = np.sqrt(sum(wa.get(t, 1.0) ** 2 for t in x)) * np.sqrt(sum(wb.get(t, 1.0) ** 2 for t in y))
    if not size:
        return None
    total = 0.0
    for t in x:
        s, best = max((token_similarity(t, o), o) for o in y)
        if s >= theta:
            total += wa.get(t, 1.0) * wb.get(best, 1.0) * s
    return float(total / size)


def poisson_binomial(p: np.ndarray) -> np.ndarray:
    """Distribution of the number of successes."""
    out = np.ones(1)
    for x in p:
        out = np.convolve(out, [1 - x, x])
    return out


def expected_f05(p: np.ndarray, miss: float = 0.0, beta2: float = 0.25) -> np.ndarray:
    """E[F] of choosing the k most probable candidates, for k = 0 ... n; p falls.

    ``miss`` is the chance of one more true match outside the list.
    """
    n = len(p)
    out = np.empty(n + 1)
    out[0] = np.prod(1 - p) * (1 - miss)
    tails = [np.ones(1)]
    for x in p[::-1]:
        tails.append(np.convolve(tails[-1], [1 - x, x]))
    head = np.ones(1)
    for k in range(1, n + 1):
        head = np.convolve(head, [1 - p[k - 1], p[k - 1]])
        joint = np.convolve(head * np.arange(k + 1), tails[n - k])
        s = np.arange(len(joint))
        out[k] = (1 + beta2) * float((joint * ((1 - miss) / (beta2 * s + k) + miss / (beta2 * (s + 1) + k))).sum())
    return out


def decide(p: np.ndarray, miss: float = 0.0) -> int:
    """How many of the most probable candidates to take; the smaller set on ties."""
    return int(np.round(expected_f05(np.sort(p)[::-1], miss), 12).argmax()) if len(p) else 0


def decide_count(p: Column) -> Column:
    """How many to take of each list of probabilities."""

    def run(p: pa.Array) -> pa.Array:
        return pa.array([decide(np.array(x or [], dtype=float)) for x in p.to_pylist()], pa.int32())

    return F.arrow_udf(run, T.IntegerType())(p)


def collapse_runs(s: str) -> str:
    return "".join(k for k, _ in groupby(s))
