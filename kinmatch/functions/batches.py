"""The string kernels of ``kernels`` over whole Arrow batches, as Arrow UDFs.

Texts of a batch are told apart once; of each there are its characters as numbers and, by character,
a word of 64 bits that tells where it stands. All pairs of a batch then take a step together. Texts
of more than 64 characters or 32 words go one by one through ``kernels``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import kernels as K

#: Characters of a text and words of a list that a batch treats together with others.
CHARS, WORDS = 64, 32
#: Entries of a batch's table of characters; a batch that needs more is halved.
CELLS = 1 << 22
#: Between the items of a packed list, and between the lists of a packed record.
ITEM, LIST = "\x1f", "\x1e"
NUMBER = re.compile("[0-9]+")

_ONE, _ALL = np.uint64(1), np.uint64(2**64 - 1)
_BIT = _ONE << np.arange(64, dtype=np.uint64)
#: The lowest n bits, by n from 0 to 64.
_LOW = np.append(_BIT - _ONE, _ALL)
_STEPS = np.arange(64)
#: By reach + 1 and place: the places of the other text that are near enough.
_NEAR = np.array([[int(_LOW[min(64, i + r + 1)] & ~_LOW[max(0, i - r)]) if r >= 0 else 0 for i in _STEPS] for r in range(-1, 32)], dtype=np.uint64)


class Texts:
    """Distinct texts of at most 64 characters: sizes, characters as numbers, places by character."""

    def __init__(self, texts: list[str]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        there = np.zeros(int(chars.max(initial=0)) + 1, dtype=bool)
        there[chars] = True
        kinds = max(1, int(there.sum()))
        self.kinds, self.wide = kinds, int(self.size.max(initial=1))
        self.fits = len(texts) * kinds <= CELLS or len(texts) <= 2
        if not self.fits:
            return
        row = np.repeat(np.arange(len(texts)), self.size)
        at = np.arange(len(chars)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        code = (np.cumsum(there) - 1)[chars]
        self.code = np.zeros((len(texts), self.wide), dtype=np.int64)
        self.code[row, at] = code
        self.places = np.zeros(len(texts) * kinds, dtype=np.uint64)
        # places of one character differ, so their sum is their union
        np.add.at(self.places, row * kinds + code, _BIT[at])

    def steps(self, x: np.ndarray, y: np.ndarray):
        """Per place of the longest of ``x``: how many pairs still have one, and where its character stands in y. Sizes of x must fall."""
        fall, base = -self.size[x], y * self.kinds
        for i in range(int(self.size[x[0]]) if len(x) else 0):
            n = int(np.searchsorted(fall, -i, "left"))
            yield i, n, self.places[base[:n] + self.code[x[:n], i]]

    def shorter_first(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, order, swapped): both ends of each pair, the shorter one as x, by falling size of x."""
        swap = self.size[a] > self.size[b]
        x, y = np.where(swap, b, a), np.where(swap, a, b)
        order = np.argsort((CHARS - self.size[x]).astype(np.uint8), kind="stable")
        return x[order], y[order], order, swap[order]


def _placed(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[order] = values
    return out


def jaro_winkler_all(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``kernels.jaro_winkler_text`` of pairs of texts. Matches pair the first free places, from either
    end the same, so it is symmetric."""
    x, y, order, _ = t.shorter_first(a, b)
    lx, ly = t.size[x], t.size[y]
    reach = ly // 2
    used, hit = np.zeros(len(x), np.uint64), np.zeros(len(x), np.uint64)
    seen = []
    for i, n, place in t.steps(x, y):
        free = place & _NEAR[:, i][reach[:n]] & ~used[:n]
        low = free & (~free + _ONE)
        used[:n] |= low
        hit[:n] |= (low != 0).astype(np.uint64) << np.uint64(i)
        seen.append(place)
    m = np.bitwise_count(used).astype(np.int64)
    swapped = np.zeros(len(x), np.int64)
    for i, place in enumerate(seen):
        n = len(place)
        mine = (hit[:n] >> np.uint64(i)) & _ONE != 0
        low = used[:n] & (~used[:n] + _ONE)
        swapped[:n] += mine & (place & low == 0)
        used[:n] ^= np.where(mine, low, np.uint64(0))
    some = m > 0
    d = np.where(some, m, 1)
    jaro = np.where(some, (m / np.maximum(lx, 1) + m / np.maximum(ly, 1) + (m - swapped // 2) / d) / 3, 0.0)
    high = np.flatnonzero(jaro > 0.7)
    if len(high):
        p, q, same, on = x[high], y[high], np.zeros(len(high), np.int64), np.ones(len(high), bool)
        for k in range(min(4, t.wide)):
            on &= (t.code[p, k] == t.code[q, k]) & (lx[high] > k)
            same += on
        jaro[high] += 0.1 * same * (1 - jaro[high])
    jaro[(x == y) & (lx > 0)] = 1.0
    return _placed(jaro, order)


def lcs_all(t: Texts, a: np.ndarray, b: np.ndarray, keep_a: np.ndarray | None = None, keep_b: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the longest common subsequences of pairs of texts, or of the places kept of them."""
    x, y, order, swap = t.shorter_first(a, b)
    s = np.full(len(x), _ALL)
    if keep_a is not None:
        keep_a, keep_b = keep_a[order], keep_b[order]
        kx, ky = np.where(swap, keep_b, keep_a), np.where(swap, keep_a, keep_b)
    for i, n, place in t.steps(x, y):
        u = s[:n] & place
        if keep_a is not None:
            u &= ky[:n] & (~((kx[:n] >> np.uint64(i)) & _ONE) + _ONE)
        s[:n] = (s[:n] + u) | (s[:n] - u)
    return _placed(np.bitwise_count(~s).astype(np.int64), order)


def similarity_all(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``kernels.token_similarity`` of pairs of words."""
    out = jaro_winkler_all(t, a, b)
    swap = t.size[a] > t.size[b]
    out[abbreviates_all(t, np.where(swap, b, a), np.where(swap, a, b))] = 0.8
    out[a == b] = 1.0
    return out


def _coded(a: pa.Array, b: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct texts of both, and which of them each row has; null is the empty text."""
    both = pa.concat_arrays([pc.fill_null(a, "").cast(pa.large_string()), pc.fill_null(b, "").cast(pa.large_string())]).dictionary_encode()
    at = both.indices.to_numpy().astype(np.int64)
    return both.dictionary, at[: len(a)], at[len(a) :]


def _halves(fn: Callable, a, b, *more):
    k = len(a) // 2
    return np.concatenate([fn(a[:k], b[:k], *more), fn(a[k:], b[k:], *more)])


def _of_texts(whole: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray], one: Callable[[str, str], float], form: Callable[[str], str] | None = None):
    """The measure of two columns of texts: of all pairs in ``whole``, of long texts in ``one``."""

    def run(a: pa.Array, b: pa.Array) -> np.ndarray:
        d, i, j = _coded(a, b)
        raw = d.to_pylist()
        texts = [form(s) for s in raw] if form else raw
        long = np.fromiter((len(s) > CHARS for s in texts), bool, len(texts))
        t = Texts(["" if z else s for s, z in zip(texts, long)] if long.any() else texts)
        if not t.fits:
            return _halves(run, a, b)
        out, far = np.empty(len(i)), long[i] | long[j]
        at = np.flatnonzero(~far)
        out[at] = whole(t, i[at], j[at])
        for k in np.flatnonzero(far):
            out[k] = one(raw[i[k]], raw[j[k]])
        return out

    return run


def _indel_all(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = t.size[a] + t.size[b]
    return np.where(total > 0, 2 * lcs_all(t, a, b) / np.maximum(total, 1), 1.0)


jaro_winkler_batch = _of_texts(jaro_winkler_all, K.jaro_winkler_text)
token_sort_batch = _of_texts(_indel_all, K.token_sort_ratio, lambda s: " ".join(sorted(s.split())))


def _padded(values: np.ndarray, sizes: np.ndarray, wide: int, fill) -> np.ndarray:
    """Rows of ``values``, one after another, of so many each, as a matrix."""
    out = np.full((len(sizes), wide), fill, dtype=values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _equal(wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words of either side the other has too; -1 stands for none."""
    of_a, of_b = np.zeros(wa.shape, bool), np.zeros(wb.shape, bool)
    for k in range(wa.shape[1]):
        same = (wb == wa[:, k, None]) & (wa[:, k, None] >= 0)
        of_a[:, k] = same.any(1)
        of_b |= same
    return of_a, of_b


def token_set_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """``kernels.token_set_ratio``: the shared words are a prefix of both, so only the others are compared."""
    d, i, j = _coded(a, b)
    raw = d.to_pylist()
    words = [sorted(set(s.split())) for s in raw]
    texts = [" ".join(w) for w in words]
    long = np.fromiter((len(s) > CHARS for s in texts), bool, len(texts))
    if long.any():
        words, texts = [[] if z else w for w, z in zip(words, long)], ["" if z else s for s, z in zip(texts, long)]
    t = Texts(texts)
    if not t.fits:
        return _halves(token_set_batch, a, b)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat, ids = [w for ws in words for w in ws], {}
    number = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, len(flat))
    chars = np.fromiter(map(len, flat), np.int64, len(flat))
    wide = int(sizes.max(initial=1)) or 1
    word, char = _padded(number, sizes, wide, -1), _padded(chars, sizes, wide, 0)
    end = np.cumsum(char + 1, axis=1) - 1
    # a word's places and the one before it
    mask = np.where(word >= 0, _LOW[np.minimum(end, CHARS)] & ~_LOW[np.clip(end - char - 1, 0, CHARS)], np.uint64(0))
    wa, wb = word[i], word[j]
    of_a, of_b = _equal(wa, wb)

    def others(at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        keep = np.bitwise_or.reduce(np.where(shared, np.uint64(0), mask[at]), axis=1)
        return np.where(shared[:, 0], keep & (keep - (keep != 0).astype(np.uint64)), keep)

    ka, kb = others(i, of_a), others(j, of_b)
    both = (of_a * (char[i] + 1)).sum(1)  # with the space after them
    only_a, only_b = np.bitwise_count(ka).astype(np.int64), np.bitwise_count(kb).astype(np.int64)
    left, right = both + only_a, both + only_b
    some = (left > 0) & (right > 0)
    best = 2 * (both + lcs_all(t, i, j, ka, kb)) / np.maximum(left + right, 1)
    short = 2 * (both - 1)
    for side in (left, right):
        best = np.where(both > 0, np.maximum(best, short / np.maximum(both - 1 + side, 1)), best)
    out = np.where((both > 0) & ((only_a == 0) | (only_b == 0)), 1.0, best)
    out[(sizes[i] == 0) | (sizes[j] == 0) | ~some] = 0.0
    for k in np.flatnonzero(long[i] | long[j]):
        out[k] = K.token_set_ratio(raw[i[k]], raw[j[k]])
    return out


def alias_batch(a: pa.Array, b: pa.Array) -> pa.Array:
    """Best token-set ratio over two packed lists of aliases; null if either is empty."""
    d, i, j = _coded(a, b)
    lists = pc.split_pattern(d, ITEM)
    n = np.where(pc.equal(d, "").to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
    flat, start = lists.flatten(), lists.offsets.to_numpy()[:-1]
    times = n[i] * n[j]
    row, step = np.repeat(np.arange(len(i)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    p, q = start[i][row] + step // n[j][row], start[j][row] + step % n[j][row]
    best = np.full(len(i), -1.0)
    for k in range(0, len(row), CELLS >> 6):
        part = slice(k, k + (CELLS >> 6))
        np.maximum.at(best, row[part], token_set_batch(flat.take(pa.array(p[part])), flat.take(pa.array(q[part]))))
    return pa.array(best, mask=times == 0)


def _records(d: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(words a record, their texts, weights, counts) of packed records."""
    parts = pc.split_pattern(d, LIST)
    flat = parts.flatten()
    some = np.diff(parts.offsets.to_numpy()) == 3
    lists = [pc.split_pattern(flat.take(pa.array(parts.offsets.to_numpy()[:-1][some] + k)), ITEM) for k in range(3)]
    sizes = np.zeros(len(d), np.int64)
    sizes[some] = np.diff(lists[0].offsets.to_numpy())
    return sizes, lists[0].flatten(), lists[1].flatten().cast(pa.float64()).to_numpy(), lists[2].flatten().cast(pa.float64()).to_numpy()


def words_batch(a: pa.Array, b: pa.Array, both: bool = True) -> np.ndarray:
    """Columns of Monge-Elkan from a and, if ``both``, from b, and the soft cosine; NaN is undefined."""
    d, i, j = _coded(a, b)
    sizes, texts, weight, count = _records(d)
    coded = texts.dictionary_encode()
    words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    wordy = np.fromiter((len(w) > CHARS for w in words), bool, len(words))
    long = sizes > WORDS
    long[np.repeat(np.arange(len(sizes)), sizes)[wordy[number]]] = True
    t = Texts(["" if z else w for w, z in zip(words, wordy)])
    if not t.fits and len(i) > 1:
        return _halves(words_batch, a, b, both)
    out = np.full((len(i), 3 if both else 1), np.nan)
    far = long[i] | long[j]
    here = np.repeat(~long, sizes)
    few = np.where(long, 0, sizes)
    wide = int(few.max(initial=1)) or 1
    word, w, times = (_padded(x[here], few, wide, fill) for x, fill in ((number, -1), (weight, 0.0), (count, 0.0)))
    at = np.flatnonzero(~far & (sizes[i] > 0) & (sizes[j] > 0))
    if len(at):
        out[at] = _measured(t, words, word, w, times, i[at], j[at], both)
    for k in np.flatnonzero(far):
        (x, wx, nx), (y, wy, ny) = (([words[m] for m in number[s : s + n]], weight[s : s + n], count[s : s + n].astype(int)) for s, n in ((first[r], sizes[r]) for r in (i[k], j[k])))
        p, q = dict(zip(x, wx)), dict(zip(y, wy))
        xs, ys = ([v for v, c in zip(*of) for _ in range(c)] for of in ((x, nx), (y, ny)))
        got = (K.monge_elkan_words(xs, ys, p), K.monge_elkan_words(ys, xs, q), K.soft_tfidf_words(xs, p, ys, q)) if both else (K.monge_elkan_words(xs, ys, p),)
        out[k] = [np.nan if v is None else v for v in got]
    return out


def _measured(t: Texts, words: list[str], word, w, times, i, j, both: bool, theta: float = 0.9) -> np.ndarray:
    wa, wb = word[i], word[j]
    of_a, of_b = _equal(wa, wb)
    there = wb >= 0
    rows, cols = [], []
    for k in range(wa.shape[1]):
        # equal words have the best there is; a pair of words counts where one of them has no equal
        lone = ~of_a[:, k] & (wa[:, k] >= 0)
        need = there & (lone[:, None] | ((wa[:, k] >= 0)[:, None] & ~of_b & (wb != wa[:, k, None]))) if both else there & lone[:, None]
        at = np.flatnonzero(need)
        rows.append(at)
        cols.append(np.full(len(at), k))
    flat, k = np.concatenate(rows), np.concatenate(cols)
    row, c = flat // wb.shape[1], flat % wb.shape[1]
    x, y = wa[row, k], wb[row, c]
    key, back = np.unique(np.minimum(x, y) * len(words) + np.maximum(x, y), return_inverse=True)
    got = similarity_all(t, key // len(words), key % len(words))[back]
    s = np.full((len(i), wa.shape[1], wb.shape[1]), -1.0)
    s[row, k, c] = got
    best_a = np.where(of_a, 1.0, s.max(2))
    with np.errstate(invalid="ignore", divide="ignore"):
        load = w * times
        total = load.sum(1)
        mean = lambda at, best, has: np.where(total[at] != 0, (load[at] * np.where(has, best, 0.0)).sum(1) / total[at], np.nan)
        out = [mean(i, best_a, wa >= 0)]
        if both:
            out.append(mean(j, np.where(of_b, 1.0, s.max(1)), there))
            norm = np.sqrt((w * w).sum(1))
            soft = np.zeros(len(i))
            for k in range(wa.shape[1]):
                at = np.flatnonzero((best_a[:, k] >= theta) & (wa[:, k] >= 0))
                same = np.where(of_a[at, k, None], wb[at] == wa[at, k, None], s[at, k] == best_a[at, k, None]) & there[at]
                c = same.argmax(1)
                for r in np.flatnonzero(same.sum(1) > 1):
                    c[r] = max(np.flatnonzero(same[r]), key=lambda v: words[wb[at[r], v]])
                soft[at] += w[i[at], k] * w[j[at], c] * best_a[at, k]
            size = norm[i] * norm[j]
            out.append(np.where(size != 0, soft / size, np.nan))
    return np.stack(out, 1)


def _sides(a: pa.Array, b: pa.Array):
    """Both sides' words as numbers, weights and which of them the other side has, with the texts of the numbers, in parts that stay small."""
    d, i, j = _coded(a, b)
    sizes, texts, weight, count = _records(d)
    coded = texts.dictionary_encode()
    number, wide = coded.indices.to_numpy().astype(np.int64), int(sizes.max(initial=1)) or 1
    if len(i) > 1 and max(len(d), len(i)) * wide > CELLS:
        k = len(i) // 2
        yield from _sides(a[:k], b[:k])
        yield from _sides(a[k:], b[k:])
        return
    word, w, times = (_padded(x, sizes, wide, fill) for x, fill in ((number, -1), (weight, 0.0), (count, 0.0)))
    wa, wb = word[i], word[j]
    yield coded.dictionary.to_pylist(), (wa, w[i], times[i]), (wb, w[j], times[j]), _equal(wa, wb)


def shared_batch(a: pa.Array, b: pa.Array, heavy: float) -> np.ndarray:
    """Columns of either side's weight, of the weight of its words that the other has, and of its lone
    words of weight ``heavy`` at least that are no numbers."""
    out = []
    for words, (wa, va, _), (wb, vb, _), (of_a, of_b) in _sides(a, b):
        plain = np.array([not NUMBER.fullmatch(x) for x in words] + [False])  # -1 is the last
        lone = lambda x, v, of: np.where(~of & plain[x] & (v >= heavy), v, 0.0).sum(1)
        out.append(np.stack([va.sum(1), vb.sum(1), np.where(of_a, va, 0.0).sum(1), np.where(of_b, vb, 0.0).sum(1), lone(wa, va, of_a), lone(wb, vb, of_b)], 1))
    return np.concatenate(out)


def abbreviates_all(t: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``kernels.abbreviates`` of pairs of words, the first of the second."""
    out = np.zeros(len(x), bool)
    short = np.flatnonzero((t.size[x] > 0) & (t.size[x] <= 0.7 * t.size[y]) & (t.code[x, 0] == t.code[y, 0]))
    short = short[np.argsort(-t.size[x[short]], kind="stable")]
    rest, on = np.full(len(short), _ALL), np.ones(len(short), bool)
    for _, n, place in t.steps(x[short], y[short]):
        left = place & rest[:n]
        low = left & (~left + _ONE)
        on[:n] &= low != 0
        rest[:n] = ~(low | (low - _ONE))
    out[short[on]] = True
    return out


def lone_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Columns of how many words of weight 0 either side has that the other lacks, abbreviations of either kind included."""
    out = []
    for words, (wa, va, _), (wb, vb, _), (of_a, of_b) in _sides(a, b):
        open_a, open_b = (wa >= 0) & (va == 0) & ~of_a, (wb >= 0) & (vb == 0) & ~of_b
        rows, cols = [], []
        for k in range(wa.shape[1]):
            at = np.flatnonzero((wb >= 0) & (wa[:, k, None] >= 0) & (open_a[:, k, None] | open_b))
            rows.append(at)
            cols.append(np.full(len(at), k))
        flat, k = np.concatenate(rows), np.concatenate(cols)
        row, c = flat // wb.shape[1], flat % wb.shape[1]
        x, y = wa[row, k], wb[row, c]
        first, size = np.array([ord(z[:1] or "\0") for z in words]), np.array([len(z) for z in words])
        near = np.flatnonzero((x != y) & (first[x] == first[y]) & (np.minimum(size[x], size[y]) <= 0.7 * np.maximum(size[x], size[y])))
        row, k, c, x, y = (z[near] for z in (row, k, c, x, y))
        x, y = np.where(size[x] > size[y], y, x), np.where(size[x] > size[y], x, y)
        key, back = np.unique(x * len(words) + y, return_inverse=True)
        x, y = key // max(1, len(words)), key % max(1, len(words))
        hit, far = np.zeros(len(key), bool), size[y] > CHARS
        t = Texts(["" if n > CHARS else z for z, n in zip(words, size)])
        at = np.flatnonzero(~far) if t.fits else np.zeros(0, np.int64)
        hit[at] = abbreviates_all(t, x[at], y[at]) if len(at) else False
        for n in np.flatnonzero(far) if t.fits else range(len(key)):
            hit[n] = K.abbreviates(words[x[n]], words[y[n]])
        yes = hit[back]
        open_a[row[yes], k[yes]] = False
        open_b[row[yes], c[yes]] = False
        out.append(np.stack([open_a.sum(1), open_b.sum(1)], 1))
    return np.concatenate(out)


# ---- columns
def pack(words: list[str], weight: dict[str, float]) -> str:
    """Distinct words, their weights, 1 where there is none, and how often each occurs, as one text."""
    times = Counter(words)
    return LIST.join(ITEM.join(x) for x in (times, [repr(float(weight.get(t, 1.0))) for t in times], map(str, times.values()))) if words else ""


def packed(words: Column, weight: Column, numbers: bool = True) -> Column:
    """A list of words, or those of it that are no ``numbers``, and a map of word weights as one text, for ``monge_elkan`` and ``word_measures``."""

    def run(words: pa.Array, weight: pa.Array) -> pa.Array:
        rows = zip(words.to_pylist(), weight.to_pylist())
        return pa.array([pack([t for t in x or () if numbers or not NUMBER.fullmatch(t)], {e["key"]: e["value"] for e in w or ()}) for x, w in rows], pa.string())

    return F.arrow_udf(run, T.StringType())(words, F.map_entries(weight))


def packed_list(items: Column) -> Column:
    return F.array_join(items, ITEM)


def _over_texts(batch):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(batch(a, b), pa.float64())

    return F.arrow_udf(run, T.DoubleType())


def jaro_winkler(a: Column, b: Column) -> Column:
    return _over_texts(jaro_winkler_batch)(a, b)


def token_sort(a: Column, b: Column) -> Column:
    return _over_texts(token_sort_batch)(a, b)


def token_set(a: Column, b: Column) -> Column:
    return _over_texts(token_set_batch)(a, b)


def alias_best(a: Column, b: Column) -> Column:
    return _over_texts(alias_batch)(a, b)


def _defined(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def monge_elkan(a: Column, b: Column) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _defined(words_batch(a, b, False)[:, 0])

    return F.arrow_udf(run, T.DoubleType())(a, b)


def word_measures(a: Column, b: Column) -> Column:
    """A struct of Monge-Elkan from either side, ``me_12`` and ``me_21``, and of ``softtfidf``."""
    names = ("me_12", "me_21", "softtfidf")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_defined(c) for c in words_batch(a, b).T.copy()], names)

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(a, b)


def _nullable(x: np.ndarray, own: pa.Array, other: pa.Array, kind: pa.DataType) -> pa.Array:
    """Null where the own list is, 0 where only the other is."""
    mine, theirs = own.is_null().to_numpy(zero_copy_only=False), other.is_null().to_numpy(zero_copy_only=False)
    return pa.array(np.where(theirs, 0, x), kind, mask=mine)


def shared_weights(a: Column, b: Column, heavy: float) -> Column:
    """A struct of ``shared_batch``: totals ``wa``, ``wb``, shared ``sa``, ``sb``, lone heavy ones ``la``, ``lb``."""
    names = ("wa", "wb", "sa", "sb", "la", "lb")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        got = shared_batch(a, b, heavy) if len(a) else np.zeros((0, 6))
        none = pa.array(np.zeros(len(a)))
        sides = ((a, none), (b, none), (a, b), (b, a), (a, b), (b, a))
        return pa.StructArray.from_arrays([_nullable(got[:, k], *side, pa.float64()) for k, side in enumerate(sides)], names)

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(a, b)


def lone_words(a: Column, b: Column) -> Column:
    """A struct of ``lone_batch``: ``only_1`` and ``only_2``."""
    names = ("only_1", "only_2")

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        got = lone_batch(a, b) if len(a) else np.zeros((0, 2), np.int64)
        return pa.StructArray.from_arrays([_nullable(got[:, 0], a, b, pa.int32()), _nullable(got[:, 1], b, a, pa.int32())], names)

    return F.arrow_udf(run, T.StructType([T.StructField(n, T.IntegerType()) for n in names]))(a, b)


def packed_map(weight: Column) -> Column:
    """A map of word weights as one text, for ``shared_weights``."""

    def run(weight: pa.Array) -> pa.Array:
        return pa.array([None if w is None else pack([e["key"] for e in w], {e["key"]: e["value"] for e in w}) for w in weight.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())(F.map_entries(weight))


def packed_flags(words: Column, marked: Column) -> Column:
    """A list of words as one text, 1 for those ``marked`` and 0 for others, for ``lone_words``."""

    def run(words: pa.Array, marked: pa.Array) -> pa.Array:
        rows = zip(words.to_pylist(), marked.to_pylist())
        return pa.array([None if x is None else pack(x, {t: float(t in (m or ())) for t in x}) for x, m in rows], pa.string())

    return F.arrow_udf(run, T.StringType())(words, marked)
