"""Text normalisation as Column builders; every function takes and returns Columns.

Missing text is the empty string throughout. ``fold_latin`` stays in whole-stage code and covers
Latin letters; records in other scripts pass ``kinmatch.functions.romanise.romanised`` first, which
the chain sees to, so all functions here meet Latin letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to, letter for letter.
ACCENTED = "àáâãäåāăąçćčďđèéêëēęěğìíîïīįıłñńňòóôõöøōőŕřśşšťţùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeegiiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"
#: Letters that fold to two.
LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))

# Rules and patterns that results depend on.
SKELETON_RULES = (
    ("ph", "f"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"),
    ("th", "t"), ("dh", "d"), ("bh", "b"),
    ("q", "k"), ("c", "k"), ("x", "ks"), ("w", "v"), ("z", "s"), ("y", "i"),
)
TLDS = (
    "com|net|org|co|io|biz|info|me|online|site|shop|store"
    "|in|fr|us|uk|de|es|it|nl|ca|au|jp|cn|br|ae|sg|za|ru|se|ch|be|pl|mx|id"
)
DOMAIN = r"\b(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]{2,})\.(?:" + TLDS + r")\b"
ALIAS_SPLIT = r"\s+\|\s+|\s+(?:dba|d/b/a|t/a)\s+"
JUNK = r"<\s*null\s*>|#{2,}"
NULL_WORD = r"\bnull\b"
BRACKETS, LEADING = r"[\[\](){}]", r"^[\W_]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold_latin(c: Column) -> Column:
    """Lower case without accents."""
    out = F.lower(_text(c))
    for a, b in LIGATURES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, ACCENTED, PLAIN)


def has_native_script(c: Column) -> Column:
    return _text(c).rlike("[^\\u0000-\\u024F]")


def words_of(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), 0)


def drop_adjacent(words: Column) -> Column:
    """Array without elements that equal the one before."""
    pairs = F.arrays_zip(words.alias("w"), F.concat(F.array(F.lit(None).cast("string")), words).alias("p"))
    kept = F.filter(pairs, lambda x: x["w"].isNotNull() & ~x["w"].eqNullSafe(x["p"]))
    return F.transform(kept, lambda x: x["w"])


def tokens(c: Column) -> Column:
    return drop_adjacent(words_of(fold_latin(c)))


def clean_text(c: Column) -> Column:
    """Folded words without placeholders, repeats kept, one blank between."""
    s = F.regexp_replace(fold_latin(c), JUNK, " ")
    s = F.regexp_replace(s, NULL_WORD, " ")
    return F.array_join(words_of(s), " ")


def is_domain_name(c: Column) -> Column:
    return fold_latin(c).rlike(DOMAIN)


def name_aliases(c: Column) -> Column:
    """Trading names, parts and domain labels of a name, in order, without repeats."""
    s = F.regexp_replace(fold_latin(c), JUNK, " ")
    s = F.regexp_replace(s, BRACKETS, " ")
    s = F.regexp_replace(s, LEADING, " ")

    def of_part(part: Column) -> Column:
        label = F.replace(F.regexp_extract(part, DOMAIN, 1), F.lit("-"), F.lit(" "))
        single = F.size(F.filter(F.split(part, r"\s+"), lambda w: w != "")) == 1
        rest = F.regexp_replace(part, DOMAIN, " ")
        return (
            F.when(label == "", F.array(part))
            .when(single, F.array(label))
            .otherwise(F.array(rest, label))
        )

    parts = F.flatten(F.transform(F.split(s, ALIAS_SPLIT), of_part))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.array_join(tokens(p), " ")), lambda p: p != ""))


def house_numbers(c: Column) -> Column:
    """Distinct digit runs without leading zeros; both ends of a range are runs of their own."""
    runs = F.regexp_extract_all(fold_latin(c), F.lit(r"\d+"), 0)
    return F.array_distinct(F.transform(runs, lambda n: F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), F.lit("0"))))


def is_abbrev(a: Column, b: Column) -> Column:
    """a abbreviates b: same first letter, a subsequence, at most 70 % of the length."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(a, "(.)", "$1.*"))
    return (
        (F.length(a) > 0)
        & (F.length(a) <= 0.7 * F.length(b))
        & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
        & F.regexp_like(b, pattern)
    )


def skeleton(c: Column) -> Column:
    return skeleton_of_folded(fold_latin(c))


def skeleton_of_folded(s: Column) -> Column:
    """Consonants of a folded text after the letter rules, runs and blanks collapsed."""
    for a, b in SKELETON_RULES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(F.regexp_replace(s, "[aeiou]", ""), "[^a-z0-9 ]", " ")
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(s: Column, n: int) -> Column:
    """All runs of n characters, over an array of them: places in a string are counted from its
    start each time."""

    def of(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))

    return _let(F.split(s, ""), of)


def char_ngrams(s: Column, n: int = 3) -> Column:
    """Set of n-grams; a shorter text whole; nothing of an empty one."""
    none = F.array().cast("array<string>")
    return _let(s, lambda x: F.when(F.length(x) == 0, none).when(F.length(x) < n, F.array(x)).otherwise(F.array_distinct(_windows(x, n))))


def char_wb_ngrams(s: Column, n: int = 4) -> Column:
    """Bag of n-grams within words, each word padded with a blank on both sides."""

    def of_word(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        return F.when(F.length(p) <= n, F.array(p)).otherwise(_windows(p, n))

    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, of_word))


def word_ngrams(s: Column, n: int = 1) -> Column:
    """Word n-grams; a text of fewer words whole."""
    split = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    if n == 1:
        return split

    def of(words: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) == 0, words).when(F.size(words) < n, F.array(F.array_join(words, " "))).otherwise(grams)

    return _let(split, of)


def analyse(s: Column, kind: str, n: int) -> Column:
    """Terms of a view: char, word, or char+word."""
    if kind == "char":
        return char_wb_ngrams(s, n)
    if kind == "word":
        return word_ngrams(s, n)
    if kind == "char+word":
        return F.concat(word_ngrams(s, 1), char_wb_ngrams(s, n))
    raise ValueError(f"unknown kind of terms: {kind}")


def make_view(view: str, name: Column, addr: Column) -> Column:
    """The text of a record that a view indexes."""
    views = {
        "index": lambda: F.concat_ws(" ", clean_text(name), clean_text(addr)),
        "name": lambda: clean_text(name),
        "addr": lambda: clean_text(addr),
        "skeleton": lambda: skeleton(F.concat_ws(" ", clean_text(name), clean_text(addr))),
        "skelname": lambda: skeleton(clean_text(name)),
    }
    if view not in views:
        raise ValueError(f"unknown view: {view}")
    return views[view]()


def index_view(name: Column) -> Column:
    """All aliases of a name, separated by bars."""
    return F.concat_ws(" | ", name_aliases(name))


def skeleton_view(name: Column) -> Column:
    return F.concat_ws(" | ", F.transform(name_aliases(name), skeleton_of_folded))


def stable_hash(c: Column) -> Column:
    return F.crc32(_text(c).cast("binary"))


def hash64(c: Column) -> Column:
    """Two salted crc32 values as one signed 64-bit number."""
    low = F.crc32(F.concat(_text(c).cast("binary"), F.lit("\0salt").cast("binary")))
    return F.shiftleft(F.crc32(_text(c).cast("binary")), 32).bitwiseOR(low)


def serialise(name: Column, addr: Column, country: Column) -> Column:
    """One record as one line of marked fields."""
    folded, raw = clean_text(name), F.trim(_text(name))
    echo = F.when((folded != "") & (folded != F.lower(raw)), F.concat(F.lit(" ("), folded, F.lit(")"))).otherwise("")
    nums = F.coalesce(F.nullif(F.array_join(F.array_sort(house_numbers(addr)), " "), F.lit("")), F.lit("-"))
    where = F.coalesce(F.nullif(F.trim(_text(addr)), F.lit("")), F.lit("-"))
    return F.concat(F.lit("name: "), raw, echo, F.lit(" | nums: "), nums, F.lit(" | addr: "), where, F.lit(" | country: "), _text(country))


def pair_text(a: Column, b: Column) -> Column:
    return F.concat_ws(" [SEP] ", a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null when either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """The same of two arrays that repeat nothing, so that their union need not be made."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared))
