"""Romanisation of any script from the names of its characters, as Arrow UDFs.

No table of letters: Unicode names tell the sound ("DEVANAGARI LETTER KA" is "ka", "CYRILLIC SMALL
LETTER ZHE" is "zhe"). In Brahmic scripts a consonant's inherent vowel gives way to a vowel sign
or a virama. Approximate where names and sounds part, which a consonant skeleton forgives.
"""

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions import text as X

_LETTER = re.compile(r"(?:LETTER|SYLLABLE|IDEOGRAPH|DIGIT) (?:FINAL |SMALL |VOCALIC )?([A-Z]+)")
_BRAHMIC = re.compile(r"^(DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM|SINHALA) ")


@lru_cache(maxsize=1 << 16)
def _sound(ch: str) -> tuple[str, str]:
    """(kind, sound): consonant of a Brahmic script, its vowel sign, its virama, or plain."""
    name = unicodedata.name(ch, "")
    brahmic = _BRAHMIC.match(name)
    if brahmic and "VIRAMA" in name:
        return "virama", ""
    if brahmic and "VOWEL SIGN" in name:
        return "sign", name.split("VOWEL SIGN ")[1].split()[-1].lower()
    if brahmic and ("ANUSVARA" in name or "CANDRABINDU" in name):
        return "plain", "n"
    digit = unicodedata.digit(ch, None)
    if digit is not None:
        return "plain", str(digit)
    m = _LETTER.search(name)
    if not m:
        return "plain", ch if ord(ch) < 128 else ""
    sound = m.group(1).lower()
    if brahmic and len(sound) > 1 and sound.endswith("a") and sound[0] not in "aeiou":
        return "consonant", sound
    return "plain", sound


def fold_text(s: str | None) -> str:
    """Compatibility form, accents stripped, other scripts romanised, lower case."""
    if not s:
        return ""
    out: list[str] = []
    bare = False  # the last consonant may still lose its vowel
    for ch in unicodedata.normalize("NFKC", s):
        if ord(ch) < 128:
            out.append(ch)
            bare = False
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain and plain.isascii():
            out.append(plain)
            bare = False
            continue
        if ch in "ßæœÆŒøØđĐłŁ":
            out.append({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l"}[ch.lower()])
            bare = False
            continue
        kind, sound = _sound(ch)
        if kind in ("virama", "sign"):
            if bare:
                out[-1] = out[-1][:-1]
            out.append(sound)
            bare = False
        else:
            out.append(sound)
            bare = kind == "consonant"
    return "".join(out).lower()


def fold_full(c: Column) -> Column:
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else fold_text(x) for x in s.to_pylist()], pa.string())

    return F.arrow_udf(run, T.StringType())(c)


def romanised(rec: DataFrame) -> DataFrame:
    """Records with name and addr in Latin letters, and ``native``: whether either was not.

    Only texts in other scripts are handed to Python; all others pass as nulls and stay as they are.
    """
    out = {"native": X.has_native_script(F.col("name")) | X.has_native_script(F.col("addr"))}
    for c in ("name", "addr"):
        raw = F.col(c)
        out[c] = F.coalesce(fold_full(F.when(X.has_native_script(raw), raw)), raw)
    return rec.withColumns(out)
