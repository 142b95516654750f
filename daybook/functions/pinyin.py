"""Syllables of Chinese characters, from the transliterator in Spark's own class path.

The driver asks it once per session for every character from U+4E00 to U+9FFF; the answer,
tones removed, goes into expressions as one ``translate``: each character is replaced by a
private-use letter, whose code is the place of its syllable in a literal array of the about
400 syllables. Polyphones get their first reading.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FIRST, LAST = 0x4E00, 0x9FFF
#: Private-use letters, one per syllable.
PRIVATE = 0xE000


@lru_cache(maxsize=1)
def syllables() -> dict[str, str]:
    """Character to syllable; empty where the transliterator is missing."""
    spark = SparkSession.active()
    try:
        maker = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin")
    except Exception:
        return {}
    chars = [chr(c) for c in range(FIRST, LAST + 1)]
    spelt = maker.transliterate("|".join(chars)).split("|")
    out = {}
    for char, s in zip(chars, spelt, strict=True):
        plain = "".join(c for c in unicodedata.normalize("NFD", s.strip().replace("ü", "v")) if not unicodedata.combining(c))
        if plain.isascii() and plain.isalpha():
            out[char] = plain.lower()
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, tuple[str, ...]]:
    known = syllables()
    names = sorted(set(known.values()))
    letter = {s: chr(PRIVATE + i) for i, s in enumerate(names)}
    return "".join(known), "".join(letter[s] for s in known.values()), tuple(names)


def spelt(name: Column) -> Column:
    """``name`` with each known character as its syllable. Names without any cost one
    regular expression."""
    chars, letters, names = _tables()
    if not chars:
        return name
    table = F.array(*map(F.lit, names))

    def one(c: Column) -> Column:
        place = F.ascii(c) - PRIVATE
        return F.when(place.between(0, len(names) - 1), F.get(table, place)).otherwise(c)

    whole = F.array_join(F.transform(F.split(F.translate(name, chars, letters), ""), one), "")
    return F.when(name.rlike("[\u4e00-\u9fff]"), whole).otherwise(name)
