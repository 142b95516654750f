"""Text functions as Column expressions; similarity by matching blocks as an Arrow UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook import vocab

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def strip(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)^\\s+", ""), "(?U)\\s+$", "")


def in_list(c: Column, words: tuple | list) -> Column:
    return c.isin(*words)


def contains_any(c: Column, words: tuple) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def compact_name(raw: Column, most: int = 40, stripped: bool = False) -> Column:
    """Up to the first mark that ends a clause at place 5..most+1 (marks in order of rank,
    not of place), or cut hard with an ellipsis. ``raw`` is read several times: give a
    column or a lambda's variable, not a long expression."""
    s = raw if stripped else strip(raw)
    out = F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most - 1)), F.lit("…"))).otherwise(s)
    for mark in reversed(("。", "；", "，", ", ", "; ")):
        at = F.locate(mark, s) - 1
        out = F.when((at > 4) & (at <= most), F.left(s, at)).otherwise(out)
    return out


def slug(name: Column) -> Column:
    """Latin letters and digits; Chinese characters by their syllable without tone, runs of
    others as one underscore; at most 30 letters.

    Syllables are spelt one character at a time with two ``translate`` calls per letter
    place, from tables that the driver makes (see ``daybook.functions.pinyin``)."""
    from daybook.functions.pinyin import spelt

    plain = F.regexp_replace(F.lower(spelt(name)), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, 30)


def entity_id(kind: Column, name: Column) -> Column:
    prefix = kind
    for k, v in vocab.ID_PREFIX.items():
        prefix = F.when(kind == k, F.lit(v)).otherwise(prefix)
    return F.concat(prefix, F.lit(":"), slug(name))


def is_garbage_text(text: Column) -> Column:
    """An item left by the note-taking process, not knowledge."""
    s = strip(text)
    pattern = "(?d)" + "|".join(f"(?:{p})" for p in vocab.GARBAGE_PATTERNS)
    ops = s.rlike(vocab.OPS_KEYWORDS) & (F.length(s) < 200)
    return in_list(s, vocab.GARBAGE_NAMES) | (F.length(s) <= 2) | s.rlike(pattern) | ops


def is_garbage_name(name: Column) -> Column:
    s = strip(name)
    number = F.regexp_replace(s, "[.-]", "").rlike("^\\d+$")
    marked = s.startswith("**") | s.startswith("：")
    shapes = s.rlike(vocab.CLOCK_UTC) | s.rlike(vocab.CLOCK_BRACKET) | s.rlike(vocab.NAME_PUNCTUATION) | s.rlike(vocab.DURATION)
    return in_list(s, vocab.GARBAGE_NAMES) | (F.length(s) <= 1) | number | marked | shapes


def tokens(text: Column) -> Column:
    """Distinct Latin tokens of two letters or more, lower case, without stopwords."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z]{2,}"), F.lit(0)), F.lower))
    return F.array_except(found, F.array(*map(F.lit, vocab.STOPWORDS)))


def like_ascii(text: Column, query: str) -> Column:
    """LIKE %query% that folds A-Z only; ``%`` and ``_`` in the query are wildcards."""
    folded = query.translate(str.maketrans(UPPER, UPPER.lower()))
    return F.translate(text, UPPER, UPPER.lower()).like("%" + folded.replace("\\", "\\\\") + "%")


def about_topic(topic: str, name: str = "name", summary: str = "summary") -> Column:
    """The topic inside name and summary joined without a blank, in lower case."""
    joined = F.concat(F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(summary), F.lit("")))
    return F.lower(joined).contains(topic.lower())


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2M / (len a + len b) over matching blocks; not symmetric. Null counts as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; the longer vector is read up to the shorter's length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
