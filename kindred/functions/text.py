"""Normalization and tokens as Column expressions. Python runs only for what Spark lacks: Unicode composition and the
scripts of letters."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode NFC."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def normalize(text: Column) -> Column:
    """Lower case, composed, punctuation as spaces, runs of white space as one space, none at the ends; null gives ''.
    Accents, symbols, digits and leading zeros stay."""
    plain = F.regexp_replace(composed(F.lower(F.coalesce(text, F.lit("")))), r"\p{P}", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(text: Column) -> Column:
    """The words of a normalized text, in order; none of an empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(text)))


def is_decimal(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def numbers(token_array: Column) -> Column:
    return F.filter(token_array, is_decimal)


def words(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: ~is_decimal(t))


def char_ngrams(text: Column, n: int) -> Column:
    """The set of character n-grams without white space; a shorter text has none."""
    places = lambda c: F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    # A lambda's body is evaluated for each place; the text without spaces is a variable there, made once.
    grams = F.transform(F.array(F.replace(text, F.lit(" "), F.lit(""))), lambda c: F.transform(places(c), lambda i: F.substring(c, i, F.lit(n))))
    return F.array_sort(F.array_distinct(F.element_at(grams, 1)))


def source_of(entity_id: Column) -> Column:
    return F.substring_index(entity_id, "-", 1)


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """How many first characters agree, up to ``most``."""
    out = F.lit(0)
    for k in range(1, most + 1):
        same = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        out = F.when(same, F.lit(k)).otherwise(out)
    return out


@cache
def script_table() -> tuple[np.ndarray, tuple[str, ...]]:
    """For each code point the number of its letter's script, -1 for what is no letter, and the scripts' names in order. A
    letter's script is the first word of its Unicode name, that of unified ideographs HAN."""
    words = {}
    for point in range(sys.maxunicode + 1):
        letter = chr(point)
        if unicodedata.category(letter)[0] == "L":
            words[point] = unicodedata.name(letter, "UNKNOWN").partition(" ")[0]
    names = tuple(sorted({"HAN" if w == "CJK" else w for w in words.values()}))
    numbers = {w: names.index("HAN" if w == "CJK" else w) for w in set(words.values())}
    table = np.full(sys.maxunicode + 1, -1, np.int16)
    table[list(words)] = [numbers[w] for w in words.values()]
    return table, names


def letter_scripts(texts: list[str | None]) -> list[tuple[list[str], str | None]]:
    """Of each text the scripts of its letters, in order, and the one of most letters, the first of equally many."""
    table, names = script_table()
    known = [t or "" for t in texts]
    points = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), "<u4")
    of_text = np.repeat(np.arange(len(known)), [len(t) for t in known])
    script = table[points]
    cells, letters = np.unique((of_text * len(names) + script)[script >= 0], return_counts=True)
    row, script = np.divmod(cells, len(names))
    order = np.lexsort((script, -letters, row))
    firsts = order[np.unique(row[order], return_index=True)[1]]
    most = dict(zip(row[firsts].tolist(), script[firsts].tolist()))
    cut = np.searchsorted(row, np.arange(len(known) + 1))
    return [([names[k] for k in script[cut[i] : cut[i + 1]]], names[most[i]] if i in most else None) for i in range(len(known))]


@F.pandas_udf(T.StructType([T.StructField("scripts", T.ArrayType(T.StringType())), T.StructField("dominant", T.StringType())]))
def script_profile(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(letter_scripts(text.tolist()), columns=["scripts", "dominant"])
