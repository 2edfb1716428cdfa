import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as tx

CASES = [
    (None, ""), ("   ", ""), ("NaN", "nan"), ("ABC Technologies Pvt. Ltd.", "abc technologies pvt ltd"), ("25, MG Road", "25 mg road"),
    ("00125, 25/7 MG Road 75001", "00125 25 7 mg road 75001"), ("  A,,,B—C/D_(E)  ", "a b c d e"), ("...", ""),
    ("25, Rue de l’Église, 75001 Paris", "25 rue de l église 75001 paris"), ("ABC\t\n  Technologies", "abc technologies"), ("A+B €25", "a+b €25"),
    (unicodedata.normalize("NFD", "ÉCOLE"), "école"), ("a\x1cb\x1fc", "a b c"),
]


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())).select(expr).first()[0]


def test_normalize(spark):
    rows = spark.createDataFrame([(a,) for a, _ in CASES], "x string").select(tx.normalize(F.col("x")).alias("n"), tx.normalize(tx.normalize(F.col("x"))).alias("again")).collect()
    assert [r.n for r in rows] == [b for _, b in CASES] == [r.again for r in rows]


def plain(s):
    s = unicodedata.normalize("NFC", s.lower())
    return " ".join("".join(" " if unicodedata.category(c)[0] == "P" else c for c in s).split())


def test_normalize_against_plain(spark):
    words = ["É.à", "Straße—7", "x_y z", "Ünï-code", "naïve gap", "ÇA/VA", "1.2,3"]
    texts = [" ".join(words[i:] + words[:i]) for i in range(len(words))]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(tx.normalize(F.col("x"))).collect()
    assert [r[0] for r in rows] == list(map(plain, texts))


@pytest.mark.parametrize("text,n,grams", [("ab c", 2, ["ab", "bc"]), ("a", 2, []), ("", 3, []), ("aaaa", 3, ["aaa"]), ("abcd", 4, ["abcd"])])
def test_char_ngrams(spark, text, n, grams):
    assert one(spark, tx.char_ngrams(F.col("x"), n), x=text) == grams


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("x")), x="") == []
    assert one(spark, tx.token_set(F.col("x")), x="b a b") == ["a", "b"]
    assert one(spark, tx.numbers(tx.token_set(F.col("x"))), x="25 a २५ 001 1b") == ["001", "25", "२५"]


def test_scripts():
    assert tx.letter_scripts(["École 25"]) == [(["LATIN"], "LATIN")]
    assert tx.letter_scripts(["गंगा"]) == [(["DEVANAGARI"], "DEVANAGARI")]
    assert tx.letter_scripts(["123 !"]) == [([], None)]
    assert tx.letter_scripts(["漢字a"]) == [(["HAN", "LATIN"], "HAN")]
    assert tx.letter_scripts(["aб"]) == [(["CYRILLIC", "LATIN"], "CYRILLIC")]


@pytest.mark.parametrize("a,b,k", [("abcd", "abxd", 2), ("ab", "abc", 2), ("", "a", 0), ("abcde", "abcdf", 4), ("xb", "ab", 0)])
def test_common_prefix(spark, a, b, k):
    assert one(spark, tx.common_prefix(F.col("a"), F.col("b")), a=a, b=b) == k


def test_set_similarities(spark):
    assert one(spark, sim.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, sim.dice(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == 0.5
    assert one(spark, sim.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0
    assert one(spark, sim.length_ratio(F.col("a"), F.col("b")), a="ab c", b="ab") == 0.5
    assert one(spark, sim.length_ratio(F.col("a"), F.col("b")), a="", b="") == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_indel(a, b):
    want = 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0
    assert sim.indel(a, b) == pytest.approx(want)
    assert 0 <= sim.token_set(a, b) <= 1 and sim.token_set(a, b) == pytest.approx(sim.token_set(b, a))


def test_token_set():
    assert sim.token_set("alpha shop", "shop alpha") == 1
    assert sim.token_set("alpha shop", "alpha") == 1
    assert sim.token_set("", "a") == 0


def test_string_ratios_run_on_columns(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    assert df.select(sim.indel_ratio("a", "b")).first()[0] == pytest.approx(2 / 3)
