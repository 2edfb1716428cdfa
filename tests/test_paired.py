"""Features made in matrices against the expressions of features."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import features, frequency, paired, scoring
from tests.test_linkage import made


@pytest.mark.parametrize("queries", [256, 1])
def test_odd_texts(spark, monkeypatch, queries):
    """Empty and repeated words, other scripts, characters beyond 16 bits, digits that are not ASCII; a pair without score."""
    texts = [("", ""), ("a", "7"), ("a a b", "٣ 7 x x"), ("été 数据 库", "12 rue 𝒜𝒷 𝒜𝒷"), ("abab abab", None), ("aba", "rue 12")]
    q = made(spark, *((f"S1-{i}", *t, "X") for i, t in enumerate(texts)))
    p = made(spark, *((f"S{2 + i % 2}-{i}", *t, "X") for i, t in enumerate(texts)))
    docs, terms = frequency.document_counts(p), frequency.term_counts(p, ("name", "address"))
    left, right = frequency.weighted(q, docs, terms), frequency.weighted(p, docs, terms)
    ids = lambda df, c: df.select(F.col("entity_id").alias(c))
    pairs = ids(q, "s1_id").crossJoin(ids(p, "cand_id")).withColumn("score", F.when(F.col("s1_id") != "S1-0", 0.5)).withColumn("rank", F.when(F.col("score").isNotNull(), F.lit(3)).cast("long"))
    truth, split = pairs.filter("s1_id = 'S1-1' and cand_id < 'S2-3'").select("s1_id", F.col("cand_id").alias("match_id")), ids(q, "s1_id").withColumn("split", F.lit("train"))
    plain = features.labelled(features.pair_features(scoring.with_records(pairs, left, right)), truth).join(split, "s1_id")
    worker = paired._worker

    def cut(batches):
        paired.QUERIES = queries
        yield from worker(batches)

    monkeypatch.setattr(paired, "_worker", cut)
    got = paired.pair_features(pairs, left, right, truth, split)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.filter("label = 1").count() == 2


def test_large_alphabets_are_halved():
    """Three characters' numbers and a text's must fit in one integer."""
    wide = "".join(map(chr, range(0x20000, 0x20000 + (1 << 18))))
    half = pa.array([wide[: 1 << 17], wide[1 << 17 :]] * 16)
    with pytest.raises(OverflowError):
        list(paired._Texts(half, half).grams(3))


def test_invalid_pairs_are_errors(spark):
    ready = frequency.weighted(made(spark, ("S9-1", "a", "1", "X")), spark.createDataFrame([("X", 1)], "country string, n long"), spark.createDataFrame([], "field string, country string, term string, df long"))
    pairs = spark.createDataFrame([("S9-1", "S9-1", 0.5, 1)], "s1_id string, cand_id string, score double, rank long")
    split = spark.createDataFrame([("S9-1", "train")], "s1_id string, split string")
    with pytest.raises(Exception, match="source, score or rank is invalid"):
        paired.pair_features(pairs, ready, ready, spark.createDataFrame([], "s1_id string, match_id string"), split).collect()
