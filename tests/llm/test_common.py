import random

import numpy as np
from pyspark.sql import functions as F

from kindred.llm import common as c


def test_ranks_are_gapless_and_stable(spark):
    df = spark.range(3000).select((F.col("id") % 3 == 0).cast("string").alias("k"), (F.col("id") % 1000).alias("v"))
    a, b = (sorted(map(tuple, c.ranked(x, ["k"], ["v"], "rank", 16).collect())) for x in (df, df.repartition(7)))
    assert a == b
    for k in ("true", "false"):
        own = [r for kk, _, r in a if kk == k]
        assert sorted(own) == list(range(len(own)))
    assert c.ranked(df.limit(0), ["k"], ["v"], "rank").collect() == []


def test_id_filter_loses_nothing(spark):
    ids = spark.range(0, 200_000, 40)
    kept = c.only_likely(spark.range(200_000).withColumn("text", F.lit("x")), "id", ids)
    assert kept.join(ids, "id").count() == 5000 and kept.count() < 30_000 and kept.columns == ["id", "text"]
    assert c.only_likely(spark.range(10), "id", ids.limit(0)).count() == 0


def test_word_hashes_follow_the_words():
    random.seed(1)
    texts = ["".join(random.choice("aB é\t\n\x0b  x") for _ in range(random.randint(0, 30))).encode() for _ in range(400)]
    words = [t.split() for t in texts]
    hashed = c.word_hashes(texts)
    assert [len(h) for h in hashed] == [len(w) for w in words]
    names = {}
    for w, h in zip(words, hashed):
        for x, y in zip(w, h.tolist()):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)
    lower = {h for t in c.word_hashes(texts, lower=True) for h in t.tolist()}
    assert lower == {h for t in c.word_hashes([t.replace(b"B", b"b") for t in texts]) for h in t.tolist()}
    whole = c.word_hashes([b" ".join(texts)])[0]
    assert np.array_equal(whole, np.concatenate(hashed))


def test_prefix_terms():
    a, b = c.word_hashes([b"stemone stemtwo", b"st stem"], prefixes=(4,))
    assert len(a) == 4 and len(b) == 2 and a[2] == a[3]


def test_long_words_are_told_apart():
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64, whatever the odd base."""
    for n in (64, 65, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        a, b = (bytes(97 + (x ^ y) for x in bits) for y in (0, 1))
        (x,), (y,), (z,) = c.word_hashes([a, b, a])
        assert x != y and x == z
    (u,), (v,) = c.word_hashes([b"A" * 90, b"a" * 90], lower=True)
    assert u == v


def test_flat_hashes_are_the_same():
    texts = [b"one two", b"", b"threefold fourteenth x", b"one"]
    own = c.word_hashes(texts, prefixes=(4, 9))
    flat = [[] for _ in texts]
    for rows, hashes in c.flat_hashes(texts, prefixes=(4, 9)):
        for i, h in zip(rows, hashes):
            flat[i].append(h)
    assert [list(x) for x in own] == flat


def test_scopes_drop_what_they_wrote(spark):
    with c.scope() as s:
        inner = c.Written(spark.range(3))
        kept = s.keep(inner.df)
    assert kept.df.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(inner.path)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
