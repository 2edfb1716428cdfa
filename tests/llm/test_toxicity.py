import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import queries
from kindred.llm import toxicity as t


def corpus(n, seed):
    """An insult next to a mention of a group is toxic; neither is alone."""
    random.seed(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{random.randrange(300)}" for _ in range(30)]
        insult, group = random.random() < 0.4, random.random() < 0.4
        words += ["Idiots!"] * insult + ["groupies"] * group
        random.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(insult and group))
    return texts, np.array(labels)


def test_pairs_are_learnt():
    texts, y = corpus(3000, 1)
    found = t.terms([x.encode() for x in texts])
    known = np.unique(np.concatenate(t.terms([b"idiots groupies w1 w2 w3 w4 w5"])))
    places = [np.searchsorted(known, np.intersect1d(known, f)) for f in found]
    m = t.fit(known, places, y, epochs=30)
    fresh, truth = corpus(800, 2)
    got = m.scores(t.terms([x.encode() for x in fresh])) >= 0.5
    assert (got == truth).mean() > 0.98
    assert np.abs(m.vectors).max() > 0.1


def agreement(n, seed):
    """Toxic is the agreement of two words, of which neither tells anything alone."""
    random.seed(seed)
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{random.randrange(300)}" for _ in range(30)]
        a, b = random.random() < 0.5, random.random() < 0.5
        words += ["zorble"] * a + ["quintan"] * b
        random.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a == b))
    return texts, np.array(labels)


def test_pairs_are_found_among_terms_that_tell_nothing_alone(spark, docs):
    texts, y = agreement(3000, 5)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, toxic int")
    out = t.scored_documents(docs(*enumerate(texts)), labels).filter("held_out").collect()
    assert len(out) > 400 and sum(r.predicted == y[r.doc_id] for r in out) / len(out) > 0.95


def test_repeated_ids_do_not_pass_the_bound(spark, docs):
    texts, y = corpus(300, 8)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, toxic int")
    once, often = docs(*enumerate(texts)), docs(*[(i, x) for i, x in enumerate(texts) for _ in range(3)])
    a, b = (t.learn(df, labels.unionByName(labels)) for df in (once, often))
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_scores_by_definition():
    m = t.Machine(np.array([3, 9], np.int32), -1.0, np.array([0.5, 0.25]), np.array([[1.0, 2.0], [0.5, -1.0]]))
    z = [-1, -1 + 0.5, -1 + 0.75 + (0.5 - 2.0)]
    assert m.scores([np.empty(0, np.int32), np.array([3, 4], np.int32), np.array([3, 9], np.int32)]) == pytest.approx(1 / (1 + np.exp(-np.array(z))))


def test_rows_of_any_kind(spark, docs):
    texts, y = corpus(600, 3)
    rows = [(i, x) for i, x in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    df = docs(*rows, (10_000, None), (10_001, ""), (None, "x"), (5, texts[5]), (10_002, "w1 " * 100_000))
    out = t.scored_documents(df, labels).collect()
    assert len(out) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    blank = {r.score for r in out if r.doc_id in (10_000, 10_001)}
    assert len(blank) == 1
    assert t.scored_documents(df.limit(0), labels).collect() == []
    alone = t.scored_documents(df, labels.filter("toxic = 0")).collect()
    assert all(r.predicted == 0 for r in alone)
    assert all(r.predicted == 0 for r in t.scored_documents(df, labels.limit(0)).collect())


def test_held_out_labels_teach_nothing(spark, docs):
    texts, y = corpus(400, 4)
    df = docs(*enumerate(texts))
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(t.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in t.scored_documents(df, x).collect()) for x in (labels, flipped))
    assert a == b


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    hit = [r.predicted for r in rows if labels[r.doc_id]]
    clean = [r.predicted for r in rows if not labels[r.doc_id]]
    assert sum(hit) / len(hit) > 0.7 and sum(clean) / len(clean) < 0.01
