import collections
import hashlib
import random

from kindred.llm import queries
from kindred.llm import substring_dedup as s


def plain(rows, length=13):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if d is not None and first[tuple(w[p : p + length])] < d:
                gone[p : p + length] = [True] * length
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return collections.Counter(out)


def got(df, **options):
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in s.dedup(df, **options).collect())


def test_against_plain(docs):
    random.seed(10)
    passages = [" ".join(random.choice("abcdefgh") + str(random.randrange(4)) for _ in range(random.randint(8, 60))) for _ in range(8)]
    rows = [(i, " ".join(random.choice(passages) for _ in range(random.randint(0, 4)))) for i in range(60)]
    assert got(docs(*rows)) == plain(rows)
    assert got(docs(*rows), length=4) == plain(rows, 4)


def test_ranges_are_cut_where_they_arrive(docs, monkeypatch):
    from kindred.llm import common

    monkeypatch.setattr(common, "MOST_RANGES", 3)
    monkeypatch.setattr(common, "BUCKET_BYTES", 200)
    random.seed(13)
    passages = [" ".join(f"p{random.randrange(90)}" for _ in range(random.randint(14, 40))) for _ in range(5)]
    rows = [(i, " ".join(random.choice(passages) for _ in range(random.randint(0, 3)))) for i in range(40)]
    assert common.Buckets(4000, s.ENTRY).fine > 1
    assert got(docs(*rows)) == plain(rows)


def test_rows_of_any_kind(docs):
    w, x = " ".join("abcdefghijklmnopqrst"), " ".join("ABCDEFGHIJKLMNOPQRST")
    rows = [(1, w), (2, w + " zz"), (2, x), (2, w + " zz"), (None, w), (3, x), (4, None), (5, ""), (6, "\x0b" + w.replace(" ", "\t \n")), (7, "é " * 70_000), (8, "é " * 70_000)]
    assert got(docs(*rows)) == plain(rows)
    assert got(docs(*rows).limit(0)) == {}


def test_doubling_goes_on_until_nothing_repeats(docs):
    random.seed(11)
    long = [f"w{random.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:60])), (3, " ".join(long[100:130])), (4, "other words"), (5, " ".join(long[200:213]))]
    assert {r.doc_id: r.longest for r in s.dedup(docs(*rows), longest=True).collect()} == {1: 52, 2: 52, 3: 26, 4: None, 5: 13}


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = collections.Counter((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in plain(rows).elements())
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op4_substring_dedup(spark, small).collect()) == want
