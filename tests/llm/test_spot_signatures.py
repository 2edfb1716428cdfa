import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kindred.llm import queries
from kindred.llm import spot_signatures as s


def expected(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        k, nxt = len(t) // 2, order[(i + 1) % len(order)][1]
        out[d] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    return out


def test_edits_and_order(docs, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_ROWS", 3)
    monkeypatch.setattr(s, "GRID", 2)
    rows = [(i * i * 7 % 1009, f"the ünï text {i} of the many words in it {i * 31}") for i in range(60)]
    got = {r.doc_id: r for r in s.fingerprints(docs(*rows)).collect()}
    assert {d: r.edited_sha256 for d, r in got.items()} == expected(rows)
    following = dict(zip(sorted(got), sorted(got)[1:] + sorted(got)[:1]))
    for d, r in got.items():
        own, edited, after = (set(x.split(",")) for x in (r.fingerprint, r.edited_fingerprint, got[following[d]].fingerprint))
        assert r.near_edited == pytest.approx(len(own & edited) / len(own | edited)) and r.near_next == pytest.approx(len(own & after) / len(own | after))


@pytest.mark.parametrize("grid,size", [(2, 3), (4, 2), (32, 2000)])
def test_ids_far_apart_and_an_id_of_most_rows(docs, monkeypatch, grid, size):
    """Each row's edit takes from the row that follows in ascending (id, hash of the text), whatever the buckets."""
    monkeypatch.setattr(s, "BUCKET_ROWS", size)
    monkeypatch.setattr(s, "GRID", grid)
    ids = [-(2**63), -(9 * 10**18), 2**63 - 1, 9 * 10**18, 0, 1, 2, 3] + [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(30)] + [77] * 40 + [None] * 20
    rows = [(d, f"the text {i} of {i * 31}") for i, d in enumerate(ids)]
    df = docs(*rows)
    order = [x.text for x in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in s.fingerprints(df).collect()) == want


def plain_signatures(text):
    """Spot signatures word by word."""
    common = {w for words in s.COMMON.values() for w in words.split()}
    found = re.findall(r"[^\W_]+", text.lower())
    words = ["^", *found]
    content = [i for i, w in enumerate(words) if i and w not in common]
    out = set()
    for i, w in enumerate(words):
        after = [j for j in content if j > i][:2]
        if after and (i == 0 or w in common):
            out.add(" ".join(words[i : after[-1] + 1]))
    return out or {" ^ " + " ".join(found) + " "}


def test_fingerprints_against_plain(docs):
    random.seed(15)
    words = ["the", "of", "und", "is", "it", "house", "Red", "x1", "brick,", "!", "é", "la", "a"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 14))) for _ in range(300)]
    for r in s.fingerprints(docs(*enumerate(texts))).collect():
        assert r.fingerprint == ",".join(sorted(hashlib.md5(x.encode()).hexdigest()[:16] for x in plain_signatures(texts[r.doc_id])))


def test_rows_of_any_kind(docs):
    long = "the cat of the house " * 40_000
    df = docs((1, None), (2, ""), (3, "That it."), (4, "the of"), (4, "the of"), (5, long), (None, "x"), (6, "!!"))
    rows = s.fingerprints(df).collect()
    assert len(rows) == 8 and all(r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[1] == by[2] == by[6] and len(by[4]) == 1 and {r.doc_id: r.n_chars for r in rows}[5] == len(long)
    assert s.fingerprints(df.limit(0)).collect() == []
    one = s.fingerprints(docs((1, "a cat"))).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a ca a"[:3] + b"a ").hexdigest()


def test_chains(docs):
    same = [(1, "We saw the red house of brick"), (2, "we saw THE red, house of brick!"), (3, "we saw the blue house of brick")]
    fp = {r.doc_id: r.fingerprint for r in s.fingerprints(docs(*same)).collect()}
    assert fp[1] == fp[2] != fp[3] and set(fp[1].split(",")) & set(fp[3].split(","))


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_against_all_pairs(docs, threshold):
    base = [f"the w{i} x{i} of" for i in range(12)]
    rows = [(i, " ".join(base[: 12 - i % 5] + [f"the z{i % 7} q"])) for i in range(24)]
    rows += [(None, rows[3][1]), (30, None), (31, ""), (3, "another text of the same id")]
    membership, pairs = s.similar(docs(*rows), threshold)
    named = {}
    for r in membership.collect():
        named.setdefault(r["class"], set()).add(r.doc_id)
    found = s.fingerprints(docs(*rows)).select("doc_id", "fingerprint").distinct().collect()
    sets = {hashlib.sha256(r.fingerprint.encode()).hexdigest(): set(r.fingerprint.split(",")) for r in found}
    assert set(named) == set(sets) and {None, 3} <= set().union(*named.values())
    for r in found:
        assert r.doc_id in named[hashlib.sha256(r.fingerprint.encode()).hexdigest()]
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_query_is_native(spark, small):
    df = queries.op8_spot_signatures(spark, small)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = {r.doc_id: r for r in df.collect()}
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert {d: r.edited_sha256 for d, r in rows.items()} == expected(texts)
