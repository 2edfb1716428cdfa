import itertools
import random

import numpy as np
import pytest

from kindred.llm import jaccard_join as j
from kindred.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        both = len(sets[a] & sets[b])
        if den * both >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    names = {}
    for i, (d, _) in enumerate(rows):
        names[find(i)] = min(names.get(find(i), d), d) if d is not None else None
    return sorted(((d or -1), len(s), names[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df, n, num, den):
    return sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in j.linked(df, n, num, den).collect())


def corpus(seed, copies=120):
    random.seed(seed)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 6])):
            w[random.randrange(60)] = f"e{random.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    common = " ".join(f"c{i}" for i in range(25))
    for i in range(60):
        own = [f"o{random.randrange(40)}" for _ in range(random.choice([1, 2, 5, 9, 10, 11, 40]))]
        rows.append((i, " ".join(own) + " " + common))
        if i % 4 == 0:
            own[random.randrange(len(own))] = "changed"
            rows.append((500 + i, " ".join(own) + " " + common.upper()))
    return rows + [(3000 + i, " ".join("xyz"[: 1 + i % 3])) for i in range(12)]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 70, 100)])
def test_against_plain(docs, n, num, den, monkeypatch):
    monkeypatch.setattr(j, "RARE", 8)
    monkeypatch.setattr(j, "SMALL", 6)
    rows = corpus(n)
    assert got(docs(*rows), n, num, den) == plain(rows, n, num, den)


def test_ranges_are_cut_where_they_arrive(docs, monkeypatch):
    from kindred.llm import common

    monkeypatch.setattr(common, "MOST_RANGES", 3)
    monkeypatch.setattr(common, "BUCKET_BYTES", 500)
    monkeypatch.setattr(j, "RARE", 8)
    rows = corpus(7, 40)
    assert got(docs(*rows), 3, 90, 100) == plain(rows, 3, 90, 100)


def test_rows_of_any_kind(docs):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "one"), (5, "one"), (None, "one"), (6, long), (7, long + " x"), (8, "two words"), (9, " \t\n")]
    assert got(docs(*rows), 3, 90, 100) == plain(rows, 3, 90, 100)
    assert got(docs(*rows).limit(0), 3, 90, 100) == []
    with pytest.raises(ValueError):
        j.linked(docs(*rows), 3, 60, 100)


def test_one_of_each(docs):
    text = " ".join(f"w{i}" for i in range(50))
    df = docs((5, text), (3, text + " more"), (3, text + " more"), (3, "quite another text of seven words"), (None, text), (None, text), (9, ""), (9, ""), (7, text))
    out = j.one_of_each(df)
    assert out.columns == df.columns
    want = [(3, text + " more"), (3, "quite another text of seven words"), (-1, text), (-1, text), (9, ""), (9, "")]
    assert sorted((r.doc_id or -1, r.text) for r in out.collect()) == sorted(want)


def test_blocks_find_all_links():
    random.seed(12)
    cores = [np.sort(np.array(random.sample(range(40), 30), np.uint64)) for _ in range(90)]
    sizes, names = np.full(90, 32), np.arange(90)
    links = {(a, b) for a, b in itertools.combinations(range(90), 2) if 100 * len(np.intersect1d(cores[a], cores[b])) >= 60 * (64 - len(np.intersect1d(cores[a], cores[b])))}

    def classes(edges):
        root = {i: i for i in range(90)}
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[a] = b
        out = {}
        for i in range(90):
            k = i
            while root[k] != k:
                k = root[k]
            out.setdefault(k, set()).add(i)
        return sorted(map(sorted, out.values()))

    assert classes(j.block_links(names, sizes, cores, np.ones(90, bool), 60, 100)) == classes(links)
    left = np.arange(90) < 45
    assert classes(j.block_links(names, sizes, cores, left, 60, 100)) == classes({(a, b) for a, b in links if left[a] != left[b]})


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 70)] + [(100, 101), (102, 101), (100, 102)]
    got = {r["class"]: r.root for r in j.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, 100: 100, 101: 100, 102: 100}


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, small).collect()) == plain(rows, 3, 90, 100)


def links_of(rows, n, num, den):
    """Each row's number of other rows that it is linked with."""
    sets = []
    for d, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets.append(set() if d is None else {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} - {()})
    found = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            found[a] += 1
            found[b] += 1
    return sorted((d or -1, k) for (d, _), k in zip(rows, found))


@pytest.mark.parametrize("small,block", [(6, 4096), (6, 10), (1, 10), (1000, 4096)])
def test_all_links_are_counted(docs, monkeypatch, small, block):
    monkeypatch.setattr(j, "RARE", 8)
    monkeypatch.setattr(j, "SMALL", small)
    monkeypatch.setattr(j, "BLOCK_CLASSES", block)
    rows = corpus(5) + corpus(6)[:30] + [(None, "xyz"), (7, None), (8, "")]
    got = sorted((r.doc_id or -1, r.n_links) for r in j.linked(docs(*rows), 5, 80, 100).collect())
    assert got == links_of(rows, 5, 80, 100)
