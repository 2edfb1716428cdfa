import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import mixing as m
from kindred.llm import queries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_are_a_water_level(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = m.targets(sizes, weights, 1.5 * sum(sizes))
    assert all(t <= 2 * n + 1e-9 for t, n in zip(got, sizes)) and abs(sum(got) - 1.5 * sum(sizes)) < 1e-6
    levels = [t / w for t, w, n in zip(got, weights, sizes) if t < 2 * n - 1e-9]
    assert not levels or max(levels) - min(levels) < 1e-6 * max(levels) and all(t / w <= levels[0] + 1e-6 for t, w in zip(got, weights))


def test_fit_is_exact_on_small_sets():
    random.seed(2)
    for _ in range(300):
        lengths = random.sample(range(1, 15), random.randint(1, 4))
        counts = [random.randint(1, 3) for _ in lengths]
        budget = random.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        got = m.fit(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        took = sum(a * b for a, b in zip(lengths, got))
        floor = [c * budget // sum(a * b for a, b in zip(lengths, counts)) for c in counts]
        best = max(s for s in (sum(a * k for a, k in zip(lengths, ks)) for ks in itertools.product(*(range(f, c + 1) for f, c in zip(floor, counts)))) if s <= budget)
        assert took == best


def test_fit_of_large_budgets():
    random.seed(3)
    lengths = random.sample(range(1, 20_000), 800)
    counts = [random.randint(1, 500) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    for part in (0.001, 0.37, 0.99):
        budget = int(total * part)
        assert sum(a * b for a, b in zip(lengths, m.fit(lengths, counts, budget))) == budget


def test_rows_of_any_kind(docs):
    df = docs((1, None, "a"), (2, "", "a"), (3, "x y z", "a"), (3, "x y z", "a"), (4, "x", None), (5, "x " * 5000, "b"), (None, "q", "b"))
    rows = m.taken(df).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == [(0, 1), (1, 0), (2, 0), (3, 3), (3, 3), (4, 1), (5, 5000)]
    assert all(0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)
    assert {r.doc_id: r.source_size for r in rows}[4] == 1
    assert sorted(map(str, rows)) == sorted(map(str, m.taken(df.repartition(3)).collect()))
    assert m.taken(df.limit(0)).collect() == []


def test_mixed_table_has_the_copies(docs):
    df = docs(*((i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)), (3, "w " * 4, "b"))
    plan = {}
    for r in m.taken(df).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    got = {}
    out = m.mixed(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {k: v for k, v in plan.items() if v}


def test_equal_rows_of_several_sources_keep_theirs(docs):
    rows = [(i, "w " * (i % 7 + 1), s) for i in range(30) for s in ("a", "b", None)] + [(None, "w w", "a"), (None, "w w", "b"), (3, "w " * 4, "b")]
    df = docs(*rows)
    want, got = {}, {}
    for r in m.mix(df).collect():
        want[r.source, r.doc_id] = want.get((r.source, r.doc_id), 0) + r.size * r.copies
    for r in m.mixed(df).collect():
        got[r.source, r.doc_id] = got.get((r.source, r.doc_id), 0) + len(r.text.split())
    assert got == {k: v for k, v in want.items() if v}


def test_query(spark, small):
    rows = queries.op3_mixing(spark, small).collect()
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    total, target = {}, {}
    for r in rows:
        total[sources[r.doc_id]] = total.get(sources[r.doc_id], 0) + r.taken
        target[sources[r.doc_id]] = r.target
    assert all(abs(total[s] - target[s]) <= 0.02 * target[s] + 25 for s in total)
    assert abs(sum(target.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
