import itertools
import random
import zlib

from pyspark.sql import functions as F

from kindred.llm import queries
from kindred.llm import resharding as r


def plain_cost(supply, room):
    """The least number of units moved to another place, by trying all ways."""
    if not any(supply):
        return 0
    i = next(k for k, x in enumerate(supply) if x)
    best = None
    for j, x in enumerate(room):
        if x:
            rest = plain_cost([s - (k == i) for k, s in enumerate(supply)], [s - (k == j) for k, s in enumerate(room)])
            cost = rest + (i != j)
            best = cost if best is None or cost < best else best
    return best


def test_flow_against_plain():
    random.seed(8)
    for supply, room in itertools.islice((([random.randint(0, 2) for _ in range(3)], [random.randint(0, 3) for _ in range(3)]) for _ in itertools.count()), 60):
        if sum(supply) > sum(room):
            continue
        flow = r.min_cost_flow(supply, room)
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(3)] == supply
        assert all(sum(x for (_, j), x in flow.items() if j == k) <= room[k] for k in range(3))
        assert sum(x for (i, j), x in flow.items() if i != j) == plain_cost(supply, room)


def test_flow_moves_the_excess_alone():
    random.seed(9)
    supply = [random.randrange(10**9, 2 * 10**9) for _ in range(32)]
    room = r.even(sum(supply), 40)
    moved = sum(x for (i, j), x in r.min_cost_flow(supply, room).items() if i != j)
    assert moved == sum(max(0, s - c) for s, c in zip(supply, room))


def test_rows_of_any_kind(docs):
    df = docs((1, None), (2, ""), (3, "same"), (3, "same"), (None, "x"), (4, "y" * 100_000), *((i, "t" * (i % 50)) for i in range(10, 300)))
    rows = r.assignment(df, shards=4, old_shards=3).collect()
    assert len(rows) == 296 and sum(x.size for x in rows) == sum(16 + len(x.text or "") for x in df.collect())
    slots = {}
    for x in rows:
        slots.setdefault(x["shard"], []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert r.assignment(df.limit(0)).collect() == []


def located(spark, got):
    return sorted((k, x.doc_id or 0, x.text or "") for k in got for x in spark.read.parquet(got[k]).collect())


def test_rewrite_leaves_other_files(spark, docs, tmp_path):
    df = docs(*((i, "t" * (i % 9)) for i in range(40)))
    old = F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 30, 1).otherwise(2)
    manifest, sizes = {}, {}
    for k in range(3):
        manifest[k] = str(tmp_path / f"old{k}")
        df.filter(old == k).write.parquet(manifest[k])
        sizes[k] = sum(16 + len(x.text) for x in df.filter(old == k).collect())
    rows = r.named(r.of_manifest(spark, manifest), F.col(r.OLD))
    capacity = [sizes[0] // 2, sizes[1], sizes[2], sizes[0] - sizes[0] // 2]
    plan = r.plan(rows, capacity, blocks=4, grain=1)
    got = r.rewrite(rows, plan, str(tmp_path / "new"), manifest)
    assert {got[k] for k in (1, 2)} == {manifest[1], manifest[2]} and set(got) == {0, 1, 2, 3}
    assert sorted(x[1:] for x in located(spark, got)) == sorted((x.doc_id, x.text) for x in df.collect())
    for k in (0, 3):
        assert abs(sum(16 + len(x.text) for x in spark.read.parquet(got[k]).collect()) - capacity[k]) <= 24
    assert spark.read.parquet(got[0]).columns == df.columns


def test_rewrite_keeps_every_row_of_any_kind(spark, docs, tmp_path):
    """Twins of one key are most of the rows, and ids are null or repeated with other texts."""
    rows = [(None, "same")] * 300 + [(None, None)] * 30 + [(1, "a"), (1, "bb"), (1, "bb"), (2, None), (3, "")] + [(7, "large " * 300)] * 9 + [(i, "t" * (i % 23)) for i in range(100, 260)]
    df = docs(*rows)
    named = r.named(df, r.by_hash(3))
    plan = r.plan(named, 5, blocks=8, grain=4)
    got = r.rewrite(named, plan, str(tmp_path / "new"))
    assert sorted(x[1:] for x in located(spark, got)) == sorted((d or 0, t or "") for d, t in rows)
    load = [sum(16 + len(t) for s, _, t in located(spark, got) if s == k) for k in range(5)]
    assert max(load) - min(load) < 2 * (16 + 1800)
    moved = plan.affected()
    assert moved and max(moved) <= 4


def test_cuts_move_no_more_than_the_flow(spark, docs):
    df = docs(*((i, "t" * (i * 7 % 50)) for i in range(3000)))
    named = r.named(df, r.by_hash(6))
    out = r.plan(named, 8, blocks=16).place(named).collect()
    supply, room = [0] * 6, [0] * 8
    for x in out:
        supply[x[r.OLD]] += x[r.SIZE]
        room[x[r.SHARD]] += x[r.SIZE]
    capacity = r.even(sum(supply), 8)
    least = sum(max(0, s - c) for s, c in zip(supply, capacity))
    assert all(abs(a - b) <= 3 * 66 for a, b in zip(room, capacity))
    assert abs(sum(x[r.SIZE] for x in out if x[r.OLD] != x[r.SHARD]) - least) <= 16 * 66


def test_query(spark, small):
    rows = queries.op10_resharding(spark, small).collect()
    texts = {x.doc_id: (x.text or "").encode() for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert sorted(x.doc_id for x in rows) == sorted(texts)
    load = [0] * 40
    for x in rows:
        assert x.size == len(texts[x.doc_id]) + 16 and x.text_crc32 == zlib.crc32(texts[x.doc_id]) and x.grown_shard is None and x.law == "bytes"
        load[x["shard"]] += x.size
    largest = max(x.size for x in rows)
    assert max(load) <= max(largest, 1.1 * sum(load) / 40)
