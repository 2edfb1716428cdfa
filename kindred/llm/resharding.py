"""Minimum-cost-flow resharding: from the sizes of the old shards and the capacities of the new ones, a flow
gives the transfers that move the fewest bytes; documents follow it, and only files that change are rewritten.

Documents lie in an old shard in the order of a hash of what tells them apart (id, size, CRC-32 of the text). A transfer is a
stretch of that order, so that the plan is a few cuts for each old shard, and a row finds its new shard by comparing itself
with these. The driver sees totals by block of an old shard (``old shards * blocks`` rows), then looks for each cut in its
one block. The few documents that are large against a capacity (at most ``shards * grain`` of them, by the threshold's
definition) are placed one by one. Twins, which nothing tells apart, lie together; where a cut goes through them or large
ones have several homes, they are shared out by number.

Null texts count as no bytes; empty texts have the fixed overhead only; repeated rows and ids, and null ids, are documents
of their own; an empty table gives an empty result and writes no shard; other columns go with their rows.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Folder, ranked, written

OVERHEAD = 16


def min_cost_flow(supply: list[int], room: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Amounts from each supply to each room, all of the supply, at the least cost, none of which is
    negative. Successive shortest paths."""
    n, m = len(supply), len(room)
    if sum(supply) > sum(room):
        raise ValueError("the capacities are too small")
    left, free, flow = list(supply), list(room), {}
    for i in range(min(n, m)):  # what may stay for nothing is a cheapest flow of its amount
        if cost(i, i) == 0 and (stays := min(left[i], free[i])):
            flow[i, i] = stays
            left[i] -= stays
            free[i] -= stays
    while any(left):
        dist = [0 if x else None for x in left] + [None] * m
        back = [None] * (n + m)
        queue, queued = deque(i for i in range(n) if left[i]), set()
        while queue:
            at = queue.popleft()
            queued.discard(at)
            steps = ((n + j, cost(at, j)) for j in range(m)) if at < n else ((i, -cost(i, at - n)) for i in range(n) if flow.get((i, at - n)))
            for to, price in steps:
                d = dist[at] + price
                if dist[to] is None or d < dist[to]:
                    dist[to], back[to] = d, at
                    if to not in queued:
                        queued.add(to)
                        queue.append(to)
        end = min((n + j for j in range(m) if free[j] and dist[n + j] is not None), key=lambda x: dist[x])
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min([left[path[0]], free[end - n], *(flow[b, a - n] for a, b in zip(path, path[1:]) if a >= n)])
        for a, b in zip(path, path[1:]):
            e, sign = ((a, b - n), 1) if a < n else ((b, a - n), -1)
            flow[e] = flow.get(e, 0) + sign * amount
        left[path[0]] -= amount
        free[end - n] -= amount
    return {e: x for e, x in flow.items() if x}


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def place_large(items: list[tuple[int, int, int]], room: list[int]) -> dict[int, int]:
    """The new shard of each (key, size, old shard), largest first: it stays where there is room, else goes where most is."""
    room, out, moving = list(room), {}, []
    for key, size, old in sorted(items, key=lambda x: (-x[1], x[0])):
        if old < len(room) and room[old] >= size:
            room[old] -= size
            out[key] = old
        else:
            moving.append((key, size))
    free = [(-r, j) for j, r in enumerate(room)]
    heapq.heapify(free)
    for key, size in moving:
        r, j = heapq.heappop(free)
        out[key] = j
        heapq.heappush(free, (r + size, j))
    return out


def lowered(room: list[int], total: int) -> list[int]:
    """``room`` without what is below 0, and lowered to one level so that it sums to ``total``."""
    room = [max(0, r) for r in room]
    while (over := sum(room) - total) > 0:
        open_ = [j for j, r in enumerate(room) if r]
        step = max(1, min(over // len(open_), min(room[j] for j in open_)))
        for j in open_[: max(1, over // step)]:
            room[j] -= step
    return room


def transfers(supply: list[int], room: list[int]) -> list[list[tuple[int, int]]]:
    """For each old shard (the new shard, the end of its stretch), its own shard's stretch first."""
    flow, out = min_cost_flow(supply, room), []
    for i in range(len(supply)):
        ends, at = [], 0
        for j in sorted((j for (a, j) in flow if a == i), key=lambda j: (j != i, j)):
            at += flow[i, j]
            ends.append((j, at))
        out.append(ends)
    return out


#: Names of the columns that rows carry while they find their shards.
ID, SIZE, CRC, OLD, SHARD = (f"__kindred_{x}" for x in ("id", "size", "crc", "old", "shard"))
POSITION = "struct<h:long,id:{id},size:long,crc:long>"


def named(docs: DataFrame, old_shard: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what tells a document apart, and its old shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + OVERHEAD).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    return docs.withColumns({ID: F.col(id_col), SIZE: size, CRC: crc, OLD: old_shard.cast("int")})


def by_hash(old_shards: int, id_col: str = "doc_id") -> Column:
    """The old shard that a hash of the id names."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards))


def _hash() -> Column:
    return F.xxhash64(ID, SIZE, CRC)


def _position() -> Column:
    """A row's place in its old shard's order; equal for twins."""
    return F.struct(_hash().alias("h"), F.col(ID).alias("id"), F.col(SIZE).alias("size"), F.col(CRC).alias("crc"))


@dataclass(slots=True)
class Plan:
    """stretches: of each old shard, in order, (new shard, the last position in it or None); homes: of single groups of
    twins (old shard, id, size, crc), (new shard, how many are placed up to there)."""

    id_type: str
    shards: int
    total: int
    stretches: dict[int, list[tuple[int, tuple | None]]]
    homes: dict[tuple, list[tuple[int, int]]]

    def affected(self) -> set[int]:
        """The shards, old and new, that documents leave or enter."""
        moves = [(i, j) for i, ends in self.stretches.items() for j, _ in ends] + [(key[0], j) for key, ends in self.homes.items() for j, _ in ends]
        return {x for i, j in moves if i != j for x in (i, j)}

    def place(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of :func:`named`) with their new shard."""
        spark, name = rows.sparkSession, POSITION.format(id=self.id_type)
        ends = [(i, [j for j, _ in e], [p for _, p in e[:-1]]) for i, e in self.stretches.items()]
        known = spark.createDataFrame(ends, f"__old int, __to array<int>, __cuts array<{name}>")
        homes = [(*key, [{"shard": j, "upto": n} for j, n in e]) for key, e in self.homes.items()]
        single = spark.createDataFrame(homes, f"__old_ int, __id_ {self.id_type}, __size_ long, __crc_ long, __homes array<struct<shard:int,upto:long>>")
        # A row for each old shard; at most shards * grain large ones and a group for each cut.
        rows = rows.join(F.broadcast(known), rows[OLD] == known["__old"], "left")
        same = (rows[OLD] == single["__old_"]) & rows[ID].eqNullSafe(single["__id_"]) & (rows[SIZE] == single["__size_"]) & (rows[CRC] == single["__crc_"])
        rows = rows.join(F.broadcast(single), same, "left").withColumn("__at", _position())
        passed = F.size(F.filter("__cuts", lambda c: F.col("__at") > c))
        rows = rows.withColumn(SHARD, F.when(F.col("__homes").isNotNull(), F.col("__homes")[0]["shard"]).otherwise(F.col("__to")[passed]))
        helpers = ["__old", "__to", "__cuts", "__old_", "__id_", "__size_", "__crc_", "__at"]
        if all(len(e) == 1 for e in self.homes.values()):
            return rows.drop(*helpers, "__homes")
        several = F.coalesce(F.size("__homes"), F.lit(0)) > 1
        twins = written(rows.filter(several).drop(*helpers).withColumn("__row", F.monotonically_increasing_id()))
        numbered = ranked(twins, [OLD, ID, SIZE, CRC], ["__row"], "__rank")
        own = F.filter("__homes", lambda e: F.col("__rank") < e["upto"])[0]["shard"]
        return rows.filter(~several).drop(*helpers, "__homes").unionByName(numbered.withColumn(SHARD, own).drop("__homes", "__row", "__rank"))


def _cut(sized: DataFrame, blocks: int, cuts: list[tuple[int, int, int, int]], id_type: str) -> dict[int, tuple]:
    """For each cut (number, old shard, block, bytes of the block before it): the last group of twins before it, how many of
    that group are, and how many there are; none where it lies before the block's first document."""
    wanted = sized.sparkSession.createDataFrame([(n, i, b, int(to)) for n, i, b, to in cuts], "n int, i int, b int, upto long")
    own = sized.join(F.broadcast(wanted.select("i", "b").distinct()), (F.col(OLD) == F.col("i")) & (_block(blocks) == F.col("b")), "left_semi")
    groups = own.groupBy(OLD, ID, SIZE, CRC).agg(F.count(F.lit(1)).alias("rows")).withColumns({"b": _block(blocks), "at": _position()})
    upto = F.sum(F.col("rows") * F.col(SIZE)).over(Window.partitionBy(OLD, "b").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = groups.withColumn("start", upto - F.col("rows") * F.col(SIZE)).withColumnRenamed("b", "own")
    met = ends.join(F.broadcast(wanted), (F.col(OLD) == F.col("i")) & (F.col("own") == F.col("b")))
    before = F.least("rows", F.floor((F.col("upto") - F.col("start")) / F.col(SIZE) + 0.5))
    last = met.withColumn("before", before).filter("before >= 1").groupBy("n").agg(F.max_by(F.struct("at", "before", "rows"), "at").alias("x"))
    return {r.n: (tuple(r.x.at), r.x.before, r.x.rows) for r in last.collect()}  # a row for each cut


def _block(blocks: int) -> Column:
    """The block of a row: so many equal ranges of the hash, in its order."""
    return F.least(F.floor((F.shiftright(_hash(), 32) + (1 << 31)) * blocks / (1 << 32)), F.lit(blocks - 1)).cast("int")


def plan(sized: DataFrame, capacities: list[int] | int, blocks: int = 256, grain: int = 256) -> Plan:
    """The plan for rows (of :func:`named`): new shards of these capacities, or of so many near equal ones, reached by
    moving the fewest bytes. A document larger than 1/``grain`` of a mean capacity is placed by itself."""
    total = sized.agg(F.coalesce(F.sum(SIZE), F.lit(0))).first()[0]
    capacity = even(total, capacities) if isinstance(capacities, int) else list(capacities)
    shards, id_type = len(capacity), sized.schema[ID].dataType.simpleString()
    limit = max(OVERHEAD, total // (shards * grain))
    key = [OLD, ID, SIZE, CRC]
    found = sized.filter(F.col(SIZE) > limit).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).collect()  # shards * grain documents at most
    items = [(tuple(r[k] for k in key), r.rows) for r in sorted(found, key=lambda r: (r[ID] is not None, r[ID] if r[ID] is not None else 0, r[SIZE], r[CRC], r[OLD]))]
    each = [k for k, n in items for _ in range(n)]
    homes, at = {}, 0
    placed = place_large([(x, k[2], k[0]) for x, k in enumerate(each)], capacity)
    for x, k in enumerate(each):
        capacity[placed[x]] -= k[2]
    for k, n in items:
        counts: dict[int, int] = defaultdict(int)
        for x in range(at, at + n):
            counts[placed[x]] += 1
        at += n
        homes[k] = _upto(sorted(counts.items()))

    small = sized.filter(F.col(SIZE) <= limit)
    rows = small.groupBy(OLD, _block(blocks).alias("block")).agg(F.sum(SIZE).alias("bytes")).collect()  # at most old shards * blocks rows
    old = sorted({r[OLD] for r in rows})
    inside = {i: sorted((r.block, r.bytes) for r in rows if r[OLD] == i) for i in old}
    supply = [0] * (max(old, default=-1) + 1)
    for i in old:
        supply[i] = sum(n for _, n in inside[i])
    ends = transfers(supply, lowered(capacity, sum(supply)))
    cuts, where = [], {}
    for i in old:
        for k, (_, to) in enumerate(ends[i][:-1]):
            before, block = 0, None
            for b, n in inside[i]:
                if block is None and before + n >= to:
                    block = b
                    break
                before += n
            where[i, k] = len(cuts)
            cuts.append((len(cuts), i, block, to - before))
    last = _cut(small, blocks, cuts, id_type) if cuts else {}
    stretches: dict[int, list[tuple[int, tuple | None]]] = {}
    for i in old:
        own: list[tuple[int, tuple | None]] = []
        for k, (j, _) in enumerate(ends[i]):
            if k == len(ends[i]) - 1:
                own.append((j, None))
                continue
            n, b = where[i, k], cuts[where[i, k]][2]
            if n in last:
                position, before, group = last[n]
                if before < group:  # the cut goes through twins
                    twin = (i, *position[1:])
                    known = [e for e in homes.get(twin, []) if e[1] < group]
                    if not known or known[-1][1] < before:
                        known.append((j, before))
                    homes[twin] = [*known, (ends[i][k + 1][0], group)]
                own.append((j, position))
            else:  # just below the block's first hash
                own.append((j, (_first_hash(b, blocks) - 1, None, 0, 0)))
        stretches[i] = own
    return Plan(id_type, shards, total, stretches, homes)


def _upto(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, n = [], 0
    for j, x in counts:
        n += x
        out.append((j, n))
    return out


def _first_hash(block: int, blocks: int) -> int:
    """The smallest hash of a block."""
    return max((-(-(block << 32) // blocks) - (1 << 31)) << 32, -(1 << 63) + 1)


def of_manifest(spark: SparkSession, manifest: dict[int, str]) -> DataFrame:
    """The rows of the old shards' Parquet folders with the column OLD."""
    parts = [spark.read.parquet(path).withColumn(OLD, F.lit(i)) for i, path in sorted(manifest.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Bytes of a rewritten file, about.
FILE_BYTES = 256 << 20


def rewrite(rows: DataFrame, plan: Plan, target: str, manifest: dict[int, str] | None = None) -> dict[int, str]:
    """Write anew, below ``target``, only the shards that documents leave or enter; ``rows`` are all rows (of
    :func:`named`), each of which lies in one new shard afterwards. Returns the new manifest, also written to
    ``target``/manifest after all files, so that a reader never sees half a rewrite; files of unaffected shards stay."""
    spark, affected = rows.sparkSession, plan.affected()
    out = {i: p for i, p in (manifest or {}).items() if i in plan.stretches | {k[0]: 0 for k in plan.homes} and i not in affected}
    moving = rows.filter(F.col(OLD).isin(*affected)) if manifest is not None else rows
    if affected or manifest is None:
        files = max(1, plan.total // (plan.shards * FILE_BYTES))
        spread = F.pmod(F.xxhash64(_hash(), F.spark_partition_id()), F.lit(files)).alias("__kindred_file")
        placed = plan.place(moving).withColumn("__kindred_file", spread).repartition(SHARD, "__kindred_file")
        placed.drop(ID, SIZE, CRC, OLD, "__kindred_file").write.partitionBy(SHARD).parquet(f"{target}/shards")
        held = {j for e in plan.stretches.values() for j, _ in e} | {j for e in plan.homes.values() for j, _ in e}
        out |= {j: f"{target}/shards/{SHARD}={j}" for j in sorted(held if manifest is None else held & affected)}
    spark.createDataFrame([(json.dumps({str(k): v for k, v in sorted(out.items())}),)], "value string").coalesce(1).write.text(f"{target}/manifest")
    return out


def resharded(docs: DataFrame, shards: int = 40, old_shards: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as the rewritten files have them, with the column SHARD. Old shards are those that a hash of the id names."""
    rows = named(docs, by_hash(old_shards, id_col), id_col, text_col)
    sized = written(rows.select(ID, SIZE, CRC, OLD))
    folder = Folder(docs.sparkSession)
    rewrite(rows, plan(sized, shards), folder.path)
    return docs.sparkSession.read.schema(docs.withColumn(SHARD, F.lit(0)).schema).parquet(f"{folder.path}/shards")


def assignment(docs: DataFrame, shards: int = 40, old_shards: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document in the rewritten files."""
    back = resharded(docs.select(id_col, text_col), shards, old_shards, id_col, text_col)
    rows = named(back, F.lit(0), id_col, text_col).select(F.col(ID).alias("doc_id"), F.col(SIZE).alias("size"), F.col(CRC).alias("text_crc32"), F.col(SHARD).alias("shard"))
    return ranked(written(rows), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
