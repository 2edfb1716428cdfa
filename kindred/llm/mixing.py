"""Mixing sources to target weights by subset-sum budget fitting: documents are counted by exact length, a
bounded-knapsack programme fits what is left of each source's budget, and seeded documents fill the counts.

A source's share of ``share`` times all words goes by weight, at most twice its size, the excess to the others.
Whole passes take every document; the rest of a budget takes the same fraction of every length, and its last
words are fitted exactly where the lengths allow. The driver sees a row for each source; programmes run on the
executors over (source, length) counts.

Null texts have no words; documents without words are never taken; a null source is a source of its own, last
in order; ties and repeated rows are told apart by seeded hashes, and twins are interchangeable; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """``total`` shared by weight, each at most ``most`` times its size, the excess shared again until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        by = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / by >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / by
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit(lengths: list[int], counts: list[int], budget: int, window: int = 1 << 16) -> list[int]:
    """How many documents of each length come nearest below or at ``budget`` words. The last ``window`` words or fewer
    are fitted by a bounded-knapsack programme over a bit set of reachable sums."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left <= window:
            break
        more = min(counts[i] - take[i], max(0, (left - window // 2) // lengths[i]))
        take[i] += more
        left -= more * lengths[i]
    reach, steps, within = 1, [], (1 << left + 1) - 1
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, spare, part = lengths[i], min(counts[i] - take[i], left // lengths[i]), 1
        while spare > 0 and not reach >> left & 1:
            part = min(part, spare)
            steps.append((i, part, reach))
            reach |= reach << n * part & within
            spare -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            at -= lengths[i] * part
            take[i] += part
    return take


def sized(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))


def source_plan(spark: SparkSession, sizes: DataFrame, weights: tuple[float, ...], share: float) -> DataFrame:
    """(source, source_size, target, passes, rest): a row for each source."""
    rows = sorted(((r.source, int(r.source_size)) for r in sizes.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    goals = targets([n for _, n in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], share * sum(n for _, n in rows))
    plan = []
    for (source, n), t in zip(rows, goals):
        passes = int(t // n) if n else 0
        plan.append((source, n, t, passes, min(n, round(t - passes * n))))
    return spark.createDataFrame(plan, "source string, source_size long, target double, passes int, rest long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, seed: int = 42, **columns: str) -> DataFrame:
    """(doc_id, source, size, draw, source_size, target, copies): how often the mix takes each row of ``docs``."""
    spark = docs.sparkSession
    rows = written(sized(docs, seed, **columns))
    histogram = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    plan = source_plan(spark, histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share)

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        words = group[group["size"] > 0]
        extra = fit(words["size"].tolist(), words["n"].tolist(), int(group["rest"].iloc[0]))
        return words[["source", "size", "n", "passes", "source_size", "target"]].assign(extra=extra)

    lengths = histogram.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    counts = written(lengths.groupBy("source").applyInPandas(fitted, "source string, size long, n long, passes int, source_size long, target double, extra long"))
    some = counts.filter("extra > 0 and extra < n").select(F.col("source").alias("s"), F.col("size").alias("l"), "extra")
    chosen = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("l"))
    partly = ranked(rows.join(some, chosen).drop("s", "l"), ["source", "size"], ["draw", "doc_id"], "rank")
    drawn = partly.select("doc_id", "source", "size", "draw", (F.col("rank") < F.col("extra")).cast("int").alias("more"))
    wholly = counts.filter("extra = 0 or extra = n").select(F.col("source").alias("s"), F.col("size").alias("l"), (F.col("extra") > 0).cast("int").alias("more"))
    rest = rows.filter("size > 0").join(wholly, chosen).select("doc_id", "source", "size", "draw", "more")
    empty = rows.filter("size = 0").select("doc_id", "source", "size", "draw", F.lit(0).alias("more"))
    every = drawn.unionByName(rest).unionByName(empty)
    out = every.join(F.broadcast(plan.withColumnRenamed("source", "s")) if plan.count() <= 10_000 else plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("more")).otherwise(0)
    return out.select("doc_id", "source", "size", "draw", "source_size", "target", copies.cast("int").alias("copies"))


def taken(docs: DataFrame, **options) -> DataFrame:
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each copy that it takes."""
    plan = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = written(plan.groupBy(F.col("doc_id").alias("__kindred_id"), F.col("source").alias("__kindred_source"), F.col("draw").alias("__kindred_drawn")).agg(F.sum("copies").alias("__kindred_copies"), F.count(F.lit(1)).alias("__kindred_rows")))
    rows = docs.withColumn("__kindred_draw", F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    if not copies.filter("__kindred_rows > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, source_col, "__kindred_draw"])  # twins, whose copies are counted together
    wanted = copies.filter("__kindred_copies > 0").drop("__kindred_rows")
    on = rows[id_col].eqNullSafe(wanted["__kindred_id"]) & rows[source_col].eqNullSafe(wanted["__kindred_source"]) & (rows["__kindred_draw"] == wanted["__kindred_drawn"])
    each = F.explode(F.array_repeat(F.lit(1), F.col("__kindred_copies").cast("int"))).alias("__kindred_copy")
    return rows.join(wanted, on).select(*docs.columns, each).drop("__kindred_copy")
