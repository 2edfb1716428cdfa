"""Recall, candidate counts, rank summaries and selection. Entities without candidates or links count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio
from ..functions.text import source_of

K_VALUES = (20, 30, 50, 75, 100, 150)
EXPERIMENT_K = (50, 100, 150, 200)


def recall(found: Column, total: Column) -> Column:
    """Null without links."""
    return F.try_divide(found.cast("double"), total.cast("double"))


def count_summary(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Of one row for each entity, zero counts included."""
    return counts.groupBy(*by).agg(
        F.avg(n).alias("average_candidates"), F.median(n).alias("median_candidates"), F.max(n).cast("long").alias("maximum_candidates"),
        (100.0 * F.count_if(F.col(n) == 0) / F.count(F.lit(1))).alias("zero_candidate_percent"), F.sum(n).cast("long").alias("total_pairs"),
    )


def link_counts(links: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Links and found links, overall and by source, of rows (match_id, flag)."""
    src = source_of(F.col("match_id"))
    sums = [F.count(F.lit(1)).alias("true_links"), F.count_if(F.col(flag)).alias("found_links")]
    for s in ("S2", "S3"):
        sums += [F.count_if(src == s).alias(f"{s}_links"), F.count_if((src == s) & F.col(flag)).alias(f"{s}_found")]
    return links.groupBy(*by).agg(*sums)


def with_recall(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("overall_recall", recall(F.col("found_links"), F.col("true_links")))
    return out.withColumns({f"{s}_recall": recall(F.col(f"{s}_found"), F.col(f"{s}_links")) for s in ("S2", "S3")})


def evaluate(entities: DataFrame, truth: DataFrame, variants: DataFrame, names: list[str], axis: str) -> DataFrame:
    """A row for each variant: ``variants`` has (s1_id, cand_id) and a flag for each of ``names``."""
    stack = F.explode(F.array(*(F.struct(F.lit(v).alias(axis), F.col(v).alias("there")) for v in names)))
    axes = entities.select(F.col("entity_id").alias("s1_id"), F.explode(F.array(*map(F.lit, names))).alias(axis))
    there = variants.select("s1_id", "cand_id", stack.alias("x")).select("s1_id", "cand_id", f"x.{axis}", "x.there").filter("there")
    counts = axes.join(there.groupBy("s1_id", axis).agg(F.count(F.lit(1)).alias("n")), ["s1_id", axis], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    links = truth.select("s1_id", "match_id", F.explode(F.array(*map(F.lit, names))).alias(axis))
    found = links.join(there.withColumnRenamed("cand_id", "match_id"), ["s1_id", "match_id", axis], "left").withColumn("found", F.col("there").isNotNull())
    return evaluated(counts, found, axis)


def evaluated(counts: DataFrame, found: DataFrame, axis: str) -> DataFrame:
    """The same of (s1_id, axis, n) for every entity and variant and (match_id, axis, found) for every link and variant."""
    return with_recall(count_summary(counts, [axis]).join(link_counts(found, [axis], "found"), axis, "left"))


def best_configuration(metrics: DataFrame, axis: str = "config") -> DataFrame:
    """The highest recall, then the fewest candidates, then the first name."""
    return metrics.orderBy(F.desc("overall_recall"), "average_candidates", axis).limit(1)


def rank_summary(ranks: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Count, median, nearest-rank percentiles and maximum."""
    return ranks.groupBy(*by).agg(
        F.count(rank).alias("links"), F.median(rank).alias("median_rank"),
        *(F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {rank})").cast("long").alias(f"p{p}") for p in (90, 95, 99)),
        F.max(rank).alias("maximum_rank"),
    )


def rank_distribution(linked: DataFrame, by: list[str]) -> DataFrame:
    """Rank summaries overall and by source of the found links (match_id, rank)."""
    scoped = linked.filter("rank is not null").withColumn("scope", F.explode(F.array(F.lit("overall"), source_of(F.col("match_id")))))
    return rank_summary(scoped, [*by, "scope"])


def sweep(entities: DataFrame, truth: DataFrame, ranks: DataFrame, axis: str, ks: tuple[int, ...] = K_VALUES, names: tuple[str, ...] | None = None) -> DataFrame:
    """(axis, k) metrics of ``ranks`` (axis, s1_id, cand_id, rank): everything is ranked once, each K cuts the same list.
    ``names`` are the values of the axis, a few; without them the ranks are asked for theirs. Entities or links come first
    with each name, so that a name without candidates counts."""
    names = names or tuple(r[0] for r in ranks.select(axis).distinct().collect())
    sizes = ranks.groupBy(axis, "s1_id").agg(F.count(F.lit(1)).alias("all"))
    return swept(entities, sizes, linked_ranks(each_name(truth, axis, names), ranks, axis), axis, ks, names)


def swept(entities: DataFrame, sizes: DataFrame, links: DataFrame, axis: str, ks: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """The same of (axis, s1_id, all), the candidates of the entities that have some, and (axis, match_id, rank) of every link."""
    grid = each_name(entities.select(F.col("entity_id").alias("s1_id")), axis, names)
    every_k = F.explode(F.array(*map(F.lit, ks))).alias("k")
    counts = grid.join(sizes, [axis, "s1_id"], "left").select(axis, "s1_id", F.coalesce("all", F.lit(0)).alias("all"), every_k).withColumn("n", F.least("k", "all"))
    cut = links.select(axis, "match_id", "rank", every_k).withColumn("found", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)))
    broad = links.groupBy(axis).agg(F.count("rank").alias("broad_found"), *(F.count_if(F.col("rank").isNotNull() & (source_of(F.col("match_id")) == s)).alias(f"broad_{s}") for s in ("S2", "S3")))
    rows = with_recall(count_summary(counts, [axis, "k"]).join(link_counts(cut, [axis, "k"], "found"), [axis, "k"], "left")).join(broad, axis, "left")
    lost = {"lost_links": F.col("broad_found") - F.col("found_links"), "missed_links": F.col("true_links") - F.col("found_links")}
    return rows.withColumns(lost | {f"{s}_lost": F.col(f"broad_{s}") - F.col(f"{s}_found") for s in ("S2", "S3")})


def each_name(rows: DataFrame, axis: str, names: tuple[str, ...]) -> DataFrame:
    """Each row once for each name, as the column ``axis``."""
    return rows.withColumn(axis, F.explode(F.array(*map(F.lit, names))))


def linked_ranks(truth: DataFrame, ranks: DataFrame, axis: str | None = None) -> DataFrame:
    """Every true link with its rank, null where it is no candidate."""
    on = ["s1_id", "match_id", *([axis] if axis else [])]
    return truth.join(ranks.withColumnRenamed("cand_id", "match_id").select(*on, "rank"), on, "left")


def selection(metrics: DataFrame, axis: str = "formula", most_lost: float = 0.005) -> DataFrame:
    """The formula of the highest recall at 50 and then 20, and the smallest K that loses at most ``most_lost`` of recall, or
    the largest K with the target missed."""
    at = metrics.groupBy(axis).agg(*(F.max(F.when(F.col("k") == k, F.col("overall_recall"))).alias(f"r{k}") for k in (50, 20)))
    order = F.expr(f"case {axis} when 'name_first' then 0 when 'balanced' then 1 else 2 end")
    best = at.orderBy(F.desc("r50"), F.desc("r20"), order).limit(1).select(axis)
    own = metrics.join(best, axis).withColumn("loss", ratio(F.col("broad_found") - F.col("found_links"), F.col("true_links")))
    return own.groupBy(axis).agg(F.coalesce(F.min(F.when(F.col("loss") <= most_lost, F.col("k"))), F.max("k")).alias("k"), F.bool_or(F.col("loss") <= most_lost).alias("k_loss_target_met"))


def recovered(failures: DataFrame, ranks: DataFrame, ks: tuple[int, ...] = EXPERIMENT_K) -> DataFrame:
    """(k, kind, recovered): failed links (kind, s1_id, match_id) that new ranks bring within K."""
    links = linked_ranks(failures.select("kind", "s1_id", "match_id"), ranks).select("kind", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return links.groupBy("k", "kind").agg(F.count_if(F.col("rank") <= F.col("k")).alias("recovered"))


def newly_lost(truth: DataFrame, failures: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """Links kept before and no longer within K."""
    return lost(truth.join(failures.select("s1_id", "match_id"), ["s1_id", "match_id"], "left_anti"), ranks, k)


def lost(kept: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """The same of the links kept before."""
    return linked_ranks(kept, ranks).agg(F.count_if(F.coalesce(F.col("rank") > k, F.lit(True))).alias("newly_lost"))


def example_outcomes(truth: DataFrame, ranks: DataFrame, seq: DataFrame, k: int, most: int = 10) -> DataFrame:
    """(outcome, s1_id): the first entities with all links within K of more candidates, and those with a candidate link beyond."""
    return outcomes(linked_ranks(truth, ranks), ranks.groupBy("s1_id").agg(F.count(F.lit(1)).alias("all")), seq, k, most)


def outcomes(linked: DataFrame, sizes: DataFrame, seq: DataFrame, k: int, most: int = 10) -> DataFrame:
    """The same of every link's rank and (s1_id, all), the candidates of the entities that have some."""
    links = linked.groupBy("s1_id").agg(F.count_if(F.coalesce(F.col("rank") > k, F.lit(True))).alias("outside"), F.count_if(F.col("rank") > k).alias("beyond"))
    rows = links.join(sizes, "s1_id").join(seq, "s1_id")
    good = rows.filter((F.col("outside") == 0) & (F.col("all") > k)).orderBy("seq", "s1_id").limit(most).select(F.lit("success").alias("outcome"), "s1_id")
    return good.unionByName(rows.filter("beyond > 0").orderBy("seq", "s1_id").limit(most).select(F.lit("failure").alias("outcome"), "s1_id"))


def candidate_listing(candidates: DataFrame, truth: DataFrame, seq: DataFrame, most: int = 10) -> DataFrame:
    """(s1_id, cand_id, is_match, is_candidate) of the first ``most`` entities: every candidate, told whether it is a match,
    and every match that is no candidate."""
    first = seq.orderBy("seq", "s1_id").limit(most).select("s1_id")
    found = candidates.select("s1_id", "cand_id", F.lit(True).alias("c"))
    true = truth.select("s1_id", F.col("match_id").alias("cand_id"), F.lit(True).alias("m"))
    rows = found.join(true, ["s1_id", "cand_id"], "full").join(F.broadcast(first), "s1_id", "left_semi")
    return rows.select("s1_id", "cand_id", F.col("m").isNotNull().alias("is_match"), F.col("c").isNotNull().alias("is_candidate"))


def assert_reproduced(metrics: DataFrame, expected: dict[str, object]) -> None:
    """Raise unless the one row of ``metrics`` has the values of an earlier run."""
    row = metrics.first().asDict()
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise ValueError(f"an earlier run is not reproduced: {wrong}")
