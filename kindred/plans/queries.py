"""The linkage queries over the driver's tables. Cutoffs are parameters; those of the failure queries fit the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.similarity import indel_ratio, token_set_ratio
from ..functions.text import script_profile
from ..operators import blocking, cells, evaluation, failures, features, frequency, paired, profiling, scoring, validation
from ..sources import records as src
from .fixture import Linkage, raw_sources

#: Ranks behind this count as ranking failures in the registered queries.
CUTOFF = 20
PLACES = 6


def _rounded(df: DataFrame, *skip: str) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*(F.bround(c, PLACES).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.records(raw_sources(spark, sf_dir), "seq").select("entity_id", "name", "address", "country", "src", "seq")


def blocking_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.blocking_keys(Linkage(spark, sf_dir).records)


def _candidates(config: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Linkage(spark, sf_dir)
        return blocking.candidates(x.queries, x.pool, config)

    return query


def _block_metrics(x: Linkage) -> DataFrame:
    flags = x.linked(x.tokens).select("match_id", *(v.alias(k) for k, v in cells.rules().items()))
    return _evaluated(x, cells.counts(x.queries, x.pool), flags, {c: (c, F.col(c)) for c in blocking.CONFIGURATIONS}, "config")


def _evaluated(x: Linkage, counts: DataFrame, flags: DataFrame, variants: dict[str, tuple], axis: str) -> DataFrame:
    """``variants`` tells of each name the column of its candidates' counts and whether a link is found."""
    stack = lambda name, of: F.explode(F.array(*(F.struct(F.lit(v).alias(axis), of(v).alias(name)) for v in variants))).alias("x")
    sizes = x.queries.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select("s1_id", stack("n", lambda v: F.coalesce(variants[v][0], F.lit(0))))
    found = flags.select("match_id", stack("found", lambda v: variants[v][1]))
    return evaluation.evaluated(sizes.select("s1_id", "x.*"), found.select("match_id", "x.*"), axis)


def block_eval_abc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_block_metrics(Linkage(spark, sf_dir)))


def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_configuration(_block_metrics(Linkage(spark, sf_dir))).select("config", "total_pairs")


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).terms


def idf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return _rounded(frequency.idf_weights(x.docs, x.terms))


def rare_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return blocking.rare_names(x.queries, x.pool, x.terms)


def rare_address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return blocking.rare_addresses(x.queries, x.pool, x.terms)


def rare_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return blocking.rare_trigrams(x.queries, x.pool, x.terms)


def expanded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).expanded


def pair_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Linkage(spark, sf_dir).signals)


def _ranks(formula: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(scoring.formula_ranks(Linkage(spark, sf_dir).signals, (formula,)).drop("formula"))

    return query


def topk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return _rounded(_formula_sweep(x))


def _formula_sweep(x: Linkage) -> DataFrame:
    linked, sizes = x.formula_links(tuple(scoring.FORMULAS))
    return evaluation.swept(x.queries, sizes, linked, "formula", evaluation.K_VALUES, tuple(scoring.FORMULAS))


def formula_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.selection(_formula_sweep(Linkage(spark, sf_dir)))


def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rank_distribution(Linkage(spark, sf_dir).formula_links(tuple(scoring.FORMULAS))[0], ["formula"])


def improved_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return cells.improved_pairs(*x.sides(x.weights), places=PLACES)


def address_rescue_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return _rounded(scoring.top_k(cells.top(*x.sides(x.weights), 50), 50))


#: Config C by either score, and the expanded candidates: score and rules.
VARIANTS = {"C_weighted": ("weighted", cells.BASE), "C_address_rescue": ("score", cells.BASE), "expanded_address_rescue": ("score", cells.ALL)}


def _rescued(x: Linkage) -> DataFrame:
    """(s1_id, cand_id, rank) of the links among the expanded candidates."""
    linked, _ = x.variant_links({"expanded_address_rescue": VARIANTS["expanded_address_rescue"]})
    return linked.filter("rank is not null").withColumnRenamed("match_id", "cand_id")


def expansion_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    left, right = x.sides(x.rare_records)
    tokens = F.col("C") | F.col("in_tokens")
    variants = {"C": ("C", F.col("C")), "C_tokens": ("T", tokens), "C_tokens_ngrams": ("E", tokens | F.col("in_ngrams"))}
    flags = x.linked(x.rare_records).select("match_id", *(v.alias(k) for k, v in cells.rules(expanded=True).items()))
    return _rounded(_evaluated(x, cells.counts(left, right, expanded=True), flags, variants, "variant"))


def experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    linked, sizes = x.variant_links(VARIANTS)
    return _rounded(evaluation.swept(x.queries, sizes, linked, "variant", evaluation.EXPERIMENT_K, tuple(VARIANTS)))


def experiment_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked, _ = Linkage(spark, sf_dir).variant_links(VARIANTS)
    return evaluation.rank_summary(linked.filter("rank is not null"), ["variant"])


def _failed(x: Linkage) -> DataFrame:
    return failures.kinds(x.formula_links(("address_supported",))[0], CUTOFF)


def _supported(x: Linkage, failed: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score, rank) up to the cutoff, of the entities with a ranking failure."""
    wanted = failed.filter("kind = 'ranking'").select(F.col("s1_id").alias("entity_id")).distinct()
    return scoring.top_k(cells.top(x.queries.join(wanted, "entity_id", "left_semi"), x.pool, CUTOFF, "address_supported"), CUTOFF)


def recovery_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return evaluation.recovered(_failed(x), _rescued(x))


def newly_lost_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    linked, _ = x.formula_links(("address_supported",))
    return evaluation.lost(linked.filter(F.col("rank") <= CUTOFF).select("s1_id", "match_id"), _rescued(x), CUTOFF)


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).features()


def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.statistics(Linkage(spark, sf_dir).features()))


def separation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.separation(features.statistics(Linkage(spark, sf_dir).features())))


def constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.constant_features(features.statistics(Linkage(spark, sf_dir).features()))


def split_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).split


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return _rounded(features.balances(x.split, x.truth, paired.match_labels(x.kept(), x.truth)))


def frozen_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Linkage(spark, sf_dir).frozen[1]


def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(Linkage(spark, sf_dir))


def _common(x: Linkage, fields: tuple[str, ...] = ("name", "address")) -> DataFrame:
    rows = frequency.term_counts(x.pool, fields).join(x.docs, "country")
    return rows.filter(frequency.is_common(F.col("n"), F.col("df"))).select("field", "country", "term")


def _flagged(x: Linkage) -> DataFrame:
    failed = _failed(x).select("s1_id", F.col("match_id").alias("cand_id"), "kind")
    pairs = x.linked(x.tokens).withColumnRenamed("match_id", "cand_id").join(failed, ["s1_id", "cand_id"])
    return failures.flags(pairs, _common(x, ("name",)).select("country", "term"), extra=("kind",))


def failure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(Linkage(spark, sf_dir))


def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.categories(_flagged(Linkage(spark, sf_dir)))


def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    rows = _flagged(x).join(x.queries.select(F.col("entity_id").alias("s1_id"), "seq"), "s1_id")
    return failures.examples(rows).select("kind", "flag", "s1_id", "cand_id", F.col("place").cast("long").alias("place"))


def rival_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    failed = _failed(x).persist()
    found = failures.rivals(failed, _supported(x, failed), x.truth, CUTOFF).persist()
    rival = found.select("s1_id", F.col("rival_id").alias("cand_id"), "match_id")
    both = rival.drop("match_id").union(found.select("s1_id", "match_id")).distinct()
    return failures.rival_diagnostics(x.pairs(rival), scoring.pair_signals(x.pairs(both)), _common(x))


def failure_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    failed = _failed(x).persist()
    return _rounded(failures.cutoffs(failed, _supported(x, failed), x.truth, CUTOFF))


def ranking_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    linked, sizes = x.formula_links(("address_supported",))
    return evaluation.outcomes(linked, sizes, x.queries.select(F.col("entity_id").alias("s1_id"), "seq"), CUTOFF)


def candidate_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    first = x.queries.orderBy("seq", "entity_id").limit(10)
    seq = first.select(F.col("entity_id").alias("s1_id"), "seq")
    return evaluation.candidate_listing(blocking.candidates(first, x.pool), x.truth.join(F.broadcast(seq.select("s1_id")), "s1_id", "left_semi"), seq, 10)


def script_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Linkage(spark, sf_dir).queries.select("entity_id", script_profile(F.col("name")).alias("p"))
    return rows.select("entity_id", F.array_join("p.scripts", ",").alias("scripts"), F.col("p.dominant").alias("dominant"))


def truth_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return _rounded(profiling.cardinality(profiling.match_lists(x.queries, x.truth)))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    return profiling.source_coverage(profiling.match_lists(x.queries, x.truth))


def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth table with flaws put in by rule: ids beyond the tables, another prefix, repeats, unknown entities."""
    x = Linkage(spark, sf_dir)
    lists = x.truth.groupBy("s1_id").agg(F.collect_list("match_id").alias("ids"))
    number = F.substring("s1_id", 4, 20).cast("long")
    flawed = lists.withColumn("ids", F.when(number % 7 == 0, F.concat("ids", F.array(F.element_at("ids", 1)))).when(number % 7 == 1, F.concat("ids", F.array(F.concat(F.lit("S2-x"), "s1_id")))).when(number % 7 == 2, F.concat("ids", F.array(F.lit("Q-1")))).otherwise(F.col("ids")))
    named = flawed.withColumn("s1_id", F.when(number % 11 == 0, F.concat(F.lit("S1-x"), number)).otherwise(F.col("s1_id")))
    return profiling.integrity(named, x.queries, x.pool)


def orders_customer_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    lost = orders.join(customer, orders.o_custkey == customer.c_custkey, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("orders_without_customer"))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.table_profile(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiling.text_statistics(Linkage(spark, sf_dir).records, "business_address", ["src"]))


def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.value_counts(Linkage(spark, sf_dir).records, "src", "country")


def train_test_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with odd tens of seq against the others."""
    x = Linkage(spark, sf_dir).records
    tens = F.floor(F.col("seq") / 10) % 2
    return _rounded(profiling.drift(x.filter(tens == 0), x.filter(tens == 1)))


def record_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    wanted = {"one": ("n = 1", 10), "none": ("n = 0", 10), "two": ("n >= 2", 3)}
    return profiling.examples(profiling.match_lists(x.queries, x.truth), x.truth, x.queries, x.pool, wanted)


RESULT_LINES = """
select 1 as line, 'source1_entity_id\tmatched_entity_ids' as value
union all select 2 + doc_id * 2, case doc_id % 13 when 1 then concat('S1-', doc_id) when 2 then concat('S1-', doc_id, '\t', 'S2-', doc_id, ',S2-', doc_id) when 3 then concat('S1-', doc_id, '\t', ' S2-', doc_id)
  when 4 then concat('S1-', doc_id, '\tS2-', doc_id, ',,S3-', doc_id) when 5 then concat('S1-', doc_id, '\tS1-', doc_id) when 6 then '' when 7 then concat('S1-', doc_id, '\t') else concat('S1-', doc_id, '\tS2-', doc_id, ',S3-', doc_id) end from {documents}
union all select 3 + doc_id * 2, concat('S1-', doc_id, '\tS3-', doc_id) from {documents} where doc_id % 17 = 0
"""


def validator_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results file made by rule of doc_id, flaws and all."""
    lines = spark.sql(RESULT_LINES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    x = Linkage(spark, sf_dir)
    return validation.findings(validation.lists_of(lines), x.queries.select("entity_id"), x.pool.select("entity_id"))


def pool_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    s2 = x.pool.filter("src = 2")
    required = x.truth.select(F.col("match_id").alias("entity_id")).filter("entity_id like 'S2-%'")
    return src.sampled_pool(s2, required, 100, 44).select("entity_id")


def pool_sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Linkage(spark, sf_dir)
    s2 = x.pool.filter("src = 2")
    required = x.truth.select(F.col("match_id").alias("entity_id")).filter("entity_id like 'S2-%'")
    return src.pool_stats(s2, required, src.sampled_pool(s2, required, 100, 44))


def row_range_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.first_rows(Linkage(spark, sf_dir).queries, 21, 60).select("entity_id")


def result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches as one list for each entity, empty ones too."""
    x = Linkage(spark, sf_dir)
    lists = x.truth.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("match_id")), ",").alias("ids"))
    return x.queries.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select("s1_id", F.coalesce("ids", F.lit("")).alias("ids"))


def fuzz_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional string ratios of true links' names."""
    x = Linkage(spark, sf_dir)
    rows = x.pairs(x.truth.select("s1_id", F.col("match_id").alias("cand_id")))
    return _rounded(rows.select("s1_id", "cand_id", indel_ratio(F.col("a_name"), F.col("b_name")).alias("name_indel_ratio"), token_set_ratio(F.col("a_name"), F.col("b_name")).alias("name_token_set_ratio")))


QUERIES = {f.__name__: f for f in (
    normalize_records, blocking_keys, block_eval_abc, best_configuration, doc_freq, idf_weights, rare_name_tokens, rare_address_tokens, rare_trigrams, expanded_candidates, pair_signals, topk_sweep, formula_selection,
    rank_summary, improved_signals, address_rescue_top50, expansion_eval, experiment_sweep, experiment_ranks, recovery_accounting, newly_lost_links, pair_features, feature_statistics, separation_report, constant_features,
    split_entities, label_balance, frozen_doc_freq, failure_kinds, failure_flags, failure_categories, failure_examples, rival_diagnostics, failure_cutoffs, ranking_examples, candidate_listing, script_profiles, truth_cardinality, source_coverage,
    integrity_checks, orders_customer_integrity, customer_profile, text_stats, value_counts, train_test_drift, record_examples, validator_findings, pool_sample, pool_sample_stats, row_range_sample, result_lists, fuzz_ratio,
)}
QUERIES |= {f"candidates_{c.lower()}": _candidates(c) for c in blocking.CONFIGURATIONS} | {f"rank_{f}": _ranks(f) for f in scoring.FORMULAS}
