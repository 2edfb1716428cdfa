import math

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, evaluation, failures, features, frequency, scoring
from kindred.sources import records as src
from kindred.sources import sinks

RAW = "entity_id string, business_name string, business_address string, country string"


def made(spark, *rows):
    return frequency.prepared(src.records(spark.createDataFrame(rows, RAW)))


def pairs(df, a="s1_id", b="cand_id"):
    return {(r[a], r[b]) for r in df.collect()}


@pytest.fixture(scope="module")
def basic(spark):
    q = made(spark, ("S1-1", "Alpha Shop", "25 Road", "X"))
    p = made(spark, ("S2-1", "Alpha Store", "9 Lane", "X"), ("S2-2", "Beta", "25 Road", "X"), ("S3-1", "Alphabet", "7 Way", "X"), ("S3-2", "Alpha Shop", "25 Road", "Y"))
    return q, p


@pytest.mark.parametrize("config,found", [("A", {"S2-1"}), ("B", {"S2-1", "S2-2"}), ("C", {"S2-1", "S2-2", "S3-1"})])
def test_blocking(basic, config, found):
    assert pairs(blocking.candidates(*basic, config)) == {("S1-1", c) for c in found}


def test_blocking_flags(basic):
    got = {r.cand_id: (r.a, r.b) for r in blocking.candidates_by_config(*basic).collect()}
    assert got == {"S2-1": (True, True), "S2-2": (False, True), "S3-1": (False, False)}


def test_no_keys_without_country_or_name(spark):
    assert blocking.blocking_keys(made(spark, ("S1-1", "A", "1 b", ""))).count() == 0
    keys = blocking.blocking_keys(made(spark, ("S1-2", None, "1 b", "X"))).collect()
    assert [(k.rule, k.value) for k in keys] == [("address_number", "1")]


def test_document_frequencies_count_records(spark):
    ready = made(spark, ("S2-1", "a a b", "", "X"), ("S2-2", "a", "", "X"))
    got = {(r.field, r.term): r.df for r in frequency.term_counts(ready, ("name", "address")).collect()}
    assert got == {("name", "a"): 2, ("name", "b"): 1}


def test_rare_tokens_find_reordered_names(spark):
    q, p = made(spark, ("S1-1", "Quorn Mills", "", "X")), made(spark, ("S2-1", "Mills Quorn", "", "X"))
    assert pairs(blocking.candidates(q, p)) == set()
    assert pairs(blocking.rare_names(q, p, frequency.term_counts(p))) == {("S1-1", "S2-1")}


def test_two_address_words_are_needed(spark):
    q = made(spark, ("S1-1", "", "1 high street", "X"))
    p = made(spark, ("S2-1", "", "high street", "X"), ("S2-2", "", "high 1", "X"))
    assert pairs(blocking.rare_addresses(q, p, frequency.term_counts(p))) == {("S1-1", "S2-1")}


def test_trigrams(spark):
    q, p = made(spark, ("S1-1", "Nordwint", "", "X")), made(spark, ("S2-1", "Mordwint", "", "X"))
    terms = frequency.term_counts(p)
    assert pairs(blocking.candidates(q, p)) == set() == pairs(blocking.rare_names(q, p, terms))
    got = blocking.expanded(q, p, terms).collect()
    assert [(r.in_c, r.in_tokens, r.in_ngrams) for r in got] == [(False, False, True)]


def test_common_keys_are_left_out_whole(spark):
    q = made(spark, ("S1-1", "Tarn Oval", "upper mill lane", "X"))
    p = made(spark, *((f"S2-{i}", "Oval Tarn", "upper mill lane", "X") for i in range(340)))
    terms = frequency.term_counts(p)
    assert blocking.rare_names(q, p, terms).count() == blocking.rare_addresses(q, p, terms).count() == blocking.rare_trigrams(q, p, terms).count() == 0


def weighted(spark, q, p, fit=None):
    fit = p if fit is None else fit
    docs, terms = frequency.document_counts(fit), frequency.term_counts(fit, ("name", "address"))
    both = [frequency.weighted(x, docs, terms) for x in (q, p)]
    ids = q.select(F.col("entity_id").alias("s1_id")).crossJoin(p.select(F.col("entity_id").alias("cand_id")))
    return scoring.with_records(ids, *both)


def test_formulas_and_signals(spark):
    assert all(math.isclose(sum(w), 1) for w in scoring.FORMULAS.values())
    q, p = made(spark, ("S1-1", "alpha shop", "25 road", "X")), made(spark, ("S2-1", "alpha store", "25 lane a", "X"), ("S2-2", "alpha shop", "", "Y"))
    got = {r.cand_id: r for r in scoring.pair_signals(weighted(spark, q, p)).collect()}
    a = got["S2-1"]
    assert (a.name_jaccard, a.address_jaccard, a.shared_number, a.name_prefix, a.name_exact) == (pytest.approx(1 / 3), 0.25, 1, 1, 0)
    assert got["S2-2"].missing_address and not got["S2-2"].country_equal
    scored = scoring.pair_signals(weighted(spark, q, p)).withColumn("score", scoring.ranking_score("balanced"))
    assert [r.cand_id for r in scoring.ranked(scored).collect()] == ["S2-1"]


def test_improved_score_without_addresses(spark):
    q, p = made(spark, ("S1-1", "alpha", "", "X")), made(spark, ("S2-1", "alpha", "", "X"), ("S2-2", "alpha", "", ""))
    rows = {r.cand_id: r for r in scoring.improved_signals(weighted(spark, q, p)).withColumn("score", scoring.improved_score()).collect()}
    r = rows["S2-1"]
    assert (r.name_evidence, r.address_evidence, r.numeric_evidence, r.score) == (1, 0, 0, 0.65)
    assert rows["S2-2"].score is None
    with pytest.raises(ValueError):
        scoring.improved_score("other")


def test_rare_numbers_weigh_more(spark):
    q = made(spark, ("S1-1", "a", "7 x", "X"), ("S1-2", "a", "9 x", "X"))
    p = made(spark, ("S2-1", "a", "7 y", "X"), *((f"S2-{i}", "a", "9 y", "X") for i in range(2, 12)))
    rows = {(r.s1_id, r.cand_id): r.numeric_evidence for r in scoring.improved_signals(weighted(spark, q, p)).collect()}
    assert rows["S1-1", "S2-1"] > rows["S1-2", "S2-2"] > 0 == rows["S1-1", "S2-2"]


def test_ranks_break_ties_by_id(spark):
    rows = spark.createDataFrame([("S1-1", "S3-1", 0.5), ("S1-1", "S2-2", 0.5), ("S1-1", "S2-1", 0.5), ("S1-1", "S2-9", None), ("S1-1", "S2-8", 0.9)], "s1_id string, cand_id string, score double")
    assert [r.cand_id for r in scoring.ranked(rows).orderBy("rank").collect()] == ["S2-8", "S2-1", "S2-2", "S3-1"]
    assert scoring.top_k(rows, 2).count() == 2
    with pytest.raises(ValueError):
        scoring.top_k(rows, 0)


def test_recall_counts_entities_without_candidates(spark):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S3-1")], "s1_id string, match_id string")
    found = spark.createDataFrame([("S1-1", "S2-1", True), ("S1-1", "S2-2", True)], "s1_id string, cand_id string, C boolean")
    r = evaluation.evaluate(entities, truth, found, ["C"], "config").first()
    assert (r.overall_recall, r.S2_recall, r.S3_recall) == (pytest.approx(2 / 3), 1, 0)
    assert (r.average_candidates, r.median_candidates, r.maximum_candidates, r.zero_candidate_percent, r.total_pairs) == (1, 1, 2, 50, 2)


def test_rank_summary(spark):
    rows = spark.range(1, 101).select(F.lit("x").alias("f"), F.col("id").alias("rank"))
    r = evaluation.rank_summary(rows, ["f"]).first()
    assert (r.links, r.median_rank, r.p90, r.p95, r.p99, r.maximum_rank) == (100, 50.5, 90, 95, 99, 100)


def test_sweep_tells_pruning_from_blocking(spark):
    entities = spark.createDataFrame([("S1-1",)], "entity_id string")
    ranks = spark.range(1, 27).select(F.lit("f").alias("formula"), F.lit("S1-1").alias("s1_id"), F.format_string("S2-%02d", "id").alias("cand_id"), F.col("id").alias("rank"))
    truth = spark.createDataFrame([("S1-1", f"S2-{i:02d}") for i in (1, 21, 26, 99)], "s1_id string, match_id string")
    got = {r.k: r for r in evaluation.sweep(entities, truth, ranks, "formula", (20, 30)).collect()}
    assert (got[20].overall_recall, got[20].lost_links, got[20].missed_links, got[20].total_pairs) == (0.25, 2, 3, 20)
    assert (got[30].overall_recall, got[30].lost_links, got[30].missed_links, got[30].total_pairs) == (0.75, 0, 1, 26)


def test_failure_flags(spark):
    q, p = made(spark, ("S1-1", "Ltd Alpha", "25 Road", "X")), made(spark, ("S2-1", "Alpha Ltd", "", "X"), ("S2-2", "गंगा", "26 Road", "Y"))
    common = spark.createDataFrame([], "country string, term string")
    got = {r.cand_id: {f for f in failures.FLAGS if r[f]} for r in failures.flags(weighted(spark, q, p), common).collect()}
    assert got["S2-1"] == {"first_name_token_changed", "name_tokens_reordered", "spelling_change_proxy", "address_missing", "no_shared_address_words", "address_numbers_missing_on_either_side", "short_name_on_either_side"}
    assert {"country_missing_or_different", "different_dominant_scripts", "disjoint_letter_scripts", "no_shared_name_tokens", "address_numbers_disjoint", "nonempty_addresses_differ", "weak_character_name_overlap"} <= got["S2-2"]


def test_identical_pair_features(spark):
    q, p = made(spark, ("S1-1", "Alpha Shop", "25 Road", "X")), made(spark, ("S2-1", "alpha shop", "25, road", "x"))
    rows = weighted(spark, q, p).withColumns({"score": F.lit(1.0), "rank": F.lit(1)})
    r = features.pair_features(rows).first()
    ones = ("name_exact", "name_token_jaccard", "name_bigram_dice", "name_trigram_dice", "name_length_ratio", "name_prefix_similarity", "name_rare_token_dice", "address_exact", "address_token_jaccard", "address_bigram_dice", "address_length_ratio", "country_equal", "ranking_available", "candidate_is_s2")
    assert all(r[f] == 1 for f in ones) and len(features.FEATURES) == 25
    assert r.shared_numeric_token_count == 1 and r.candidate_is_s3 == 0
    assert set(features.FUZZY) <= set(features.pair_features(rows, fuzzy=True).columns)


def test_numbers_and_missing_ranking(spark):
    q, p = made(spark, ("S1-1", None, "25 25/7 001", "X")), made(spark, ("S3-1", "b", "25/7 1", "X"))
    none = {"score": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")}
    r = features.pair_features(weighted(spark, q, p).withColumns(none)).first()
    assert (r.shared_numeric_token_count, r.numeric_token_jaccard, r.s1_name_missing, r.candidate_rank, r.ranking_available) == (2, 0.5, 1, 0, 0)
    with pytest.raises(Exception, match="invalid"):
        features.pair_features(weighted(spark, q, p).withColumns(none | {"rank": F.lit(1)})).collect()


def test_split(spark):
    ids = spark.range(100).select(F.format_string("S1-%d", "id").alias("entity_id"))
    a = {r.s1_id: r.split for r in features.split_entities(ids).collect()}
    assert sorted(a.values()).count("validation") == 20 and len(a) == 100
    assert a == {r.s1_id: r.split for r in features.split_entities(ids.orderBy(F.desc("entity_id"))).collect()}
    for bad in (0, 1):
        with pytest.raises(ValueError):
            features.split_entities(ids, bad)
    with pytest.raises(ValueError):
        features.split_entities(ids.limit(1))


def test_statistics(spark):
    rows = spark.createDataFrame([("train", 1, x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "split string, label int, f double")
    r = features.statistics(rows, ("f",)).first()
    assert (r["count"], r["mean"], r["median"], r["p90"], r["min"], r["max"]) == (5, 0.5, 0.5, pytest.approx(0.9), 0, 1)
    assert r["std"] == pytest.approx(math.sqrt(0.125))
    with pytest.raises(Exception, match="finite"):
        features.statistics(rows.withColumn("f", F.lit(float("nan"))), ("f",)).collect()


def test_training_pool_leaves_out_validation_matches(spark):
    p = made(spark, ("S2-1", "a", "", "X"), ("S2-2", "b", "", "X"), ("S2-3", "c", "", "X"))
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-2", "S2-1")], "s1_id string, match_id string")
    split = spark.createDataFrame([("S1-1", "train"), ("S1-2", "validation")], "s1_id string, split string")
    assert {r.entity_id for r in features.training_pool(p, truth, split).collect()} == {"S2-1", "S2-3"}


def test_readers(spark, tmp_path):
    f = tmp_path / "s.tsv"
    f.write_text('﻿entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""q"" B"\t"x\ny"\tFR\nS1-2\tsay "hi"\t\tFR\n', encoding="utf-8")
    rows = src.read_tsv(spark, str(f)).collect()
    assert [(r.entity_id, r.business_name, r.business_address) for r in rows] == [("S1-1", 'A "q" B', "x\ny"), ("S1-2", 'say "hi"', None)]
    assert [r.address for r in src.records(src.read_tsv(spark, str(f))).orderBy("seq").collect()] == ["x y", ""]


def test_truth(spark):
    ids = spark.createDataFrame([("S1-1",)], "entity_id string")
    raw = spark.createDataFrame([("S1-1", "S2-1,S2-1, S3-1,"), ("S1-1", "S3-2"), ("S1-9", "")], src.TRUTH_SCHEMA)
    assert pairs(src.truth(raw, ids), b="match_id") == {("S1-1", "S2-1"), ("S1-1", "S3-1"), ("S1-1", "S3-2")}
    with pytest.raises(ValueError):
        src.truth(raw, spark.createDataFrame([("S1-7",)], "entity_id string"))
    with pytest.raises(ValueError):
        src.truth(spark.createDataFrame([("S1-1", "Q-1")], src.TRUTH_SCHEMA), ids)


def test_pool_sample(spark):
    rows = spark.range(20).select(F.format_string("S2-%d", "id").alias("entity_id"))
    need = spark.createDataFrame([("S2-3",), ("S2-7",)], "entity_id string")
    got = src.sampled_pool(rows, need, 3, 1)
    assert got.count() == 5 and {"S2-3", "S2-7"} <= {r.entity_id for r in got.collect()}
    assert got.collect() == src.sampled_pool(rows.orderBy(F.rand(3)), need, 3, 1).collect() or {r.entity_id for r in got.collect()} == {r.entity_id for r in src.sampled_pool(rows.orderBy(F.rand(3)), need, 3, 1).collect()}
    assert src.pool_stats(rows, need, got).first() == (20, 2, 3, 5)
    with pytest.raises(ValueError):
        src.sampled_pool(rows, spark.createDataFrame([("S2-99",)], "entity_id string"), 3, 1)


def test_sinks(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    links = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1")], "s1_id string, match_id string")
    sinks.write_results(links, ids, str(tmp_path / "r"))
    lines = sorted(x for f in (tmp_path / "r").glob("*.csv") for x in f.read_text().splitlines())
    assert "S1-1\tS2-1,S3-1" in lines and "S1-2\t" in lines
    docs, terms = spark.createDataFrame([("x", 2)], "country string, n long"), spark.createDataFrame([("name", "x", "a", 1)], "field string, country string, term string, df long")
    sinks.save_frequencies(docs, terms, str(tmp_path / "f"))
    assert [sorted(x.collect()) for x in sinks.load_frequencies(spark, str(tmp_path / "f"))] == [docs.collect(), terms.collect()]
    sinks.save_sample(ids, ids, links, {"a": 1}, str(tmp_path / "s"))
    assert sinks.load_sample(spark, str(tmp_path / "s"), {"a": 2}) is None
    assert sinks.load_sample(spark, str(tmp_path / "s"), {"a": 1})[2].count() == 2
    sinks.write_pairs(links.withColumnRenamed("match_id", "cand_id"), str(tmp_path / "p"))
    sinks.write_split(spark.createDataFrame([("S1-1", "train")], "s1_id string, split string"), str(tmp_path / "sp"))
    sinks.write_ids(ids, str(tmp_path / "i"))
    sinks.report(docs, str(tmp_path / "rep"), "Counts")
    assert spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).filter("candidate_source = 'S2'").count() == 1
    assert len(sinks.input_manifest(spark, str(tmp_path / "i"))) >= 1


def test_listing_and_reproduction(spark):
    found = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-2", "S2-9")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S3-7")], "s1_id string, match_id string")
    seq = spark.createDataFrame([("S1-1", 1), ("S1-2", 2)], "s1_id string, seq long")
    rows = {tuple(r) for r in evaluation.candidate_listing(found, truth, seq, 1).collect()}
    assert rows == {("S1-1", "S2-1", True, True), ("S1-1", "S2-2", False, True), ("S1-1", "S3-7", True, False)}
    metrics = spark.createDataFrame([(3, 2)], "total_pairs int, found_links int")
    evaluation.assert_reproduced(metrics, {"total_pairs": 3})
    with pytest.raises(ValueError):
        evaluation.assert_reproduced(metrics, {"total_pairs": 4})
    assert len(features.schema_descriptor()["features"]) == 25 and len(features.schema_descriptor(True)["features"]) == 27


def test_a_pair_of_an_entity_without_truth_is_an_error(spark):
    rows = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-1")], "s1_id string, cand_id string")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "s1_id string, match_id string")
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "s1_id string")
    assert {(r.s1_id, r.label) for r in features.labelled(rows, truth, of("S1-1", "S1-2")).collect()} == {("S1-1", 1), ("S1-2", 0)}
    with pytest.raises(Exception, match="lacks the entity S1-2"):
        features.labelled(rows, truth, of("S1-1")).collect()
