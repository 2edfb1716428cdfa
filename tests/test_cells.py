"""Pairs in cells against the joins of blocking and scoring, with cells so small that every key is cut and cells are merged."""

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, cells, evaluation, frequency, scoring
from kindred.plans.fixture import Linkage


@pytest.fixture(scope="module")
def linkage(spark, small):
    return Linkage(spark, small)


@pytest.fixture(params=[(2048, 1 << 15, 1 << 16), (3, 8, 1)], ids=["merged", "cut"])
def sized(request, monkeypatch):
    """Sizes that the driver and, sent with the function, the workers use."""
    cell, strip, merged = request.param
    monkeypatch.setattr(cells, "CELL", cell)
    plain = cells._worker

    def worker(spec):
        inner = plain(spec)

        def run(batches):
            cells.STRIP, cells.MERGED = strip, merged
            yield from inner(batches)

        return run

    monkeypatch.setattr(cells, "_worker", worker)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_expanded_pairs(linkage, sized):
    x = linkage
    columns = ("s1_id", "cand_id", "in_c", "in_tokens", "in_ngrams")
    assert rows(x.expanded, *columns) == rows(blocking.expanded(x.queries, x.pool, x.terms), *columns)


def test_counts(linkage, sized):
    x = linkage
    flags = blocking.candidates_by_config(x.queries, x.pool)
    want = flags.groupBy("s1_id").agg(F.count_if("a").alias("A"), F.count_if("b").alias("B"), F.count(F.lit(1)).alias("C"))
    assert rows(cells.counts(x.queries, x.pool), "s1_id", "A", "B", "C") == rows(want, "s1_id", "A", "B", "C")
    ex = blocking.expanded(x.queries, x.pool, x.terms)
    want = ex.groupBy("s1_id").agg(F.count_if("in_c").alias("C"), F.count_if(F.col("in_c") | F.col("in_tokens")).alias("T"), F.count(F.lit(1)).alias("E"))
    assert rows(cells.counts(*x.sides(x.records), expanded=True), "s1_id", "C", "T", "E") == rows(want, "s1_id", "C", "T", "E")


def test_formula_ranks(linkage, sized):
    x = linkage
    names = tuple(scoring.FORMULAS)
    ranks = scoring.formula_ranks(x.signals)
    linked, sizes = x.formula_links(names)
    assert rows(linked.filter("rank is not null"), "formula", "s1_id", "match_id", "rank") == rows(ranks.join(x.truth.withColumnRenamed("match_id", "cand_id"), ["s1_id", "cand_id"]), "formula", "s1_id", "cand_id", "rank")
    assert linked.count() == x.truth.count() * len(names)
    assert rows(sizes, "formula", "s1_id", "all") == rows(ranks.groupBy("formula", "s1_id").count(), "formula", "s1_id", "count")
    top = scoring.top_k(cells.top(x.queries, x.pool, 7, "balanced"), 7)
    assert rows(top, "s1_id", "cand_id", "rank", "score") == rows(ranks.filter("formula = 'balanced' and rank <= 7"), "s1_id", "cand_id", "rank", "score")


def test_improved(linkage, sized):
    x = linkage
    ex = blocking.expanded(x.queries, x.pool, x.terms)
    scored = scoring.improved_signals(x.weighted_pairs(ex), ("in_c",)).withColumns({"weighted": scoring.improved_score("weighted"), "score": scoring.improved_score()})
    columns = ("s1_id", "cand_id", *cells.EVIDENCE)
    assert rows(cells.improved_pairs(*x.sides(x.weights)), *columns) == rows(scored, *columns)
    variants = {"base": ("weighted", cells.BASE), "all": ("score", cells.ALL)}
    linked, sizes = x.variant_links(variants)
    for v, ranked in (("base", scoring.ranked(scored.filter("in_c"), "weighted")), ("all", scoring.ranked(scored))):
        want = evaluation.linked_ranks(x.truth, ranked).filter("rank is not null")
        assert rows(linked.filter((F.col("variant") == v) & F.col("rank").isNotNull()), "s1_id", "match_id", "rank") == rows(want, "s1_id", "match_id", "rank")
        assert rows(sizes.filter(F.col("variant") == v), "s1_id", "all") == rows(ranked.groupBy("s1_id").count(), "s1_id", "count")


def test_prefixes_and_words_share_one_key(spark):
    from tests.test_linkage import made

    q = made(spark, ("S1-1", "the", "", "X"), ("S1-2", "them all", "", "X"), ("S1-3", "", "5 5 a", "X"))
    p = made(spark, ("S2-1", "the one", "", "X"), ("S2-2", "theme", "", "X"), ("S2-3", "", "5", "X"), ("S2-4", "the", "", "Y"))
    pairs = {(r.s1_id, r.cand_id) for r in blocking.candidates(q, p).collect()}
    assert pairs == {("S1-1", "S2-1"), ("S1-2", "S2-2"), ("S1-3", "S2-3")}
    assert {r.s1_id: (r.A, r.B, r.C) for r in cells.counts(q, p).collect()} == {"S1-1": (1, 1, 1), "S1-2": (0, 0, 1), "S1-3": (0, 1, 1)}


def test_base_counts_need_no_cells(linkage, monkeypatch):
    x, asked = linkage, []
    plain = cells._run
    monkeypatch.setattr(cells, "_run", lambda *a, **k: asked.append(a[2].rules) or plain(*a, **k))
    cells.counts(x.queries, x.pool)
    cells.counts(*x.sides(x.records), expanded=True)
    assert asked == ["tag"]


def test_a_record_that_shares_several_numbers_counts_once(spark):
    from tests.test_linkage import made

    q = made(spark, ("S1-1", "one a", "7 8 9", "X"), ("S1-2", "", "8", "X"), ("S1-3", "one b", "", "X"), ("S1-4", "none", "1", "X"))
    p = made(spark, ("S2-1", "one c", "9 8 7", "X"), ("S2-2", "onen", "7 9", "X"), ("S2-3", "else", "8 9", "X"), ("S2-4", "", "7", "X"), ("S2-5", "one", "7", "Y"), ("S2-6", "one", "", "X"))
    want = {r.s1_id: (r.A, r.B, r.C) for r in blocking.candidates_by_config(q, p).groupBy("s1_id").agg(F.count_if("a").alias("A"), F.count_if("b").alias("B"), F.count(F.lit(1)).alias("C")).collect()}
    assert want == {"S1-1": (2, 5, 5), "S1-2": (0, 2, 2), "S1-3": (2, 2, 2)}
    assert {r.s1_id: (r.A, r.B, r.C) for r in cells.counts(q, p).collect()} == want


def test_cells_get_what_their_rule_reads(linkage):
    """Weights go with queries alone, rare terms to the rules that ask for them, and no row to a cell where it can have no pair."""
    x = linkage
    sent = cells._cells(*x.sides(x.weights), cells.Spec("pairs", "improved", cells.ALL), None).persist()
    assert {r.rule for r in sent.select("rule").distinct().collect()} == set(cells.ALL)
    weights = ("name_w", "w", "is_number", "distinctive", "most")
    assert not sent.filter("side = 1").filter(" or ".join(f"{c} is not null" for c in weights)).count()
    assert not sent.filter("side = 0").filter(" or ".join(f"{c} is null" for c in weights)).count()
    for column, rules in (("numbers", "ntag"), ("rare_names", "tag"), ("rare_words", "ag"), ("rare_grams", "g")):
        assert {r.rule for r in sent.filter(f"{column} is not null").select("rule").distinct().collect()} == set(rules)
    for rule, column in (("a", "rare_words"), ("g", "rare_grams")):
        assert not sent.filter((F.col("rule") == rule) & (F.col("value") == F.element_at(F.split(column, " "), -1))).count()
    assert not {t for c, t in sent.dtypes if t == "array<string>"}
    sent.unpersist()


def test_pairs_of_the_last_two_terms_stay(spark):
    from tests.test_linkage import made

    q = made(spark, ("S1-1", "one", "b y z", "X"), ("S1-2", "abcdef", "", "X"), ("S1-3", "two", "z", "X"))
    p = made(spark, ("S2-1", "other", "a y z", "X"), ("S2-2", "xbcdex", "c z", "X"), ("S2-3", "three", "y z", "X"))
    terms = frequency.term_counts(p)
    left, right = (cells.with_rarity(df, cells.rarity(q, p, terms)) for df in (q, p))
    columns = ("s1_id", "cand_id", "in_c", "in_tokens", "in_ngrams")
    assert rows(cells.expanded_pairs(left, right), *columns) == rows(blocking.expanded(q, p, terms), *columns) == [("S1-1", "S2-1", False, True, False), ("S1-1", "S2-3", False, True, False), ("S1-2", "S2-2", False, False, True)]


def test_links_read_the_records_once_for_each_side(linkage):
    """No exchange of the records by id beside the join that makes the links."""
    rows = linkage.linked(linkage.tokens)
    want = linkage.pairs(linkage.truth.withColumnRenamed("match_id", "cand_id"))
    assert rows_of(rows, "match_id") == rows_of(want, "cand_id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def rows_of(df, match):
    return rows(df, "s1_id", match, "a_name", "b_name", "a_address_numbers", "b_name_bigrams")
