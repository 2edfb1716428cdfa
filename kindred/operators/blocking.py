"""Candidate generation: multi-key equi-joins on (rule, country, value), and rare-term joins with posting caps.

No bucket is cut short: a key that is too common for a rule is left out of it, the baseline rules keep every key, and a
skewed key's join is split by adaptive execution. Joins carry ids alone; texts are fetched for the pairs that stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens

CONFIGURATIONS = {"A": ("name_token",), "B": ("name_token", "address_number"), "C": ("name_token", "address_number", "name_prefix")}
NAME_CAP, ADDRESS_CAP, GRAM_CAP, QUERY_GRAMS, HITS = 200, 300, 200, 4, 2
ORIGINS = {"c": 1, "tokens": 2, "ngrams": 4}


def blocking_keys(ready: DataFrame, rules: tuple[str, ...] = CONFIGURATIONS["C"]) -> DataFrame:
    """(entity_id, rule, country, value): first name token, each address number, first four characters of the name."""
    key = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.alias("value"))
    named = F.col("name") != ""
    none = F.array().cast("array<struct<rule:string,value:string>>")
    parts = {
        "name_token": F.when(named, F.array(key("name_token", F.element_at(tokens(F.col("name")), 1)))).otherwise(none),
        "address_number": F.transform("address_numbers", lambda t: key("address_number", t)),
        "name_prefix": F.when(named, F.array(key("name_prefix", F.substring("name", 1, 4)))).otherwise(none),
    }
    rows = ready.filter("country <> ''").select("entity_id", "country", F.explode(F.concat(*(parts[r] for r in rules))).alias("k"))
    return rows.select("entity_id", "k.rule", "country", "k.value")


def _sides(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.withColumnRenamed("entity_id", "s1_id").join(right.withColumnRenamed("entity_id", "cand_id"), on)


def _key_pairs(queries: DataFrame, pool: DataFrame, config: str) -> DataFrame:
    rules = CONFIGURATIONS[config]
    return _sides(blocking_keys(queries, rules), blocking_keys(pool, rules), ["rule", "country", "value"]).select("s1_id", "cand_id")


def candidates(queries: DataFrame, pool: DataFrame, config: str = "C") -> DataFrame:
    """(s1_id, cand_id) that share a key of any of the configuration's rules."""
    return _key_pairs(queries, pool, config).distinct()


def candidates_by_config(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, cand_id, a, b): config C's pairs with whether A and B have them too, from one join."""
    rows = _sides(blocking_keys(queries), blocking_keys(pool), ["rule", "country", "value"])
    return rows.groupBy("s1_id", "cand_id").agg(F.bool_or(F.col("rule") == "name_token").alias("a"), F.bool_or(F.col("rule").isin("name_token", "address_number")).alias("b"))


def _terms(ready: DataFrame, column: str) -> DataFrame:
    return ready.filter("country <> ''").select("entity_id", "country", F.explode(column).alias("term"))


def _capped(terms: DataFrame, field: str, cap: int) -> DataFrame:
    return terms.filter((F.col("field") == field) & (F.col("df") <= cap)).select("country", "term", "df")


def _name_pairs(queries: DataFrame, pool: DataFrame, terms: DataFrame, cap: int) -> DataFrame:
    postings = _terms(pool, "name_tokens").join(_capped(terms, "name", cap), ["country", "term"], "left_semi")
    return _sides(_terms(queries, "name_tokens"), postings, ["country", "term"]).select("s1_id", "cand_id")


def rare_names(queries: DataFrame, pool: DataFrame, terms: DataFrame, cap: int = NAME_CAP) -> DataFrame:
    """Pairs that share any name token of at most ``cap`` pool records."""
    return _name_pairs(queries, pool, terms, cap).distinct()


def rare_addresses(queries: DataFrame, pool: DataFrame, terms: DataFrame, cap: int = ADDRESS_CAP, hits: int = HITS) -> DataFrame:
    """Pairs that share ``hits`` address words, no numbers, each of at most ``cap`` pool records."""
    postings = _terms(pool, "address_words").join(_capped(terms, "address", cap), ["country", "term"], "left_semi")
    rows = _sides(_terms(queries, "address_words"), postings, ["country", "term"])
    return rows.groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hits).select("s1_id", "cand_id")


def rare_trigrams(queries: DataFrame, pool: DataFrame, terms: DataFrame, cap: int = GRAM_CAP, most: int = QUERY_GRAMS, hits: int = HITS) -> DataFrame:
    """Pairs that share ``hits`` of the query's ``most`` rarest name trigrams, each of at most ``cap`` pool records."""
    known = _capped(terms, "grams", cap)
    order = Window.partitionBy("entity_id").orderBy("df", "term")
    rarest = _terms(queries, "name_grams").join(known, ["country", "term"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    rows = _sides(rarest.select("entity_id", "country", "term"), _terms(pool, "name_grams"), ["country", "term"])
    return rows.groupBy("s1_id", "cand_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hits).select("s1_id", "cand_id")


def expanded(queries: DataFrame, pool: DataFrame, terms: DataFrame) -> DataFrame:
    """(s1_id, cand_id, in_c, in_tokens, in_ngrams): the union of config C and the rare-term rules, with origins as flags so
    that one pass serves every variant. ``terms`` are the frequencies of the searched pool."""
    # Pairs of several keys meet in the one aggregation below; its partial step takes most of them together before any shuffle.
    parts = [(_key_pairs(queries, pool, "C"), "c"), (_name_pairs(queries, pool, terms, NAME_CAP), "tokens"), (rare_addresses(queries, pool, terms), "tokens"), (rare_trigrams(queries, pool, terms), "ngrams")]
    rows = reduce(DataFrame.unionByName, (df.withColumn("origin", F.lit(ORIGINS[o])) for df, o in parts))
    bits = rows.groupBy("s1_id", "cand_id").agg(F.bit_or("origin").alias("origin"))
    return bits.select("s1_id", "cand_id", *((F.col("origin").bitwiseAND(F.lit(b)) > 0).alias(f"in_{o}") for o, b in ORIGINS.items()))
