"""Document frequencies by country, and the weights they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, numbers, token_set, words

FIELDS = ("name", "address", "grams")


def with_tokens(records: DataFrame) -> DataFrame:
    """Records with their token sets."""
    rows = records.withColumns({"name_tokens": token_set(F.col("name")), "address_tokens": token_set(F.col("address"))})
    return rows.withColumns({"address_numbers": numbers(F.col("address_tokens")), "address_words": words(F.col("address_tokens"))})


def with_ngrams(records: DataFrame) -> DataFrame:
    """Records with their n-gram sets, each several times as long as its text: not made where no one asks for them."""
    return records.withColumns({"name_bigrams": char_ngrams(F.col("name"), 2), "name_grams": char_ngrams(F.col("name"), 3), "address_bigrams": char_ngrams(F.col("address"), 2)})


def prepared(records: DataFrame) -> DataFrame:
    """Records with their token sets and n-gram sets, made once before any pair."""
    return with_ngrams(with_tokens(records))


def document_counts(records: DataFrame) -> DataFrame:
    """(country, n)."""
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def term_counts(ready: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(field, country, term, df): records of a country that have a term, in one pass over prepared records."""
    columns = {"name": "name_tokens", "address": "address_tokens", "grams": "name_grams"}
    tagged = lambda f: F.transform(columns[f], lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))
    every = F.concat(*map(tagged, fields))
    return ready.select("country", F.explode(every).alias("x")).groupBy("x.field", "country", "x.term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return 1 + F.ln((F.coalesce(n, F.lit(0)) + 1).cast("double") / (F.coalesce(df, F.lit(0)) + 1).cast("double"))


def is_common(n: Column, df: Column) -> Column:
    """A term of at least a hundredth of a country's records."""
    return F.coalesce(df, F.lit(0)) >= 0.01 * F.greatest(F.lit(1), F.coalesce(n, F.lit(0)))


def idf_weights(docs: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(docs, "country").select("field", "country", "term", idf(F.col("n"), F.col("df")).alias("idf"))


def weighted(ready: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Prepared records with token-weight maps and their totals, the words and names that are distinctive, and the weight
    that a term of no record would have."""
    fields = F.concat(F.transform("name_tokens", lambda t: F.struct(F.lit("name").alias("field"), t.alias("term"))), F.transform("address_tokens", lambda t: F.struct(F.lit("address").alias("field"), t.alias("term"))))
    rows = ready.select("entity_id", "country", F.explode(fields).alias("x")).select("entity_id", "country", "x.field", "x.term")
    known = rows.join(terms, ["field", "country", "term"], "left").join(docs, "country", "left")
    each = known.select("entity_id", "field", "term", idf(F.col("n"), F.col("df")).alias("w"), is_common(F.col("n"), F.col("df")).alias("common"))
    pick = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("term", "w"))))
    rare = lambda f: F.collect_list(F.when((F.col("field") == f) & ~F.col("common"), F.col("term")))
    # Dealt out as plain rows: lists that each task had gathered of a record would take twice the shuffle.
    maps = each.repartition("entity_id").groupBy("entity_id").agg(pick("name").alias("nw"), pick("address").alias("aw"), rare("name").alias("nd"), rare("address").alias("ad"))
    joined = ready.join(maps, "entity_id", "left").join(docs.withColumnRenamed("n", "country_records"), "country", "left")
    total = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<struct<term:string,w:double>>")), F.lit(0.0), lambda a, x: a + x["w"])
    made = lambda c: F.map_from_entries(F.coalesce(c, F.array().cast("array<struct<term:string,w:double>>")))
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {"name_weights": made("nw"), "address_weights": made("aw"), "name_total": total("nw"), "address_total": total("aw"), "distinctive_names": F.coalesce("nd", none), "distinctive_words": F.coalesce("ad", none), "most_idf": idf(F.col("country_records"), F.lit(0))}
    ).drop("nw", "aw", "nd", "ad", "country_records")
