"""SpotSigs document fingerprints, in DataFrame functions alone: common words are anchors, and an anchor with the next
content words after it, and what common words lie between, is a spot signature. A document's fingerprint is its sorted
set of hashed signatures; sets are partitioned by length and compared by Jaccard similarity, pruned by length and prefix.

Texts are lower-cased and read as runs of letters and digits. The start of a text is an anchor too, so that texts
without common words have signatures; a text without content words has one signature, its words. A signature is known by
the first 64 bits of its MD5, as 16 hex digits. Null texts count as empty; empty texts have equal fingerprints; texts of any
length are read whole; ids are numbers, any of their type; documents in order are those in ascending (id, hash of the
text), a null id first, and repeated rows follow one another; the last one's next document is the first, which is itself
in a table of one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Common words of the corpus's languages.
COMMON = {
    "en": "a an and are as at be by for from had has he in is it of on or that the they this to was were which with you",
    "fr": "au aux avec ce cette dans de des du elle en est et il la le les ne on ou par pas pour que qui sur un une",
    "de": "auf das dem den der des die ein eine es für ich im in ist mit nicht sich sie und von wir zu",
    "es": "al como con de del el en es ha la las lo los mi no para pero por que se su sus un una y",
}
CHAIN = 2
#: Documents in order are dealt out in buckets of about so many, by at most GRID * GRID quantiles of the id.
BUCKET_ROWS = 2000
GRID = 32


def _alternatives(words: list[str]) -> str:
    """A pattern of the words, factored by first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(c + (f"(?:{'|'.join(sorted(rest, key=len, reverse=True))})" if rest != [""] else "") for c, rest in sorted(by.items())) + ")"


def _pattern(chain: int) -> str:
    common = _alternatives(sorted({w for words in COMMON.values() for w in words.split()}))
    word = rf"(?:{common} )*+[^ ]+"
    return rf" (?=((?:\^|{common}) {word}(?: {word}){{0,{chain - 1}}}) )"


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted set of a text's spot signatures, each known by 16 hex digits."""
    words = F.concat(F.lit(" ^ "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    found = F.regexp_extract_all(words, F.lit(_pattern(chain)), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(words)), lambda s: F.substring(F.md5(s), 1, 16))))


def packed(sets: Column) -> Column:
    """A set as bytes, eight for each signature: half of what its digits take where it is dealt out."""
    return F.unhex(F.array_join(sets, ""))


def unpacked(raw: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(raw)), F.lit("(.{16})"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(1.0))


def _buckets(rows: DataFrame, id_col: str, tie_col: str) -> Column:
    """The bucket of a row, a number that ascends with (id, tie): the quantile of the id, then the part of that quantile's
    range, or of the ties of an id that fills quantiles alone."""
    most = GRID * GRID
    spread = rows.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"), F.percentile_approx(id_col, [i / most for i in range(most + 1)], 100_000).alias("points")).first()
    every = list(spread.points or [])
    points = sorted(set(every))
    fine = min(1 << 19, max(1, math.ceil(spread.n / (most * BUCKET_ROWS))))
    times = {p: every.count(p) - 1 for p in points}
    by_tie = lambda parts: F.least(F.floor((F.col(tie_col).cast("double") / 2.0**64 + 0.5) * parts), parts - 1).cast("long")
    of_null = by_tie(F.lit(min(1 << 19, max(1, math.ceil((spread.n - spread.ids) / BUCKET_ROWS)))))
    if not points:
        return of_null
    kind = rows.schema[id_col].dataType.simpleString()
    listed = lambda values: "[" + ",".join(map(str, values)) + "]"
    chunks = [points[i : i + GRID] for i in range(0, len(points), GRID)]
    column = F.col(id_col)
    chunk = F.greatest(F.size(F.filter(F.from_json(F.lit(listed(c[0] for c in chunks)), f"array<{kind}>"), lambda p: p <= column)), F.lit(1))
    inside = F.element_at(F.from_json(F.lit(listed(map(listed, chunks))), f"array<array<{kind}>>"), chunk)
    top = (chunk - 1) * GRID + F.greatest(F.size(F.filter(inside, lambda p: p <= column)), F.lit(1))
    low = F.element_at(inside, top - (chunk - 1) * GRID).cast("double")
    ends = [points[min(i + GRID, len(points) - 1)] for i in range(0, len(points), GRID)]
    following = F.concat(F.slice(inside, 2, GRID), F.array(F.element_at(F.from_json(F.lit(listed(ends)), f"array<{kind}>"), chunk)))
    high = F.element_at(following, top - (chunk - 1) * GRID).cast("double")
    part = F.floor((column.cast("double") - low) * fine / F.greatest(high - low, F.lit(1.0)))
    part = F.least(F.greatest(part, F.lit(0)), F.lit(fine - 1)).cast("long")
    hot = {p: t for p, t in times.items() if t > 0}
    ties = F.lit(0).cast("long")
    if hot:
        known = F.create_map(*(x for p, t in hot.items() for x in (F.lit(p).cast(kind), F.lit(t * fine))))
        parts = F.try_element_at(known, column)
        ties = F.when(parts.isNotNull(), by_tie(parts))
        part = F.when(parts.isNull(), part + 1).otherwise(F.lit(0).cast("long"))
        ties = F.coalesce(ties, F.lit(0).cast("long"))
    bucket = F.shiftleft(top.cast("long"), 40) + F.shiftleft(part, 20) + ties
    return F.when(column.isNull(), of_null).otherwise(bucket)


def with_next(rows: DataFrame, id_col: str, tie_col: str, carried: list[str]) -> DataFrame:
    """``rows`` with ``next``: the ``carried`` columns of the row that follows in ascending (id, tie), of the last the
    first. Rows are dealt out once, by ranges of the id; only a range's first row is sent to the range before."""
    bucket = _buckets(rows, id_col, tie_col)
    dealt = rows.withColumn("bucket", bucket).repartition("bucket")
    own = F.struct(*carried)
    inside = Window.partitionBy("bucket").orderBy(id_col, tie_col)
    followed = dealt.withColumn("next", F.lead(own).over(inside))
    # A row for each bucket: its first row, which the bucket before it needs.
    firsts = dealt.groupBy("bucket").agg(F.min_by(own, F.struct(F.col(id_col).isNotNull(), id_col, tie_col)).alias("first"))
    known = rows.select(bucket.alias("bucket")).distinct().withColumn("top", F.shiftright("bucket", 40))
    tops = known.groupBy("top").agg(F.min("bucket").alias("least"))  # a row for each quantile
    order = Window.orderBy("top")
    after = F.coalesce(F.lead("least").over(order), F.first("least").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select("top", after.alias("after"))
    within = known.withColumn("later", F.lead("bucket").over(Window.partitionBy("top").orderBy("bucket")))
    before = within.join(F.broadcast(tops), "top").select(F.col("bucket").alias("before"), F.coalesce("later", "after").alias("bucket"))
    heads = firsts.join(before, "bucket").select(F.col("before").alias("bucket"), "first")
    return followed.join(heads, "bucket", "left").withColumn("next", F.coalesce("next", "first")).drop("first", "bucket")


def fingerprints(docs: DataFrame, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half is the next text's beginning, and their likeness."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), packed(signatures(text, chain)).alias("raw"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = with_next(rows, "doc_id", "tie", ["text", "raw"]).select(
        "doc_id", unpacked(F.col("raw")).alias("set"), n.cast("long").alias("n_chars"), unpacked(F.col("next.raw")).alias("next_set"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
    )
    both = edited.withColumn("edited_set", signatures(F.col("edited"), chain))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("set", ",").alias("fingerprint"), F.array_join("edited_set", ",").alias("edited_fingerprint"),
        jaccard(F.col("set"), F.col("edited_set")).alias("near_edited"), jaccard(F.col("set"), F.col("next_set")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8, chain: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): the class of each document, documents of equal sets being a class, named by a digest of the
    set; and every pair of classes (a, b, likeness) with a likeness of ``threshold`` or more. Null ids are documents too.

    Sets are partitioned by length, a partition's lengths spanning a factor of 1/threshold, so that only a partition and the
    next one can meet. Of each set the rarest signatures are indexed, as many as a partner must share one of."""
    sets = docs.select(F.col(id_col).alias("doc_id"), signatures(F.coalesce(F.col(text_col), F.lit("")), chain).alias("set"))
    named = sets.withColumn("class", F.sha2(F.array_join("set", ","), 256))
    classes = named.groupBy("class").agg(F.any_value("set").alias("set"))
    n = F.size("set")
    spot = classes.select("class", n.alias("n"), F.floor(F.log(n.cast("double")) / math.log(1 / threshold)).cast("int").alias("part"), F.explode("set").alias("spot"))
    rarity = spot.groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("df", "spot"))
    index = spot.join(rarity, "spot").filter("df > 1 or n = 1").withColumn("place", place)
    # Signatures of one class alone cannot be shared; what is left of the prefix is what may be.
    lone = spot.join(rarity, "spot").groupBy("class").agg(F.count_if(F.col("df") == 1).alias("lone"))
    index = index.join(lone, "class").filter(F.col("place") + F.col("lone") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = index.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), "spot")
    right = index.select(F.col("class").alias("b"), F.col("n").alias("n_b"), "part", "spot")
    near = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)
    candidates = left.join(right, ["part", "spot"]).filter(near).select("a", "b").distinct()
    of = lambda c: classes.select(F.col("class").alias(c), F.col("set").alias(f"set_{c}"))
    verified = candidates.join(of("a"), "a").join(of("b"), "b").select("a", "b", jaccard(F.col("set_a"), F.col("set_b")).alias("likeness"))
    return named.select("doc_id", "class"), verified.filter(F.col("likeness") >= threshold - 1e-9)
