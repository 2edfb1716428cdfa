"""The features of kept pairs in matrices: pairs meet their records as texts, and sets of tokens and n-grams are made where
pairs are compared, so that no exchange has them.

Pairs come in the order of their queries. A batch's queries are the rows of a matrix with a column for each term that one of
them has; a pool record's terms are looked up in its query's row. Sums of weights run in the order of the sorted terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_of
from .features import FEATURES, is_invalid
from .scoring import same_country

#: Queries whose terms share a matrix.
QUERIES = 256
KEPT = {"s1_id": "string", "cand_id": "string", "score": "double", "rank": "long", "label": "int", "split": "string", "same": "int"}
MADE = {
    "name_exact": "int", "name_token_jaccard": "double", "name_bigram_dice": "double", "name_trigram_dice": "double", "name_length_ratio": "double", "name_prefix_similarity": "double", "name_rare_token_dice": "double",
    "s1_name_missing": "int", "candidate_name_missing": "int", "address_exact": "int", "address_token_jaccard": "double", "address_bigram_dice": "double", "shared_numeric_token_count": "int", "numeric_token_jaccard": "double",
    "address_rare_token_dice": "double", "s1_address_missing": "int", "candidate_address_missing": "int", "address_length_ratio": "double",
}


def match_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where the candidate is a match; the matches come as one list for each entity, not to each pair."""
    lists = truth.groupBy("s1_id").agg(F.collect_set("match_id").alias("matches"))
    hit = F.coalesce(F.array_contains("matches", F.col("cand_id")), F.lit(False))
    return pairs.join(lists, "s1_id", "left").withColumn("label", hit.cast("int")).drop("matches")


def pair_features(pairs: DataFrame, queries: DataFrame, pool: DataFrame, truth: DataFrame, split: DataFrame) -> DataFrame:
    """Pairs (s1_id, cand_id, score, rank) of one country each to (s1_id, cand_id, features, label, split), as
    :func:`.features.pair_features` has them of records whose weights are those of their country's terms."""
    col = F.col
    own = queries.join(split.withColumnRenamed("s1_id", "entity_id"), "entity_id").select(
        col("entity_id").alias("s1_id"), "split", *(col(c).alias(f"a_{c}") for c in ("country", "name", "address", "name_total", "address_total")), F.map_values("name_weights").alias("a_name_w"), F.map_values("address_weights").alias("a_address_w"),
        F.transform("address_tokens", lambda t: F.array_contains("address_numbers", t)).alias("a_is_number"),
    )
    theirs = pool.select(col("entity_id").alias("cand_id"), *(col(c).alias(f"b_{c}") for c in ("country", "name", "address", "name_total", "address_total")), F.size("address_numbers").alias("b_numbers"))
    rows = match_labels(pairs.select("s1_id", "cand_id", "score", "rank").join(theirs, "cand_id"), truth).join(own, "s1_id")
    told = rows.withColumn("same", same_country().cast("int")).drop("a_country", "b_country")
    made = told.sortWithinPartitions("s1_id").mapInArrow(_worker, ", ".join(f"{c} {t}" for c, t in (KEPT | MADE).items()))
    source = source_of(col("cand_id"))
    good = F.when(is_invalid(source), F.raise_error(F.lit("a pair's source, score or rank is invalid"))).otherwise(source)
    flag = lambda c: c.cast("int")
    rest = {
        "both_addresses_missing": flag((col("s1_address_missing") == 1) & (col("candidate_address_missing") == 1)), "country_equal": col("same"), "candidate_is_s2": flag(good == "S2"), "candidate_is_s3": flag(good == "S3"),
        "candidate_ranking_score": F.bround(F.coalesce("score", F.lit(0.0)), 8), "candidate_rank": F.coalesce("rank", F.lit(0)).cast("int"), "ranking_available": flag(col("rank").isNotNull()),
    }
    out = {f: rest[f] if f in rest else F.bround(f, 8) if MADE[f] == "double" else col(f) for f in FEATURES}
    return made.select("s1_id", "cand_id", *(v.alias(f) for f, v in out.items()), "label", "split")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.divide(a, b, out=np.zeros(len(a)), where=b != 0)


def _distinct(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different (row, code) in order; ``width`` bits hold a code."""
    key = np.sort(row.astype(np.int64) << width | code)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> width, key & (1 << width) - 1


class _Texts:
    """Texts of both sides, those of the queries first: characters as numbers, sets of n-grams and tokens."""

    def __init__(self, left: pa.Array, right: pa.Array):
        self.n, self.all = len(left), pa.concat_arrays([left, right])
        self.sizes = pc.utf8_length(self.all).to_numpy(zero_copy_only=False).astype(np.int64)
        self.heads, _, _ = self._characters(pc.utf8_slice_codeunits(self.all, 0, 4))

    def _characters(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each character its number (from 1) and its text, and the bits of a number."""
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        alphabet = np.unique(points)
        row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        return np.searchsorted(alphabet, points) + 1, row, max(1, int(len(alphabet)).bit_length())

    def prefix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many of the first four characters agree."""
        short = np.minimum(self.sizes, 4)
        start = np.cumsum(short) - short
        table = np.zeros((len(short), 4), np.int64)
        row = np.repeat(np.arange(len(short)), short)
        table[row, np.arange(len(row)) - start[row]] = self.heads
        a, b = table[left], table[right + self.n]
        return np.logical_and.accumulate((a == b) & (a > 0), axis=1).sum(axis=1)

    def grams(self, *sizes: int) -> Iterator[_Sets]:
        c, row, bits = self._characters(pc.replace_substring(self.all, " ", ""))
        for n in sizes:
            if n * bits + len(self.all).bit_length() > 62:
                raise OverflowError  # fewer texts have fewer characters
            code = sum(c[k : len(c) - n + 1 + k] << bits * (n - 1 - k) for k in range(n)) if len(c) >= n else c[:0]
            inside = row[: len(code)] == row[len(row) - len(code) :]
            yield _Sets(self, *_distinct(row[: len(code)][inside], code[inside], n * bits))

    def tokens(self) -> _Sets:
        lists = pc.split_pattern(self.all, " ")
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)  # by bytes, as sorted sets are
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[coded.indices.to_numpy(zero_copy_only=False)]
        some = pc.not_equal(lists.flatten(), "").to_numpy(zero_copy_only=False)
        return _Sets(self, *_distinct(row[some], code[some], max(1, len(order).bit_length())))


class _Sets:
    """Sets of both sides; the queries' in a matrix, the pool's as those of its codes that a query has."""

    def __init__(self, texts: _Texts, row: np.ndarray, code: np.ndarray):
        n = texts.n
        self.sizes = np.bincount(row, minlength=len(texts.all))
        mine = row < n
        self.n, self.row, (self.codes, self.column) = n, row[mine], np.unique(code[mine], return_inverse=True)
        row, code = row[~mine] - n, code[~mine]
        at = np.searchsorted(self.codes, code)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == code[known]
        row, self.at = row[known], at[known]
        self.start = np.searchsorted(row, np.arange(len(texts.all) - n + 1))

    def meet(self, left: np.ndarray, right: np.ndarray) -> None:
        """The pairs that the sums are of."""
        n = self.start[right + 1] - self.start[right]
        self.ends = np.cumsum(n)
        self.pair = np.repeat(np.arange(len(left)), n)
        term = np.arange(len(self.pair)) + np.repeat(self.start[right] - self.ends + n, n)
        self.cell = left[self.pair] * len(self.codes) + self.at[term]
        self.left, self.right = self.sizes[left], self.sizes[right + self.n]

    def _looked_up(self, values: np.ndarray) -> np.ndarray:
        matrix = np.zeros((self.n, len(self.codes)), values.dtype)
        matrix[self.row, self.column] = values
        return matrix.ravel()[self.cell]

    def shared(self, which: np.ndarray | None = None) -> np.ndarray:
        """How many terms a pair shares, those of ``which``, a flag for each of the queries' terms."""
        hit = self._looked_up(np.ones(len(self.row), bool) if which is None else which)
        upto = np.append(0, np.cumsum(hit))
        return np.diff(upto[np.append(0, self.ends)])

    def mass(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.pair, self._looked_up(weights), len(self.ends))

    def jaccard(self, both: np.ndarray) -> np.ndarray:
        return _ratio(both, self.left + self.right - both)

    def dice(self) -> np.ndarray:
        return _ratio(2 * self.shared(), self.left + self.right)


def _made(t: pa.RecordBatch) -> dict[str, np.ndarray]:
    number = lambda c: t.column(c).to_numpy(zero_copy_only=False)
    ids = t.column("s1_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    left = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
    firsts = t.take(pa.array(first))
    flat = lambda c: firsts.column(c).flatten().to_numpy(zero_copy_only=False)
    out = {}
    for field in ("name", "address"):
        coded = t.column(f"b_{field}").dictionary_encode()
        right = coded.indices.to_numpy(zero_copy_only=False)
        texts = _Texts(firsts.column(f"a_{field}"), coded.dictionary)
        a, b = texts.sizes[left], texts.sizes[right + texts.n]
        same = pc.equal(t.column(f"a_{field}"), t.column(f"b_{field}")).to_numpy(zero_copy_only=False)
        out |= {f"{field}_exact": same & (a > 0), f"{field}_length_ratio": _ratio(np.minimum(a, b), np.maximum(a, b))}
        out |= {f"s1_{field}_missing": a == 0, f"candidate_{field}_missing": b == 0}
        terms = texts.tokens()
        terms.meet(left, right)
        out[f"{field}_token_jaccard"] = terms.jaccard(terms.shared())
        out[f"{field}_rare_token_dice"] = _ratio(2 * terms.mass(flat(f"a_{field}_w")), number(f"a_{field}_total") + number(f"b_{field}_total"))
        kinds = ("bigram", "trigram") if field == "name" else ("bigram",)
        for kind, grams in zip(kinds, texts.grams(2, 3)):
            grams.meet(left, right)
            out[f"{field}_{kind}_dice"] = grams.dice()
        if field == "name":
            out["name_prefix_similarity"] = texts.prefix(left, right) / 4.0
        else:
            both, numeric = terms.shared(flat("a_is_number")), np.bincount(terms.row[flat("a_is_number")], minlength=texts.n)
            out |= {"shared_numeric_token_count": both, "numeric_token_jaccard": _ratio(both, numeric[left] + number("b_numbers") - both)}
    return out


def _batch(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    try:
        made = _made(t)
    except OverflowError:
        if t.num_rows == 1:
            raise
        half = t.num_rows // 2
        yield from _batch(t.slice(0, half))
        yield from _batch(t.slice(half))
        return
    types = {"int": pa.int32(), "double": pa.float64()}
    yield pa.RecordBatch.from_arrays([*(t.column(c) for c in KEPT), *(pa.array(made[c], pa.float64()) if MADE[c] == "double" else pa.array(made[c].astype(np.int32), types[MADE[c]]) for c in MADE)], [*KEPT, *MADE])


def _worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        if not t.num_rows:
            continue
        ids = t.column("s1_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[::QUERIES]
        for lo, hi in zip(first, np.append(first[1:], len(ids))):
            yield from _batch(t.slice(lo, hi - lo))
