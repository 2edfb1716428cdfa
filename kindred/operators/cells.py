"""Candidate pairs told, scored and counted in cells, without a row for each pair in any exchange.

Records go to the blocks of their keys with what a pair needs of them there, sets as texts of spaced terms; the block of a frequent key is cut into cells of at most
about CELL by CELL records, so that no task holds a key. Two names that share a first token or their first four characters
share the first four characters of the first token, and the other way round: rule ``u`` has them in one block, ``n`` those
that share a number, ``t`` a rare name token, ``a`` a rare address word, ``g`` a rare trigram. A pair counts in one cell only: that of the first
of these rules that finds it, and of the first shared key of it. Python works on matrices of at most
about STRIP pairs, some queries by a cell's pool records; small cells of one rule share a matrix. Sums run in the order of the sorted terms, as they do in the expressions of :mod:`.scoring`."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .blocking import ADDRESS_CAP, GRAM_CAP, HITS, NAME_CAP, QUERY_GRAMS
from .scoring import FORMULAS

CELL, STRIP, MERGED = 2048, 1 << 15, 1 << 16
BASE, ALL, RARE = "un", "untag", "tag"
FLAGS = ("in_c", "in_tokens", "in_ngrams")
EVIDENCE = ("name_evidence", "address_evidence", "numeric_evidence", "weighted", "score")


def first_token(name: str = "name") -> Column:
    return F.when(F.col(name) != "", F.element_at(tokens(F.col(name)), 1))


def rarity(queries: DataFrame, pool: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity_id, rare_names, rare_words, rare_grams): the terms by which the rare-term rules join a record, in order."""
    tagged = lambda f, c: F.transform(c, lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))
    every = F.explode(F.concat(tagged("name", "name_tokens"), tagged("address", "address_words"), tagged("grams", "name_grams"))).alias("x")
    split = lambda df, side: df.filter("country <> ''").select("entity_id", F.lit(side).alias("side"), "country", every).select("entity_id", "side", "country", "x.field", "x.term")
    left, right = split(queries, 0), split(pool, 1)
    caps = F.when(F.col("field") == "name", NAME_CAP).when(F.col("field") == "address", ADDRESS_CAP).otherwise(GRAM_CAP)
    on = ["field", "country", "term"]
    known = terms.filter(F.col("df") <= caps).join(left.select(*on).distinct(), on, "left_semi").select(*on, "df")
    pick = lambda f, x: F.array_sort(F.collect_list(F.when(F.col("field") == f, x)))
    lists = left.unionByName(right).join(known, on).repartition("entity_id").groupBy("entity_id").agg(F.min("side").alias("side"), pick("name", F.col("term")).alias("rare_names"), pick("address", F.col("term")).alias("rare_words"), pick("grams", F.struct("df", "term")).alias("g"))
    kept = F.when(F.col("side") == 0, F.slice("g", 1, QUERY_GRAMS)).otherwise(F.col("g"))
    return lists.select("entity_id", "rare_names", "rare_words", F.array_sort(F.transform(kept, lambda x: x["term"])).alias("rare_grams"))


def with_rarity(ready: DataFrame, rare: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    names = ("rare_names", "rare_words", "rare_grams")
    return ready.join(rare, "entity_id", "left").withColumns({c: F.coalesce(c, none) for c in names})


def link_flags(links: DataFrame, queries: DataFrame, pool: DataFrame, expanded: bool = False) -> DataFrame:
    """Links (s1_id, match_id, ...) with whether each rule finds them: A, B, C and, of records with rarity, in_tokens, in_ngrams."""
    rare = ("rare_names", "rare_words", "rare_grams") if expanded else ()
    slim = lambda df, key, p: df.select(F.col("entity_id").alias(key), *(F.col(c).alias(p + c) for c in ("country", "name", "address_numbers", *rare)))
    rows = links.join(slim(queries, "s1_id", "a_"), "s1_id").join(slim(pool, "match_id", "b_"), "match_id")
    return rows.select(*links.columns, *(v.alias(k) for k, v in rules(expanded).items()))


def rules(expanded: bool = False) -> dict[str, Column]:
    """The same of pairs with both records' columns, prefixed a_ and b_."""
    a_t, b_t = first_token("a_name"), first_token("b_name")
    same = (F.col("a_country") != "") & (F.col("a_country") == F.col("b_country"))
    there = lambda c: F.coalesce(same & c, F.lit(False))
    number = F.arrays_overlap("a_address_numbers", "b_address_numbers")
    a, u = F.coalesce(a_t == b_t, F.lit(False)), F.coalesce(F.substring(a_t, 1, 4) == F.substring(b_t, 1, 4), F.lit(False))
    values = {"A": there(a), "B": there(a | number), "C": there(u | number)}
    if expanded:
        shared = lambda c: F.size(F.array_intersect(f"a_{c}", f"b_{c}"))
        values |= {"in_tokens": there((shared("rare_names") > 0) | (shared("rare_words") >= HITS)), "in_ngrams": there(shared("rare_grams") >= HITS)}
    return values


@dataclass(frozen=True)
class Spec:
    """What a run needs: ``score`` is formulas, improved or nothing; an axis is (name, score, rules)."""

    out: str
    score: str = ""
    rules: str = BASE
    formulas: tuple[str, ...] = ()
    axes: tuple[tuple[int, str], ...] = ()
    k: int = 0
    places: int | None = None


def _payload(spec: Spec, side: int) -> dict[str, Column]:
    """What a record's pairs need; the weights of shared terms and what tells them apart are read from queries (side 0) alone."""
    col = F.col
    text = lambda c: F.array_join(c, " ")
    flags = lambda c: F.transform("address_tokens", lambda t: F.array_contains(c, t))
    own = lambda v, kind="array<double>": v if side == 0 else F.lit(None).cast(kind)
    out = {"u": F.substring(first_token(), 1, 4), "numbers": text("address_numbers")}
    if spec.score:
        out |= {"name": col("name"), "terms": text("address_tokens"), "is_number": own(flags("address_numbers"), "array<boolean>")}
    if spec.score == "improved":
        out |= {"name_w": own(F.map_values("name_weights")), "name_total": col("name_total"), "w": own(F.map_values("address_weights")), "total": col("address_total"), "distinctive": own(flags("distinctive_words"), "array<boolean>"), "most": own(col("most_idf"), "double")}
    if spec.rules != BASE:
        out |= {c: text(c) for c in ("rare_names", "rare_words", "rare_grams")}
    return out


def _read(spec: Spec) -> dict[str, str]:
    """The rules whose cells read a column, of columns that not all read."""
    if spec.out == "pairs" and not spec.score:
        return {"u": RARE + "n"}
    return {"u": RARE + "n", "numbers": RARE + "n" + "u" * (spec.score == "formulas"), "rare_names": RARE, "rare_words": "ag", "rare_grams": "g"}


def _cells(queries: DataFrame, pool: DataFrame, spec: Spec, links: DataFrame | None) -> DataFrame:
    """Both sides' rows with the cell that they meet in, side by side and in the order of ids."""
    key = lambda r: lambda v: F.struct(F.lit(r).alias("rule"), v.alias("value"))
    none = F.array().cast("array<struct<rule:string,value:string>>")
    u = F.substring(first_token(), 1, 4)
    parts = {"u": F.when(u.isNotNull(), F.array(key("u")(u))).otherwise(none), "n": F.transform("address_numbers", key("n"))}
    if spec.rules != BASE:
        # A pair meets at the first of HITS shared terms or more, which is never among a record's last HITS - 1.
        first = lambda c: F.slice(c, 1, F.greatest(F.size(c) - (HITS - 1), F.lit(0)))
        parts |= {r: F.transform(c, key(r)) for r, c in (("t", "rare_names"), ("a", first("rare_words")), ("g", first("rare_grams")))}
    if spec.out == "ranks":
        # A query without a link to rank has no place in the base rules' blocks; the pool's records have no scores.
        ranked = F.col("side").eqNullSafe(1) | F.exists("link_scores", lambda s: s.isNotNull())
        based = {r: F.when(ranked, F.col(f"keys_{r}")).otherwise(none) for r in BASE}
    else:
        based = {}
    keys = F.explode(F.concat(*(based.get(r, F.col(f"keys_{r}")) for r in spec.rules))).alias("key")
    slim = lambda df, side: df.filter("country <> ''").select("entity_id", "country", *(parts[r].alias(f"keys_{r}") for r in spec.rules), *(v.alias(k) for k, v in _payload(spec, side).items()))
    left, right = slim(queries, 0), slim(pool, 1)
    if spec.out == "ranks":
        none_of = lambda t: F.array().cast(t)
        left = left.join(links, left["entity_id"] == links["s1_id"], "left").drop("s1_id").withColumns({"link_ids": F.coalesce("link_ids", none_of("array<string>")), "link_scores": F.coalesce("link_scores", none_of("array<double>"))})
        right = right.withColumns({"link_ids": none_of("array<string>"), "link_scores": none_of("array<double>")})
    left, right = (df.withColumn("side", F.lit(side)) for side, df in enumerate((left, right)))
    told = [df.select("side", "country", keys) for df in (left, right)]
    at = ["country", "key.rule", "key.value"]
    counts = told[0].unionByName(told[1]).groupBy(*(F.col(c) for c in at)).agg(*((F.ceil(F.count_if(F.col("side") == s) / CELL)).alias(n) for s, n in ((0, "nq"), (1, "np"))))
    hot = F.broadcast(counts.filter("(nq > 1 or np > 1) and nq > 0 and np > 0").persist())  # at most a CELLth of the rows, counted once for both sides
    cut = []
    for side, df in enumerate((left, right)):
        own, other = ("nq", "np") if side == 0 else ("np", "nq")
        rows = df.select("*", keys).select("*", "key.rule", "key.value").drop("key", *(f"keys_{r}" for r in spec.rules))
        rows = rows.withColumns({c: F.when(F.col("rule").isin(*r), F.col(c)) for c, r in _read(spec).items() if c in rows.columns}).join(hot, ["country", "rule", "value"], "left")
        mine = F.coalesce(F.pmod(F.xxhash64("entity_id"), F.col(own)), F.lit(0))
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other).cast("int"), F.lit(1)) - 1))
        rows = rows.withColumn("mine", mine).withColumn("theirs", theirs)
        place = (F.col("mine"), F.col("theirs")) if side == 0 else (F.col("theirs"), F.col("mine"))
        cut.append(rows.withColumn("cell", F.concat_ws("\x1f", "country", "rule", "value", *place)).drop("mine", "theirs", "nq", "np", "country"))
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut[0].unionByName(cut[1]).repartition(n, "cell").sortWithinPartitions("cell", "side", "entity_id")


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell that has both sides, one cell after the other."""
    held, last = [], None
    both = lambda: held and held[0].column("side")[0].as_py() == 0 and held[-1].column("side")[-1].as_py() == 1
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("cell"))
        at = 0
        for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            if value != last:
                if both():
                    yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, end - at))
            at, last = end, value
    if both():
        yield pa.Table.from_batches(held).combine_chunks()


class _Sets:
    """Sets of terms of both sides; the pool's as postings."""

    def __init__(self, left: pa.Array, right: pa.Array):
        a, b = left.flatten(), right.flatten()
        coded = pa.concat_arrays([a, b]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.names, self.left = coded.dictionary, codes[: len(a)]
        offsets = lambda x: x.offsets.to_numpy() - x.offsets[0].as_py()
        self.cuts, ends = offsets(left), offsets(right)
        self.left_sizes, self.right_sizes = np.diff(self.cuts), np.diff(ends)
        theirs = codes[len(a) :]
        order = np.argsort(theirs, kind="stable")
        self.rows = np.repeat(np.arange(len(right)), self.right_sizes)[order]
        start = np.searchsorted(theirs[order], np.arange(len(self.names) + 1))
        self.lo, self.hi = start[self.left], start[self.left + 1]
        self.live = self.hi > self.lo

    def hits(self, i: int, keep: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The places of a query's terms that the pool has, with the pool's rows."""
        for j in range(self.cuts[i], self.cuts[i + 1]):
            if self.live[j] and (keep is None or keep[j]):
                yield j, self.rows[self.lo[j] : self.hi[j]]

    def counts(self, rows, n: int, keep: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(rows), n))
        for k, i in enumerate(rows):
            row = out[k]
            for j, p in self.hits(i, keep):
                row[p] += 1.0 if weight is None else weight[j]
        return out

    def greatest(self, rows, n: int, keep: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), n))
        for k, i in enumerate(rows):
            for j, p in self.hits(i, keep):
                out[k, p] = np.maximum(out[k, p], weight[j])
        return out

    def not_before(self, mask: np.ndarray, rows, values: pa.Array) -> None:
        """Takes the pairs out of ``mask`` that share a term in front of the query's of ``values``."""
        codes = pc.index_in(values.slice(rows.start, len(rows)), self.names).to_pylist()
        for k, i in enumerate(rows):
            for j, p in self.hits(i):
                if self.left[j] == codes[k]:
                    break
                mask[k, p] = False


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b != 0)


def _bigrams(names: list[str]) -> pa.Array:
    return pa.array([sorted({c[i : i + 2] for i in range(len(c) - 1)}) for c in (x.replace(" ", "") for x in names)], pa.list_(pa.string()))


def _words(names: list[str]) -> pa.Array:
    return pa.array([sorted({*x.split(" ")} - {""}) for x in names], pa.list_(pa.string()))


class _Names:
    """Scores of names, made once for each pair of different names."""

    def __init__(self, q: pa.Table, p: pa.Table, spec: Spec):
        self.spec = spec
        coded = pa.concat_arrays([_array(q, "name"), _array(p, "name")]).dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        (a, at, self.left), (b, bt, self.right) = (np.unique(x, return_index=True, return_inverse=True) for x in (codes[: q.num_rows], codes[q.num_rows :]))
        self.n = len(b)
        x, y = [names[i] for i in a], [names[i] for i in b]
        self.exact = [(a, b), np.array([bool(t) for t in x], bool)]
        self.bigrams = _Sets(_bigrams(x), _bigrams(y))
        self.tokens = _Sets(_words(x), _words(y))
        if spec.score == "improved":
            self.weights = _array(q, "name_w").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
            self.totals = _array(q, "name_total").to_numpy()[at], _array(p, "name_total").to_numpy()[bt]
        else:
            known: dict[str, int] = {}
            code = lambda t, k, other: known.setdefault(t[:k], len(known)) if len(t) >= k else other
            self.heads = [(np.array([code(t, k, -1) for t in x]), np.array([code(t, k, -2) for t in y])) for k in range(1, 5)]

    def scores(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each formula the part of the score that names decide, or the name evidence, of a strip's records."""
        own, back = np.unique(self.left[rows], return_inverse=True)
        (a, b), named = self.exact
        exact = ((a[own][:, None] == b) & named[own][:, None]).astype(float)
        dice = lambda s: _divided(2 * s.counts(own, self.n), (s.left_sizes[own][:, None] + s.right_sizes).astype(float))
        gram = dice(self.bigrams)
        if self.spec.score == "improved":
            mass = self.tokens.counts(own, self.n, weight=self.weights)
            shared = _divided(2 * mass, self.totals[0][own][:, None] + self.totals[1])
            out = [np.maximum(exact, 0.65 * shared + 0.35 * gram)]
        else:
            both = self.tokens.counts(own, self.n)
            jaccard = _divided(both, self.tokens.left_sizes[own][:, None] + self.tokens.right_sizes - both)
            prefix = np.zeros(exact.shape)
            for k, (x, y) in enumerate(self.heads):
                prefix[x[own][:, None] == y] = k + 1
            prefix /= 4.0
            weights = (FORMULAS[f] for f in self.spec.formulas)
            out = [((exact * w[0] + jaccard * w[1]) + gram * w[2]) + prefix * w[3] for w in weights]
        return [np.take(x, self.right, axis=1)[back] for x in out]


def _array(t: pa.Table, column: str) -> pa.Array:
    return t.column(column).combine_chunks() if t.column(column).num_chunks != 1 else t.column(column).chunk(0)


def _lists(t: pa.Table, column: str) -> pa.Array:
    """The terms of a column's texts; none of an empty or null one."""
    texts = _array(t, column).fill_null("")
    lists = pc.split_pattern(texts, " ")
    terms, sizes = lists.flatten(), np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), terms.filter(pc.not_equal(terms, "")))


def _classes(q: pa.Table, p: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of both sides' countries, names and address terms: records that have them all in common have equal scores."""

    def keys(t: pa.Table) -> pa.Array:
        cell = _array(t, "cell").dictionary_encode()
        country = pa.array([c.split("\x1f", 1)[0] for c in cell.dictionary.to_pylist()], pa.string()).take(cell.indices)
        return pc.binary_join_element_wise(country, _array(t, "name"), _array(t, "terms"), "\x1f")

    codes = pa.concat_arrays([keys(q), keys(p)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[: q.num_rows], codes[q.num_rows :]


class _Scores:
    """Scores of every pair of different records."""

    def __init__(self, q: pa.Table, p: pa.Table, spec: Spec):
        self.spec, self.n, self.names = spec, p.num_rows, _Names(q, p, spec)
        self.terms, self.numbers = (_Sets(_lists(q, c), _lists(p, c)) for c in ("terms", "numbers"))
        flat = lambda c: _array(q, c).flatten().to_numpy(zero_copy_only=False)
        self.is_number = flat("is_number")
        if spec.score == "improved":
            self.w, self.distinctive, self.most = flat("w"), flat("distinctive"), q.column("most").to_numpy()
            self.totals = q.column("total").to_numpy(), p.column("total").to_numpy()

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        """Unrounded: of each formula, or the evidence with both scores."""
        names = self.names.scores(rows)
        if self.spec.score == "formulas":
            both = self.terms.counts(rows, self.n)
            jaccard = _divided(both, self.terms.left_sizes[rows][:, None] + self.terms.right_sizes - both)
            number = (self.numbers.counts(rows, self.n) > 0).astype(float)
            return [(x + jaccard * FORMULAS[f][4]) + number * FORMULAS[f][5] for x, f in zip(names, self.spec.formulas)]
        left, right = self.totals[0][rows][:, None], self.totals[1]
        mass = self.terms.counts(rows, self.n, weight=self.w)
        dice, contained = _divided(2 * mass, left + right), _divided(mass, np.minimum(left, right))
        words = ~self.is_number
        supported = (self.terms.counts(rows, self.n, words) >= 2) & (self.terms.counts(rows, self.n, words & self.distinctive) > 0)
        a = np.where(supported, 0.65 * dice + 0.35 * contained, dice)
        q = self.terms.greatest(rows, self.n, self.is_number, self.w) / self.most[rows][:, None]
        n = names[0]
        plain = (0.65 * n + 0.30 * a) + 0.05 * q
        return [n, a, q, plain, np.maximum(plain, (0.85 * a + 0.10 * n) + 0.05 * q)]


class _Cell:
    """Queries and pool records of one cell, or of several of one rule, whose rows follow each other in the same order."""

    def __init__(self, q: pa.Table, p: pa.Table, spec: Spec):
        if spec.out == "ranks":
            q = q.take(pa.array(np.argsort(_classes(q, p)[0], kind="stable")))  # equal queries share strips, and so their scores
        self.rule, self.q, self.p, self.spec, self.n = q.column("rule")[0].as_py(), q, p, spec, p.num_rows
        self.value = _array(q, "value")
        cell = pa.concat_arrays([_array(q, "cell"), _array(p, "cell")]).dictionary_encode()
        codes = cell.indices.to_numpy(zero_copy_only=False)
        self.cells = (codes[: q.num_rows], codes[q.num_rows :]) if len(cell.dictionary) > 1 else None
        self.sets = lambda c: _Sets(_lists(q, c), _lists(p, c))
        self.numbers = self.sets("numbers")
        self.rare = [self.sets(c) for c in ("rare_names", "rare_words", "rare_grams")] if spec.rules != BASE and (not spec.score or self.rule not in BASE) else []
        self.us = pa.concat_arrays([_array(q, "u"), _array(p, "u")]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        if spec.score:
            (at, self.left), (bt, self.right) = ((i, inverse) for _, i, inverse in (np.unique(k, return_index=True, return_inverse=True) for k in _classes(q, p)))
            self.scored = _Scores(q.take(pa.array(at)), p.take(pa.array(bt)), spec)

    def equal(self, codes: np.ndarray, rows: range) -> np.ndarray:
        a = codes[rows.start : rows.stop][:, None]
        return (a == codes[self.q.num_rows :]) & (a >= 0)

    def flags(self, rows: range) -> list[np.ndarray]:
        names, words, grams = (s.counts(rows, self.n) for s in self.rare)
        return [(names > 0) | (words >= HITS), grams >= HITS]

    def mask(self, rows: range) -> np.ndarray | None:
        """The pairs that count here; None for all."""
        same = None if self.cells is None else self.cells[0][rows.start : rows.stop][:, None] == self.cells[1]
        if self.rule == "u":
            return same
        mask = ~self.equal(self.us, rows)
        if same is not None:
            mask &= same
        if self.rule == "n":
            self.numbers.not_before(mask, rows, self.value)
            return mask
        mask &= self.numbers.counts(rows, self.n) == 0
        names, words, grams = self.rare
        if self.rule != "t":
            mask &= names.counts(rows, self.n) == 0
            n = words.counts(rows, self.n)
            mask &= n >= HITS if self.rule == "a" else n < HITS
        if self.rule == "g":
            mask &= grams.counts(rows, self.n) >= HITS
        {"t": names, "a": words, "g": grams}[self.rule].not_before(mask, rows, self.value)
        return mask

    def scores(self, rows: range) -> list[np.ndarray]:
        """Of each formula, or the evidence with both scores; scores are rounded."""
        own, back = np.unique(self.left[rows.start : rows.stop], return_inverse=True)
        made = self.scored.of(own)
        made = [np.round(x, 12) if self.spec.score == "formulas" or k > 2 else x for k, x in enumerate(made)]
        return [np.take(x, self.right, axis=1)[back] if len(own) > 1 else np.broadcast_to(np.take(x[0], self.right), (len(rows), self.n)) for x in made]

    def pairs(self, rows: range) -> Iterator[pa.RecordBatch]:
        mask = self.mask(rows)
        i, j = np.indices((len(rows), self.n)).reshape(2, -1) if mask is None else np.nonzero(mask)
        if not len(i):
            return
        out = [self.ids(self.q).take(pa.array(i + rows.start)), self.ids(self.p).take(pa.array(j))]
        if self.spec.score:
            scores = self.scores(rows)
            values = [x[i, j] for x in scores]
            out += [pa.array(v if self.spec.places is None else np.round(v, self.spec.places)) for v in values]
            yield pa.RecordBatch.from_arrays(out, ["s1_id", "cand_id", *EVIDENCE])
        else:
            flags = [np.full(len(i), self.rule in BASE), *(f[i, j] for f in self.flags(rows))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(f) for f in flags], ["s1_id", "cand_id", *FLAGS])

    def ids(self, t: pa.Table) -> pa.Array:
        return _array(t, "entity_id")

    def masked(self, rows: range) -> tuple[np.ndarray | None, list[np.ndarray]]:
        """Rounded scores; -1 where a pair does not count here."""
        mask, scores = self.mask(rows), self.scores(rows)
        scores = scores[3:] if self.spec.score == "improved" else scores
        return mask, scores if mask is None else [np.where(mask, x, -1.0) for x in scores]

    def top(self, rows: range) -> Iterator[pa.RecordBatch]:
        """The first ``k`` of each query; equal scores in the order of ids, in which the pool's rows are."""
        _, scores = self.masked(rows)
        x, k = scores[-1], self.spec.k
        keep = x >= 0
        if self.n > k:
            edge = np.partition(x, self.n - k, axis=1)[:, self.n - k][:, None]
            above, level = x > edge, x == edge
            keep &= above | level & (np.cumsum(level, axis=1) <= k - above.sum(axis=1)[:, None])
        i, j = np.nonzero(keep)
        if len(i):
            yield pa.RecordBatch.from_arrays([self.ids(self.q).take(pa.array(i + rows.start)), self.ids(self.p).take(pa.array(j)), pa.array(x[i, j])], ["s1_id", "cand_id", "score"])

    def counts(self, rows: range) -> Iterator[pa.RecordBatch]:
        size = self.mask(rows).sum(axis=1)
        tokens = np.zeros_like(size) if self.rule == "g" else size
        yield pa.RecordBatch.from_arrays([self.ids(self.q).slice(rows.start, len(rows)), pa.array(tokens), pa.array(size)], ["s1_id", "T", "E"])

    def ranks(self, rows: range) -> Iterator[pa.RecordBatch]:
        """The pairs of each query by rare terms alone (without a match), and for its links and each axis the pairs in front of them."""
        mask, scores = self.masked(rows)
        size = np.full(len(rows), self.n) if mask is None else mask.sum(axis=1)
        ids = self.order
        out = [] if self.rule in BASE else [(i, None, -1, int(s)) for i, s in zip(rows, size) if s]
        axes = [(k, scores[s]) for k, (s, rules) in enumerate(self.spec.axes) if self.rule in rules]
        width = len(self.spec.axes)
        for k, i in enumerate(rows):
            if not size[k]:
                continue
            lo, hi = (0, self.n) if self.cells is None else (self.first_of[self.cells[0][i]], self.last_of[self.cells[0][i]])
            for m, match in enumerate(self.link_ids[i]):
                at = bisect_left(ids, match, lo, hi)
                here = at < hi and ids[at] == match
                for a, x in axes:
                    s = self.link_scores[i][m * width + a]
                    if s is None:
                        continue
                    s, row = np.round(s, 12), x[k, lo:hi]
                    better = int(np.count_nonzero(row > s)) + int(np.count_nonzero(row[: at - lo] == s)) - int(here and row[at - lo] > s)
                    if better:
                        out.append((i, match, a, better))
        if out:
            i, match, axis, n = zip(*out)
            yield pa.RecordBatch.from_arrays([self.ids(self.q).take(pa.array(i)), pa.array(match, pa.string()), pa.array(axis, pa.int32()), pa.array(n, pa.int64())], ["s1_id", "match_id", "axis", "n"])

    def run(self) -> Iterator[pa.RecordBatch]:
        if self.spec.out == "ranks":
            # Ids compare by their bytes, as the pool's rows are sorted.
            self.order = [x.encode() for x in self.ids(self.p).to_pylist()]
            self.link_ids = [[x.encode() for x in r] for r in self.q.column("link_ids").to_pylist()]
            self.link_scores = self.q.column("link_scores").to_pylist()
            if self.cells is not None:
                cells = np.arange(self.cells[1].max() + 1)
                self.first_of, self.last_of = ([int(x) for x in np.searchsorted(self.cells[1], cells, side)] for side in ("left", "right"))
        one, step = getattr(self, self.spec.out), max(1, STRIP // self.n)
        for lo in range(0, self.q.num_rows, step):
            yield from one(range(lo, min(lo + step, self.q.num_rows)))


def _worker(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, rule, sizes = [], [], None, (0, 0)
        joined = lambda: _Cell(pa.concat_tables(left).combine_chunks(), pa.concat_tables(right).combine_chunks(), spec).run()
        for t in _whole_cells(batches):
            n = int(np.count_nonzero(t.column("side").to_numpy() == 0))
            both = sizes[0] + n, sizes[1] + t.num_rows - n
            if left and (t.column("rule")[0].as_py() != rule or both[0] * both[1] > MERGED):
                yield from joined()
                left, right, both = [], [], (n, t.num_rows - n)
            left.append(t.slice(0, n))
            right.append(t.slice(n))
            rule, sizes = t.column("rule")[0].as_py(), both
        if left:
            yield from joined()

    return run


def _run(queries: DataFrame, pool: DataFrame, spec: Spec, schema: str, links: DataFrame | None = None) -> DataFrame:
    return _cells(queries, pool, spec, links).mapInArrow(_worker(spec), schema)


def expanded_pairs(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, cand_id, in_c, in_tokens, in_ngrams) of records with rarity, as :func:`.blocking.expanded` has them."""
    return _run(queries, pool, Spec("pairs", rules=ALL), "s1_id string, cand_id string, " + ", ".join(f"{c} boolean" for c in FLAGS))


def improved_pairs(queries: DataFrame, pool: DataFrame, places: int | None = None) -> DataFrame:
    """Evidence and both scores of all expanded pairs of weighted records with rarity."""
    return _run(queries, pool, Spec("pairs", "improved", ALL, places=places), "s1_id string, cand_id string, " + ", ".join(f"{c} double" for c in EVIDENCE))


def top(queries: DataFrame, pool: DataFrame, k: int, formula: str | None = None) -> DataFrame:
    """(s1_id, cand_id, score): of each query the first ``k`` of each cell, among which are the first ``k`` of all; config C's by
    a formula, else the expanded pairs of weighted records by the address rescue score."""
    if k < 1:
        raise ValueError("K must be positive")
    spec = Spec("top", "formulas", BASE, (formula,), k=k) if formula else Spec("top", "improved", ALL, k=k)
    return _run(queries, pool, spec, "s1_id string, cand_id string, score double")


def counts(queries: DataFrame, pool: DataFrame, expanded: bool = False) -> DataFrame:
    """(s1_id, A, B, C, T, E): each query's candidates by the three configurations, by C with the rare tokens and by all
    rules; T and E are C's without ``expanded``. Queries without any are left out."""
    rows = base_counts(queries, pool).withColumns({"T": F.col("C"), "E": F.col("C")})
    if expanded:
        rare = _run(queries, pool, Spec("counts", rules=RARE), "s1_id string, T long, E long")
        rows = rows.unionByName(rare, allowMissingColumns=True).groupBy("s1_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "ABCTE"))
    return rows.filter("E > 0")


def base_counts(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(s1_id, A, B, C) of every query with a country, without pairs: the pool records of its first token (f), of its first
    four characters (u), those that share a number (n), less those of n that f or u has already. Records with equal numbers
    are one set; sets that share a number meet, so that a record counts once however many numbers it shares."""
    start = first_token()
    slim = lambda df: df.filter("country <> ''").select("entity_id", "country", start.alias("f"), F.substring(start, 1, 4).alias("u"), F.col("address_numbers").alias("numbers"))
    left, right = slim(queries), slim(pool)
    there = F.size("numbers") > 0
    key = lambda kind, numbers, value: F.struct(F.lit(kind).alias("kind"), numbers.alias("numbers"), value.alias("value"))
    no_numbers, no_value = F.array().cast("array<string>"), F.lit("")
    alone = (key("f", no_numbers, F.col("f")), key("u", no_numbers, F.col("u")))
    shared = (key("n", F.col("numbers"), no_value), key("nf", F.col("numbers"), F.col("f")), key("nu", F.col("numbers"), F.col("u")))
    keys = lambda parts: F.explode(F.filter(F.array(*parts), lambda k: k["value"].isNotNull())).alias("key")
    classes = right.groupBy("country", "numbers", "f", "u").agg(F.count(F.lit(1)).alias("n"))
    sets = lambda df, name: df.filter(there).select("country", F.col("numbers").alias(name)).distinct().select("*", F.explode(name).alias("number"))
    meet = sets(left, "own").join(sets(right, "numbers"), ["country", "number"]).select("country", "own", "numbers").distinct()
    near = meet.join(classes, ["country", "numbers"]).select("country", F.col("own").alias("numbers"), "f", "u", "n")
    told = classes.select("country", keys(alone), "n").unionByName(near.select("country", keys(shared), "n"))
    at = ["country", "kind", "numbers", "value"]
    sizes = told.select("country", "key.*", "n").groupBy(*at).agg(F.sum("n").alias("n"))
    wanted = left.select("entity_id", "country", keys((*alone, *shared))).select("entity_id", "country", "key.*")
    rows = wanted.join(sizes, at, "left").groupBy(F.col("entity_id").alias("s1_id")).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("f", "u", "n", "nf", "nu")))
    return rows.select("s1_id", F.col("f").alias("A"), (F.col("f") + F.col("n") - F.col("nf")).alias("B"), (F.col("u") + F.col("n") - F.col("nu")).alias("C"))


def ranks(queries: DataFrame, pool: DataFrame, links: DataFrame, axes: dict[str, tuple[str, str]], score: str, axis: str) -> tuple[DataFrame, DataFrame]:
    """(s1_id, match_id, axis, rank) of every link, null where it is no candidate, and (axis, s1_id, all), each query's candidates.
    ``axes`` names scores and rules; ``links`` has (s1_id, match_id) and for each name its unrounded score, null where it is no candidate."""
    names = list(axes)
    which = list(dict.fromkeys(s for s, _ in axes.values())) if score == "formulas" else ["weighted", "score"]
    rules = ALL if any(r == ALL for _, r in axes.values()) else BASE
    spec = Spec("ranks", score, rules, tuple(which) if score == "formulas" else (), tuple((which.index(s), r) for s, r in axes.values()))
    lists = links.groupBy("s1_id").agg(F.collect_list(F.struct("match_id", F.array(*names).alias("s"))).alias("x"))
    lists = lists.select("s1_id", F.col("x.match_id").alias("link_ids"), F.flatten(F.col("x.s")).alias("link_scores"))
    found = _run(queries, pool, spec, "s1_id string, match_id string, axis int, n long", lists).groupBy("s1_id", "match_id", "axis").agg(F.sum("n").alias("n")).persist()
    every = lambda value: F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), F.lit(a).alias("label"), value(a)) for k, a in enumerate(names)))).alias("y")
    own = links.select("s1_id", "match_id", every(lambda a: F.col(a).alias("s"))).select("s1_id", "match_id", "y.axis", F.col("y.label").alias("label"), "y.s")
    rank = F.when(F.col("s").isNotNull(), F.coalesce("n", F.lit(0)) + 1)
    linked = own.join(found.filter("axis >= 0"), ["s1_id", "match_id", "axis"], "left").select("s1_id", "match_id", F.col("label").alias(axis), rank.alias("rank"))
    totals = base_counts(queries, pool).select("s1_id", F.col("C").alias("base"))
    if rules == ALL:
        totals = totals.join(found.filter("axis < 0").select("s1_id", F.col("n").alias("rare")), "s1_id", "left").withColumn("every", F.col("base") + F.coalesce("rare", F.lit(0)))
    sizes = totals.select("s1_id", F.explode(F.array(*(F.struct(F.lit(a).alias(axis), F.col("every" if r == ALL else "base").alias("all")) for a, (_, r) in axes.items()))).alias("y")).select(f"y.{axis}", "s1_id", "y.all")
    return linked, sizes.filter("all > 0")
