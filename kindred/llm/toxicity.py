"""Toxicity: a factorization machine over hashed terms. Beside a weight for each term it learns a short vector for
each, whose products weigh pairs: an insult next to a mention of a group may count though neither does alone.

Terms are the words of a text (lower case, between ASCII characters that are neither letters nor digits) and the
first 4 to 9 bytes of longer ones, hashed; a text has or lacks a term. The machine is fitted on a bounded sample of labelled
rows (``sample``): its terms are counted on the executors, and the driver fits those that tell the labels apart alone
and those that do so in pairs, which it looks for among the most frequent ones (``frequent``). All rows are scored, whole.

Null texts count as empty and get the score of a text without known terms; a label without its document, a null label
and a null id teach nothing; a repeated id teaches by one of its rows for each label, so that ``sample`` bounds rows too;
without labels of both kinds the score is the smoothed rate; repeated rows are scored each; an empty table gives an empty
result; other columns are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, bounded_batches, flat_hashes, lean, trim, word_hashes, written

TERM_BITS = 26
PREFIXES = (4, 5, 6, 7, 8, 9)
#: Terms that agree but for so many bits share a place of the sieve that a text's terms go through first.
SIEVE_SHIFT = 8
SAMPLE, VOCABULARY = 20_000, 4096
#: Terms among which pairs are looked for, terms that pairs may add, and how sure a pair must be: with half a million
#: pairs, six deviations are met by chance about once in a thousand corpora.
FREQUENT, PAIRED, PAIR_SURE = 1024, 512, 6.0


def terms(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed terms of each text."""
    return [np.unique((h >> np.uint64(64 - TERM_BITS)).astype(np.int32)) for h in word_hashes(texts, True, NOT_ALNUM, PREFIXES)]


@dataclass(slots=True)
class Machine:
    """known: sorted hashed terms; bias, weights and vectors: of the terms."""

    known: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Of rows that have these distinct terms."""
        every = np.concatenate([np.empty(0, np.int32), *found])
        return self._scores(len(found), [(np.repeat(np.arange(len(found)), [len(t) for t in found]), every)])

    def text_scores(self, texts: list[bytes]) -> np.ndarray:
        return self._scores(len(texts), ((row, (h >> np.uint64(64 - TERM_BITS)).astype(np.int32)) for row, h in flat_hashes(texts, True, NOT_ALNUM, PREFIXES)))

    def _scores(self, n: int, parts) -> np.ndarray:
        """Of ``n`` rows with the terms (row, term) of ``parts``, each of which counts once in a row."""
        z, k = np.full(n, self.bias), len(self.known)
        if k:
            may = np.zeros(1 << TERM_BITS - SIEVE_SHIFT, bool)
            may[self.known >> SIEVE_SHIFT] = True
            hits = []
            for row, every in parts:
                some = may[every >> SIEVE_SHIFT]
                row, every = row[some], every[some]
                at = np.minimum(np.searchsorted(self.known, every), k - 1)
                same = self.known[at] == every
                hits.append(row[same] * k + at[same])
            row, at = np.divmod(np.unique(np.concatenate([np.empty(0, np.int64), *hits])), k)
            z += np.bincount(row, self.weights[at], n)
            for f in range(self.vectors.shape[1]):
                v = self.vectors[at, f]
                z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(counts: DataFrame, positive: int, negative: int, vocabulary: int = VOCABULARY) -> np.ndarray:
    """The sorted terms of ``counts`` (term, pos, all) whose presence differs most surely between the labels."""
    p = F.col("all") / (positive + negative)
    gap = F.abs(F.col("pos") / positive - (F.col("all") - F.col("pos")) / negative)
    z = gap / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / positive + 1 / negative))
    rows = counts.filter("`all` >= 3").withColumn("z", z).filter("z > 3").orderBy(F.desc("z"), "term").limit(vocabulary).select("term").collect()
    return np.array(sorted(r.term for r in rows), np.int32)


def most_frequent(counts: DataFrame, rows: int, frequent: int = FREQUENT) -> np.ndarray:
    """The sorted terms that most rows have, without those that nearly all have."""
    found = counts.filter((F.col("all") >= 3) & (F.col("all") <= 0.98 * rows)).orderBy(F.desc("all"), "term").limit(frequent).select("term").collect()
    return np.array(sorted(r.term for r in found), np.int32)


def interacting(found: list[np.ndarray], labels: np.ndarray, candidates: np.ndarray, most: int = PAIRED, sure: float = PAIR_SURE) -> np.ndarray:
    """Those of the places ``candidates`` that occur together with another of them otherwise under one label than under
    the other, beyond what each does alone: the terms of the ``most`` / 2 surest pairs. A pair's measure is the difference
    of its covariances under the two labels, over that difference's deviation."""
    k, gap, spread = len(candidates), 0.0, 0.0
    if k < 2:
        return candidates[:0]
    column = np.full(int(max([candidates.max(), *(f.max() for f in found if len(f))])) + 1, -1)
    column[candidates] = np.arange(k)
    for label, sign in ((1, 1.0), (0, -1.0)):
        own = np.flatnonzero(labels == label)
        both = np.zeros((k, k), np.float32)
        for first in range(0, len(own), 1024):
            x = np.zeros((len(own[first : first + 1024]), k), np.float32)
            for i, r in enumerate(own[first : first + 1024]):
                at = column[found[r]]
                x[i, at[at >= 0]] = 1
            both += x.T @ x
        both = both.astype(np.float64) / len(own)
        p = np.diag(both)
        a, b = p[:, None], p[None, :]
        covariance = both - a * b
        # The mean square of the product of both deviations, over the four cases, gives the covariance's own deviation.
        square = both * ((1 - a) * (1 - b)) ** 2 + (a - both) * ((1 - a) * b) ** 2 + (b - both) * (a * (1 - b)) ** 2 + (1 - a - b + both) * (a * b) ** 2
        gap = gap + sign * covariance
        spread = spread + np.maximum(square - covariance**2, 1e-9) / len(own)
    z = np.triu(np.abs(gap) / np.sqrt(spread), 1)
    best = np.argsort(-z, axis=None, kind="stable")[: most // 2]
    best = best[z.ravel()[best] > sure]
    return np.unique(candidates[np.concatenate([best // k, best % k])])


def fit(known: np.ndarray, found: list[np.ndarray], labels: np.ndarray, factors: int = 8, epochs: int | None = None, rate: float = 0.1, decay: float = 1e-4, batch: int = 256, seed: int = 42) -> Machine:
    """The machine over the terms ``known`` for rows that have the terms ``found`` (places in ``known``). Adagrad on the
    logistic loss, at least 12 times over all rows and a thousand steps unless ``epochs`` is given; without labels of both
    kinds, the smoothed rate alone."""
    y = labels.astype(np.float32)
    n1 = float(y.sum())
    n0 = len(y) - n1
    if not n1 or not n0:
        base = min(max(n1 / (len(y) + 1), 1e-6), 1 - 1e-6)
        return Machine(np.empty(0, np.int32), float(np.log(base / (1 - base))), np.empty(0), np.empty((0, factors)))
    k = len(known)
    draw = np.random.default_rng(seed)
    bias, w, v = float(np.log(n1 / n0)), np.zeros(k, np.float32), draw.normal(0, 0.01, (k, factors)).astype(np.float32)
    gw, gv, gb = np.full(k, 1e-2, np.float32), np.full((k, factors), 1e-2, np.float32), 1e-2
    for _ in range(epochs or max(12, -(-1000 * batch // len(y)))):
        order = draw.permutation(len(y))
        for first in range(0, len(y), batch):
            rows = order[first : first + batch]
            x = np.zeros((len(rows), k), np.float32)
            for i, r in enumerate(rows):
                x[i, found[r]] = 1
            mass = x @ v
            score = bias + x @ w + 0.5 * (mass**2 - x @ v**2).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) / len(rows)
            each = x.T @ slope
            dw = each + decay * w
            dv = x.T @ (slope[:, None] * mass) - each[:, None] * v + decay * v
            gw += dw**2
            gv += dv**2
            gb += slope.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            bias -= rate * float(slope.sum()) / gb**0.5
    return Machine(known, bias, w.astype(np.float64), v.astype(np.float64))


def held_out(id_col: str, folds: int = 5):
    """Whether an id is kept from learning: its text's CRC-32 is a multiple of ``folds``; a null id is not."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, frequent: int = FREQUENT, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Machine:
    """A machine from at most ``sample`` labelled rows, drawn by a seeded hash of the id among those not held out."""
    bounded_batches(docs.sparkSession)
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    drawn = rows.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).distinct().orderBy(F.xxhash64("k", F.lit(seed)), "k", "y").limit(sample)
    texts = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [t.tobytes() for t in terms([x.as_buffer().to_pybytes() for x in b.column(2)])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["k", "y", "terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, found = b.column(0).to_numpy(), [np.frombuffer(t.as_buffer(), np.int32) for t in b.column(1)]
            names, index = np.unique(np.concatenate(found), return_inverse=True)
            pos = np.bincount(index, np.repeat(y, [len(t) for t in found]), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pos.astype(np.int64)), pa.array(np.bincount(index, minlength=len(names)))], ["term", "pos", "all"])

    kind = texts.schema["k"].dataType.simpleString()
    named = texts.join(F.broadcast(drawn), "k").select("k", "y", "t").mapInArrow(lean(describe), f"k {kind}, y int, terms binary")  # at most ``sample`` labels
    sampled = written(named.groupBy("k", "y").agg(F.min("terms").alias("terms")).select("y", "terms"))
    both = {r.y: r.n for r in sampled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (both.get(0) and both.get(1)):
        return fit(np.empty(0, np.int32), [], np.repeat([0, 1], [both.get(0, 0), both.get(1, 0)]), seed=seed)
    counts = written(sampled.mapInArrow(lean(count), "term int, pos long, `all` long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all")).filter("`all` >= 3"))
    alone, often = telling(counts, both[1], both[0], vocabulary), most_frequent(counts, both[0] + both[1], frequent)
    every = np.union1d(alone, often).astype(np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.searchsorted(every, np.intersect1d(every, np.frombuffer(t.as_buffer(), np.int32), assume_unique=True)).astype(np.int16).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["y", "places"])

    rows = sampled.mapInArrow(lean(place), "y int, places binary").collect()  # at most ``sample`` rows of at most ``vocabulary`` + ``frequent`` places
    rows.sort(key=lambda r: (r.y, bytes(r.places)))
    found, y = [np.frombuffer(bytes(r.places), np.int16) for r in rows], np.array([r.y for r in rows], np.float32)
    own = np.union1d(np.searchsorted(every, alone), interacting(found, y, np.searchsorted(every, often)))
    place_of = np.full(len(every), -1)
    place_of[own] = np.arange(len(own))
    found = [(at := place_of[f])[at >= 0] for f in found]
    return fit(every[own], found, y, seed=seed, **options)


def score(docs: DataFrame, machine: Machine, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        parts = [machine.text_scores([t.encode() for t in texts.iloc[i : i + 500]]) for i in range(0, len(texts), 500)]
        trim()
        return pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(out, scored(F.coalesce(F.col(text_col), F.lit(""))))


def scored_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    slim = score(docs.select("doc_id", "text"), learn(docs, labels, **options))
    return slim.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
