"""Substring dedup by level-wise doubling: windows that repeat at one length alone are extended to twice that length.

The first level has half the length asked for, and of each full window only the half with the smallest hash, so
that equal windows choose equal halves and about a quarter of all places are looked at. Windows around halves that
repeat are compared at full length; with ``longest`` the doubling goes on until no candidate survives.

Windows are compared by 64-bit hashes. Each task keeps one entry for a hash, that of its smallest document, and
settles its other documents itself: a passage that a third of all documents share costs an entry for each task.
Answers go back by document. Hashes of n windows meet by chance in about n * n / 2^65 pairs: 0.0005 in a billion
windows' first eighth, 0.1 for 2 billion.

Words are the runs without ASCII white space, unchanged. Null and empty texts have no words; texts of any length are
read whole; rows that repeat an id share its fate and never make each other's windows repeated; a null id is neither
smaller nor larger than another, so that nothing of it is removed; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WINDOW_BASE, Buckets, Written, bounded_batches, lean, mix, release, window_hashes, word_hashes, written

LENGTH = 13
#: An entry: document, tag, place (low and high half), hash and marks.
ENTRY = {"docs": "i8", "tags": "i8", "low": "u2", "high": "u2", "hashes": "u8", "marks": "u1"}
#: An entry's marks: another document of its task shares it; a smaller one has it; its task has told it so.
SHARED, LATER, SETTLED = 1, 2, 4


def anchors(words: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` words the place of its half with the smallest hash."""
    half = (length + 1) // 2
    h = window_hashes(words, half)
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, place = h[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - half + 1):
        next_ = h[k : k + n]
        np.copyto(place, k, where=next_ < best)
        np.minimum(best, next_, out=best)
    return place + np.arange(n)


def twice(places: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of twice the length whose halves are both among these, sorted by place."""
    n = int(places[-1]) + 1 if len(places) else 0
    at = np.full(n + length, -1)
    at[places] = np.arange(len(places))
    other = at[places + length] if n else at
    both = other >= 0
    return places[both], mix(hashes[both] * np.uint64(WINDOW_BASE) + mix(hashes[other[both]]))


def _unpack(raw, kind) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind) if raw.is_valid else np.empty(0, kind)


def _judged(docs: np.ndarray, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The marks, with what the documents of equal hashes say of each other added."""
    if not len(hashes):
        return marks
    order = np.argsort(hashes)
    sorted_, docs = hashes[order], docs[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    heads, run = np.flatnonzero(first), np.cumsum(first) - 1
    late = docs > np.minimum.reduceat(docs, heads)[run]
    shared = np.logical_or.reduceat(late | (marks[order] & SHARED > 0), heads)[run]
    out = marks.copy()
    out[order] |= shared.astype(np.uint8) * np.uint8(SHARED) | late.astype(np.uint8) * np.uint8(LATER)
    return out


def _by_document(docs: np.ndarray, tags: np.ndarray, columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """The distinct (document, tag), and each column's packed rows of each."""
    order = np.lexsort((tags, docs)) if tags.any() else np.argsort(docs, kind="stable")
    docs, tags = docs[order], tags[order]
    first = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))) if len(docs) else np.empty(0, np.int64)
    cut = np.append(first, len(order)).tolist()
    return [docs[first], tags[first]], [[c[a:b].tobytes() for a, b in zip(cut, cut[1:])] for c in (c[order] for c in columns)]


def exchange(rows: DataFrame, of: Callable[[pa.RecordBatch], Iterator[tuple]], size: int, with_hashes: bool = False) -> DataFrame:
    """The windows that ``of`` makes of a batch of ``rows`` as (doc_id, tag, places, hashes), of which those stay that another
    document has too; ``later`` says which of these a document with a smaller id has. A row for each document; answers
    go back packed by parts of the documents. ``size`` is the bytes of all texts."""
    buckets = Buckets(size, ENTRY)
    home = Buckets(size, {k: t for k, t in ENTRY.items() if with_hashes or k != "hashes"}, by="docs")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}  # repeated rows count once
        entries = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                for x in of(whole.slice(at, 200)):
                    if len(x[2]) and x[:2] not in held:
                        held[x[:2]] = x
                        entries += len(x[2])
                if entries >= buckets.held:
                    yield dealt(list(held.values()))
                    held, entries = {}, 0
        if held:
            yield dealt(list(held.values()))

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[2]) for x in held]
        docs, tags = (np.repeat(np.array([x[k] for x in held], np.int64), sizes) for k in (0, 1))
        places = np.concatenate([x[2] for x in held]).astype(np.uint32)
        hashes = np.concatenate([x[3] for x in held])
        marks = _judged(docs, hashes, np.zeros(len(docs), np.uint8))
        marks[marks & LATER > 0] |= SETTLED
        return buckets.pack(docs=docs, tags=tags, low=places.astype(np.uint16), high=(places >> 16).astype(np.uint16), hashes=hashes, marks=marks)

    def answer(docs, tags, low, high, hashes, marks) -> pa.Table:
        open_ = np.flatnonzero(marks & SETTLED == 0)
        marks[open_] = _judged(docs[open_], hashes[open_], marks[open_])
        told = np.flatnonzero(marks & SHARED)
        columns = {"docs": docs, "tags": tags, "low": low, "high": high, "hashes": hashes, "marks": marks}
        return pa.Table.from_batches([home.pack(**{k: columns[k][told] for k in home.kinds})])

    def together(docs, tags, low, high, marks, hashes=None) -> pa.Table:
        columns = [low | high.astype(np.uint32) << 16, marks & LATER > 0] + ([hashes] if with_hashes else [])
        keys, packed = _by_document(docs, tags, columns)
        return pa.table([*(pa.array(k, pa.int64()) for k in keys), *(pa.array(x, pa.binary()) for x in packed)], names)

    names = ["doc_id", "tag", "places", "later"] + ["hashes"] * with_hashes
    found = buckets.answered(rows.mapInArrow(lean(deal), buckets.schema), answer, home.schema)
    return home.answered(found, together, "doc_id long, tag long, places binary, later binary" + ", hashes binary" * with_hashes)


def repeated(source: DataFrame, length: int = LENGTH, longest: bool = False) -> DataFrame:
    """``source`` (from :func:`rows_of`) to (doc_id, tag, places, later, longest): packed places of the windows of ``length`` that another document has too,
    whether one with a smaller id has, and the longest doubled length at which a window still repeats in another document."""
    spark = source.sparkSession
    source = source.filter("doc_id is not null")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def halves(b: pa.RecordBatch):
        for doc, tag, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes([_raw(t) for t in b.column(2)])):
            places = np.unique(anchors(words, length))
            yield doc, tag, places, window_hashes(words, (length + 1) // 2)[places]

    def full(b: pa.RecordBatch):
        for i, (doc, tag, words) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes([_raw(t) for t in b.column(2)]))):
            around = anchors(words, length)
            known = np.zeros(len(words) + 1, bool)
            known[_unpack(b.column(3)[i], np.uint32)] = True
            places = np.flatnonzero(known[around])
            yield doc, tag, places, window_hashes(words, length)[places]

    def longer(times: int):
        def of(b: pa.RecordBatch):
            for i, (doc, tag) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                places, hashes = _unpack(b.column(2)[i], np.uint32), _unpack(b.column(3)[i], np.uint64)
                places, first = np.unique(places, return_index=True)
                yield doc, tag, *twice(places.astype(np.int64), hashes[first], length << times)

        return of

    first = Written(exchange(source, halves, size).select("doc_id", "tag", "places"))
    release(spark)
    found = Written(exchange(source.join(first.df, ["doc_id", "tag"]), full, size, longest))
    first.drop()
    release(spark)
    out = found.df.select("doc_id", "tag", "places", "later", F.lit(length).alias("longest"))
    level, times, reached = found, 0, []
    while longest and not level.df.isEmpty():
        next_ = Written(exchange(level.df.select("doc_id", "tag", "places", "hashes"), longer(times), size, True).select("doc_id", "tag", "places", "hashes"))
        times += 1
        reached.append(Written(next_.df.select("doc_id", "tag", F.lit(length << times).alias("longest"))).df)
        if level is not found:
            level.drop()
        level = next_
        release(spark)
    if reached:
        most = reduce(DataFrame.unionByName, [found.df.select("doc_id", "tag", F.lit(length).alias("longest")), *reached]).groupBy("doc_id", "tag").agg(F.max("longest").alias("longest"))
        out = out.drop("longest").join(most, ["doc_id", "tag"])
    return out


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag and text: the tag is 0, or for ids that repeat a hash of the text, which tells their rows apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again"))
    marked = rows.join(written(again), "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("tag"), "text")


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def dedup(docs: DataFrame, length: int = LENGTH, longest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, longest): what is left of each text without the words that a window covers whose
    words start in a document with a smaller id too; kept words are joined by one space."""
    bounded_batches(docs.sparkSession)
    source = rows_of(docs, id_col, text_col)
    joined = source.join(repeated(source, length, longest), ["doc_id", "tag"], "left").select("doc_id", "text", "places", "later", "longest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                n, gone, kept = [], [], []
                for i, text in enumerate(b.column(1)):
                    words = _raw(text).split()
                    n.append(len(words))
                    starts = _unpack(b.column(2)[i], np.uint32)[_unpack(b.column(3)[i], np.bool_)].astype(np.int64)
                    if len(starts):
                        edge = np.zeros(len(words) + 1, np.int32)
                        np.add.at(edge, starts, 1)
                        np.subtract.at(edge, starts + length, 1)
                        words = [w for w, s in zip(words, (np.cumsum(edge[:-1]) == 0).tolist()) if s]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), b.column(4)], ["doc_id", "n_words", "n_removed", "kept", "longest"])

    return joined.mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept string, longest int")


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("longest", F.lit(0)).alias("longest"))
