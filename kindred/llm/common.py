"""What the operators share: the shared folder, written intermediates, distributed ranks, word hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    folder of its own; on a cluster that is an error, since executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            folder = "file://" + tempfile.mkdtemp(prefix="kindred-checkpoint-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_folders: dict[str, str] = {}


def _app_dir(spark: SparkSession) -> str:
    ship(spark)
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/kindred-{app}"
        atexit.register(delete, spark, _folders[app])
    return _folders[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written intermediate; nothing happens where the session or the path has gone."""
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM ends before the interpreter does
        return


#: Bytes of an Arrow batch at most. Spark's 64 MB is for short rows; of texts, both sides of the pipe hold such a batch.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in batches of BATCH_BYTES or fewer."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "67108864b").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more, before a long job makes its own."""
    for _ in range(2):  # the first round frees the driver's handles, the second what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that this worker has freed back to the system; a reused worker else keeps its peak for the next stage."""
    pa.default_memory_pool().release_unused()
    if own := _malloc_trim():
        own(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker gives back what it has freed."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


_scopes: list[list[Folder]] = []


class Folder:
    """A new folder inside the shared one. It goes with :meth:`drop`, with the innermost :class:`scope` around, or when
    the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{_app_dir(spark)}/{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def drop(self) -> None:
        delete(self.spark, self.path)


class Written(Folder):
    """A DataFrame written to the shared folder as Parquet: it cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame):
        super().__init__(df.sparkSession)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)


class scope:
    """Inside ``with scope() as s`` all intermediates are the scope's; it drops them at its end, but for what
    ``s.keep(df)`` writes. What is still to be read from them has to be written by then."""

    def __enter__(self) -> scope:
        _scopes.append([])
        return self

    def keep(self, df: DataFrame) -> Written:
        out = Written(df)
        _scopes[-1].remove(out)
        if len(_scopes) > 1:
            _scopes[-2].append(out)
        return out

    def __exit__(self, *_) -> None:
        for w in _scopes.pop():
            w.drop()


def written(df: DataFrame) -> DataFrame:
    return Written(df).df


def ranked(df: DataFrame, keys: list[str], order: list[str], rank: str, buckets: int = 256) -> DataFrame:
    """Add ``rank``: the row's place (from 0) among the rows of its key, ordered by (bucket, ``order``), bucket being a
    hash of ``order``. A key with most of the rows is numbered in ``buckets`` parts: counts by part are summed up
    first, so that no task ever sees a whole key. Rows that agree in ``order`` take consecutive ranks in any order."""
    cell = "__kindred_cell"
    df = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("__kindred_n"))
    offsets = counts.select(*keys, cell, F.coalesce(F.sum("__kindred_n").over(before), F.lit(0)).alias("__kindred_before"))
    within = Window.partitionBy(*keys, cell).orderBy(*order)
    left = df.withColumn(rank, F.row_number().over(within) - 1)
    on = [left[k].eqNullSafe(offsets[k]) for k in [*keys, cell]]
    out = left.join(offsets, on, "left")
    return out.select(*[left[c] for c in left.columns if c not in (rank, cell)], (left[rank] + offsets["__kindred_before"]).alias(rank))


#: Hashed entries are dealt out to so many ranges at most; a range of more text than a bucket's is cut where it arrives.
MOST_RANGES = 1 << 15
#: Text bytes for each bucket of hashes; a bucket is worked on at once.
BUCKET_BYTES = 16 << 20
#: Entries that a task holds before it packs and sends them.
HELD, MOST_HELD = 1 << 18, 1 << 21


class Buckets:
    """Entries dealt out by a column ``by``, of hashes or of signed numbers: columns of numbers (``kinds``: name and type),
    packed by range. So many ranges are there that each holds BUCKET_BYTES of text or they are MOST_RANGES; then every range is cut
    into ``fine`` buckets by the task that gets it, so that rows stay packed however large the input is."""

    def __init__(self, size: int, kinds: dict[str, str], by: str = "hashes"):
        wanted = max(12, size // BUCKET_BYTES)
        self.ranges, self.kinds, self.by = int(min(wanted, MOST_RANGES)), kinds, by
        self.fine = -(-wanted // self.ranges)
        self.held = int(min(max(HELD, 32 * self.ranges), MOST_HELD))

    @property
    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"{k} binary" for k in self.kinds)

    def _key(self, columns: dict[str, np.ndarray], shift: int) -> np.ndarray:
        own = columns[self.by]
        own = own if own.dtype == np.uint64 else mix(own.astype(np.int64).view(np.uint64))
        return (own >> np.uint64(shift)).astype(np.int64) & 0xFFFFFF

    def _packed(self, key: np.ndarray, columns: dict[str, np.ndarray], most: int) -> tuple[list[int], list[pa.Array]]:
        order = np.argsort(key.astype(np.uint16) if most <= 1 << 16 else key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        cut = np.append(first, len(key)).tolist()
        sorted_ = [columns[k].astype(t, copy=False)[order] for k, t in self.kinds.items()]
        return key[first].tolist(), [pa.array([c[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for c in sorted_]

    def pack(self, **columns: np.ndarray) -> pa.RecordBatch:
        ids, packed = self._packed(self._key(columns, 40) % self.ranges, columns, self.ranges)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *packed], ["bucket", *self.kinds])

    def _unpacked(self, table) -> dict[str, np.ndarray]:
        return {k: np.concatenate([np.empty(0, t), *(np.frombuffer(x.as_buffer(), t) for x in table.column(k))]) for k, t in self.kinds.items()}

    def answered(self, rows: DataFrame, answer: Callable[..., pa.Table], schema: str) -> DataFrame:
        """What ``answer`` makes of the columns of each bucket of ``rows`` (of :meth:`pack`)."""

        def whole(table: pa.Table) -> pa.Table:
            out = answer(**self._unpacked(table))
            trim()
            return out

        if self.fine == 1:
            return rows.groupBy("bucket").applyInArrow(whole, schema)

        def cut(batches):
            for b in batches:
                for i, bucket in enumerate(b.column(0).to_pylist()):
                    columns = self._unpacked(b.slice(i, 1))
                    ids, packed = self._packed(self._key(columns, 16) % self.fine, columns, self.fine)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(ids), pa.int32()), pa.array(ids, pa.int32()), *packed], ["bucket", "cut", *self.kinds])

        def each(batches):
            key, held = None, []
            for b in batches:
                for i, own in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    if held and own != key:
                        yield from whole(pa.Table.from_batches(held)).to_batches()
                        held = []
                    key = own
                    held.append(b.slice(i, 1))
            if held:
                yield from whole(pa.Table.from_batches(held)).to_batches()

        parts = rows.repartition("bucket").mapInArrow(lean(cut), self.schema.replace("bucket int", "bucket int, cut int"))
        return parts.sortWithinPartitions("bucket", "cut").mapInArrow(lean(each), schema)


#: Bits of a filter of ids at most: 8 MB, however many ids there are.
FILTER_BITS = 1 << 26


def only_likely(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose integer id is not in ``ids`` (its first column), before a join deals them out.
    A bitmap of hashed ids, of bounded size, lets some others pass; with very many ids it lets all pass."""
    spark, name = df.sparkSession, ids.columns[0]
    bits = min(FILTER_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    parts = ids.select((place(F.col(name)) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    maps = [(r.b - 1, np.frombuffer(bytes(r.m), "<i8").tolist()) for r in parts]
    known = spark.createDataFrame(maps, "__kindred_bucket long, __kindred_words array<long>")
    at = place(F.col(id_col))
    joined = df.join(F.broadcast(known), F.floor(at / (1 << 15)) == known["__kindred_bucket"])  # FILTER_BITS at most
    bit = F.expr("bit_get(element_at(__kindred_words, cast((__kindred_at % 32768) div 64 as int) + 1), cast(__kindred_at % 64 as int)) = 1")
    return joined.withColumn("__kindred_at", at).filter(bit).select(*df.columns)


#: Odd multipliers of the word and window hashes.
WINDOW_BASE, MIX_A, MIX_B = 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What keeps the first 0 to 8 bytes of a little-endian lane.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


#: Whole texts are hashed a block at a time, so that the arrays made on the way stay small.
BLOCK_BYTES = 1 << 20
#: Every ASCII character that is neither letter nor digit, as a gap between words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    block, held = [], 0
    for t in texts:
        if block and held + len(t) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t) + 1
    if block:
        yield block


def word_hashes(texts: list[bytes], lower: bool = False, gaps: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """For each text (UTF-8) the 64-bit hashes of its words, in order: the runs without ASCII white space, or without the
    bytes that ``gaps`` marks. With ``prefixes``, each of these many first bytes of longer words follow, as further terms."""
    out: list[np.ndarray] = []
    for block in _blocks(texts):
        parts = [np.split(hashes, np.searchsorted(rows, np.arange(1, len(block)))) for rows, hashes in _hashed(block, lower, gaps, prefixes)]
        out += parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts)]
    return out


def flat_hashes(texts: list[bytes], lower: bool = False, gaps: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same hashes as (texts' places, hashes), some at a time."""
    first = 0
    for block in _blocks(texts):
        for rows, hashes in _hashed(block, lower, gaps, prefixes):
            yield rows + first, hashes
        first += len(block)


#: Words of more bytes have the hash of a digest, others are mixed in lanes of eight bytes.
LONG_WORD = 64


def _hashed(texts: list[bytes], lower: bool, gaps: np.ndarray, prefixes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = np.frombuffer(b" ".join(texts) + b" " * (LONG_WORD + 8), np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    gap = gaps[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge if gap[0] else np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    row = np.searchsorted(bounds, starts, "right")
    raw = _LOWER[raw] if lower else raw
    lanes = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))  # the eight bytes from every place on
    lengths = ends - starts
    head = lanes[starts]
    whole = mix((head & _FIRST[np.minimum(lengths, 8)]) ^ (lengths.astype(np.uint64) * np.uint64(MIX_A)))
    own, k = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(own):
        whole[own] = mix(whole[own] * np.uint64(MIX_B) + (lanes[starts[own] + k] & _FIRST[np.minimum(lengths[own] - k, 8)]))
        k += 8
        own = own[lengths[own] > k]
    for i in np.flatnonzero(lengths > LONG_WORD):
        whole[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    yield row, whole
    for n in prefixes:
        own = np.flatnonzero(lengths > n)
        part = mix((head[own] & _FIRST[min(n, 8)]) ^ np.uint64(n * MIX_B & 0xFFFFFFFFFFFFFFFF))
        for k in range(8, n, 8):
            part = mix(part * np.uint64(MIX_B) + (lanes[starts[own] + k] & _FIRST[min(n - k, 8)]))
        yield row[own], part


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit hash of each run of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= np.uint64(WINDOW_BASE)
        total += words[k : k + n]
    return mix(total)
