"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents become tokens and a closing id; only longer ones than a sequence are cut. Pieces of one length are
alike, so the decreasing order is that of the counts by length (at most ``capacity`` of them, whatever the
corpus): the driver packs counts, the tree gives the tightest open bin in logarithmic time, and a run of equal
pieces goes to a range of bins at once. Each piece then finds its run by its rank among the pieces of its length.

Null texts count as empty, and an empty text is one piece of the closing id; texts of any length are read
whole, some megabytes at a time; rows with null ids, repeated rows and repeated ids are pieces of their own; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, ranked, written

CAPACITY = 2048
CLOSING_ID = 0
#: Characters that are encoded together: equal chunks among them are encoded once.
TOGETHER = 2_000_000
ROWS_TOGETHER = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The stages of tokenizer files whose chunks between spaces are encoded on their own, and the model's settings.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
KNOWN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Lower-case Latin letters, then ASCII marks but for the apostrophe: two words to such a tokenizer.
PLAIN = r"^[a-zß-öø-ÿ]+[!-&(-/:;=>?@\[-`{-~]*$"


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class PairMerges:
    """Byte-pair merges of many words at once: in each round every word makes its first merge of the lowest rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        letters, suffix = _byte_letters(), KNOWN_MODEL["end_of_word_suffix"]
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int32)
        self.none = len(pairs)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.uint64)
        # A table with linear probing: in the order of their hashes, keys take their own place or the next free one.
        self.bits = max(8, (4 * len(keys)).bit_length())
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        place = np.arange(len(keys)) + np.maximum.accumulate(home[order] - np.arange(len(keys))) if len(keys) else home
        self.probes = int((place - home[order]).max()) + 1 if len(keys) else 1
        self.keys = np.full((1 << self.bits) + len(keys) + self.probes, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(len(self.keys), self.none, np.int32)
        self.keys[place], self.ranks[place] = keys[order], order

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` of those that do not merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], self.none).astype(np.int32)
        left_over = np.flatnonzero((there != keys) & (there != np.iinfo(np.uint64).max))
        for _ in range(self.probes - 1):
            if not len(left_over):
                break
            at[left_over] += 1
            there = self.keys[at[left_over]]
            hit = there == keys[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (there != np.iinfo(np.uint64).max)]
        return out

    def __call__(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words that begin at ``starts`` of the bytes ``raw``, and how many each word has."""
        n = len(starts)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        size = np.diff(np.append(starts, len(raw)))
        word, ids = np.arange(n), self.inner[raw]
        last = starts + size - 1
        ids[last] = self.final[raw[last]]
        rank = np.full(len(ids), self.none, np.int32)
        rank[:-1] = self.rank(ids[:-1], ids[1:])
        rank[last] = self.none
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            best = np.minimum.reduceat(rank, starts)
            over = best == self.none
            if over.any():
                gone = np.repeat(over, size)
                done.append((word[over], size[over], ids[gone]))
                ids, rank, word, size, best = ids[~gone], rank[~gone], word[~over], size[~over], best[~over]
                starts = np.cumsum(size) - size
            if not len(word):
                break
            found = np.flatnonzero(rank == np.repeat(best, size))
            owner = np.searchsorted(starts, found, "right")
            fresh = np.ones(len(found), bool)
            fresh[1:] = owner[1:] != owner[:-1]
            at = found[fresh]  # one for each word, in order
            ids[at] = self.made[best]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, rank = ids[stays], rank[stays]
            each = np.arange(len(word))
            at, size, starts = at - each, size - 1, starts - each
            rank[at] = self.none
            more = at[at < starts + size - 1]
            rank[more] = self.rank(ids[more], ids[more + 1])
            before = at[at > starts] - 1
            rank[before] = self.rank(ids[before], ids[before + 1])
        words, sizes, flat = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(words)
        return flat[_ranges((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1, one range after the other."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Encoder:
    """Ids of whole texts, as arrays of 32-bit ids.

    A tokenizer whose stages are the known ones drops white space and never joins across it, so that the chunks between
    spaces and line breaks are encoded once for all texts of a call. It lower-cases, and so may the chunk, but for control
    tokens and sigmas. Plain chunks go through :class:`PairMerges`, the others to the library; of any other tokenizer
    the library encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(Path(path).read_text())
        model = stated["model"]
        specials = all(t["content"].startswith("<|") and not t.get("normalized") for t in stated.get("added_tokens") or ())
        known = stated.get("normalizer") == KNOWN_NORMALIZER and stated.get("pre_tokenizer") == KNOWN_SPLIT and specials and not stated.get("truncation")
        known = known and all(model.get(k) == v for k, v in KNOWN_MODEL.items())
        self.merges = PairMerges(model["vocab"], model["merges"]) if known else None

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, and how many each has."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        own, plain = chunks.filter(plain), plain.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(chunks), np.int64)
        others = chunks.filter(pa.array(~plain)).to_pylist()
        other_ids, sizes[~plain] = self._library(others)
        if not len(own):
            return other_ids, sizes
        own = pa.concat_arrays([own])  # from the buffers' beginning
        bounds = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1, 4 * own.offset)
        raw = np.frombuffer(own.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        begin = bounds[:-1] - bounds[0]
        mark = (raw < 128) & ((raw < 97) | (raw > 122))
        first = mark.copy()
        first[1:] &= ~mark[:-1]
        first[begin] = True
        words = np.flatnonzero(first)
        ids, each = self.merges(raw, words)
        sizes[plain] = np.add.reduceat(each, np.searchsorted(words, begin))
        out = np.empty(len(ids) + len(other_ids), np.int32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids, other_ids
        return out, sizes

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        low = [(t if "<|" in t or "Σ" in t or "İ" in t else t.lower()).replace("\n", " ") for t in texts]
        lists = pc.split_pattern(pa.array(low, pa.large_string()), " ")
        chunks = lists.flatten().dictionary_encode()
        ids, sizes = self._chunks(chunks.dictionary.cast(pa.string()))
        index = chunks.indices.to_numpy()
        flat = ids[_ranges((np.cumsum(sizes) - sizes)[index], sizes[index])]
        upto = np.concatenate(([0], np.cumsum(sizes[index])))
        ends = upto[lists.offsets.to_numpy()[1:]]
        return np.split(flat, ends[:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.merges is None:
            ids, sizes = self._library(texts)
            return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []
        out: list[np.ndarray] = []
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > TOGETHER:
                out += self._together(held)
                held, size = [], 0
            if len(t) > TOGETHER:  # cut at spaces, across which nothing is joined
                out.append(np.concatenate([self._together([part])[0] for part in _parts(t)]))
            else:
                held.append(t)
                size += len(t)
        return out + (self._together(held) if held else [])


def _parts(text: str) -> Iterator[str]:
    """A long text cut at spaces into parts of about TOGETHER characters; one without spaces stays whole."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + TOGETHER)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids and the closing id, cut only where longer."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__kindred_text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    closing = np.array([CLOSING_ID], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_TOGETHER):
                b = whole.slice(at, ROWS_TOGETHER)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, own in enumerate(encode(b.column(1).to_pylist())):
                    for k, s in enumerate(range(0, len(own) + 1, capacity)):
                        part = own[s : s + capacity]
                        part = np.concatenate((part, closing)) if len(part) < capacity else part
                        row.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4", copy=False)))
                        if with_ids:
                            ids.append(part)
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return source.mapInArrow(lean(run), schema)


class OpenBins:
    """Ranges of bins by remaining capacity, with a segment tree that says which capacities have any."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.ranges: list[deque] = [deque() for _ in range(capacity + 1)]

    def _mark(self, r: int, yes: bool) -> None:
        at = self.size + r
        while at and self.any[at] != yes:
            self.any[at] = yes
            at //= 2
            yes = self.any[2 * at] or self.any[2 * at + 1] if at else yes

    def put(self, r: int, first: int, count: int) -> None:
        if r and count:
            self.ranges[r].append((first, count))
            self._mark(r, True)

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity that holds ``length``."""
        at = self.size + length
        while not self.any[at]:
            while at & 1:
                at //= 2
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size

    def take(self, r: int, most: int) -> tuple[int, int]:
        first, count = self.ranges[r].popleft()
        if count > most:
            self.ranges[r].appendleft((first + most, count - most))
        elif not self.ranges[r]:
            self._mark(r, False)
        return first, min(count, most)


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces a bin, offset): a piece of the run with rank first rank + t lies in
    bin first bin + t // pieces a bin, at offset + length * (t % pieces a bin)."""
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            r = bins.tightest(length)
            room = capacity if r is None else r
            fit = min(room // length, left)
            want = left // fit
            first, got = (opened, want) if r is None else bins.take(r, want)
            opened += got if r is None else 0
            runs.append((length, rank, first, fit, capacity - room))
            bins.put(room - fit * length, first, got)
            rank += got * fit
            left -= got * fit
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``cut`` (from :func:`pieces`) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    runs = np.array(sorted(best_fit_decreasing(counts, capacity)), np.int64).reshape(-1, 5)
    # A few ranges for each pair of lengths at most: bounded by the capacity, not by the corpus.
    if runs.nbytes > 256 << 20:
        raise MemoryError("the packing plan is too large to be sent to the executors")
    plan = spark.sparkContext.broadcast(runs)
    placed = ranked(cut, ["length"], [id_col, "piece", "ids_crc32"], "__kindred_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = plan.value
        keys = own[:, 0] << 44 | own[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("__kindred_rank").to_numpy().astype(np.int64)
            at = own[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            t = rank - at[:, 1]
            out = b.drop_columns(["__kindred_rank"])
            out = out.append_column("sequence_id", pa.array(at[:, 2] + t // at[:, 3]))
            yield out.append_column("offset", pa.array(at[:, 4] + length * (t % at[:, 3])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return placed.mapInArrow(lean(run), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, **columns: str) -> DataFrame:
    """Every document tokenized, cut and packed; tokens are made once, and only the pieces' sizes are dealt out."""
    return pack(written(pieces(docs, capacity, tokenizer, **columns)), capacity, columns.get("id_col", "doc_id"))
