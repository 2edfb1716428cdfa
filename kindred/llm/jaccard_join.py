"""N-gram Jaccard join with token-combination prefixes. Documents are sets of word n-grams; equal sets are one class.

A set of n tokens and its partner differ in at most E = n (1 - t) / t tokens, and at most A = n (1 - t) of the set's are
missing in the partner. Of the set's first A + (k - 1) E + k tokens in an order that all sets share, A may be missing,
and each difference breaks at most k - 1 of the runs of k neighbours that are left: partners share one of these runs.

1. Each class names combinations of k neighbours in hash order; a class that shares none has no partner. The others'
   whole sets are kept.
2. Among these tokens are counted. Tokens are ordered by count: those of one class alone, then rare, then frequent ones.
3. Of each class the prefix is indexed: A + 1 tokens if so many are rare, singly. Where too few are, r of them, the
   prefix is extended with A + E - 2 r + 2 frequent ones, indexed as combinations of two neighbours: if all of the
   rare ones are missing, so few differences are left that the above holds for these.
4. Classes that share an indexed key are verified exactly, each pair once. Pairs of small groups meet as rows. A large
   group is dealt out in blocks, each pair of blocks compared by products of incidence matrices, without the pairs that
   share a smaller key of a large group; a spanning forest of the links and each class's number of them leave the task.
5. Components of the links come by alternating large and small stars; links are summed up by class.

A token is a 64-bit hash of an n-gram, a class a 64-bit hash of its set. Null and empty texts have no tokens and are
linked with nothing; a text with fewer words than n is one token, all of its words; long texts are read whole; repeated
rows are one class; rows that share an id are documents of their own with the same name; a null id is linked with
nothing and its component is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, Buckets, Written, bounded_batches, lean, mix, only_likely, release, trim, window_hashes, word_hashes, written

#: Tokens of more classes than this are frequent; at most so many are, those of most classes.
RARE, FREQUENT = 64, 1 << 18
#: Groups of more classes than this are compared by blocks of so many classes and tokens at most.
SMALL, BLOCK_CLASSES, BLOCK_TOKENS = 32, 4096, 4_000_000
#: Text bytes for each part of the classes.
PART_BYTES = 32 << 20
#: Sets of so many tokens or more name combinations of three where partners are alike enough, smaller ones of two.
THREES = 32


def token_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams."""
    out = []
    for words in word_hashes(texts, lower=True):
        width = min(n, len(words))
        out.append(np.unique(mix(window_hashes(words, width) + np.uint64(width))) if width else np.empty(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def lacking(n, num: int, den: int):
    """How many of its n tokens a partner may lack, at most."""
    return n * (den - num) // den


def differing(n, num: int, den: int):
    """How many tokens a set of n and its partner differ in, at most."""
    return n * (den - num) // num


def combined(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` neighbours."""
    out = tokens
    for i in range(1, k):
        out = mix(out[:-1] * np.uint64(2 * i + 1) + mix(tokens[i:]))
    return out


def first_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Combinations that a set, in hash order, and any partner share. Where sets of three neighbours are used, those that
    may have a smaller partner without them name pairs too."""
    n = len(tokens)
    lack, differ = lacking(n, num, den), differing(n, num, den)
    threes = 100 * num >= 85 * den
    found = []
    if not threes or n * num < THREES * den:
        found.append(combined(tokens[: lack + differ + 2], 2))
    if threes and n >= THREES:
        found.append(combined(tokens[: lack + 2 * differ + 3], 3) + np.uint64(1))
    return np.unique(np.concatenate(found))


def keys_of(n: int, lone: int, rare: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index keys of a class: ``lone`` tokens are no other's, ``rare`` and ``frequent`` are in order."""
    lack = lacking(n, num, den)
    if lone > lack:
        return np.empty(0, np.uint64)
    if lone + len(rare) > lack:
        return rare[: lack + 1 - lone]
    more = frequent[: lack + differing(n, num, den) - 2 * (lone + len(rare)) + 2]
    return np.concatenate([rare, combined(more, 2)])


def _raw(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _unpack(raw, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), kind)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and each value's run."""
    first = np.ones(len(sorted_values), bool)
    first[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


def _dealt(pairs: Iterator[tuple[int, np.ndarray]], most: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(class, tokens) as (tokens, classes), in the tokens' order and distinct, of about ``most`` rows at a time."""
    held: dict[int, np.ndarray] = {}
    size = 0

    def flat():
        classes = np.repeat(np.array(list(held), np.int64), [len(t) for t in held.values()])
        tokens = np.concatenate(list(held.values()))
        order = np.argsort(tokens)
        return tokens[order], classes[order]

    for c, t in pairs:
        if len(t) and c not in held:
            held[c] = t
            size += len(t)
        if size >= most:
            yield flat()
            held, size = {}, 0
    if held:
        yield flat()


def _parted(classes: np.ndarray, columns: list[np.ndarray], parts: int) -> tuple[list[int], list[list[bytes]]]:
    """Rows packed by parts of the classes, so that what a group answers is a row for each part and not for each class."""
    part = np.mod(classes, parts)
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    cut = np.append(first, len(order)).tolist()
    return ids.tolist(), [[c[a:b].tobytes() for a, b in zip(cut, cut[1:])] for c in (c[order] for c in [classes, *columns])]


def _pairs_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    for c, raw in zip(batch.column(0).to_pylist(), batch.column(column)):
        yield c, _unpack(raw)


#: Of an entry in the search for partners: its task has the token in several classes; the class is known to have a partner.
SEVERAL, KNOWN = 1, 2


def partnered(firsts: DataFrame, size: int, parts: int) -> DataFrame:
    """The classes of ``firsts`` (class, packed keys) that share a key with another class. A task settles its own and
    sends one class for each key, so that a key of most classes is met once for each task."""
    buckets = Buckets(size, {"hashes": "u8", "classes": "i8", "marks": "u1"})

    def deal(batches):
        for tokens, classes in _dealt((x for b in batches for x in _pairs_of(b)), buckets.held):
            start, run = _runs(tokens)
            several = np.bincount(run) > 1
            known = np.unique(classes[several[run]])
            marks = np.concatenate([several.astype(np.uint8) * np.uint8(SEVERAL), np.full(len(known), KNOWN, np.uint8)])
            yield buckets.pack(hashes=np.concatenate([tokens[start], mix(known.view(np.uint64))]), classes=np.concatenate([classes[start], known]), marks=marks)

    def answer(hashes, classes, marks) -> pa.Table:
        found = [classes[marks == KNOWN]]
        tokens, classes, marks = (x[marks != KNOWN] for x in (hashes, classes, marks))
        if len(tokens):
            order = np.argsort(tokens)
            tokens, classes = tokens[order], classes[order]
            start, run = _runs(tokens)
            shared = (np.minimum.reduceat(classes, start) != np.maximum.reduceat(classes, start)) | (np.bincount(run, marks[order]) > 0)
            found.append(classes[shared[run]])
        (ids, (packed,)) = _parted(np.unique(np.concatenate(found)), [], parts)
        return pa.table([pa.array(ids, pa.int32()), pa.array(packed, pa.binary())], ["part", "classes"])

    def together(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(np.unique(np.concatenate([_unpack(x, np.int64) for x in table.column("classes")])), pa.int64())], ["class"])

    rows = firsts.mapInArrow(lean(deal), buckets.schema)
    return buckets.answered(rows, answer, "part int, classes binary").groupBy("part").applyInArrow(together, "class long")


def frequent_tokens(sets: DataFrame, size: int) -> dict[int, int]:
    """The tokens of most classes with their numbers of classes: more than RARE, and at most FREQUENT of them."""
    buckets = Buckets(size, {"hashes": "u8", "counts": "u4"})

    def deal(batches):
        for tokens, _ in _dealt((x for b in batches for x in _pairs_of(b)), buckets.held):
            start, run = _runs(tokens)
            yield buckets.pack(hashes=tokens[start], counts=np.bincount(run))

    def total(hashes, counts) -> pa.Table:
        names, index = np.unique(hashes, return_inverse=True)
        df = np.bincount(index, counts).astype(np.int64)
        own = np.flatnonzero(df > RARE)
        own = own[np.lexsort((names[own], -df[own]))][:FREQUENT]
        return pa.table([pa.array(names[own].view(np.int64)), pa.array(df[own])], ["token", "df"])

    rows = buckets.answered(sets.select("class", "tokens").mapInArrow(lean(deal), buckets.schema), total, "token long, df long")
    return {r.token & 0xFFFFFFFFFFFFFFFF: r.df for r in rows.orderBy(F.desc("df"), "token").limit(FREQUENT).collect()}


def indexed(sets: DataFrame, num: int, den: int, size: int, parts: int) -> DataFrame:
    """(class, n, rows, core, keys): of each class of ``sets`` (class, n, tokens, rows) that may have a partner the tokens that others
    have too, packed, and its index keys."""
    often = frequent_tokens(sets, size)
    buckets = Buckets(size, {"hashes": "u8", "classes": "i8"})
    table = np.array(sorted((t, df) for t, df in often.items()), np.uint64).reshape(-1, 2)
    names = sets.sparkSession.sparkContext.broadcast(table)  # at most FREQUENT rows

    def is_frequent(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = names.value
        if not len(known):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(known[:, 0], tokens), len(known) - 1)
        return known[at, 0] == tokens, at

    def deal(batches):
        for tokens, classes in _dealt(((c, t[~is_frequent(t)[0]]) for b in batches for c, t in _pairs_of(b)), buckets.held):
            yield buckets.pack(hashes=tokens, classes=classes)

    def answer(hashes, classes) -> pa.Table:
        order = np.argsort(hashes)
        tokens, classes = hashes[order], classes[order]
        start, run = _runs(tokens)
        df = np.bincount(run).astype(np.uint32)[run]
        own = np.flatnonzero(df > 1)
        ids, packed = _parted(classes[own], [tokens[own], df[own]], parts)
        return pa.table([pa.array(ids, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["part", "classes", "tokens", "df"])

    def key(group: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (("classes", np.int64), ("tokens", np.uint64), ("df", np.uint32))
        owners, shared, counts = (np.concatenate([np.empty(0, k), *(_unpack(x, k) for x in answers.column(n))]) for n, k in kinds)
        order = np.lexsort((shared, counts, owners))
        owners, shared = owners[order], shared[order]
        classes, ns, rows, cores, keys = [], [], [], [], []
        for c, n, rows_of, raw in zip(*(group.column(x).to_pylist() for x in ("class", "n", "rows")), group.column("tokens")):
            tokens = _unpack(raw)
            rare = shared[np.searchsorted(owners, c, "left") : np.searchsorted(owners, c, "right")]
            hit, where = is_frequent(tokens)
            common = tokens[hit]
            common = common[np.lexsort((common, names.value[where[hit], 1]))] if len(common) else common
            own = keys_of(n, n - len(rare) - len(common), rare, common, num, den)
            if len(own):
                classes.append(c)
                ns.append(n)
                rows.append(rows_of)
                cores.append(np.sort(np.concatenate([rare, common])).tobytes())
                keys.append(own.view(np.int64))
        trim()
        return pa.table([pa.array(classes, pa.int64()), pa.array(ns, pa.int64()), pa.array(rows, pa.int64()), pa.array(cores, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["class", "n", "rows", "core", "keys"])

    rows = sets.select("class", "tokens").mapInArrow(lean(deal), buckets.schema)
    found = buckets.answered(rows, answer, "part int, classes binary, tokens binary, df binary")
    parts_ = sets.withColumn("part", F.pmod("class", F.lit(parts)).cast("int"))
    return parts_.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(key, "class long, n long, rows long, core binary, keys array<long>")


def verified(pairs: DataFrame, cores: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link and share no key of a large group, with both classes' numbers of rows."""
    of = lambda c: cores.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "rows", "core", "large")))
    both_sides = pairs.join(of("b"), "b").join(of("a"), "a")
    rows = both_sides.select("a", "b", "rows_a", "rows_b", "n_a", "n_b", "core_a", "core_b", "large_a", "large_b")

    def run(batches):
        for b in batches:
            n = b.column(4).to_numpy() + b.column(5).to_numpy()
            both = np.array([len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True)) for x, y in zip(b.column(6), b.column(7))], np.int64)
            links = den * both >= num * (n - both)
            for i in np.flatnonzero(links):
                x, y = (b.column(c)[int(i)].values.to_numpy() for c in (8, 9))
                links[i] = not (len(x) and len(y) and len(np.intersect1d(x, y)))
            yield b.select(["a", "b", "rows_a", "rows_b"]).filter(pa.array(links))

    return rows.mapInArrow(lean(run), "a long, b long, rows_a long, rows_b long")


def _forest(links: Iterator[tuple[int, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Of the links, a class with its partners at a time, those that connect what was not yet connected."""
    part, out = np.arange(n), []
    for a, partners in links:
        parts, first = np.unique(part[partners], return_index=True)
        fresh = parts != part[a]
        if fresh.any():
            out += [(a, int(b)) for b in partners[first[fresh]]]
            part[np.isin(part, parts[fresh])] = part[a]
    return out


def _products(sets: list[np.ndarray], b: np.ndarray):
    """A function that gives the sizes of intersections of the sets ``top`` with those of ``b``: products of incidence
    matrices, some tokens at a time."""
    names, index = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(c) for c in sets])
    order = np.argsort(index, kind="stable")
    index, row = index[order], row[order]
    place, other = np.full(len(sets), -1), np.full(len(sets), -1)
    other[b] = np.arange(len(b))

    def of(top: np.ndarray) -> np.ndarray:
        place[:] = -1
        place[top] = np.arange(len(top))
        both = np.zeros((len(top), len(b)), np.float32)
        for first in range(0, len(names), 1024):
            lo, hi = np.searchsorted(index, (first, first + 1024))
            x, y = np.zeros((len(top), 1024), np.float32), np.zeros((len(b), 1024), np.float32)
            r, t = row[lo:hi], index[lo:hi] - first
            x[place[r[place[r] >= 0]], t[place[r] >= 0]] = 1
            y[other[r[other[r] >= 0]], t[other[r] >= 0]] = 1
            both += x @ y.T
        return both

    return of


def block_links(classes: np.ndarray, sizes: np.ndarray, cores: list[np.ndarray], left: np.ndarray, num: int, den: int, earlier: list[np.ndarray] | None = None, rows: np.ndarray | None = None, found: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between classes of which one is ``left`` and the other is not, or of all if none or
    all are. Pairs that share one of their ``earlier`` keys are left out. To ``found`` are added the ``rows`` of all
    classes that each class is linked with. Some classes are compared with all others at a time."""
    within = not 0 < left.sum() < len(left)
    a, b = (np.arange(len(left)),) * 2 if within else (np.flatnonzero(left), np.flatnonzero(~left))
    shared, met = _products(cores, b), _products(earlier, b) if earlier is not None else None

    def links():
        for at in range(0, len(a), 512):
            top = a[at : at + 512]
            fresh = met(top) == 0 if met else np.ones((len(top), len(b)), bool)
            if within:
                fresh[np.arange(len(top)), top] = False
            some = fresh.any(axis=1)
            top, fresh = top[some], fresh[some]
            if not len(top):
                continue
            both = shared(top).astype(np.float64)
            link = fresh & (den * both >= num * (sizes[top][:, None] + sizes[b][None, :] - both))
            if found is not None:
                found[top] += link @ rows[b]
                if not within:
                    found[b] += rows[top] @ link
            for i in np.flatnonzero(link.any(axis=1)):
                yield int(top[i]), b[link[i]]

    return [(int(classes[i]), int(classes[j])) for i, j in _forest(links(), len(cores))]


def large_group_links(groups: DataFrame, cores: DataFrame, num: int, den: int) -> DataFrame:
    """Of groups (key, class, blocks): links (a, b) that connect what is linked, and rows (a, null, others) that sum up to the
    rows of the classes that a is linked with. Each class goes to one row for every other block of its group; a pair
    counts in the group of the smallest key that it shares."""
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    dealt = groups.withColumn("own", block).withColumn("other", other)
    dealt = dealt.select("key", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        classes, rows, left = table.column("class").to_numpy(), table.column("rows").to_numpy(), np.array(table.column("left").to_pylist(), bool)
        edges, found = [], np.zeros(len(classes), np.int64)
        if key[1].as_py() == key[2].as_py() or 0 < left.sum() < len(left):  # else one of the blocks is empty
            earlier = [x.values.to_numpy().astype(np.int64) for x in table.column("earlier")]
            edges = block_links(classes, table.column("n").to_numpy(), [_unpack(x) for x in table.column("core")], left, num, den, earlier, rows, found)
        trim()
        some = np.flatnonzero(found)
        a = np.concatenate([np.array([x for x, _ in edges], np.int64), classes[some]])
        b = [x for _, x in edges] + [None] * len(some)
        others = np.concatenate([np.zeros(len(edges), np.int64), found[some]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(others, pa.int64())], ["a", "b", "others"])

    rows = dealt.join(cores.select("class", "n", "rows", "core", "large"), "class")
    rows = rows.withColumn("earlier", F.filter("large", lambda k: k < F.col("key"))).drop("large")
    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long, others long")


def components(links: DataFrame) -> DataFrame:
    """(class, root): the smallest class that the links (a, b) reach, for every class in a link. Alternating large and
    small stars; every round is written, so that nothing is made anew if an executor goes."""
    edges = Written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        next_ = Written(small)
        same = edges.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == next_.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges.drop()
        edges = next_
        if same:
            break
    return edges.df.select(F.col("u").alias("class"), F.col("v").alias("root")).unionByName(edges.df.select(F.col("v").alias("class"), F.col("v").alias("root")).distinct())


def class_links(sets: DataFrame, num: int, den: int, size: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Of the links between classes of ``sets`` (class, n, tokens, rows): some (a, b) that connect all that any connect, and
    (class, others), the rows of all classes that a class is linked with."""
    indexed_ = Written(indexed(sets, num, den, size, parts))
    release(sets.sparkSession)
    keyed = indexed_.df.select(F.explode("keys").alias("key"), "class", "n")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("tokens")).filter("classes > 1")
    members = Written(keyed.join(groups, "key").select("key", "class", "n", "classes", "tokens"))
    large = members.df.filter(F.col("classes") > SMALL)
    keys = large.groupBy("class").agg(F.collect_list("key").alias("large"))
    met = members.df.select("class").distinct()
    none = F.array().cast("array<long>")
    cores = Written(indexed_.df.drop("keys").join(met, "class").join(keys, "class", "left").withColumn("large", F.coalesce("large", none))).df
    indexed_.drop()
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    by_block = Written(large_group_links(large.select("key", "class", blocks.alias("blocks")), cores, num, den)).df
    fits = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    small = members.df.filter(F.col("classes") <= SMALL)
    left = small.select("key", F.col("class").alias("a"), F.col("n").alias("n_a"))
    right = small.select("key", F.col("class").alias("b"), F.col("n").alias("n_b"))
    # At most SMALL - 1 partners a row; larger groups went by blocks.
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    by_row = Written(verified(pairs, cores, num, den)).df
    each = F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("rows_b").alias("others")), F.struct(F.col("b").alias("class"), F.col("rows_a").alias("others")))).alias("e")
    counted = by_row.select(each).select("e.class", "e.others").unionByName(by_block.filter("b is null").select(F.col("a").alias("class"), "others"))
    links = by_row.select("a", "b").unionByName(by_block.filter("b is not null").select("a", "b"))
    return links, counted.groupBy("class").agg(F.sum("others").alias("others"))


def linked(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, tag, root): sets of n-grams that link when den * intersection >= num *
    union. n_links counts all other rows that a row is linked with, rows of an equal set among them; tag is a hash of the
    text and root a class of the component (rows that share an id may lie in two)."""
    if 10 * num < 7 * den or num > den:
        raise ValueError("the prefixes hold for similarities from 0.7 to 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(12, size // PART_BYTES)

    def describe(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = token_sets([_raw(t) for t in b.column(2)], n)
                firsts = [first_keys(s, num, den).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(firsts, pa.binary())], ["doc_id", "tag", "class", "n", "firsts"])

    with_keys = Written(source.mapInArrow(lean(describe), "doc_id long, tag long, class long, n long, firsts binary"))
    described = Written(with_keys.df.drop("firsts")).df
    named = "n > 0 and doc_id is not null"
    classes = described.filter(named).groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    wanted = Written(classes.join(partnered(with_keys.df.filter(named).select("class", "firsts"), size, parts), "class").select("class", "rep", "rows"))
    with_keys.drop()
    release(spark)

    def whole_sets(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                sets = token_sets([_raw(t) for t in b.column(1)], n)
                own = [i for i, (s, c) in enumerate(zip(sets, b.column(0).to_pylist())) if class_of(s) == c]  # rows may share an id
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.array([len(sets[i]) for i in own], pa.int64()), pa.array([sets[i].tobytes() for i in own], pa.binary()), b.column(2).take(pa.array(own, pa.int64()))], ["class", "n", "tokens", "rows"])

    named_texts = only_likely(source, "doc_id", wanted.df.select("rep"))
    texts = named_texts.join(wanted.df.withColumnRenamed("rep", "doc_id"), "doc_id").select("class", "text", "rows")
    sets = Written(texts.mapInArrow(lean(whole_sets), "class long, n long, tokens binary, rows long"))
    release(spark)
    links, counts = class_links(sets.df, num, den, size, parts)
    joined = classes.join(components(links), "class", "left").join(counts, "class", "left")
    n_links = F.col("rows") - 1 + F.coalesce("others", F.lit(0))
    homes = written(joined.select("class", "rep", F.coalesce("root", "class").alias("root"), n_links.alias("n_links")))
    smallest = homes.groupBy("root").agg(F.min("rep").alias("component_id"))
    home = homes.join(smallest, "root").select("class", "root", "component_id", "n_links")
    out = described.select("doc_id", "tag", "class", F.col("n").alias("n_shingles")).join(home, "class", "left")
    named_row = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(named_row, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(named_row, F.col("n_links")).otherwise(0).alias("n_links"), "tag", F.when(named_row, F.col("root")).alias("root"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id and then the smallest tag. Rows without words and
    those with a null id are in no component and stay."""
    tag = "__kindred_tag"
    rows = written(linked(docs, n, num, den, id_col, text_col).filter("root is not null").select("doc_id", "tag", "component_id", "root"))
    firsts = rows.filter("doc_id = component_id").groupBy("root").agg(F.min("tag").alias("first"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("tag") == F.col("first"))
    judged = written(rows.join(firsts, "root").groupBy("doc_id", "tag").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("rows")))
    left = docs.withColumn(tag, F.xxhash64(text_col))

    def among(names: DataFrame, how: str) -> DataFrame:
        return left.join(names, (left[id_col] == names["doc_id"]) & (left[tag] == names["tag"]), how)

    # Most rows stay, and those that go are named; of repeated rows one stays.
    kept = among(judged.filter("not stays or rows > 1"), "left_anti")
    repeated = judged.filter("stays and rows > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(among(repeated, "left_semi").dropDuplicates([id_col, tag]))
    return kept.drop(tag)
