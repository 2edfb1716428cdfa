"""Secret scans: one Aho-Corasick pass finds keywords, anchored expressions run at its hits alone, and
formats that carry a checksum count only where the checksum holds.

Kinds ``assign``, ``access`` and ``hex`` have no checksum. ``github``, ``npm`` (CRC-32 in base 62) and
``xprv`` (base 58 with a double SHA-256) do. A run of hex digits has no keyword; all of the four-digit
groups are patterns of the same automaton, since any long run starts with one.

A null text counts as empty; an empty text has no spans; texts of any length are scanned whole; each row
is scanned on its own, so that repeated rows and ids give repeated results; an empty table gives an empty
table; columns other than the id and the text are not read by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# The kinds in order, the public formats and their alphabets.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "xprv")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
HEX_GROUP = 4

SPANS = "array<struct<kind:string,start:int,end:int>>"


def crc_base62(body: str) -> str:
    """The six base-62 digits of a body's CRC-32."""
    n, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits))


def base58_checked(key: str) -> bool:
    """Whether the last four of the decoded bytes are the double SHA-256 of the others."""
    n = 0
    for c in key:
        n = n * 58 + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for digits in itertools.product("0123456789abcdef", repeat=HEX_GROUP):
        a.add_word("".join(digits), ("hex", HEX_GROUP))
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")), ("npm", ("npm_",)), ("xprv", ("xprv",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in code points, in order; each kind's matches do not overlap."""
    if not text:
        return []
    # The one letter whose lower case is longer becomes another, so that places stay the same.
    low = text.replace("İ", "ı").lower()
    past = dict.fromkeys(KINDS, 0)
    found = []
    for last, (kind, length) in _automaton().iter(low):
        at = last - length + 1
        if at < past[kind]:
            continue
        if kind == "hex":
            m = HEX.match(text, at)
            good = m and m.end() - at >= HEX_LEAST
        elif kind == "assign":
            m = ASSIGN.match(text, at)
            good = m and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, at)
            good = m and m.end() - at >= ACCESS_LEAST
        elif at and text[at - 1].isalnum():
            continue
        elif kind == "xprv":
            m = XPRV.match(text, at)
            good = m and base58_checked(m[0])
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, at)
            good = m and crc_base62(m[1]) == m[2]
        if m and (good or kind in BASE_KINDS):
            past[kind] = m.end()
        if good:
            found.append((at, KINDS.index(kind), m.end()))
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: its id and ``spans``, ordered by start and then by kind."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).alias("__kindred_text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, spans {SPANS}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], [id_col, "spans"])

    return source.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans make one mark. Other columns stay."""

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, mark), na_action="ignore")

    return docs.withColumn(text_col, masked(F.col(text_col)))


def mask(text: str, mark: str = "[secret]") -> str:
    parts, at = [], 0
    for start, _, end in find_spans(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scanned.select(id_col, *map(of, BASE_KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
