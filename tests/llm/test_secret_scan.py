import base64
import hashlib
import random

from kindred.llm import queries
from kindred.llm import secret_scan as s


def plain(text):
    found = []
    for k, (pattern, good) in enumerate(((s.ASSIGN, lambda m: len(m[2]) >= 6), (s.ACCESS, lambda m: len(m[0]) >= 20), (s.HEX, lambda m: len(m[0]) >= 24))):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(m)]
    return sorted(found)


def test_base_spans_against_plain():
    random.seed(1)
    parts = ["token", "AKIA", 'Token = "', "api_key:", "secret=", "passwd", "0a1b2c3d4e5f" * 3, "İ", "ſecret:", "K", " ", "=", "ABCDEF123456789012", "é"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert s.find_spans(text) == plain(text), text


def test_checksummed_formats():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{s.crc_base62(body)}"
    assert [s.KINDS[k] for _, k, _ in s.find_spans(f"x {good} y npm_{good[4:]}")] == ["github", "npm"]
    assert not s.find_spans(f"x {good[:-1]}{'a' if good[-1] != 'a' else 'b'} y") and not s.find_spans("x" + good) and not s.find_spans(good + "z")
    raw = b"\x04\x88\xad\xe4" + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = s.BASE58[d] + key
    assert [s.KINDS[k] for _, k, _ in s.find_spans(f"({key})")] == ["xprv"]
    assert not s.find_spans(key[:-1] + ("1" if key[-1] != "1" else "2"))


def test_rows_of_any_kind(docs):
    long = "a " * 300_000 + "token=abcdef1"
    rows = s.digest(s.scan(docs((1, None), (2, ""), (3, "token=abcdef1"), (3, "token=abcdef1"), (None, "x"), (4, long)))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_assign) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert {r.base_sha256 for r in rows if not r.n_assign} == {empty}
    assert next(r for r in rows if r.doc_id == 4).spans == f"assign:600000:{len(long)}"
    assert s.digest(s.scan(docs((1, "")).limit(0))).collect() == []


def test_redact_keeps_everything_else(docs):
    df = docs((1, "a token=abcdef1 b"), (2, None), (3, "clean"))
    rows = {r.doc_id: r for r in s.redact(df).collect()}
    assert rows[1].text == "a [secret] b" and rows[2].text is None and rows[3].text == "clean" and s.redact(df).columns == df.columns


def test_query(spark, small):
    rows = queries.op1_secret_scan(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in plain(texts[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert base64.b16decode(r.base_sha256.upper())
