import collections
import random
import struct
import zlib

from kindred.llm import packing as p
from kindred.llm import queries


def plain(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: (bins[b], b))] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


def test_best_fit_decreasing_against_plain():
    random.seed(4)
    for _ in range(200):
        capacity = random.choice([10, 37, 64])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 60))]
        counts = collections.Counter(lengths)
        runs, fill = sorted(p.best_fit_decreasing(counts, capacity)), collections.defaultdict(list)
        for i, (n, first, b, per, offset) in enumerate(runs):
            end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == n else counts[n]
            for t in range(end - first):
                fill[b + t // per].append((offset + n * (t % per), n))
        for pieces in fill.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in x) for x in fill.values()) == plain(lengths, capacity)


def test_encoder_against_the_tokenizer():
    random.seed(5)
    e = p.encoder(p.default_tokenizer())
    parts = [*"aB éÉ.,!ΣσİıſK\n\t ́'sd<|9٣", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'RE", "ß", "ŉ", "œ", "÷", "Word", "naïve,"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    for t, ids in zip(texts, e(texts)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert e([]) == []


def test_merges_of_many_words():
    random.seed(6)
    e = p.encoder(p.default_tokenizer())
    letters = "aaabbeeeiilmnoorssstt" + "ßéü"
    words = ["".join(random.choice(letters) for _ in range(random.randint(1, 40))) + random.choice(["", "", "...", "!?"]) for _ in range(4000)]
    for t, ids in zip(words, e(words)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(p, "TOGETHER", 50)
    random.seed(7)
    e = p.encoder(p.default_tokenizer())
    texts = [" ".join(random.choice(["ab", "Word.", "x" * 60, "", "it's"]) for _ in range(random.randint(0, 80))) for _ in range(30)]
    for t, ids in zip(texts, e(texts)):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_are_left_to_the_library(docs):
    from pathlib import Path

    path = str(Path(p.default_tokenizer()).with_name("byte_bpe_50k.json"))
    e = p.encoder(path)
    texts = {1: "Hello World, it's", 2: "a  b\n\nC", 3: ""}
    assert e.merges is None
    found = {r.doc_id: list(r.ids) for r in p.pieces(docs(*texts.items()), tokenizer=path, with_ids=True).collect()}
    assert found == {k: [*e.tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in texts.items()}


def check(rows, texts):
    tok = p.encoder(p.default_tokenizer()).tokenizer
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for filled in sequences.values():
        at = 0
        for offset, n in sorted(filled):
            assert offset == at
            at += n
        assert at <= 2048
    for doc, own in pieces.items():
        ids = tok.encode(texts[doc], add_special_tokens=False).ids + [0]
        for r in own:
            cut = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(cut) == r.length == min(2048, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
    return len(sequences)


def test_rows_of_any_kind(docs):
    texts = {1: "", 2: "", 3: "hello world", 4: "x " * 5000, 5: "a b"}
    assert p.pack_documents(docs((None, "a b"), (None, "a b"))).count() == 2
    df = docs((1, None), (2, ""), (3, texts[3]), (3, texts[3]), (4, texts[4]), (5, texts[5]))
    rows = p.pack_documents(df).collect()
    assert collections.Counter(r.doc_id for r in rows) == {1: 1, 2: 1, 3: 2, 4: 3, 5: 1}
    assert check(rows, texts) == 3
    assert p.pack_documents(df.limit(0)).collect() == []
    assert p.pieces(df, with_ids=True).filter("doc_id = 3").first().ids[-1] == 0


def test_query(spark, small):
    rows = queries.op6_best_fit_packing(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    n = check(rows, texts)
    assert {r.doc_id for r in rows} == set(texts) and n <= 1.02 * sum(r.length for r in rows) / 2048 + 1
