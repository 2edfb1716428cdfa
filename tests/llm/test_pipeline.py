import collections

import corpus_pipeline as c
from kindred.llm import secret_scan, toxicity
from kindred.llm.common import written


def test_stages_in_order():
    assert [n for n, _ in c.STAGES] == ["toxicity", "ngram_jaccard", "secrets", "mixing", "packing"] and c.ORACLE_SQL is None


def test_each_stage_against_its_input(spark, small):
    from tests.llm.test_jaccard_join import plain
    from tests.llm.test_packing import check

    docs = spark.read.parquet(f"{small}/documents.parquet")
    civil = written(c.keep_civil(spark, docs, small))
    machine = toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = [r.doc_id for r in docs.collect() if machine.scores(toxicity.terms([(r.text or "").encode()]))[0] < 0.5]
    assert sorted(r.doc_id for r in civil.collect()) == sorted(want) and civil.columns == docs.columns
    single = written(c.keep_one_of_each(spark, civil, small))
    rows = [(r.doc_id, r.text) for r in civil.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({d for _, n, d in plain(rows, 5, 80, 100)})
    masked = written(c.mask_secrets(spark, single, small))
    before = {r.doc_id: r for r in single.collect()}
    for r in masked.collect():
        assert r.text == secret_scan.mask(before[r.doc_id].text) and r.n_chars == len(r.text)
    mixed = written(c.mix_sources(spark, masked, small))
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2 and set(copies) <= set(before) and mixed.columns == docs.columns
    packed = c.pack_sequences(spark, mixed, small).collect()
    check(packed, {r.doc_id: r.text for r in masked.collect()})
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_extra_columns_and_empty_tables(spark, small, docs):
    df = docs((1, "plain words of a text"), (2, None), (3, ""))
    null_ids = docs((None, "plain words of a text"), (None, "plain words of a text"), (None, None))
    assert [len(stage(spark, null_ids, small).collect()) for _, stage in c.STAGES[:3]] == [3, 3, 3]
    for _, stage in c.STAGES[:-1]:
        assert stage(spark, df, small).columns == df.columns
        assert stage(spark, df.limit(0), small).collect() == []
    assert c.pack_sequences(spark, df.limit(0), small).collect() == []


def test_run(spark, small):
    assert c.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
