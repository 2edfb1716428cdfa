from kindred.operators import validation as v

HEAD = "source1_entity_id\tmatched_entity_ids\n"


def check(spark, tmp_path, body, required=("S1-1", "S1-2"), known=None, head=HEAD):
    f = tmp_path / "m.tsv"
    f.write_text(head + body)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "entity_id string")
    return v.validate(spark, str(f), None, ids(required), ids(known) if known else None)


def test_valid_file(spark, tmp_path):
    got = check(spark, tmp_path, "S1-1\tS2-1,S3-1\nS1-2\t\n\n", known=("S2-1", "S3-1"))
    assert not got.errors and got.exit_code == 0


def test_every_rule(spark, tmp_path):
    body = "S1-1\tS2-1,S2-1\nS1-1\tS1-5\nS1-3\t S2-1\nS1-4\tS2-1,,S3-1\nplain\n"
    got = " | ".join(check(spark, tmp_path, body, known=("S2-1",)).errors)
    for rule in ("duplicate_entity: 1", "repeated_id: 1", "self_match: 1", "wrong_prefix: 2", "malformed_row: 1 (6)", "missing_entity: 1 (S1-2)", "extra_entity: 2", "unknown_id: 1 (S3-1)"):
        assert rule in got, rule


def test_headers(spark, tmp_path):
    assert "commas" in check(spark, tmp_path, "", head="source1_entity_id,matched_entity_ids\n").errors[0]
    assert "must be" in check(spark, tmp_path, "", head="a\tb\n").errors[0]
    assert "empty" in check(spark, tmp_path, "", head="").errors[0]
    assert v.header_error(" Source1_entity_id\tMATCHED_entity_ids ", v.MATCHING) is None


def test_missing_file_and_candidates(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "entity_id string")
    assert v.validate(spark, str(tmp_path / "none.tsv"), None, ids).exit_code == 1
    m, c = tmp_path / "m.tsv", tmp_path / "c.tsv"
    m.write_text(HEAD + "S1-1\tS2-1,S2-2\n")
    c.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    got = v.validate(spark, str(m), str(c), ids)
    assert not got.errors and any("1 matches" in w for w in got.warnings)


def test_what_is_not_utf8_and_what_is_not_there(spark, tmp_path):
    ids = spark.createDataFrame([("S1-1",)], "entity_id string")
    m = tmp_path / "m.tsv"
    m.write_bytes(HEAD.encode() + "S1-1\tS2-é\n".encode("latin-1"))
    assert any("line 2 is not UTF-8" in e for e in v.validate(spark, str(m), None, ids).errors)
    m.write_text(HEAD + "S1-1\tS2-\ufffd\n", encoding="utf-8")
    got = v.validate(spark, str(m), str(tmp_path / "none.tsv"), ids)
    assert not got.errors and any("none.tsv" in w for w in got.warnings)


def test_command_line(spark, tmp_path, capsys):
    m = tmp_path / "m.tsv"
    m.write_text(HEAD + "S1-1\tS2-9\n")
    run = lambda *more: (v.main(["-m", str(m), "-c", str(tmp_path / "c.tsv"), "-t", str(tmp_path), *more], spark), capsys.readouterr().out)
    code, said = run()
    assert code == 1 and "test_source1.tsv" in said
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    (tmp_path / "test_source1.tsv").write_text(head + "S1-1\ta\tb\tX\n")
    (tmp_path / "test_source2.tsv").write_text(head + "S2-1\ta\tb\tX\n")
    code, said = run("--check-ids")
    assert code == 0 and "test_source3.tsv" in said and "not checked for existence" in said
    (tmp_path / "test_source3.tsv").write_text(head + "S3-1\ta\tb\tX\n")
    code, said = run("--check-ids")
    assert code == 1 and "unknown_id: 1 (S2-9)" in said
