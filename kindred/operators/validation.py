"""The validator of results files: raw tab-separated lines, checked as they stand.

Lines are not unquoted and ids in lists are not trimmed; the header is line 1; blank rows are ignored; of rows that repeat an
entity the last one counts. ``python -m kindred.operators.validation --help`` tells the command line."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import session
from ..sources.records import read_tsv

# The headers of the two files and the names of the sources' files.
MATCHING, CANDIDATES = ("source1_entity_id", "matched_entity_ids"), ("source1_entity_id", "candidate_entity_ids")
SOURCES = ("test_source1.tsv", "test_source2.tsv", "test_source3.tsv")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file: lines are numbered by their bytes' order in the file, from 1."""
    parts = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    return numbered(parts, "at")


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """Lines numbered from 1 in the given order, by partitions' counts."""
    cell = F.shiftright(order, 33)
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cell", cell)
    offsets = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(offsets, "cell").select((F.col("offset") + F.row_number().over(Window.partitionBy("cell").orderBy(order))).alias("line"), "value")


def header_error(header: str | None, expected: tuple[str, str]) -> str | None:
    if header is None:
        return "the file is empty"
    if "\t" not in header and "," in header:
        return "the header is separated by commas, not tabs"
    if tuple(c.strip().lower() for c in header.rstrip("\r\n").split("\t")) != expected:
        return "the header must be " + "\\t".join(expected)
    return None


def lists_of(lines: DataFrame) -> DataFrame:
    """(line, s1_id, ids, malformed) of the rows after the header; an empty list has no ids."""
    rows = lines.filter("line > 1").filter(~F.col("value").rlike(r"^[^\S\t]*$"))
    cut = F.split("value", "\t", 2)
    ids = F.get(cut, F.lit(1))
    listed = F.when(F.coalesce(F.trim(ids), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ",", -1))
    return rows.select("line", F.get(cut, F.lit(0)).alias("s1_id"), listed.alias("ids"), (F.instr("value", "\t") == 0).alias("malformed"))


def findings(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, offenders, first): how many rows, entities or ids break each rule, and the first five of them. ``required`` has entity_id;
    with ``known`` (entity_id) ids must exist."""
    good = lists.filter(~F.col("malformed"))
    twice = good.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s1_id")
    last = good.groupBy("s1_id").agg(F.max_by("ids", "line").alias("ids"))
    wrong = F.when(F.col("id").startswith("S1-"), "self_match").when(~F.col("id").rlike("^S[23]-"), "wrong_prefix")
    each = good.select(F.explode("ids").alias("id")).distinct().withColumn("rule", wrong)
    parts = [
        (lists.filter("malformed"), "malformed_row", F.col("line").cast("string")),
        (twice, "duplicate_entity", F.col("s1_id")),
        (good.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id").distinct(), "repeated_id", F.col("s1_id")),
        (each.filter("rule = 'self_match'"), "self_match", F.col("id")),
        (each.filter("rule = 'wrong_prefix'"), "wrong_prefix", F.col("id")),
        (required.select(F.trim("entity_id").alias("s1_id")).join(last, "s1_id", "left_anti"), "missing_entity", F.col("s1_id")),
        (last.join(required.select(F.trim("entity_id").alias("s1_id")), "s1_id", "left_anti"), "extra_entity", F.col("s1_id")),
    ]
    if known is not None:
        checked = each.filter("rule is null").join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
        parts.append((checked, "unknown_id", F.col("id")))
    rows = None
    for df, rule, who in parts:
        own = df.select(F.lit(rule).alias("rule"), who.alias("who"))
        rows = own if rows is None else rows.unionByName(own)
    place = Window.partitionBy("rule").orderBy("who")
    firsts = rows.withColumn("place", F.row_number().over(place)).filter("place <= 5").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("who")), ", ").alias("first"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("offenders")).join(firsts, "rule")


def row_counts(lists: DataFrame) -> DataFrame:
    good = lists.filter(~F.col("malformed"))
    return good.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.size("ids") == 0).alias("empty_rows"), F.count_if(F.size("ids") > 0).alias("filled_rows"))


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, id) matches that are no candidates; a warning, not an error."""
    of = lambda rows: rows.filter(~F.col("malformed")).select("s1_id", F.explode("ids").alias("id")).distinct()
    return of(matches).join(of(candidates), ["s1_id", "id"], "left_anti")


@dataclass(slots=True)
class Verdict:
    errors: list[str]
    warnings: list[str]

    @property
    def exit_code(self) -> int:
        return int(bool(self.errors))


def _reason(e: PySparkException) -> str:
    return str(e).strip().splitlines()[0]


def _absent(e: PySparkException) -> bool:
    return isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"


def validate(spark: SparkSession, matching: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> Verdict:
    """Both results files checked. A file that cannot be read or is not UTF-8 is an error with its reason; that there is no
    file of candidates is a warning."""
    errors, warnings, lists = [], [], {}
    for path, expected in ((matching, MATCHING), (candidates, CANDIDATES)):
        if path is None:
            continue
        try:
            lines = text_lines(spark, path)
            broken = lines.agg(F.min(F.when(~F.is_valid_utf8("value"), F.col("line")))).first()[0]
            first = lines.filter("line = 1").first()
        except PySparkException as e:
            (warnings if _absent(e) and expected == CANDIDATES else errors).append(f"{path}: {_reason(e)}")
            continue
        if broken is not None:
            errors.append(f"{path}: line {broken} is not UTF-8; save the file as plain tab-separated text in UTF-8")
            continue
        if problem := header_error(first.value if first else None, expected):
            errors.append(f"{path}: {problem}")
            continue
        lists[expected] = lists_of(lines)
        errors += [f"{path}: {r.rule}: {r.offenders} ({r['first']})" for r in findings(lists[expected], required, known).orderBy("rule").collect()]
    if len(lists) == 2:
        n = outside_candidates(lists[MATCHING], lists[CANDIDATES]).count()
        if n:
            warnings.append(f"{n} matches are not among the candidates")
    if known is None:
        warnings.append("ids were not checked for existence")
    return Verdict(errors, warnings)


def checked_folder(spark: SparkSession, matching: str, candidates: str | None, folder: str, check_ids: bool = False) -> Verdict:
    """:func:`validate` against the sources of ``folder``. Without its first source nothing can be checked, an error; without
    one of the others ids are not checked for existence, a warning."""
    one, *others = (f"{folder.rstrip('/')}/{name}" for name in SOURCES)
    try:
        required = read_tsv(spark, one).select("entity_id")
        if required.isEmpty():
            return Verdict([f"{one}: no entities"], [])
    except PySparkException as e:
        return Verdict([f"{one}: {_reason(e)}"], [])
    known, missing = None, []
    for path in others if check_ids else ():
        try:
            ids = read_tsv(spark, path).select("entity_id")
            known = ids if known is None else known.unionByName(ids)
        except PySparkException as e:
            missing.append(f"{path}: {_reason(e)}")
    got = validate(spark, matching, candidates, required, None if missing else known)
    return Verdict(got.errors, missing + got.warnings)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The command line: findings are printed; 0 where there is no error, else 1."""
    parser = argparse.ArgumentParser(description="Check results files against the sources.")
    parser.add_argument("-m", "--matching", default="output/matching_results.tsv")
    parser.add_argument("-c", "--candidate", default="output/candidate_pairs.tsv")
    parser.add_argument("-t", "--test-dir", default="dataset/test", help="folder of " + ", ".join(SOURCES))
    parser.add_argument("--check-ids", action="store_true", help="ids must be in the second or third source")
    given = parser.parse_args(arguments)
    verdict = checked_folder(spark or session("kindred-validation"), given.matching, given.candidate, given.test_dir, given.check_ids)
    for kind, texts in (("warning", verdict.warnings), ("error", verdict.errors)):
        for text in texts:
            print(f"{kind}: {text}")
    print(f"{len(verdict.errors)} errors")
    return verdict.exit_code


if __name__ == "__main__":
    sys.exit(main())
