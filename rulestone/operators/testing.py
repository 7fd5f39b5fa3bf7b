"""Rule tests: documents with the statuses that rules must have on them."""

from __future__ import annotations

from typing import Any
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.loader import canonical_json, load_text
from .evaluate import Rules, compile_rules, status_text

SPEC = "case_id int, name string, input string, expectations map<string,string>"
#: Exit codes: all as expected, a case can't be read or evaluated, a rule isn't as expected.
TEST_OK, TEST_ERROR, TEST_FAILED = 0, 1, 7


def read_specs(spark: SparkSession, text: str) -> DataFrame:
    """case_id (from 1), name, document (VARIANT), expectations, of a YAML or JSON list of {name, input, expectations:
    {rules: {...}}}."""
    cases, _ = load_text(text, located=False)
    if not isinstance(cases, list):
        raise ValueError("a test specification is a list of cases")
    rows = []
    for i, case in enumerate(cases):
        if not isinstance(case, dict) or "input" not in case or "expectations" not in case:
            raise ValueError(f"case {i + 1} needs input and expectations")
        expected = {k: str(v) for k, v in ((case["expectations"] or {}).get("rules") or {}).items()}
        rows.append((i + 1, case.get("name"), canonical_json(case["input"]), expected))
    return specs_of(spark.createDataFrame(rows, SPEC))


def specs_of(rows: DataFrame) -> DataFrame:
    """rows: case_id, name, input (JSON text), expectations."""
    return rows.select("case_id", "name", F.parse_json("input").alias("document"), "expectations")


def run_tests(specs: DataFrame, rules: Rules, *, compat: bool = True) -> DataFrame:
    """case_id, name, rule, expected (null if the case doesn't say), evaluated (statuses of all rules of that name, in
    file order), outcome (PASS, FAIL or NONE). A rule is as expected if any of its name has the status, for SKIP all."""
    done = compile_rules(specs, rules, "document", compat=compat)
    groups: dict[str, list[str]] = {}
    for label in done.names:
        groups.setdefault(label.split("#")[0].split("@")[0], []).append(label)
    each = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.array(*[status_text(done.status(x)) for x in labels]).alias("evaluated"))
            for rule, labels in groups.items()
        ]
    )
    expected = F.upper(F.col("expectations")[F.col("__each.rule")])
    some = F.array_contains("evaluated", F.col("expected"))
    every = ~F.exists("evaluated", lambda s: s != "SKIP")
    return (
        done.frame.select("case_id", "name", "expectations", F.explode(each).alias("__each"))
        .select("case_id", "name", "__each.rule", expected.alias("expected"), "__each.evaluated")
        .withColumn(
            "outcome",
            F.when(F.col("expected").isNull(), "NONE").when(F.when(F.col("expected") == "SKIP", every).otherwise(some), "PASS").otherwise("FAIL"),
        )
    )


def test_report(outcomes: DataFrame) -> DataFrame:
    """A row per case: case_id, name, passed_rules, failed_rules (with expected and evaluated), skipped_rules (without an
    expectation)."""

    def of(outcome: str, *columns: str):
        return F.array_sort(F.collect_list(F.when(F.col("outcome") == outcome, F.struct(*columns))))

    return outcomes.groupBy("case_id", "name").agg(
        of("PASS", "rule", "evaluated").alias("passed_rules"),
        of("FAIL", "rule", "expected", "evaluated").alias("failed_rules"),
        of("NONE", "rule").alias("skipped_rules"),
    )


def test_text(outcomes: DataFrame) -> str:
    """The report as text. Tests are few, so it is put together on the driver."""
    lines: list[str] = []
    for case in test_report(outcomes).orderBy("case_id").collect():
        lines.append(f"Test Case #{case.case_id}")
        if case.name:
            lines.append(f"Name: {case.name}")
        lines += [f"  No Test expectation was set for Rule {r.rule}" for r in case.skipped_rules]
        if case.passed_rules:
            lines += ["  PASS Rules:", *[f"    {r.rule}: Expected = {next(iter(r.evaluated))}" for r in case.passed_rules]]
        if case.failed_rules:
            lines += ["  FAIL Rules:", *[f"    {r.rule}: Expected = {r.expected}, Evaluated = [{', '.join(r.evaluated)}]" for r in case.failed_rules]]
        lines.append("")
    return "\n".join(lines)


def test_results(rule_file: str, outcomes: DataFrame) -> dict[str, Any]:
    """The report as plain data, for JSON and YAML."""
    cases = []
    for case in test_report(outcomes).orderBy("case_id").collect():
        cases.append(
            {
                "name": case.name or "",
                "passed_rules": [{"name": r.rule, "evaluated": r.evaluated[0]} for r in case.passed_rules],
                "failed_rules": [{"name": r.rule, "expected": r.expected, "evaluated": list(r.evaluated)} for r in case.failed_rules],
                "skipped_rules": [{"name": r.rule} for r in case.skipped_rules],
            }
        )
    return {"rule_file": rule_file, "test_cases": cases}


def test_junit(results: list[dict[str, Any]]) -> str:
    """results: of test_results(), or rule_file and error. A suite for each rule file, a case for each test case."""
    suites, totals = [], [0, 0, 0]
    for result in results:
        file, cases = quoteattr(result["rule_file"]), result.get("test_cases", [])
        failed = sum(bool(c["failed_rules"]) for c in cases)
        wrong = int("error" in result)
        totals = [totals[0] + max(len(cases), wrong), totals[1] + failed, totals[2] + wrong]
        suites.append(f'  <testsuite name={file} errors="{wrong}" failures="{failed}" time="0">')
        if wrong:
            suites.append(f'    <testcase name={file} time="0" status="error">\n      <error>{escape(result["error"])}</error>\n    </testcase>')
        for case in cases:
            opening = f'    <testcase name={quoteattr(case["name"])} time="0" status="'
            if not case["failed_rules"]:
                status = "pass" if case["passed_rules"] else "skip"
                suites.append(f'{opening}{status}"/>' if status == "pass" else f'{opening}{status}">\n      <skipped/>\n    </testcase>')
                continue
            said = "\n".join(f"{r['name']}: Expected = {r['expected']}, Evaluated = [{', '.join(r['evaluated'])}]" for r in case["failed_rules"])
            suites.append(f'{opening}fail">\n      <failure>{escape(said)}</failure>\n    </testcase>')
        suites.append("  </testsuite>")
    head = f'<testsuites name="test report" tests="{totals[0]}" failures="{totals[1]}" errors="{totals[2]}" time="0">'
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', head, *suites, "</testsuites>"])


def test_exit_code(outcomes: DataFrame) -> int:
    found = outcomes.agg(
        F.bool_or(F.exists("evaluated", lambda s: s == "ERROR")).alias("error"), F.bool_or(F.col("outcome") == "FAIL").alias("fail")
    ).first()
    return TEST_ERROR if found.error else TEST_FAILED if found.fail else TEST_OK
