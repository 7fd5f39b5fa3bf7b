"""What a user calls first."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from .operators.evaluate import (
    EXIT_ERROR,
    EXIT_FAILED,
    EXIT_OK,
    checks,
    clause_statuses,
    evaluate,
    event_trees,
    exit_code,
    merge_reports,
    reports,
    results,
    roll_up,
    tallies,
)
from .operators.reports import console, structured
from .operators.rulegen import generate_rules
from .operators.testing import read_specs, run_tests, test_exit_code, test_text
from .plans.ast import RuleFile
from .plans.compiler import RuleError
from .plans.parser import RuleSyntaxError, parse_rules
from .plans.query import UnsupportedRuleError
from .sources.files import read_payload, read_rules, scan_documents, texts_of, with_parameters
from .sources.loader import load_documents


def parse_tree(text: str) -> dict[str, Any] | None:
    """The tree of a rule text as plain data."""
    rules = parse_rules(text)
    return None if rules is None else rules.to_dict()


def validate_text(spark: SparkSession, data: str, rules: str, verbose: bool = False) -> list[dict[str, Any]] | str:
    """One text against one rule text: its report, or the console text if verbose."""
    docs = load_documents(texts_of(spark, [("data", data)])).persist()
    try:
        wrong = docs.select("error").first().error
        if wrong:
            raise ValueError(wrong)
        report = reports(docs, rules, "name", "document")
        return console(report) if verbose else structured(report)
    finally:
        docs.unpersist()


def validate_files(spark: SparkSession, data: str | list[str], rules: str | list[str], parameters: str | list[str] | None = None) -> tuple[list[dict], int]:
    """Reports of all data files against all rule files, and the exit code."""
    files = read_rules(rules)
    docs = scan_documents(spark, data).persist()  # parsed once for errors and rules
    try:
        if docs.filter("error IS NOT NULL").limit(1).count():
            return [], EXIT_ERROR
        merged = docs if parameters is None else with_parameters(docs, scan_documents(spark, parameters))
        found = structured(reports(merged, files, "name", "document"))
    finally:
        docs.unpersist()
    statuses = {r["status"] for r in found}
    return found, EXIT_ERROR if "ERROR" in statuses else EXIT_FAILED if "FAIL" in statuses else EXIT_OK


__all__ = [
    "EXIT_ERROR", "EXIT_FAILED", "EXIT_OK", "RuleError", "RuleFile", "RuleSyntaxError", "UnsupportedRuleError", "checks", "clause_statuses", "console", "evaluate", "event_trees",
    "exit_code", "generate_rules", "load_documents", "merge_reports", "parse_rules", "parse_tree", "read_payload", "read_rules", "read_specs", "reports",
    "results", "roll_up", "run_tests", "scan_documents", "structured", "tallies", "test_exit_code", "test_text", "texts_of", "validate_files",
    "validate_text", "with_parameters",
]
