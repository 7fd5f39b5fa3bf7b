"""python -m rulestone validate | test | parse-tree | rulegen"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reports as R
from .operators.evaluate import EXIT_ERROR, EXIT_FAILED, EXIT_OK, checks_of, event_trees, exit_code_of, reports
from .operators.rulegen import generate_rules
from .operators.testing import TEST_ERROR, TEST_OK, read_specs, run_tests, test_exit_code, test_junit, test_results, test_text
from .plans.compiler import RuleError
from .plans.parser import RuleSyntaxError, parse_rules
from .plans.query import UnsupportedRuleError
from .sources.files import pair_tests, read_payload, read_rules, scan_documents, scan_texts, texts_of, with_parameters
from .sources.loader import load_documents

FORMATS = ("single-line-summary", "json", "yaml", "junit", "sarif")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("rulestone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class ConflictError(ValueError):
    """Options that don't go together."""


def check_options(args: argparse.Namespace) -> None:
    shows = set(args.show_summary) - {"none"} if "none" not in args.show_summary else set()
    if args.payload and (args.rules or args.data):
        raise ConflictError("--payload can't stand with --rules or --data")
    if not args.payload and not args.rules:
        raise ConflictError("--rules or --payload is needed")
    if args.alphabetical and args.last_modified:
        raise ConflictError("--alphabetical can't stand with --last-modified")
    if args.structured and (args.verbose or args.print_json):
        raise ConflictError("--structured can't stand with --verbose or --print-json")
    if args.structured and shows:
        raise ConflictError("--structured needs --show-summary none")
    if args.structured and args.output_format == FORMATS[0]:
        raise ConflictError(f"--structured can't stand with {FORMATS[0]}")
    if not args.structured and args.output_format in ("junit", "sarif"):
        raise ConflictError(f"{args.output_format} needs --structured")


def validate(args: argparse.Namespace, spark: SparkSession) -> int:
    check_options(args)
    order = "modified" if args.last_modified else "alphabetical"
    if args.payload:
        rules, docs = read_payload(spark, texts_of(spark, [("payload", sys.stdin.read())]), "content")
    else:
        rules = read_rules(args.rules, order)
        texts = scan_texts(spark, args.data, order=order) if args.data else texts_of(spark, [("STDIN", sys.stdin.read())])
        docs = load_documents(texts, keep_content=True)
    docs = docs.persist()  # parsed once for errors and rules
    wrong = docs.filter("error IS NOT NULL").select("name", "error").limit(20).collect()
    if wrong:
        print("\n".join(f"{r.name}: {r.error}" for r in wrong), file=sys.stderr)
        return EXIT_ERROR
    if not rules:
        return EXIT_OK
    merged = with_parameters(docs, scan_documents(spark, args.input_parameters)) if args.input_parameters else docs
    if args.output_format == "junit":
        files = {r.name or "default": reports(merged, r, "name", "document").persist() for r in rules}
        print(R.junit(files))
        return worst(exit_code_of(f) for f in files.values())
    report = reports(merged, rules, "name", "document").persist()  # evaluated once for text and exit code
    print(shown(args, merged, report))
    if args.verbose:
        print(R.verbose_text(event_trees(merged, rules, ["name"], "document")))
    if args.print_json:
        for r in event_trees(merged, rules, ["name"], "document").orderBy("name", "file").toLocalIterator():
            print(json.dumps(json.loads(r.events), indent=2, ensure_ascii=False))
    return exit_code_of(report)


def worst(codes: Iterable[int]) -> int:
    found = set(codes)
    return EXIT_ERROR if EXIT_ERROR in found else EXIT_FAILED if EXIT_FAILED in found else EXIT_OK


def shown(args: argparse.Namespace, docs: DataFrame, report: DataFrame) -> str:
    if args.output_format in ("json", "yaml"):
        if args.structured:
            return R.to_json(report) if args.output_format == "json" else R.to_yaml(report)
        each = R.structured(report)
        return "\n".join(json.dumps(r, indent=2, ensure_ascii=False) if args.output_format == "json" else R.yaml_text(r) for r in each)
    if args.output_format == "sarif":
        places = docs.select("name", F.explode("locations").alias("l")).select("name", "l.path", "l.line", "l.column")
        return R.sarif(R.sarif_results(checks_of(report), places))
    parts = [] if "none" in args.show_summary else [R.summary_text(R.summary_of(report, args.show_summary), "name")]
    return "\n".join([*parts, R.console(report, docs)])


def test(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.dir:
        below = [p for e in ("guard", "ruleset") for p in glob.glob(os.path.join(args.dir, "**", f"*.{e}"), recursive=True)]
        pairs = pair_tests(below, glob.glob(os.path.join(args.dir, "**", "tests", "*"), recursive=True))
    else:
        pairs = {args.rules_file: args.test_data}
    worst, results = TEST_OK, []
    for file, specs in pairs.items():
        try:
            rules = read_rules(file)
            for path in specs:
                with open(path, encoding="utf-8") as text:
                    outcomes = run_tests(read_specs(spark, text.read()), rules)
                if args.output_format == FORMATS[0]:
                    print(test_text(outcomes))
                else:
                    own = test_results(file, outcomes)
                    same = [r for r in results if r["rule_file"] == file and "test_cases" in r]
                    if same:
                        same[0]["test_cases"] += own["test_cases"]
                    else:
                        results.append(own)
                worst = max(worst, test_exit_code(outcomes))
        except (OSError, ValueError, RuleError, UnsupportedRuleError) as e:
            print(f"{file}: {e}", file=sys.stderr)
            results.append({"rule_file": file, "error": str(e)})
            worst = max(worst, TEST_ERROR)
    if args.output_format == "json":
        print(json.dumps(results, indent=2, ensure_ascii=False))
    elif args.output_format == "yaml":
        print(R.yaml_text(results))
    elif args.output_format == "junit":
        print(test_junit(results))
    return worst


def summary_words(text: str) -> list[str]:
    words = text.split(",")
    if set(words) - {"all", "pass", "fail", "skip", "none"}:
        raise argparse.ArgumentTypeError(f"{text} is no list of all, pass, fail, skip and none")
    return words


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="rulestone")
    commands = top.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate", help="documents against rules")
    v.add_argument("--rules", "-r", nargs="+", default=[])
    v.add_argument("--data", "-d", nargs="+")
    v.add_argument("--input-parameters", "-i", nargs="+")
    v.add_argument("--output-format", "-o", choices=FORMATS, default=FORMATS[0])
    v.add_argument("--show-summary", "-S", nargs="+", type=summary_words, action="extend", default=None)
    v.add_argument("--payload", "-P", action="store_true", help="rules and data as JSON on standard input")
    v.add_argument("--alphabetical", "-a", action="store_true")
    v.add_argument("--last-modified", "-m", action="store_true")
    v.add_argument("--type", "-t", help="kept for old scripts; nothing looks at it")
    v.add_argument("--verbose", "-v", action="store_true", help="the walk through each document")
    v.add_argument("--print-json", "-p", action="store_true", help="the walk as JSON")
    v.add_argument("--structured", "-z", action="store_true", help="one JSON, YAML, JUnit or SARIF document")
    t = commands.add_parser("test", help="rules against expected statuses")
    t.add_argument("--rules-file", "-r")
    t.add_argument("--test-data", "-t", nargs="+", default=[])
    t.add_argument("--dir", "-d")
    t.add_argument("--output-format", "-o", choices=FORMATS[:4], default=FORMATS[0])
    p = commands.add_parser("parse-tree", help="the tree of a rule file")
    p.add_argument("--rules", "-r")
    p.add_argument("--print-yaml", "-y", action="store_true")
    g = commands.add_parser("rulegen", help="rules from templates")
    g.add_argument("--template", "-t", nargs="+", required=True)
    args = top.parse_args(argv)
    if args.command == "validate":
        args.show_summary = [w for words in args.show_summary or [["fail"]] for w in words]
    try:
        if args.command == "parse-tree":
            with open(args.rules, encoding="utf-8") if args.rules else sys.stdin as text:
                rules = parse_rules(text.read())
            tree = rules.to_dict() if rules else {}
            if args.print_yaml:
                import yaml

                print(yaml.safe_dump(tree, sort_keys=False))
            else:
                print(json.dumps(tree, indent=2))
            return EXIT_OK
        if args.command == "validate":
            return validate(args, session())
        if args.command == "test":
            return test(args, session())
        print(generate_rules(scan_documents(session(), args.template)), end="")
        return EXIT_OK
    except (RuleSyntaxError, RuleError, UnsupportedRuleError, ConflictError, OSError) as e:
        print(e, file=sys.stderr)
        return EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())
