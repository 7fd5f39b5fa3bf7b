"""Reports of evaluated documents: JSON, YAML, JUnit, SARIF, summary tables and text.

Lines, suites, results and counts are made in Spark, as tables that executors write; the functions that give one text put
it together on the driver from rows that come one partition at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from typing import Any
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import Rules, checks, checks_of, results

# Fixed values of the SARIF format.
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
TOOL = {"name": "rulestone", "semanticVersion": "1.0.0", "fullName": "rulestone 1.0.0", "shortDescription": {"text": "Rules over documents, evaluated by Spark."}}


def json_rows(report: DataFrame) -> DataFrame:
    """name, value: a report per document as JSON text, for writing as a table of lines."""
    return report.select("name", F.to_json(F.struct(*report.columns)).alias("value"))


def structured(report: DataFrame) -> list[dict[str, Any]]:
    return [json.loads(r.value) for r in json_rows(report).orderBy("name").toLocalIterator()]


def to_json(report: DataFrame) -> str:
    return json.dumps(structured(report), indent=2, ensure_ascii=False)


def yaml_text(value: Any) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def to_yaml(report: DataFrame) -> str:
    return yaml_text(structured(report))


def summary(docs: DataFrame, rules: Rules, name: str, document: str | None = None, show: Iterable[str] = ("pass", "fail", "skip")) -> DataFrame:
    """name, rule, status: a row per document and rule of the statuses to show (all, pass, fail, skip, none). A skipped
    rule is left out where another of its name passed or failed on the document."""
    return _summary(results(docs, rules, [name], document), name, show)


def summary_of(report: DataFrame, show: Iterable[str] = ("pass", "fail", "skip")) -> DataFrame:
    """summary() from reports()."""
    def named(c: Column, status: str) -> Column:
        return F.transform(c, lambda r: F.struct(r.alias("rule"), F.lit(status).alias("status")))

    failed = F.transform("not_compliant", lambda r: F.struct(r["name"].alias("rule"), r["status"].alias("status")))
    each = F.concat(failed, named(F.col("compliant"), "PASS"), named(F.col("not_applicable"), "SKIP"))
    return _summary(report.select("name", F.explode(each).alias("e")).select("name", "e.*"), "name", show)


def _summary(rows: DataFrame, name: str, show: Iterable[str]) -> DataFrame:
    wanted = {s.upper() for s in show}
    if "NONE" in wanted:
        wanted = set()
    if "ALL" in wanted:
        wanted = {"PASS", "FAIL", "SKIP"}
    rows = rows.withColumn("rule", F.regexp_replace("rule", "[#@][0-9]+$", ""))
    tops = rows.groupBy(name, "rule").agg(
        F.bool_or(F.col("status") == "PASS").alias("p"), F.bool_or(F.col("status") == "FAIL").alias("f"), F.bool_or(F.col("status") == "ERROR").alias("e")
    )
    found = F.filter(
        F.array(F.when(F.col("e"), F.lit("ERROR")), F.when(F.col("f"), F.lit("FAIL")), F.when(F.col("p"), F.lit("PASS"))), lambda s: s.isNotNull()
    )
    shown = F.when(F.size(found) == 0, F.array(F.lit("SKIP"))).otherwise(found)
    return tops.select(name, "rule", F.explode(shown).alias("status")).filter(F.col("status").isin(*wanted, "ERROR") if wanted else F.lit(False))


def summary_text(rows: DataFrame, name: str) -> str:
    """A table of text for each document."""
    lines: list[str] = []
    last = None
    for r in rows.orderBy(name, "status", "rule").toLocalIterator():
        if r[name] != last:
            last = r[name]
            lines.append(f"{last} Summary")
        lines.append(f"{r.rule:<60} {r.status}")
    return "\n".join(lines)


def xml_text(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def junit_suites(files: dict[str, DataFrame]) -> DataFrame:
    """files: reports by rule file. A row for each document: name, tests, failures, errors and xml, its suite with a case
    for each rule file in their order. All of it is put together in Spark; a group is as large as there are rule files."""
    parts = []
    for at, (file, report) in enumerate(files.items()):
        messages = F.transform(F.flatten(F.col("not_compliant.checks")), lambda c: F.trim(F.concat_ws(" ", c["message"], F.coalesce(c["custom_message"], F.lit("")))))
        parts.append(report.select("name", F.lit(at).alias("at"), F.lit(file).alias("file"), "status", F.array_join(messages, "\n").alias("said")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    opening = F.concat(F.lit('    <testcase name="'), xml_text(F.col("file")), F.lit('" time="0" status="'), F.lower("status"), F.lit('"'))
    kind = F.when(F.col("status") == "FAIL", "failure").otherwise("error")
    case = (
        F.when(F.col("status").isin("FAIL", "ERROR"), F.concat(opening, F.lit(">\n      <"), kind, F.lit(">"), xml_text(F.col("said")), F.lit("</"), kind, F.lit(">\n    </testcase>")))
        .when(F.col("status") == "SKIP", F.concat(opening, F.lit(">\n      <skipped/>\n    </testcase>")))
        .otherwise(F.concat(opening, F.lit("/>")))
    )
    suites = rows.withColumn("case", F.struct("at", case.alias("xml"))).groupBy("name").agg(
        F.count("*").alias("tests"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.array_sort(F.collect_list("case")).alias("cases"),
    )
    head = F.format_string('" errors="%d" failures="%d" time="0">\n', "errors", "failures")
    xml = F.concat(F.lit('  <testsuite name="'), xml_text(F.col("name")), head, F.array_join(F.col("cases.xml"), "\n"), F.lit("\n  </testsuite>"))
    return suites.select("name", "tests", "failures", "errors", xml.alias("xml"))


def junit_totals(suites: DataFrame) -> DataFrame:
    """tests, failures, errors of all suites; one row."""
    return suites.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tests", "failures", "errors")])


def junit(files: dict[str, DataFrame], title: str = "validate report") -> str:
    """The document as text, suites by name, for as many as the driver can hold; junit_suites() is a table of them."""
    suites = junit_suites(files)
    t = junit_totals(suites).first()
    head = f'<testsuites name={quoteattr(title)} tests="{t.tests}" failures="{t.failures}" errors="{t.errors}" time="0">'
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', head, *[r.xml for r in suites.orderBy("name").select("xml").toLocalIterator()], "</testsuites>"])


def sarif_results(failed: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """failed: rows of checks() with a column name. locations: name, path, line, column of values in the documents' text.
    Returns ruleId, level, text, uri, startLine, startColumn; lines and columns are 1 at least."""
    rows = failed.select("name", "rule", "seq", "path", "message", "custom_message")
    if locations is None:
        placed = rows.withColumns({"at_line": F.lit(0), "at_column": F.lit(0)})
    else:
        places = locations.select(F.col("name").alias("__name"), F.col("path").alias("__path"), F.col("line").alias("at_line"), F.col("column").alias("at_column"))
        places = places.dropDuplicates(["__name", "__path"])
        placed = rows.join(places, (F.col("name") == F.col("__name")) & (F.col("path") == F.col("__path")), "left")
    return placed.select(
        F.upper(F.split_part("rule", F.lit("."), F.lit(1))).alias("ruleId"),
        F.lit("error").alias("level"),
        F.concat_ws(" ", F.col("message"), F.coalesce("custom_message", F.lit(""))).alias("text"),
        F.regexp_replace("name", "^/", "").alias("uri"),
        F.greatest(F.coalesce("at_line", F.lit(0)), F.lit(1)).alias("startLine"),
        F.greatest(F.coalesce("at_column", F.lit(0)), F.lit(1)).alias("startColumn"),
        "seq",
    )


def sarif_artifacts(found: DataFrame) -> DataFrame:
    """uri of each document with results, once."""
    return found.filter(F.col("uri") != "").select("uri").distinct()


def sarif(found: DataFrame) -> str:
    """found: rows of sarif_results(). The document as text, for as many as the driver can hold."""
    artifacts = [{"location": {"uri": r.uri}} for r in sarif_artifacts(found).orderBy("uri").toLocalIterator()]
    listed = [
        {
            "ruleId": r.ruleId,
            "level": r.level,
            "message": {"text": r.text},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r.uri}, "region": {"startLine": r.startLine, "startColumn": r.startColumn}}}],
        }
        for r in found.orderBy("uri", "ruleId", "seq", "startLine", "startColumn", "text").toLocalIterator()
    ]
    run = {"tool": {"driver": TOOL}, "artifacts": artifacts, "results": listed}
    return json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION, "runs": [run]}, indent=2, ensure_ascii=False)


def by_resource(failed: DataFrame, pattern: str = r"^/Resources/([^/]+)") -> DataFrame:
    """name, resource, n_checks, rules: failed checks by the resource that their path begins with; others have none."""
    resource = F.nullif(F.regexp_extract("path", pattern, 1), F.lit(""))
    return (
        failed.withColumn("resource", resource)
        .groupBy("name", "resource")
        .agg(F.count("*").alias("n_checks"), F.array_sort(F.collect_set("rule")).alias("rules"))
    )


#: Lines of code that a report shows: so many before a value's own, and so many in all.
BEFORE, SHOWN = 2, 6


def code_excerpts(content: Column, line: Column) -> Column:
    """Numbered lines around a line of a text, as an array."""
    first = F.greatest(F.lit(1), line - BEFORE)
    lines = F.slice(F.split(content, "\n"), first.cast("int"), SHOWN)
    return F.transform(lines, lambda text, i: F.concat(F.lpad((first + i).cast("string"), 5, " "), F.lit("."), F.regexp_replace(text, "\r$", "")))


def resource_details(failed: DataFrame, docs: DataFrame) -> DataFrame:
    """failed: rows of checks() with name; docs: name, document, locations, and content if code is to be shown. A row for
    each failed check that a resource of its document has: name, layout, resource, type, rule, seq, property, clause,
    value, compared, message, custom_message, code.

    layout template: documents with Resources, whose keys name resources; plan: documents with a list resource_changes,
    whose members' addresses name them, and whose properties stand below change/after. Other documents have no rows."""
    content = F.col("content") if "content" in docs.columns else F.lit(None).cast("string")
    of = docs.select(
        F.col("name").alias("__name"),
        F.try_variant_get("document", "$.Resources", "map<string,variant>").alias("__resources"),
        F.try_variant_get("document", "$.resource_changes", "array<variant>").alias("__changes"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform("locations", lambda x: x["path"])), lambda p: F.struct(p, F.filter("locations", lambda x: x["path"] == p)[0]["line"]))).alias("__lines") if "locations" in docs.columns else F.lit(None).cast("map<string,int>").alias("__lines"),
        content.alias("__content"),
    )
    rows = failed.join(of, F.col("name") == F.col("__name"))
    key = F.regexp_extract("path", r"^/Resources/([^/]+)", 1)
    change = F.get("__changes", F.regexp_extract("path", r"^/resource_changes/(\d+)", 1).try_cast("int"))
    is_template, is_plan = F.col("__resources").isNotNull() & (key != ""), F.col("__changes").isNotNull() & change.isNotNull()
    line = F.coalesce(F.col("__lines")[F.col("path")], F.lit(0))
    found = rows.select(
        "name",
        F.when(is_template, "template").when(is_plan, "plan").alias("layout"),
        F.when(is_template, key).otherwise(F.try_variant_get(change, "$.address", "string")).alias("resource"),
        F.when(is_template, F.try_variant_get(F.col("__resources")[key], "$.Type", "string")).otherwise(F.try_variant_get(change, "$.type", "string")).alias("type"),
        "rule",
        "seq",
        F.when(is_template, F.regexp_replace("path", "^/Resources/[^/]+/?", "")).otherwise(F.regexp_replace("path", r"^/resource_changes/\d+/(change/after/)?", "")).alias("property"),
        "clause",
        "value",
        "compared",
        "message",
        "custom_message",
        F.when(F.col("__content").isNotNull() & (line > 0), code_excerpts(F.col("__content"), line)).alias("code"),
    )
    return found.filter("layout IS NOT NULL")


def resource_lines(details: DataFrame) -> DataFrame:
    """name, seq, line: the report of each document by its resources, in their order. A group is one document's checks."""
    shown = F.concat(
        F.array(F.concat(F.lit("    "), F.col("rule"), F.lit(": "), F.col("clause")), F.concat(F.lit("      PropertyPath    = "), F.col("property"))),
        F.when(F.col("value").isNotNull(), F.array(F.concat(F.lit("      Value           = "), F.col("value")))).otherwise(F.array()),
        F.when(F.col("compared").isNotNull(), F.array(F.concat(F.lit("      ComparedWith    = "), F.col("compared")))).otherwise(F.array()),
        F.when(F.coalesce("custom_message", F.lit("")) != "", F.array(F.concat(F.lit("      Message         = "), F.col("custom_message")))).otherwise(F.array()),
        F.when(F.col("code").isNotNull(), F.concat(F.array(F.lit("      Code:")), F.transform("code", lambda c: F.concat(F.lit("        "), c)))).otherwise(F.array()),
    )
    of_resource = details.groupBy("name", "resource", "type").agg(F.array_sort(F.collect_list(F.struct("rule", "seq", shown.alias("lines")))).alias("all"))
    head = F.array(F.concat(F.lit("  Resource = "), F.col("resource"), F.lit(" {")), F.concat(F.lit("    Type = "), F.coalesce("type", F.lit(""))))
    own = of_resource.select("name", "resource", F.concat(head, F.flatten(F.col("all.lines")), F.array(F.lit("  }"))).alias("lines"))
    whole = own.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("resource", "lines"))).alias("all"))
    title = F.array(F.concat(F.lit("Number of non-compliant resources "), F.size("all").cast("string")))
    return whole.select("name", F.posexplode(F.concat(title, F.flatten(F.col("all.lines")))).alias("seq", "line"))


def console_lines(report: DataFrame) -> DataFrame:
    """report: rows of reports(). name, seq, line: each document's status, the failed rules with their checks, and the
    others."""
    def check(c: Column) -> Column:
        custom = F.when(F.coalesce(c["custom_message"], F.lit("")) != "", F.concat(F.lit(" "), c["custom_message"])).otherwise("")
        return F.concat(F.lit("    "), c["clause"], F.lit(" at line "), c["line"].cast("string"), F.lit(": "), c["message"], custom)

    failed = F.flatten(F.transform("not_compliant", lambda r: F.concat(F.array(F.concat(F.lit("  "), r["status"], F.lit(" "), r["name"])), F.transform(r["checks"], check))))
    passed = F.transform("compliant", lambda x: F.concat(F.lit("  PASS "), x))
    skipped = F.transform("not_applicable", lambda x: F.concat(F.lit("  SKIP "), x))
    head = F.array(F.concat(F.col("name"), F.lit(" Status = "), F.col("status")))
    return report.select("name", F.posexplode(F.concat(head, failed, passed, skipped)).alias("seq", "line"))


def console(report: DataFrame, docs: DataFrame | None = None) -> str:
    """The lines as text, documents by name; with docs also those of their resources."""
    lines = console_lines(report).withColumn("part", F.lit(0))
    if docs is not None:
        lines = lines.unionByName(resource_lines(resource_details(checks_of(report), docs)).withColumn("part", F.lit(1)))
    return "\n".join(r.line for r in lines.orderBy("name", "part", "seq").toLocalIterator())


def verbose_text(trees: DataFrame, name: str = "name") -> str:
    """trees: rows of event_trees(). The walks as text, indented."""
    lines: list[str] = []

    def walk(node: dict[str, Any], depth: int) -> None:
        lines.append(f"{'  ' * depth}{node['context']} {node['status']}")
        for child in node["children"]:
            walk(child, depth + 1)

    for r in trees.orderBy(name, "file").toLocalIterator():
        lines.append(str(r[name]))
        walk(json.loads(r.events), 1)
    return "\n".join(lines)


def at_pointer(path: str, pointer: str) -> str:
    """Where a pointer leads from a path: "" or "0" to itself, "0#" and "2#" to the last key of itself and of the parent's
    parent, "1/a" to a below the parent, and anything else is a path from the root."""
    if pointer in ("", "0"):
        return path
    found = re.fullmatch(r"(\d+)(#|/.*)?", pointer)
    if found is None:
        return pointer
    steps, rest = int(found[1]), found[2] or ""
    parts = path.split("/")[1:] if path not in ("", "/") else []
    if steps > len(parts):
        raise ValueError(f"pointer {pointer} leads beyond the root from {path}")
    above = parts[: len(parts) - steps]
    if rest == "#":
        return above[-1] if above else ""
    return ("/" + "/".join(above) if above else "") + rest or "/"


def failed_with_names(docs: DataFrame, rules: Rules, name: str, document: str | None = None) -> DataFrame:
    """checks() with the documents' names as name."""
    return checks(docs, rules, [name], document).withColumnRenamed(name, "name")
