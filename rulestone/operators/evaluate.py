"""Evaluating rules over a DataFrame of documents.

A document is a row (typed mode: its columns are the keys of a map) or a VARIANT column of it. All rules are columns of
one scan; a shuffle comes only with a roll-up.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import RuleFile
from ..plans.callsites import without_call_sites
from ..plans.compiler import CHECK, STATUSES, Compiler, event, status_text
from ..plans.parser import parse_rules
from ..plans.query import ERROR, FAIL, PASS, SKIP
from ..plans.values import VARIANT, Val

Rules = str | RuleFile | Iterable["str | RuleFile"]


class RuleEvaluationError(RuntimeError):
    """A document could not be evaluated; raised on executors in strict mode."""


def rule_files(rules: Rules) -> list[RuleFile]:
    """Blank texts have no rules and are left out."""
    given = [rules] if isinstance(rules, (str, RuleFile)) else list(rules)
    parsed = [parse_rules(r) if isinstance(r, str) else r for r in given]
    return [r for r in parsed if r is not None]


@dataclass
class Evaluated:
    """frame: the documents with internal columns; names: (status column, checks column) by rule, in file order."""

    frame: DataFrame
    names: dict[str, tuple[str, str | None]]

    def status(self, rule: str) -> Column:
        return F.col(self.names[rule][0])

    def overall(self) -> Column:
        """The document's status: any error, any FAIL, any PASS, or else SKIP."""
        columns = [F.col(c) for c, _ in self.names.values()]
        return F.lit(SKIP) if not columns else columns[0] if len(columns) == 1 else F.greatest(*columns)


def document_of(docs: DataFrame, document: str | None, detail: bool) -> Val:
    """The row itself or its VARIANT column; with paths in detail mode."""
    path = F.lit("") if detail else None
    if document is not None:
        return Val(F.col(document), VARIANT, path, nullable=False)
    return Val(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), T.StructType(docs.schema.fields), path, nullable=False)


@without_call_sites
def compile_rules(docs: DataFrame, rules: Rules, document: str | None = None, *, detail: bool = False, compat: bool = True) -> Evaluated:
    """document: name of a VARIANT column; None for the row itself."""
    root = document_of(docs, document, detail)
    names: dict[str, tuple[str, str | None]] = {}
    frame = docs
    for i, file in enumerate(rule_files(rules)):
        frame, own = Compiler(file, detail, compat).plan(frame, root)
        # names of internal columns are per file
        renamed = {c: f"__file_{i}{c}" for c in frame.columns if c not in docs.columns and not c.startswith("__file_")}
        frame = frame.withColumnsRenamed(renamed)
        for rule, (status, checks) in own.items():
            label = rule if rule not in names else f"{file.name or i}:{rule}"
            names[label] = (renamed[status], renamed[checks] if checks else None)
    return Evaluated(frame, names)


@without_call_sites
def clause_statuses(docs: DataFrame, rules: Rules, keep: list[str], document: str | None = None, *, compat: bool = True) -> DataFrame:
    """One row per clause of each rule, conditions included: keep, rule, seq, clause, status; the walk through a document."""
    frame, found = docs, []
    for i, file in enumerate(rule_files(rules)):
        compiler = Compiler(file, False, compat, trace=True)
        frame, _ = compiler.plan(frame, document_of(docs, document, False))
        renamed = {c: f"__file_{i}{c}" for c in frame.columns if c not in docs.columns and not c.startswith("__file_")}
        frame = frame.withColumnsRenamed(renamed)
        found += [F.transform(F.col(renamed[c]), lambda x, k: F.struct(F.lit(rule).alias("rule"), k.alias("seq"), x.alias("c"))) for rule, c in compiler.traces]
    return frame.select(*keep, F.explode(F.concat(*found)).alias("__each")).select(*keep, "__each.rule", "__each.seq", "__each.c.*")


@without_call_sites
def event_trees(docs: DataFrame, rules: Rules, keep: list[str], document: str | None = None, *, compat: bool = True) -> DataFrame:
    """One row per document and rule file: keep, file, events (JSON text): the walk through all rules, with nested records
    of conditions, blocks and clauses."""
    frame, found = docs, []
    for i, file in enumerate(rule_files(rules)):
        compiler = Compiler(file, False, compat, trace="events")
        frame, names = compiler.plan(frame, document_of(docs, document, False))
        statuses = [F.col(c) for c, _ in names.values()]
        top = F.greatest(F.lit(SKIP), *statuses)
        tree = event(F.lit(file.name or "rules"), top, F.array(*[F.col(c) for _, c in compiler.traces]).cast("array<string>"))
        frame = frame.withColumn("__events", tree).drop(*[c for c in frame.columns if c.startswith("__") and c not in docs.columns and not c.startswith("__file_")])
        frame = frame.withColumnRenamed("__events", f"__file_{i}_events")
        found.append(F.struct(F.lit(file.name or "rules").alias("file"), F.col(f"__file_{i}_events").alias("events")))
    return frame.select(*keep, F.explode(F.array(*found)).alias("__each")).select(*keep, "__each.*")


@without_call_sites
def evaluate(docs: DataFrame, rules: Rules, keep: list[str], document: str | None = None, *, strict: bool = False, compat: bool = True) -> DataFrame:
    """One row per document: keep, and a column of statuses (PASS, FAIL, SKIP, ERROR) for each rule. strict: an ERROR ends
    the job instead."""
    done = compile_rules(docs, rules, document, compat=compat)

    def shown(rule: str) -> Column:
        status = status_text(done.status(rule))
        if not strict:
            return status.alias(rule)
        return F.when(done.status(rule) == ERROR, F.raise_error(F.lit(f"rule {rule} could not be evaluated"))).otherwise(status).alias(rule)

    return done.frame.select(*keep, *[shown(r) for r in done.names])


@without_call_sites
def results(docs: DataFrame, rules: Rules, keep: list[str], document: str | None = None, *, compat: bool = True) -> DataFrame:
    """One row per document and rule: keep, rule, status."""
    done = compile_rules(docs, rules, document, compat=compat)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), status_text(done.status(r)).alias("status")) for r in done.names])
    return done.frame.select(*keep, F.explode(each).alias("__each")).select(*keep, "__each.rule", "__each.status")


@without_call_sites
def checks(docs: DataFrame, rules: Rules, keep: list[str], document: str | None = None, *, compat: bool = True) -> DataFrame:
    """One row per check that failed: keep, rule, seq (within the rule, from 0), clause, line, column, path, value,
    compared, message, custom_message."""
    done = compile_rules(docs, rules, document, detail=True, compat=compat)
    tagged = [
        F.transform(F.col(c), lambda x, i: F.struct(F.lit(r).alias("rule"), i.alias("seq"), x.alias("check"))) for r, (_, c) in done.names.items()
    ]
    if not tagged:
        tagged = [F.array().cast(f"array<struct<rule:string,seq:int,check:{CHECK}>>")]
    return done.frame.select(*keep, F.explode(F.concat(*tagged)).alias("__each")).select(*keep, "__each.rule", "__each.seq", "__each.check.*")


@without_call_sites
def reports(docs: DataFrame, rules: Rules, name: str, document: str | None = None, *, compat: bool = True) -> DataFrame:
    """One row per document: name, metadata, status, not_compliant (failed rules with their checks), not_applicable and
    compliant (names, in order)."""
    done = compile_rules(docs, rules, document, detail=True, compat=compat)

    def named(status: int) -> Column:
        found = F.array(*[F.when(done.status(r) == status, F.lit(r)) for r in done.names]) if done.names else F.array().cast("array<string>")
        return F.array_sort(F.array_distinct(F.array_compact(found)))

    failed = [
        F.when(done.status(r) >= FAIL, F.struct(F.lit(r).alias("name"), status_text(done.status(r)).alias("status"), F.col(c).alias("checks")))
        for r, (_, c) in done.names.items()
    ]
    kind = f"array<struct<name:string,status:string,checks:array<{CHECK}>>>"
    return done.frame.select(
        F.col(name).cast("string").alias("name"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        status_text(done.overall()).alias("status"),
        (F.array_compact(F.array(*failed)) if failed else F.array()).cast(kind).alias("not_compliant"),
        named(SKIP).alias("not_applicable"),
        named(PASS).alias("compliant"),
    )


def merge_reports(parts: DataFrame) -> DataFrame:
    """Reports of several rule files on the same documents as one report per document."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    merged = parts.withColumn("__rank", rank).groupBy("name").agg(
        F.max("__rank").alias("__rank"),
        F.flatten(F.collect_list("not_compliant")).alias("not_compliant"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("not_applicable")))).alias("not_applicable"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("compliant")))).alias("compliant"),
    )
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("__rank").cast("int"))
    return merged.select("name", F.create_map().cast("map<string,string>").alias("metadata"), status.alias("status"), "not_compliant", "not_applicable", "compliant")


@without_call_sites
def tallies(docs: DataFrame, rules: Rules, by: list[str] | None = None, document: str | None = None, *, compat: bool = True) -> DataFrame:
    """by, rule, status, n: documents by rule and status. Counts are added up before the shuffle."""
    by = by or []
    done = compile_rules(docs, rules, document, compat=compat)
    # a count for each rule and status is a column, so rows are not multiplied before they are added up
    names = list(done.names)
    sums = [F.count_if(done.status(r) == s).alias(f"__n_{i}_{s}") for i, r in enumerate(names) for s in range(len(STATUSES))]
    summed = done.frame.groupBy(*by).agg(*sums)
    each = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(STATUSES[s]).alias("status"), F.col(f"__n_{i}_{s}").alias("n"))
            for i, r in enumerate(names)
            for s in range(len(STATUSES))
        ]
    )
    return summed.select(*by, F.explode(each).alias("__each")).select(*by, "__each.*").filter(F.col("n") > 0)


@without_call_sites
def roll_up(docs: DataFrame, rules: Rules, by: list[str], document: str | None = None, *, compat: bool = True) -> DataFrame:
    """by, rule, status: the highest status of the documents of a group."""
    done = compile_rules(docs, rules, document, compat=compat)
    names = list(done.names)
    tops = done.frame.groupBy(*by).agg(*[F.max(done.status(r)).alias(f"__max_{i}") for i, r in enumerate(names)])
    each = F.array(*[F.struct(F.lit(r).alias("rule"), status_text(F.col(f"__max_{i}")).alias("status")) for i, r in enumerate(names)])
    return tops.select(*by, F.explode(each).alias("__each")).select(*by, "__each.*")


def checks_of(report: DataFrame) -> DataFrame:
    """Rows of checks() with name, from reports()."""
    each = report.select("name", F.explode("not_compliant").alias("r")).select("name", F.col("r.name").alias("rule"), F.posexplode("r.checks").alias("seq", "check"))
    return each.select("name", "rule", "seq", "check.*")


def exit_code_of(report: DataFrame) -> int:
    """exit_code() from reports()."""
    top = report.agg(F.bool_or(F.col("status") == "ERROR").alias("error"), F.bool_or(F.col("status") == "FAIL").alias("fail")).first()
    return EXIT_ERROR if top.error else EXIT_FAILED if top.fail else EXIT_OK


#: Exit codes of a run over documents.
EXIT_OK, EXIT_FAILED, EXIT_ERROR = 0, 19, 5


def exit_code(docs: DataFrame, rules: Rules, document: str | None = None) -> int:
    """0 if nothing fails, 19 if a rule fails, 5 if a document can't be evaluated; one aggregate over one scan."""
    done = compile_rules(docs, rules, document)
    top = done.frame.agg(F.max(done.overall())).first()[0]
    return EXIT_ERROR if top == ERROR else EXIT_FAILED if top == FAIL else EXIT_OK
