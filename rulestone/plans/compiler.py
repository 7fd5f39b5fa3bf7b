"""Rules as Columns of statuses: 0 SKIP, 1 PASS, 2 FAIL, 3 ERROR.

Alternatives aside, every roll-up is a maximum, so an error outranks all as it ends an evaluation. In detail mode each
clause also gives an array of the checks that failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.builtin import FUNCTIONS
from .ast import Access, Block, Call, Filter, Key, KeyFilter, Literal, QueryBlock, Rule, RuleCall, RuleFile, RuleReference, TypeBlock, WhenBlock
from .compare import APART, FAILS, HOLDS, Side, compare, compare_literals, held_by, is_list, is_scalar, same, same_literals
from .parser import UNARY
from .query import (
    ERROR,
    FAIL,
    PASS,
    RESOLVED,
    SKIP,
    Lit,
    Many,
    One,
    Piece,
    Queries,
    Scope,
    UnsupportedRuleError,
    entry,
    many,
)
from .values import Val, as_list, as_map, both, canonical, choose, element, is_kind, json_text, kind_of_type, literal_text, literal_value, scalar

STATUSES = ("SKIP", "PASS", "FAIL", "ERROR")
CHECK = "struct<clause:string,line:int,column:int,path:string,value:string,compared:string,message:string,custom_message:string>"

#: Words of messages for a comparator, plain and negated.
SAID = {
    "==": ("not equal to", "equal to"),
    ">": ("not greater than", "greater than"),
    ">=": ("not greater than equal to", "greater than equal to"),
    "<": ("not less than", "less than"),
    "<=": ("not less than equal to", "less than equal to"),
    "in": ("not in", "in"),
    "exists": ("did not exist", "existed"),
    "empty": ("was not empty", "was empty"),
    "is_string": ("was not string", "was string"),
    "is_list": ("was not list", "was list"),
    "is_struct": ("was not struct", "was struct"),
    "is_bool": ("was not bool", "was bool"),
    "is_int": ("was not int", "was int"),
    "is_float": ("was not float", "was float"),
    "is_null": ("was not null", "was null"),
}


class RuleError(ValueError):
    """Rules that can't be compiled: unknown names, wrong numbers of arguments, rules that need themselves."""


@dataclass
class Node:
    status: Column
    checks: Column | None = None


def status_text(status: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), status + 1)


def event(context: Column, status: Column, children: Column) -> Column:
    """A record of the walk as JSON text. children: an array of such texts."""
    quoted = F.to_json(F.struct(context.alias("context"), status_text(status).alias("status")))
    return F.concat(F.regexp_replace(quoted, r"\}$", ""), F.lit(',"children":['), F.array_join(children, ","), F.lit("]}"))


def highest(statuses: list[Column], least: int = SKIP) -> Column:
    if not statuses:
        return F.lit(least)
    return F.greatest(F.lit(least), *statuses) if least or len(statuses) == 1 else F.greatest(*statuses)


@dataclass
class Outcomes:
    """Statuses of the values of a clause, in order: single Columns, and arrays. In detail mode struct<s, ...> each."""

    entries: list[tuple[bool, Column]] = field(default_factory=list)

    def one(self, outcome: Column) -> None:
        self.entries.append((False, outcome))

    def many(self, outcomes: Column) -> None:
        self.entries.append((True, outcomes))

    @property
    def ones(self) -> list[Column]:
        return [c for several, c in self.entries if not several]

    @property
    def arrays(self) -> list[Column]:
        return [c for several, c in self.entries if several]


class Compiler(Queries):
    def __init__(self, rules: RuleFile, detail: bool = False, compat: bool = True, trace: bool | str = False):
        super().__init__(detail, compat)
        self.rules, self.trace = rules, trace
        self.traces: list[tuple[str, str]] = []
        #: Internal columns with their levels; need: the level that what is being compiled may stand at, behind all it reads.
        self.layers: list[tuple[str, Column, int]] = []
        self.need = 0
        self.needs: dict[tuple[int, str], tuple[int, Scope]] = {}
        self.calls: list[str] = []
        self.references: dict[str, Column] = {}

    # -- plans

    def layer(self, name: str, column: Column) -> Column:
        """The column under a name of its own."""
        self.layers.append((name, column, self.need))
        self.need += 1
        return F.col(name)

    def variable(self, name: str, scope: Scope) -> list[Piece]:
        owner = scope.owner(name)
        outer, self.need = self.need, 0
        found = super().variable(name, scope)
        own, _ = self.needs.setdefault((id(owner), name), (self.need, owner))
        self.need = max(outer, own)
        return found

    def capture(self, part: Any, before: list[Any], scope: Scope) -> None:
        super().capture(part, before, scope)
        owner = scope if scope.in_lambda else scope.top()
        key = (id(owner), part.capture)
        self.needs[key] = (max(self.need, self.needs.get(key, (0, owner))[0]), owner)

    def keep(self, scope: Scope, pieces: list[Piece]) -> list[Piece]:
        """Arrays of file-level variables become columns of their own, so that each is computed once."""
        if scope.in_lambda or scope.parent is not None:
            return pieces
        kept: list[Piece] = []
        for p in pieces:
            if isinstance(p, Many):
                p = Many(self.layer(f"__let_{len(self.layers)}", p.array), p.type)
            kept.append(p)
        return kept

    def plan(self, df: DataFrame, root: Val) -> tuple[DataFrame, dict[str, tuple[str, str | None]]]:
        """df with a status column for each rule, and its checks in detail mode; names by rule, in file order."""
        top = Scope(root, lets={let.name: let.value for let in self.rules.lets})
        by_name: dict[str, list[Rule]] = {}
        for rule in self.rules.rules:
            by_name.setdefault(rule.name, []).append(rule)
        columns: dict[int, tuple[str, str | None]] = {}
        behind: dict[int, int] = {}
        active: list[str] = []

        def compiled(rule: Rule) -> tuple[str, str | None]:
            if id(rule) in columns:
                self.need = max(self.need, behind[id(rule)])
                return columns[id(rule)]
            if rule.name in active:
                raise RuleError(f"rule {rule.name} needs itself: {' -> '.join([*active, rule.name])}")
            active.append(rule.name)
            outer, self.need = self.need, 0
            node = self.rule(rule, Scope(top.root, top))
            active.pop()
            name = f"__rule_{len(columns)}"
            self.layer(name, node.status.cast("int"))
            behind[id(rule)] = self.need
            checks = None
            if node.checks is not None:
                checks = f"{name}_checks"
                self.layer(checks, F.when(F.col(name) >= FAIL, node.checks).otherwise(F.array().cast(f"array<{CHECK}>")))
            if self.trace:
                told = self.events if self.trace == "events" else self.traced
                self.layer(f"{name}_trace", told(rule, Scope(top.root, top)))
                self.traces.append((rule.name, f"{name}_trace"))
            columns[id(rule)] = (name, checks)
            self.need = max(outer, behind[id(rule)])
            return columns[id(rule)]

        def referred(name: str) -> Column:
            """The first status that isn't SKIP among rules of a name."""
            if name not in by_name:
                raise RuleError(f"no rule is called {name}")
            found = [F.col(compiled(r)[0]) for r in by_name[name]]
            status = F.lit(SKIP)
            for c in reversed(found):
                status = F.when(c != SKIP, c).otherwise(status)
            return status

        self.referred = referred
        out: dict[str, tuple[str, str | None]] = {}
        for i, rule in enumerate(self.rules.rules):
            label = rule.name if len(by_name[rule.name]) == 1 else f"{rule.name}#{[id(r) for r in by_name[rule.name]].index(id(rule)) + 1}"
            out[label if label not in out else f"{label}@{i}"] = compiled(rule)
        # as few projections as columns that read each other need
        for level in range(max((at for _, _, at in self.layers), default=-1) + 1):
            df = df.withColumns({name: column for name, column, at in self.layers if at == level})
        return df, out

    def traced(self, rule: Rule, scope: Scope) -> Column:
        """clause and status of each clause of a rule, conditions first; clauses behind a condition that doesn't PASS are
        SKIP. All alternatives are evaluated, those behind a PASS too."""
        inner = Scope(scope.root, scope, {let.name: let.value for let in rule.block.lets})
        conditions = [("when " + self.text_of(x), self.item(x, scope).status) for d in rule.conditions or [] for x in d]
        holds = F.lit(PASS) if rule.conditions is None else self.conjunction(rule.conditions, scope).status
        body = [(self.text_of(x), F.when(holds == PASS, self.item(x, inner).status).otherwise(SKIP)) for d in rule.block.clauses for x in d]
        return F.array(*[F.struct(F.lit(t).alias("clause"), status_text(c).alias("status")) for t, c in [*conditions, *body]])

    def events(self, rule: Rule, scope: Scope) -> Column:
        """The walk through a rule as JSON text: context, status and children, of conditions, clauses, and of blocks for
        each of their values."""
        children = [self.event_of(x, scope) for d in rule.conditions or [] for x in d]
        inner = Scope(scope.root, scope, {let.name: let.value for let in rule.block.lets})
        holds = F.lit(PASS) if rule.conditions is None else self.conjunction(rule.conditions, scope).status
        body = F.when(holds == PASS, F.array(*[self.event_of(x, inner) for d in rule.block.clauses for x in d])).otherwise(F.array().cast("array<string>"))
        return event(F.lit(f"rule {rule.name}"), self.rule(rule, scope).status, F.concat(F.array(*children).cast("array<string>"), body))

    def event_of(self, item: Any, scope: Scope) -> Column:
        status, context = self.item(item, scope).status, F.lit(self.text_of(item))
        if isinstance(item, WhenBlock):
            inner = Scope(scope.root, scope, {let.name: let.value for let in item.block.lets})
            conditions = [self.event_of(x, scope) for d in item.conditions for x in d]
            holds = self.conjunction(item.conditions, scope).status == PASS
            body = F.array(*[self.event_of(x, inner) for d in item.block.clauses for x in d])
            return event(context, status, F.concat(F.array(*conditions), F.when(holds, body).otherwise(F.array().cast("array<string>"))))
        if isinstance(item, (QueryBlock, TypeBlock)):
            values = many(self.run(item.query.parts, scope))

            def of(e: Column) -> Column:
                own = Scope(Val(e["v"], values.type, e["p"] if self.detail else None), scope, in_lambda=True)
                inner = Scope(own.root, own, {let.name: let.value for let in item.block.lets})
                body = F.array(*[self.event_of(x, inner) for d in item.block.clauses for x in d])
                lost = event(F.lit("unresolved"), F.lit(FAIL), F.array().cast("array<string>"))
                return F.when(e["k"] == RESOLVED, event(F.lit("block"), self.block(item.block, own).status, body)).otherwise(lost)

            return event(context, status, F.transform(values.array, of))
        return event(context, status, F.array().cast("array<string>"))

    @staticmethod
    def text_of(item: Any) -> str:
        if isinstance(item, Access):
            return item.text
        if isinstance(item, QueryBlock):
            return f"{item.query.text} {{ ... }}"
        if isinstance(item, TypeBlock):
            return f"{item.type_name} {{ ... }}"
        if isinstance(item, WhenBlock):
            return "when ... { ... }"
        called = f"{item.name}(...)" if isinstance(item, RuleCall) else item.name
        return f"not {called}" if item.inverse else called

    # -- rules and blocks

    def rule(self, rule: Rule, scope: Scope) -> Node:
        body = self.block(rule.block, scope)
        return body if rule.conditions is None else self.when(rule.conditions, body, scope)

    def when(self, conditions: list[list[Any]], body: Node, scope: Scope) -> Node:
        condition = self.conjunction(conditions, scope).status
        status = F.when(condition == PASS, body.status).when(condition == ERROR, ERROR).otherwise(SKIP)
        checks = None if body.checks is None else F.when(condition == PASS, body.checks).otherwise(self.no_checks())
        return Node(status, checks)

    def block(self, block: Block, scope: Scope) -> Node:
        inner = Scope(scope.root, scope, {let.name: let.value for let in block.lets}) if block.lets else scope
        return self.conjunction(block.clauses, inner)

    def no_checks(self) -> Column:
        return F.array().cast(f"array<{CHECK}>")

    def clauses(self, clauses: list[list[Any]], scope: Scope) -> Column:
        detail, self.detail = self.detail, False
        try:
            return self.conjunction(clauses, scope).status
        finally:
            self.detail = detail

    def conjunction(self, clauses: list[list[Any]], scope: Scope) -> Node:
        nodes = [self.disjunction(d, scope) for d in clauses]
        checks = F.concat(*[n.checks for n in nodes]) if self.detail and nodes else self.no_checks() if self.detail else None
        return Node(highest([n.status for n in nodes]), checks)

    def disjunction(self, items: list[Any], scope: Scope) -> Node:
        nodes = [self.item(x, scope) for x in items]
        if len(nodes) == 1:
            return nodes[0]
        # the first PASS or error ends the walk, so it outranks what stands behind it; each status is read once, as it may be
        # a whole block with alternatives of its own
        ranked = []
        for i, n in enumerate(nodes):
            above = 4 * (len(nodes) - i)
            ranked.append(F.get(F.array(*map(F.lit, (SKIP, above + PASS, FAIL, above + ERROR))), n.status.cast("int")))
        status = F.greatest(*ranked).bitwiseAND(3)
        if not self.detail:
            return Node(status)
        return Node(status, F.when(status == PASS, self.no_checks()).otherwise(F.concat(*[n.checks for n in nodes])))

    def item(self, item: Any, scope: Scope) -> Node:
        if isinstance(item, Access):
            return self.access(item, scope)
        if isinstance(item, QueryBlock):
            return self.query_block(item.query.parts, item.query.every, item.block, scope, not_empty=item.not_empty, text=item.query.text, location=item.location)
        if isinstance(item, WhenBlock):
            return self.when(item.conditions, self.block(item.block, scope), scope)
        if isinstance(item, TypeBlock):
            body = self.query_block(item.query.parts, True, item.block, scope, strict=True, text=item.query.text, location=item.location)
            return body if item.conditions is None else self.when(item.conditions, body, scope)
        if isinstance(item, RuleReference):
            return self.reference(item)
        return self.rule_call(item, scope)

    def reference(self, item: RuleReference) -> Node:
        own = self.referred(item.name)
        passed, other = (FAIL, PASS) if item.inverse else (PASS, FAIL)
        status = F.when(own == ERROR, ERROR).when(own == PASS, passed).otherwise(other)
        if not self.detail:
            return Node(status)
        message = f"Check was not compliant as dependent rule [{item.name}] did not PASS. Context [{item.name}]"
        check = self.check(item.name, item.location, F.lit(""), F.lit(None), F.lit(None), F.lit(message), item.message)
        return Node(status, F.when(status == FAIL, F.array(check)).otherwise(self.no_checks()))

    def rule_call(self, item: RuleCall, scope: Scope) -> Node:
        macro = self.rules.macros.get(item.name)
        if macro is None:
            raise RuleError(f"no rule with parameters is called {item.name}")
        if len(macro.parameters) != len(item.arguments):
            raise RuleError(f"rule {item.name} takes {len(macro.parameters)} arguments, not {len(item.arguments)}")
        if item.name in self.calls:
            raise RuleError(f"rule {item.name} calls itself")
        inner = Scope(scope.root, scope)
        for name, value in zip(macro.parameters, item.arguments, strict=True):
            found = self.value(value, scope)
            if isinstance(value, Literal) and (own := literal_value(value)) is not None:
                found = [One(own)]
            inner.known[name] = found
        self.calls.append(item.name)
        try:
            return self.rule(macro, inner)
        finally:
            self.calls.pop()

    def query_block(self, parts: list[Any], every: bool, block: Block, scope: Scope, *, not_empty: bool = False, strict: bool = False, text: str = "", location: Any = None) -> Node:
        """The block's status for each value of a query. strict: an unresolved value is an error, as with types."""
        pieces = self.run(parts, scope)
        missing = ERROR if strict else FAIL
        ones: list[Column] = []
        arrays: list[Column] = []
        checks: list[Column] = []
        sizes: list[Column] = []
        always = False
        unresolved_message = f"Check was not compliant as property [{text}] is missing."

        def lost(path: Column | None) -> Column:
            return F.array(self.check(text, location, path, F.lit(None), F.lit(None), F.lit(unresolved_message), None))

        for p in pieces:
            if isinstance(p, Lit):
                own = literal_value(p.literal)
                if own is None:
                    raise UnsupportedRuleError("a block of a pattern or range")
                p = One(own)
            if isinstance(p, One):
                always = True
                if p.ok is False:
                    ones.append(F.lit(missing))
                    if self.detail:
                        checks.append(lost(p.val.path))
                    continue
                node = self.block(block, Scope(p.val, scope))
                ones.append(node.status if p.ok is True else F.when(p.ok, node.status).otherwise(missing))
                if self.detail:
                    checks.append(node.checks if p.ok is True else F.when(p.ok, node.checks).otherwise(lost(p.val.path)))
                continue
            sizes.append(F.size(p.array))

            def node_of(e: Column) -> Node:
                return self.block(block, Scope(Val(e["v"], p.type, e["p"] if self.detail else None), scope, in_lambda=True))

            def status_of(e: Column, node: Node) -> Column:
                return F.when(e["k"] == RESOLVED, node.status).when(e["k"] == ERROR, ERROR).otherwise(missing).cast("int")

            if not self.detail:
                arrays.append(F.transform(p.array, lambda e: status_of(e, node_of(e))))
                continue

            def told(e: Column) -> Column:
                node = node_of(e)
                own = F.when(e["k"] == RESOLVED, node.checks).otherwise(lost(e["p"]))
                return F.struct(status_of(e, node).alias("status"), own.alias("checks"))

            walked = F.transform(p.array, told)
            if not scope.in_lambda:
                # a column of its own, so that elements are walked once for statuses and checks
                walked = self.layer(f"__block_{len(self.layers)}", walked)
            arrays.append(F.transform(walked, lambda w: w["status"]))
            checks.append(F.flatten(F.transform(walked, lambda w: w["checks"])))
        if every:
            status = highest([*ones, *[F.coalesce(F.array_max(a), F.lit(SKIP)) for a in arrays]])
        else:
            everything = F.concat(*arrays, *([F.array(*[c.cast("int") for c in ones])] if ones else []))
            status = F.when(F.array_contains(everything, ERROR), ERROR).when(F.array_contains(everything, PASS), PASS).otherwise(F.coalesce(F.array_max(everything), F.lit(SKIP)))
        if not always:
            total = sum(sizes[1:], sizes[0]) if sizes else F.lit(0)
            status = F.when(total == 0, FAIL if not_empty else SKIP).otherwise(status)
        if not self.detail:
            return Node(status)
        own = F.concat(*checks) if checks else self.no_checks()
        if not_empty:
            message = F.lit("query for block clause did not retrieve any value")
            own = F.when((status == FAIL) & (F.size(own) == 0), F.array(self.check(text, location, F.lit(""), F.lit(None), F.lit(None), message, None))).otherwise(own)
        return Node(status, F.when(status >= FAIL, own).otherwise(self.no_checks()))

    # -- functions

    def call(self, call: Call, scope: Scope) -> list[Piece]:
        if call.name not in FUNCTIONS:
            raise RuleError(f"no function is called {call.name}")
        return FUNCTIONS[call.name]([self.value(a, scope) for a in call.arguments])

    # -- clauses

    def check(self, text: str, location: Any, path: Column | None, value: Column, compared: Column, message: Column, custom: str | None) -> Column:
        return F.struct(
            F.lit(text).alias("clause"),
            F.lit(location.line if location else 0).alias("line"),
            F.lit(location.column if location else 0).alias("column"),
            (F.lit("") if path is None else path).alias("path"),
            value.cast("string").alias("value"),
            compared.cast("string").alias("compared"),
            message.alias("message"),
            F.lit(custom).cast("string").alias("custom_message"),
        ).cast(CHECK)

    def outcome(self, status: Column | int, v: Side | None, compared: Side | None = None, missing: bool = False, path: Column | None = None) -> Column:
        status = (F.lit(status) if isinstance(status, int) else status).cast("int")
        if not self.detail:
            return status

        def shown(side: Side | None) -> Column:
            if side is None:
                return F.lit(None).cast("string")
            return F.lit(literal_text(side)) if isinstance(side, Literal) else json_text(side).cast("string")

        own = path if path is not None else (v.path if isinstance(v, Val) else None)
        return F.struct(
            status.alias("s"), (F.lit("") if own is None else own).alias("p"), shown(v).alias("v"), shown(compared).alias("c"), F.lit(missing).alias("m")
        )

    def access(self, a: Access, scope: Scope) -> Node:
        pieces = self.run(a.query.parts, scope)
        if a.comparator in UNARY:
            return self.unary(a, pieces)
        right = self.value(a.value, scope)
        found = self.binary(a.comparator, a.negated, pieces, right)
        node = self.rolled_up(a, found)
        empty = self.is_empty(pieces)
        other = self.is_empty(right)
        if empty is False and other is False:
            return node
        nothing_there = F.lit(True) if empty is True or other is True else empty if other is False else other if empty is False else empty | other
        status = F.when(self.has_error(pieces) | self.has_error(right), ERROR).when(nothing_there, SKIP).otherwise(node.status)
        return Node(status, None if node.checks is None else F.when(status >= FAIL, node.checks).otherwise(self.no_checks()))

    @staticmethod
    def is_empty(pieces: list[Piece]) -> Column | bool:
        if not pieces:
            return True
        if any(not isinstance(p, Many) for p in pieces):
            return False
        total = F.size(pieces[0].array)
        for p in pieces[1:]:
            total = total + F.size(p.array)
        return total == 0

    @staticmethod
    def has_error(pieces: list[Piece]) -> Column:
        found = F.lit(False)
        for p in pieces:
            if isinstance(p, Many):
                found = found | F.exists(p.array, lambda e: e["k"] == ERROR)
        return found

    def rolled_up(self, a: Access, found: Outcomes) -> Node:
        ones = [c["s"] for c in found.ones] if self.detail else found.ones

        def status(x: Column) -> Column:
            return F.transform(x, lambda e: e["s"]) if self.detail else x

        if a.query.every:
            tops = [F.coalesce(F.array_max(status(x)), F.lit(PASS)) for x in found.arrays]
            result = highest([*ones, *tops], PASS)
        elif not found.arrays:
            passed = F.lit(False)
            wrong = F.lit(False)
            for c in ones:
                passed, wrong = passed | (c == PASS), wrong | (c == ERROR)
            result = F.when(wrong, ERROR).when(passed, PASS).otherwise(FAIL)
        else:
            everything = F.concat(*map(status, found.arrays), *([F.array(*ones)] if ones else []))
            result = F.when(F.array_contains(everything, ERROR), ERROR).when(F.array_contains(everything, PASS), PASS).otherwise(FAIL)
        if not self.detail:
            return Node(result)
        said = SAID[a.comparator][a.negated]
        unary = a.comparator in UNARY

        def told(e: Column) -> Column:
            shown = F.concat(F.lit("[Path="), e["p"], F.lit(" Value="), F.coalesce(e["v"], F.lit("null")), F.lit("]"))
            lost = f"Check was not compliant as property [{a.query.text}] " + ("is missing." if unary else "to compare from is missing.")
            if unary:
                plain = F.concat(F.lit("Check was not compliant as property ["), e["p"], F.lit(f"] {said}."))
            elif a.comparator == "in":
                plain = F.concat(F.lit("Check was not compliant as property ["), e["p"], F.lit(f"] was {'' if a.negated else 'not '}present in ["), F.coalesce(e["c"], F.lit("")), F.lit("]"))
            else:
                plain = F.concat(F.lit("Check was not compliant as property value "), shown, F.lit(f" {said} value ["), F.coalesce(e["c"], F.lit("")), F.lit("]."))
            return self.check(a.text, a.location, e["p"], e["v"], e["c"], F.when(e["m"], F.lit(lost)).otherwise(plain), a.message)

        parts = [
            F.transform(F.filter(c, lambda e: e["s"] >= FAIL), told) if several else F.when(c["s"] >= FAIL, F.array(told(c))).otherwise(self.no_checks())
            for several, c in found.entries
        ]
        checks = self.no_checks() if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)
        alone = len(parts) == 1 and a.query.every  # the checks are empty then unless the clause fails
        return Node(result, checks if alone else F.when(result >= FAIL, checks).otherwise(self.no_checks()))

    def add(self, found: Outcomes, outcome: Column) -> None:
        found.one(outcome)

    # unary

    def unary(self, a: Access, pieces: list[Piece]) -> Node:
        last = a.query.parts[-1]
        on_selection = isinstance(last, (Filter, KeyFilter)) or (isinstance(last, Key) and last.variable is not None and len(a.query.parts) == 1)
        flip = a.negated != a.inverse
        found = Outcomes()

        def settled(true: Column | bool) -> Column:
            if isinstance(true, bool):
                return F.lit(PASS if true != flip else FAIL)
            return F.when(true, FAIL if flip else PASS).otherwise(PASS if flip else FAIL)

        def test(v: Side | None) -> Column:
            """v: None for an unresolved value."""
            if a.comparator == "empty" and on_selection:
                if v is None:
                    return settled(True)
                return settled(v.kind == "null" if isinstance(v, Literal) else is_kind(v, "null"))
            if v is None:
                return settled(a.comparator == "empty")
            if a.comparator == "exists":
                return settled(True)
            if a.comparator == "empty":
                return self.emptiness(v, settled)
            kind = {"is_struct": "map"}.get(a.comparator, a.comparator.removeprefix("is_"))
            return settled(v.kind == kind if isinstance(v, Literal) else is_kind(v, kind))

        for p in pieces:
            if isinstance(p, Lit):
                self.add(found, self.outcome(test(p.literal), p.literal))
            elif isinstance(p, One):
                here, lost = test(p.val) if p.ok is not False else None, test(None)
                if p.ok is True:
                    self.add(found, self.outcome(here, p.val))
                elif p.ok is False:
                    self.add(found, self.outcome(lost, None, missing=True, path=p.val.path))
                elif self.detail:
                    gone = self.outcome(lost, None, missing=True, path=p.val.path)
                    self.add(found, F.when(p.ok, self.outcome(here, p.val)).otherwise(gone))
                else:
                    self.add(found, F.when(p.ok, here).otherwise(lost).cast("int"))
            else:

                def each(e: Column) -> Column:
                    v = Val(e["v"], p.type, e["p"])
                    gone = self.outcome(F.when(e["k"] == ERROR, ERROR).otherwise(test(None)), None, missing=True, path=e["p"])
                    return F.when(e["k"] == RESOLVED, self.outcome(test(v), v)).otherwise(gone)

                found.many(F.transform(p.array, each))
        node = self.rolled_up(a, found)
        empty = self.is_empty(pieces)
        if empty is False:
            return node
        without = SKIP
        if a.comparator == "empty" and on_selection:
            without = PASS if not flip else FAIL
        status = F.when(F.lit(True) if empty is True else empty, without).otherwise(node.status)
        if node.checks is None:
            return Node(status)
        message = F.lit(f"Check was not compliant as variable in context [{a.query.text}] was not empty")
        if flip:
            message = F.lit(f"Check was not compliant as variable in context [{a.query.text}] was empty")
        one = F.array(self.check(a.text, a.location, F.lit(""), F.lit(None), F.lit(None), message, a.message))
        return Node(status, F.when((status == FAIL) & (F.size(node.checks) == 0), one).when(status >= FAIL, node.checks).otherwise(self.no_checks()))

    @staticmethod
    def emptiness(v: Side, settled: Callable[[Column | bool], Column]) -> Column:
        """Ints, floats and nulls can't be asked: an error."""
        if isinstance(v, Literal):
            if v.kind == "bool":
                return settled(False)
            return settled(not v.value) if v.kind in ("string", "list", "map") else F.lit(ERROR)
        own = kind_of_type(v.type)
        cases: list[tuple[Column | bool, Column]] = []
        if own in (None, "list"):
            cases.append((is_kind(v, "list"), settled(F.size(as_list(v)) == 0)))
        if own == "map":
            cases.append((is_kind(v, "map"), settled(False if isinstance(v.type, T.StructType) else F.size(v.col) == 0)))
        elif own is None:
            cases.append((is_kind(v, "map"), settled(F.size(as_map(v)) == 0)))
        if own in (None, "string"):
            cases.append((is_kind(v, "string"), settled(scalar(v, "string") == "")))
        if own in (None, "bool"):
            cases.append((is_kind(v, "bool"), settled(False)))
        return choose(cases, F.lit(ERROR))

    # binary

    def binary(self, op: str, negated: bool, left: list[Piece], right: list[Piece]) -> Outcomes:
        one_left = left[0].literal if len(left) == 1 and isinstance(left[0], Lit) else None
        one_right = right[0].literal if len(right) == 1 and isinstance(right[0], Lit) else None
        found = Outcomes()
        if not left or not right:
            return found
        if op in ("<", "<=", ">", ">="):
            self.ordered(op, left, right, found)
        elif op == "==":
            if one_left is not None and one_right is not None:
                self.add(found, self.outcome(self.verdict(compare("==", one_left, one_right), negated), one_left, one_right))
            elif one_right is not None:
                self.each(left, lambda v: self.equal_to_literal(v, one_right, negated), one_right, found)
            elif one_left is not None:
                self.each(right, lambda v: self.literal_equal_to(one_left, v, negated), one_left, found)
            else:
                self.as_sets("==", left, right, negated, found)
        elif one_left is not None and one_right is not None:
            self.add(found, self.outcome(self.literal_in_literal(one_left, one_right, negated), one_left, one_right))
        elif one_right is not None:
            self.each(left, lambda v: self.in_literal(v, one_right, negated), one_right, found)
        elif one_left is not None:
            self.literal_in(one_left, right, negated, found)
        else:
            self.as_sets("in", left, right, negated, found)
        return found

    @staticmethod
    def verdict(compared: Column, negated: bool) -> Column:
        """What isn't comparable fails, negated or not."""
        return F.when(compared == (FAILS if negated else HOLDS), PASS).otherwise(FAIL)

    def each(self, pieces: list[Piece], test: Callable[[Side], Column], compared: Side | None, found: Outcomes) -> None:
        """test gives a status, or an array of statuses where a value is a list that is taken apart."""
        for p in pieces:
            if isinstance(p, Lit):
                self.put(found, test(p.literal), p.literal, compared)
            elif isinstance(p, One):
                if p.ok is False:
                    self.add(found, self.outcome(FAIL, None, compared, True, p.val.path))
                    continue
                own = test(p.val)
                if p.ok is True:
                    self.put(found, own, p.val, compared)
                elif isinstance(own, tuple):
                    gone = F.array(self.outcome(FAIL, None, compared, True, p.val.path))
                    found.many(F.when(p.ok, self.spread(own, p.val, compared)).otherwise(gone))
                else:
                    gone = self.outcome(FAIL, None, compared, True, p.val.path)
                    self.add(found, F.when(p.ok, self.outcome(own, p.val, compared)).otherwise(gone))
            else:

                def step(e: Column) -> Column:
                    v = Val(e["v"], p.type, e["p"])
                    gone = self.outcome(F.when(e["k"] == ERROR, ERROR).otherwise(FAIL), None, compared, True, e["p"])
                    own = test(v)
                    if isinstance(own, tuple):
                        return F.when(e["k"] == RESOLVED, self.spread(own, v, compared)).otherwise(F.array(gone))
                    return F.when(e["k"] == RESOLVED, self.outcome(own, v, compared)).otherwise(gone)

                apart = isinstance(test(Val(F.lit(None), p.type)), tuple)
                stepped = F.transform(p.array, step)
                found.many(F.flatten(stepped) if apart else stepped)

    def put(self, found: Outcomes, own: Column | tuple, v: Side, compared: Side | None) -> None:
        if isinstance(own, tuple):
            found.many(self.spread(own, v, compared))
        else:
            self.add(found, self.outcome(own, v, compared))

    def spread(self, own: tuple, v: Side, compared: Side | None) -> Column:
        """own: (whether v is a list, test of an element, status of v itself)."""
        condition, test, alone = own
        if isinstance(v, Literal):
            return F.array(*[self.outcome(test(x), x, compared) for x in v.value])
        items = F.transform(as_list(v), lambda x: self.outcome(test(Val(x, element(v), v.path)), Val(x, element(v), v.path), compared))
        if condition is True:
            return items
        return F.when(condition, items).otherwise(F.array(self.outcome(alone, v, compared)))

    def equal_to_literal(self, v: Side, lit: Literal, negated: bool) -> Column | tuple:
        if lit.kind == "list":
            whole = self.verdict(compare("==", v, lit), negated)
            if len(lit.value) != 1:
                return whole
            single = self.verdict(compare("==", v, lit.value[0]), negated)
            return choose([(is_scalar(v), single)], whole)

        def alone(x: Side) -> Column:
            return self.verdict(compare("==", x, lit), negated)

        condition = is_list(v)
        return alone(v) if condition is False else (condition, alone, alone(v))

    def literal_equal_to(self, lit: Literal, v: Side, negated: bool) -> Column | tuple:
        def alone(x: Side) -> Column:
            return self.verdict(compare("==", lit, x), negated)

        condition = False if lit.kind == "list" else is_list(v)
        return alone(v) if condition is False else (condition, alone, alone(v))

    # in

    def contained(self, v: Side, right: Side, negated: bool) -> Column:
        """Status of `v in right` for a value and a value."""
        if isinstance(v, Literal) and isinstance(right, Literal):
            return F.lit(contained_literals(v, right, negated))
        right_list, v_list = is_list(right), is_list(v)

        def among(x: Side) -> Column:
            if isinstance(right, Literal):
                return held_by(x, right.value)
            return F.exists(as_list(right), lambda e: same(x, Val(e, element(right))))

        plain = self.verdict(compare("==", v, right), negated)
        held = choose([(right_list, F.when(among(v), FAIL if negated else PASS).otherwise(PASS if negated else FAIL))], plain) if right_list is not False else plain
        if v_list is False:
            return held
        if isinstance(v, Literal):
            items: list[Side] = list(v.value)
            kept = [among(x) for x in items] if right_list is not False else []
            every, some = F.lit(True), F.lit(False)
            for k in kept:
                every, some = every & k, some | k
            size = F.lit(len(items))
        elif right_list is False:
            return choose([(v_list, F.lit(FAIL))], held)
        else:
            flags = F.transform(as_list(v), lambda e: among(Val(e, element(v))))
            every, some = ~F.exists(flags, lambda k: ~k), F.exists(flags, lambda k: k)
            size = F.size(as_list(v))
        if right_list is False:
            return choose([(v_list, F.lit(FAIL))], held)
        subset = F.when(every, FAIL).when(some, FAIL).otherwise(PASS) if negated else F.when(every, PASS).otherwise(FAIL)
        whole = F.when(among(v), FAIL).when(size == 0, PASS).otherwise(FAIL) if negated else F.when(among(v), PASS).otherwise(FAIL)
        if isinstance(right, Literal):
            lists = whole if right.value and right.value[0].kind == "list" else subset
        else:
            first = F.get(as_list(right), F.lit(0))
            lists = choose([(both(is_kind(Val(first, element(right)), "list"), F.size(as_list(right)) > 0), whole)], subset)
        return choose([(v_list, choose([(right_list, lists)], F.lit(FAIL)))], held)

    def in_literal(self, v: Side, lit: Literal, negated: bool) -> Column | tuple:
        if lit.kind != "string":
            return self.contained(v, lit, negated)

        def alone(x: Side) -> Column:
            if isinstance(x, Literal):
                held = x.kind == "string" and x.value in lit.value
                return F.lit((FAIL if negated else PASS) if held else (PASS if negated and x.kind == "string" else FAIL))
            condition = is_kind(x, "string")
            if condition is False:
                return F.lit(FAIL)
            held = F.contains(F.lit(lit.value), scalar(x, "string"))
            return choose([(condition, F.when(held, FAIL if negated else PASS).otherwise(PASS if negated else FAIL))], F.lit(FAIL))

        condition = is_list(v)
        return alone(v) if condition is False else (condition, alone, alone(v))

    def literal_in_literal(self, left: Literal, right: Literal, negated: bool) -> Column:
        if left.kind == right.kind == "string" and left.value in right.value:
            return F.lit(FAIL if negated else PASS)
        return self.contained(left, right, negated)

    def literal_in(self, lit: Literal, right: list[Piece], negated: bool, found: Outcomes) -> None:
        own = many(right)
        lists = is_kind(Val(F.lit(None), own.type), "list") if kind_of_type(own.type) is not None else None
        if lit.kind != "list":
            self.each(right, lambda v: self.contained(lit, v, negated), lit, found)
            return
        resolved = F.filter(own.array, lambda e: e["k"] == RESOLVED)
        if isinstance(lists, Column):
            lists = None
        any_list = F.exists(resolved, lambda e: F.lit(lists) if isinstance(lists, bool) else F.coalesce(is_kind(Val(e["v"], own.type), "list"), F.lit(False)))
        kept = [F.exists(resolved, lambda e: same(x, Val(e["v"], own.type))) for x in lit.value]
        every = F.lit(True)
        for k in kept:
            every = every & k
        # under negation the literal as a whole counts as what is left over, unless nothing is
        whole = F.lit(FAIL) if negated else F.when(every, PASS).otherwise(FAIL)
        lost = F.transform(F.filter(own.array, lambda e: e["k"] != RESOLVED), lambda e: self.outcome(FAIL, lit))
        at_once = F.concat(lost, F.array(self.outcome(whole, lit)))
        if lists is False:
            found.many(at_once)
            return

        def one(e: Column) -> Column:
            return self.outcome(F.when(e["k"] == RESOLVED, self.contained(lit, Val(e["v"], own.type), negated)).otherwise(FAIL), lit)

        found.many(F.when(any_list, F.transform(own.array, one)).otherwise(at_once))

    def as_sets(self, op: str, left: list[Piece], right: list[Piece], negated: bool, found: Outcomes) -> None:
        """Two queries: one status for all values, and a failure for each that is unresolved."""
        if not self.detail and len(left) == len(right) == 1 and isinstance(left[0], One) and isinstance(right[0], One) and left[0].ok is True and right[0].ok is True:
            a, b = left[0].val, right[0].val
            if is_list(a) is False and is_list(b) is False:
                equal = same(a, b)
                self.add(found, F.when(equal, FAIL if negated else PASS).otherwise(PASS if negated else FAIL).cast("int"))
                return
        a, b = many(left), many(right)
        missing_left = F.transform(F.filter(a.array, lambda e: e["k"] != RESOLVED), lambda e: self.outcome(F.when(e["k"] == ERROR, ERROR).otherwise(FAIL), None, None, True, e["p"]))
        resolved_left = F.filter(a.array, lambda e: e["k"] == RESOLVED)
        resolved_right = F.filter(b.array, lambda e: e["k"] == RESOLVED)
        lost = F.filter(b.array, lambda e: e["k"] != RESOLVED)
        missing_right = F.flatten(F.transform(lost, lambda r: F.transform(resolved_left, lambda e: self.outcome(F.when(r["k"] == ERROR, ERROR).otherwise(FAIL), Val(e["v"], a.type, e["p"])))))
        if op == "==":
            x = F.transform(resolved_left, lambda e: canonical(Val(e["v"], a.type)))
            y = F.transform(resolved_right, lambda e: canonical(Val(e["v"], b.type)))
            x_more = F.size(x) > F.size(y)
            diff = F.when(x_more, F.array_except(x, y)).otherwise(F.array_except(y, x))
            if negated:
                other = F.when(F.size(b.array) >= F.size(a.array), F.array_except(y, diff)).otherwise(F.array_except(x, diff))
                status = F.when(F.size(diff) == 0, FAIL).when(F.size(other) == 0, PASS).otherwise(FAIL)
            else:
                status = F.when(F.size(diff) == 0, PASS).otherwise(FAIL)
        else:

            def inside(e: Column) -> Column:
                v = Val(e["v"], a.type)
                return F.exists(resolved_right, lambda r: self.contained(v, Val(r["v"], b.type), False) == PASS)

            flags = F.transform(resolved_left, inside)
            every, some = ~F.exists(flags, lambda k: ~k), F.exists(flags, lambda k: k)
            status = F.when(every | some, FAIL).otherwise(PASS) if negated else F.when(every, PASS).otherwise(FAIL)
        whole = self.outcome(status, None, None)
        if self.detail:
            shown = F.to_json(F.transform(resolved_left, lambda e: json_text(Val(e["v"], a.type)).cast("string")))
            compared = F.to_json(F.transform(resolved_right, lambda e: json_text(Val(e["v"], b.type)).cast("string")))
            first = F.coalesce(F.get(F.transform(resolved_left, lambda e: e["p"]), F.lit(0)), F.lit(""))
            whole = F.struct(status.cast("int").alias("s"), first.alias("p"), shown.alias("v"), compared.alias("c"), F.lit(False).alias("m"))
        found.many(F.concat(missing_left, missing_right, F.array(whole)))

    # order

    def flat(self, pieces: list[Piece]) -> list[Piece]:
        """Lists are taken apart, one level."""
        found: list[Piece] = []
        for p in pieces:
            if isinstance(p, Lit):
                found += [Lit(x) for x in p.literal.value] if p.literal.kind == "list" else [p]
                continue
            t = p.type if isinstance(p, Many) else p.val.type
            kind = kind_of_type(t)
            if kind not in (None, "list"):
                found.append(p)
                continue
            own = many([p])

            def apart(e: Column) -> Column:
                v = Val(e["v"], own.type, e["p"])
                items = F.transform(as_list(v), lambda x: entry(RESOLVED, x, e["p"]))
                if kind_of_type(own.type) == "list":
                    lost = F.array(entry(e["k"], F.lit(None).cast(element(v)), e["p"]))
                    return F.when((e["k"] == RESOLVED) & e["v"].isNotNull(), items).otherwise(lost)
                return F.when((e["k"] == RESOLVED) & is_kind(v, "list"), items).otherwise(F.array(e))

            found.append(Many(F.flatten(F.transform(own.array, apart)), element(Val(F.lit(None), own.type))))
        return found

    def ordered(self, op: str, left: list[Piece], right: list[Piece], found: Outcomes) -> None:
        """Every value with every value."""
        left, right = self.flat(left), self.flat(right)
        if not right:
            return
        for r in right:
            if isinstance(r, Lit):
                self.each(left, lambda v, r=r: self.verdict(compare(op, v, r.literal), False), r.literal, found)
            elif isinstance(r, One):
                if r.ok is True:
                    self.each(left, lambda v, r=r: self.verdict(compare(op, v, r.val), False), r.val, found)
                else:
                    ok = F.lit(False) if r.ok is False else r.ok
                    self.each(left, lambda v, r=r, ok=ok: F.when(ok, self.verdict(compare(op, v, r.val), False)).otherwise(FAIL), None, found)
            else:
                own = many(left)

                def pairs(e: Column) -> Column:
                    v = Val(e["v"], own.type, e["p"])

                    def one(x: Column) -> Column:
                        w = Val(x["v"], r.type, x["p"])
                        lost = self.outcome(F.when(x["k"] == ERROR, ERROR).otherwise(FAIL), v)
                        return F.when(x["k"] == RESOLVED, self.outcome(self.verdict(compare(op, v, w), False), v, w)).otherwise(lost)

                    gone = F.array(self.outcome(F.when(e["k"] == ERROR, ERROR).otherwise(FAIL), None, None, True, e["p"]))
                    return F.when(e["k"] == RESOLVED, F.transform(r.array, one)).otherwise(gone)

                found.many(F.flatten(F.transform(own.array, pairs)))


def contained_literals(v: Literal, right: Literal, negated: bool) -> int:
    def held(x: Literal) -> bool:
        return any(same_literals(x, y) for y in right.value)

    if v.kind == "list":
        if right.kind != "list":
            return FAIL
        if right.value and right.value[0].kind == "list":
            inside = held(v)
            return (FAIL if inside else PASS if not v.value else FAIL) if negated else (PASS if inside else FAIL)
        kept = [held(x) for x in v.value]
        if negated:
            return FAIL if all(kept) or any(kept) else PASS
        return PASS if all(kept) else FAIL
    if right.kind == "list":
        return PASS if held(v) != negated else FAIL
    found = compare_literals("==", v, right)
    if found == APART:
        return FAIL
    return PASS if (found == HOLDS) != negated else FAIL
