"""Comparing two values, or a value and a literal: Columns of 1 (it holds), 0 (it doesn't) and -1 (not comparable).

Kinds are strict: an int never compares with a float. Only strings, ints, floats and chars are ordered; nulls are equal
to nulls; bools, lists and maps are equal or not.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import Literal
from .values import (
    SCALARS,
    VARIANT,
    Val,
    as_list,
    as_map,
    both,
    choose,
    element,
    is_kind,
    java_pattern,
    json_text,
    kind_of_type,
    literal_value,
    scalar,
)

HOLDS, FAILS, APART = 1, 0, -1
Side = Val | Literal


def flag(condition: Column | bool) -> Column:
    return F.lit(int(condition)) if isinstance(condition, bool) else F.when(condition, HOLDS).otherwise(FAILS)


def order(op: str, a: Column, b: Column) -> Column:
    return {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def within(v: Column, lit: Literal) -> Column:
    _, low, high, low_in, high_in = lit.value
    return (v >= low if low_in else v > low) & (v <= high if high_in else v < high)


def compare(op: str, a: Side, b: Side) -> Column:
    """op: ==, <, <=, > or >=."""
    if isinstance(a, Literal) and isinstance(b, Literal):
        return F.lit(compare_literals(op, a, b))
    if isinstance(a, Literal):
        return compare({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
    if isinstance(b, Literal):
        return _with_literal(op, a, b)
    cases = []
    for kind in ("string", "int", "float", "char"):
        one, other = is_kind(a, kind), is_kind(b, kind)
        if (alike := both(one, other)) is False:
            continue
        x, y = scalar(a, kind), scalar(b, kind)
        found = flag(order(op, x, y))
        if kind == "float":  # NaN compares with nothing
            found = F.when(F.isnan(x) | F.isnan(y), APART).otherwise(found)
        cases.append((alike, found))
    cases.append((both(is_kind(a, "null"), is_kind(b, "null")), F.lit(HOLDS if op in ("==", "<=", ">=") else FAILS)))
    if op == "==":
        cases.append((both(is_kind(a, "bool"), is_kind(b, "bool")), _bools(a, b)))
        for kind in ("list", "map"):
            cases.append((both(is_kind(a, kind), is_kind(b, kind)), flag(json_text(a) == json_text(b))))
    return choose(cases, F.lit(APART))


def _bools(a: Val, b: Val) -> Column:
    possible = both(is_kind(a, "bool"), is_kind(b, "bool"))
    return F.lit(FAILS) if possible is False else flag(scalar(a, "bool") == scalar(b, "bool"))


def _with_literal(op: str, v: Val, lit: Literal) -> Column:
    kind = lit.kind
    if kind in ("string", "int", "float", "char"):
        if is_kind(v, kind) is False:
            return F.lit(APART)
        own = scalar(v, kind)
        found = flag(order(op, own, F.lit(lit.value)))
        if kind == "float":
            found = F.when(F.isnan(own), APART).otherwise(found)
        return choose([(is_kind(v, kind), found)], F.lit(APART))
    if kind == "null":
        return choose([(is_kind(v, "null"), F.lit(HOLDS if op in ("==", "<=", ">=") else FAILS))], F.lit(APART))
    if op != "==":
        return F.lit(APART)
    if kind == "bool":
        return F.lit(APART) if is_kind(v, "bool") is False else choose([(is_kind(v, "bool"), flag(scalar(v, "bool") == F.lit(lit.value)))], F.lit(APART))
    if kind == "regex":
        if is_kind(v, "string") is False:
            return F.lit(APART)
        return choose([(is_kind(v, "string"), flag(scalar(v, "string").rlike(java_pattern(lit.value))))], F.lit(APART))
    if kind == "range":
        own = lit.value[0]
        if is_kind(v, own) is False:
            return F.lit(APART)
        return choose([(is_kind(v, own), flag(within(scalar(v, own), lit)))], F.lit(APART))
    if kind == "list":
        if is_kind(v, "list") is False:
            return F.lit(APART)
        own = as_list(v)
        each = [compare("==", Val(F.get(own, i), element(v)), x) for i, x in enumerate(lit.value)]
        return choose([(is_kind(v, "list"), F.when(F.size(own) != len(each), FAILS).otherwise(in_turn(each)))], F.lit(APART))
    if is_kind(v, "map") is False:
        return F.lit(APART)
    pairs = dict(lit.value)
    if isinstance(v.type, T.StructType):
        if set(v.type.names) != set(pairs):
            found = F.lit(FAILS)
        else:
            found = in_turn([compare("==", Val(v.col[k], v.type[k].dataType), x) for k, x in pairs.items()])
    else:
        own = as_map(v)
        t = VARIANT if v.dynamic else v.type.valueType
        same = F.size(own) == len(pairs)
        for k in pairs:
            same = same & F.map_contains_key(own, k)
        found = F.when(~same, FAILS).otherwise(in_turn([compare("==", Val(own[k], t), x) for k, x in pairs.items()]))
    return choose([(is_kind(v, "map"), found)], F.lit(APART))


def in_turn(each: list[Column]) -> Column:
    """All hold; the first that doesn't decides."""
    found = F.lit(HOLDS)
    for c in reversed(each):
        found = F.when(c == HOLDS, found).otherwise(c)
    return found


def same(a: Side, b: Side) -> Column:
    """Equality that is false for what isn't comparable, at any depth; what sets and lists of values go by."""
    if isinstance(a, Literal) and isinstance(b, Literal):
        return F.lit(same_literals(a, b))
    if isinstance(a, Literal):
        return same(b, a)
    return compare("==", a, b) == HOLDS


def held_by(v: Side, items: tuple[Literal, ...]) -> Column:
    """Whether a value is among literals."""
    if isinstance(v, Literal):
        return F.lit(any(same_literals(v, x) for x in items))
    found, by_kind = None, {}
    for x in items:
        by_kind.setdefault(x.kind, []).append(x)
    for kind, own in by_kind.items():
        if kind in ("string", "int", "float"):
            possible = is_kind(v, kind)
            if possible is False:
                continue
            here = scalar(v, kind).isin([x.value for x in own])
            here = here if possible is True else F.coalesce(possible & here, F.lit(False))
        else:
            here = None
            for x in own:
                here = same(v, x) if here is None else here | same(v, x)
        found = here if found is None else found | here
    return F.lit(False) if found is None else found


# -- literals with literals, settled when rules are compiled


def compare_literals(op: str, a: Literal, b: Literal) -> int:
    if op == "==":
        for s, r in ((a, b), (b, a)):
            if s.kind == "string" and r.kind == "regex":
                return int(re.search(r.value, s.value) is not None)
        if a.kind == b.kind and a.kind in ("bool", "regex"):
            return int(a.value == b.value)
        if a.kind == b.kind == "list":
            return FAILS if len(a.value) != len(b.value) else _turn(compare_literals(op, x, y) for x, y in zip(a.value, b.value, strict=True))
        if a.kind == b.kind == "map":
            x, y = dict(a.value), dict(b.value)
            return FAILS if x.keys() != y.keys() else _turn(compare_literals(op, x[k], y[k]) for k in x)
        if b.kind == "range" and a.kind == b.value[0]:
            _, low, high, low_in, high_in = b.value
            return int((a.value >= low if low_in else a.value > low) and (a.value <= high if high_in else a.value < high))
    if a.kind != b.kind or a.kind not in SCALARS or a.kind == "bool":
        return APART
    if a.kind == "float" and (math.isnan(a.value) or math.isnan(b.value)):
        return APART
    x, y = (0, 0) if a.kind == "null" else (a.value, b.value)
    return int({"==": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])


def _turn(found) -> int:
    return next((x for x in found if x != HOLDS), HOLDS)


def same_literals(a: Literal, b: Literal) -> bool:
    if a.kind == b.kind == "list":
        return len(a.value) == len(b.value) and all(map(same_literals, a.value, b.value))
    if a.kind == b.kind == "map":
        x, y = dict(a.value), dict(b.value)
        return x.keys() == y.keys() and all(same_literals(x[k], y[k]) for k in x)
    return compare_literals("==", a, b) == HOLDS


def value_of(side: Side) -> Val | None:
    return literal_value(side) if isinstance(side, Literal) else side


def is_list(side: Side) -> Column | bool:
    return side.kind == "list" if isinstance(side, Literal) else is_kind(side, "list")


def is_scalar(side: Side) -> Column | bool:
    if isinstance(side, Literal):
        return side.kind not in ("list", "map")
    own = kind_of_type(side.type)
    if own is None:
        return ~(is_kind(side, "list") | is_kind(side, "map"))
    if own in ("list", "map"):
        return side.col.isNull() if side.nullable else False
    return True
