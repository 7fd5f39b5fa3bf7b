"""Path queries as Columns.

A query's results are pieces, in the order in which they are found:

* Lit: a literal,
* One: exactly one result, a value that is there always (ok is True) or where ok holds; else it is unresolved,
* Many: an array of struct<k, p, v>: k is 1 for a resolved value, 0 for an unresolved one, 3 for an error; p is the path.

Steps over values of a plain type are settled when rules are compiled, so that a query of plain columns needs no arrays.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import AllIndices, AllValues, Filter, Index, Key, KeyFilter, Literal, This
from .compare import HOLDS, compare
from .values import (
    STRING,
    VARIANT,
    Val,
    as_list,
    as_map,
    choose,
    element,
    is_kind,
    kind_of_type,
    literal_value,
    scalar,
    to_variant,
)

RESOLVED, UNRESOLVED, ERROR = 1, 0, 3
SKIP, PASS, FAIL = 0, 1, 2


@dataclass
class Lit:
    literal: Literal


@dataclass
class One:
    val: Val
    ok: Column | bool = True


@dataclass
class Many:
    """bounded: every element is resolved."""

    array: Column
    type: T.DataType


Piece = Lit | One | Many


class UnsupportedRuleError(NotImplementedError):
    pass


# -- other spellings of a key


def words_of(key: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", lambda m: f"{m[1] or m[3]} {m[2] or m[4]}", key)
    return [w for w in re.split(r"[\s_\-]+", spaced) if w]


def singular(word: str) -> str:
    if re.search(r"(ss|us|is)$", word):
        return word
    for ending, instead in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("s", "")):
        if word.endswith(ending):
            return word[: -len(ending)] + instead
    return word


def spellings(key: str) -> list[str]:
    """Camel, class, kebab, pascal, snake, title and train case, in this order."""
    w = [x.lower() for x in words_of(key)]
    if not w:
        return []
    caps = [x.capitalize() for x in w]
    pascal = "".join(caps)
    return [w[0] + "".join(caps[1:]), "".join([*caps[:-1], singular(w[-1]).capitalize()]), "-".join(w), pascal, "_".join(w), " ".join(caps), "-".join(caps)]


# -- pieces


def entry(k: int | Column, v: Column, path: Column | None) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.struct(k.cast("int").alias("k"), (F.lit("") if path is None else path).alias("p"), v.alias("v"))


def nothing(t: T.DataType) -> Column:
    return F.lit(None).cast(t)


def joined(path: Column | None, key: str | Column) -> Column | None:
    if path is None:
        return None
    return F.concat(path, F.lit("/"), F.lit(key) if isinstance(key, str) else key)


def many(pieces: list[Piece], t: T.DataType | None = None) -> Many:
    """All pieces as one array, of one type: their own, if they share it, or else VARIANT."""
    found: list[tuple[Any, T.DataType]] = []
    for p in pieces:
        if isinstance(p, Lit):
            own = literal_value(p.literal)
            if own is None:
                raise UnsupportedRuleError("a pattern or range stands where values are gathered")
            p = One(own)
        found.append((p, p.type if isinstance(p, Many) else p.val.type))
    kinds = {x.json() for _, x in found if not isinstance(x, T.NullType)}
    t = t or (next(x for _, x in found if not isinstance(x, T.NullType)) if len(kinds) == 1 else VARIANT if kinds else T.NullType())

    def cast(v: Val) -> Column:
        if v.type == t:
            return v.col
        return nothing(t) if isinstance(v.type, T.NullType) and not isinstance(t, T.VariantType) else to_variant(v)

    arrays = []
    for p, own in found:
        if isinstance(p, One):
            resolved = entry(RESOLVED, cast(p.val), p.val.path)
            missing = entry(UNRESOLVED, nothing(t), p.val.path)
            arrays.append(F.array(resolved if p.ok is True else missing if p.ok is False else F.when(p.ok, resolved).otherwise(missing)))
        elif own == t:
            arrays.append(p.array)
        else:
            arrays.append(F.transform(p.array, lambda e: entry(e["k"], F.when(e["k"] == RESOLVED, cast(Val(e["v"], own))), e["p"])))
    if not arrays:
        return Many(F.array().cast(T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("p", STRING), T.StructField("v", t)]))), t)
    return Many(arrays[0] if len(arrays) == 1 else F.concat(*arrays), t)


def each_of(piece: Many, then: Callable[[Val], list[Piece]], detail: bool) -> list[Piece]:
    """The results of a step for every element; unresolved ones and errors go on as they are."""
    probe: dict[str, Any] = {}

    def step(e: Column) -> Column:
        found = then(Val(e["v"], piece.type, e["p"] if detail else None))
        probe["one"] = len(found) == 1 and isinstance(found[0], One)
        own = many(found)
        probe["type"] = own.type
        went_on = F.array(entry(e["k"], nothing(own.type), e["p"]))
        return F.when(e["k"] == RESOLVED, own.array).otherwise(went_on)

    array = F.flatten(F.transform(piece.array, step))
    return [Many(array, probe["type"])]


# -- scopes


class Scope:
    """Where names are looked up. root: the value that queries begin at."""

    def __init__(self, root: Val, parent: Scope | None = None, lets: dict[str, Any] | None = None, in_lambda: bool | None = None):
        self.root, self.parent, self.lets = root, parent, lets or {}
        self.known: dict[str, list[Piece]] = {}
        self.in_lambda = (parent.in_lambda if parent else False) if in_lambda is None else in_lambda

    def top(self) -> Scope:
        return self if self.parent is None else self.parent.top()

    def owner(self, name: str) -> Scope | None:
        if name in self.lets or name in self.known:
            return self
        return self.parent.owner(name) if self.parent else None


class Queries:
    """Compiles path queries. compat: filters behind `[*]` on a list see the enclosing value, as they always have."""

    def __init__(self, detail: bool = False, compat: bool = True):
        self.detail, self.compat = detail, compat

    # clauses() and call() come from the compiler

    def clauses(self, clauses: list[list[Any]], scope: Scope) -> Column:
        raise NotImplementedError

    def call(self, call: Any, scope: Scope) -> list[Piece]:
        raise NotImplementedError

    def keep(self, scope: Scope, pieces: list[Piece]) -> list[Piece]:
        """A chance to give a variable's Column a name of its own."""
        return pieces

    def value(self, value: Any, scope: Scope) -> list[Piece]:
        if isinstance(value, Literal):
            return [Lit(value)]
        if hasattr(value, "parts"):
            found = self.run(value.parts, scope)
            return found if value.every else self.resolved_only(found)
        return self.call(value, scope)

    def resolved_only(self, pieces: list[Piece]) -> list[Piece]:
        found: list[Piece] = []
        for p in pieces:
            if isinstance(p, Lit) or (isinstance(p, One) and p.ok is False):
                continue
            if isinstance(p, One) and p.ok is True:
                found.append(p)
            else:
                own = many([p])
                found.append(Many(F.filter(own.array, lambda e: e["k"] != UNRESOLVED), own.type))
        return found

    def variable(self, name: str, scope: Scope) -> list[Piece]:
        owner = scope.owner(name)
        if owner is None:
            raise UnsupportedRuleError(f"no variable %{name} is in sight")
        if name not in owner.known:
            owner.known[name] = [One(Val(F.lit(None), T.NullType()), False)]  # for a variable that needs itself
            owner.known[name] = self.keep(owner, self.value(owner.lets[name], owner))
        return owner.known[name]

    def run(self, parts: list[Any], scope: Scope) -> list[Piece]:
        for at, part in enumerate(parts):
            if getattr(part, "capture", None) and not (isinstance(part, Filter) and not isinstance(parts[at - 1], Key)):
                self.capture(part, parts[:at], scope)
        return self.found(parts, scope)

    def found(self, parts: list[Any], scope: Scope) -> list[Piece]:
        first = parts[0]
        if isinstance(first, Key) and first.variable:
            values = self.variable(first.variable, scope)
            rest = 2 if len(parts) > 1 and isinstance(parts[1], AllIndices) else 1
            if rest >= len(parts):
                return values
            found: list[Piece] = []
            for p in values:
                if isinstance(p, Lit):
                    own = literal_value(p.literal)
                    if own is None:
                        raise UnsupportedRuleError("a pattern or range has no parts")
                    p = One(own)
                if isinstance(p, One):
                    found += self.guarded(p, lambda v: self.steps(parts, rest, v, Scope(v, scope), None))
                else:
                    found += each_of(p, lambda v: self.steps(parts, rest, v, Scope(v, scope, in_lambda=True), None), self.detail)
            return found
        return self.steps(parts, 0, scope.root, scope, None)

    def guarded(self, p: One, then: Callable[[Val], list[Piece]]) -> list[Piece]:
        """A step of a value that may be unresolved."""
        if p.ok is True:
            return then(p.val)
        if p.ok is False:
            return [p]
        found = then(p.val)
        if len(found) == 1 and isinstance(found[0], One):
            own = found[0]
            return [One(own.val, p.ok if own.ok is True else False if own.ok is False else p.ok & own.ok)]
        own = many(found)
        missing = F.array(entry(UNRESOLVED, nothing(own.type), p.val.path))
        return [Many(F.when(p.ok, own.array).otherwise(missing), own.type)]

    def steps(self, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        """What parts[at:] find from v on. spelling: the way of writing keys that this path has settled on."""
        if at >= len(parts):
            return [One(v)]
        part = parts[at]
        if isinstance(part, This):
            return self.steps(parts, at + 1, v, scope, spelling)
        if isinstance(part, Key):
            if part.variable:
                return self.interpolated(parts, at, v, scope, spelling)
            if re.fullmatch(r"[+-]?\d+", part.name):
                return self.index(int(part.name), parts, at, v, scope, spelling)
            return self.key(part.name, parts, at, v, scope, spelling)
        if isinstance(part, Index):
            return self.index(part.at, parts, at, v, scope, spelling)
        if isinstance(part, (AllIndices, AllValues)):
            return self.all_of(part, parts, at, v, scope, spelling)
        if isinstance(part, Filter):
            return self.filtered(part, parts, at, v, scope, spelling)
        return self.by_key(part, parts, at, v, scope, spelling)

    # -- keys and indices

    def unresolved(self, v: Val) -> list[Piece]:
        return [One(Val(F.lit(None), T.NullType(), v.path), False)]

    def key(self, name: str, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        others = spellings(name)
        if isinstance(v.type, T.StructType) and kind_of_type(v.type) == "map":
            tried = [(name, spelling)] + ([(others[spelling], spelling)] if spelling is not None and others else [(o, i) for i, o in enumerate(others)] if spelling is None else [])
            for k, way in tried:
                if k in v.type.names:
                    own = Val(v.col[k], v.type[k].dataType, joined(v.path, k), v.nullable or v.type[k].nullable)
                    there = is_kind(v, "map")
                    return self.guarded(One(own, there), lambda x: self.steps(parts, at + 1, x, scope, way))
            return self.unresolved(v)
        names = list(dict.fromkeys([name, *others]))
        if isinstance(v.type, T.MapType):
            has = [F.map_contains_key(v.col, k) for k in names]
            own = Val(F.coalesce(*[v.col[k] for k in names]), v.type.valueType, joined(v.path, name))
            there = is_kind(v, "map")
            any_has = has[0]
            for h in has[1:]:
                any_has = any_has | h
            ok = any_has if there is True else F.coalesce(there & any_has, F.lit(False))
            return self.guarded(One(own, ok), lambda x: self.steps(parts, at + 1, x, scope, spelling))
        if not v.dynamic:
            return self.unresolved(v)
        found = F.coalesce(*[self.member(v, k) for k in names])
        own = Val(found, VARIANT, joined(v.path, name), nullable=False)
        return self.guarded(One(own, found.isNotNull()), lambda x: self.steps(parts, at + 1, x, scope, spelling))

    @staticmethod
    def member(v: Val, key: str) -> Column:
        if "'" in key or "\\" in key or '"' in key:
            return F.get(F.array(as_map(v)), F.lit(0))[key]
        return F.try_variant_get(v.col, f"$['{key}']", "variant")

    def index(self, i: int, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        i = abs(i)
        if v.dynamic:
            found = F.try_variant_get(v.col, f"$[{i}]", "variant")
            own, ok = Val(found, VARIANT, joined(v.path, str(i)), nullable=False), found.isNotNull()
        elif isinstance(v.type, T.ArrayType):
            own = Val(F.get(v.col, F.lit(i)), v.type.elementType, joined(v.path, str(i)))
            ok = F.coalesce(F.size(v.col) > i, F.lit(False))
        else:
            return self.unresolved(v)
        return self.guarded(One(own, ok), lambda x: self.steps(parts, at + 1, x, scope, spelling))

    def interpolated(self, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        """A key for each value of a variable: a lookup join within the document."""
        if is_kind(v, "map") is False:
            return self.unresolved(v)
        values = self.variable(parts[at].variable, scope)
        then = at + 1
        following = parts[then] if then < len(parts) else None
        keys: list[Piece] = values
        if isinstance(following, Index):
            own = many(values)
            keys = [Many(F.slice(own.array, abs(following.at) + 1, 1), own.type)]
        elif following is not None and not isinstance(following, (AllIndices, Key)):
            raise UnsupportedRuleError("behind an interpolated key only a key, [*] or an index may stand")
        t = VARIANT if v.dynamic else v.type.valueType if isinstance(v.type, T.MapType) else VARIANT
        looked_up = v if not isinstance(v.type, T.StructType) else Val(F.to_variant_object(v.col), VARIANT, v.path)
        held = as_map(looked_up)

        def look_up(k: Val) -> list[Piece]:
            def one(key: Val) -> One:
                text = scalar(key, "string")
                own = Val(held[text], t, joined(v.path, text))
                return One(own, F.coalesce(F.map_contains_key(held, text), F.lit(False)))

            if is_kind(k, "list") is False:
                kinds = is_kind(k, "string")
                if kinds is False:
                    return [Many(F.array(entry(ERROR, nothing(t), v.path)), t)]
                found = one(k)
                if kinds is True:
                    return [found]
                return [Many(F.when(kinds, many([found]).array).otherwise(F.array(entry(ERROR, nothing(t), v.path))), t)]
            listed = Many(F.transform(as_list(k), lambda e: entry(RESOLVED, e, v.path)), element(k))
            own = many(each_of(listed, lambda e: look_up(e) if kind_of_type(e.type) != "list" and not e.dynamic else [one(e)], self.detail), t)
            if is_kind(k, "list") is True:
                return [own]
            other = choose([(is_kind(k, "string"), many([one(k)]).array)], F.array(entry(ERROR, nothing(t), v.path)))
            return [Many(F.when(is_kind(k, "list"), own.array).otherwise(other), t)]

        found: list[Piece] = []
        for p in keys:
            if isinstance(p, Lit):
                p = One(literal_value(p.literal))
            got = self.guarded(p, look_up) if isinstance(p, One) else each_of(p, look_up, self.detail)
            for g in got:
                if isinstance(g, One):
                    found += self.guarded(g, lambda x: self.steps(parts, then, x, scope, spelling))
                else:
                    found += each_of(g, lambda x: self.steps(parts, then, x, Scope(scope.root, scope, in_lambda=True), spelling), self.detail)
        if (there := is_kind(v, "map")) is True or not found:
            return found
        own = many(found)
        return [Many(F.when(there, own.array).otherwise(F.array(entry(UNRESOLVED, nothing(own.type), v.path))), own.type)]

    # -- all elements

    def elements(self, v: Val) -> Column:
        """A list's elements as entries."""
        own = as_list(v)
        if not self.detail:
            return F.transform(own, lambda e: entry(RESOLVED, e, None))
        return F.transform(own, lambda e, i: entry(RESOLVED, e, joined(v.path, i.cast("string"))))

    def members(self, v: Val) -> Column:
        """A map's values as entries."""
        return F.transform(F.map_entries(as_map(v)), lambda e: entry(RESOLVED, e["value"], joined(v.path, e["key"])))

    def or_missing(self, entries: Column, v: Val, t: T.DataType) -> Column:
        return F.when(F.size(entries) == 0, F.array(entry(UNRESOLVED, nothing(t), v.path))).otherwise(entries)

    def capture(self, part: AllIndices | AllValues | Filter, before: list[Any], scope: Scope) -> None:
        """Keeps the keys of the maps that the parts before find as the variable that part names: all keys, or those whose
        values a filter passes. They are seen by all that is compiled later; inside a block of each element, by the later
        clauses of that element's block."""
        values = many(self.found(before, scope))

        def keys(v: Val) -> Column:
            none = F.array().cast("array<string>")
            if is_kind(v, "map") is False:
                return none

            def passes(x: Val) -> Column:
                return self.clauses(part.clauses, Scope(x, scope, in_lambda=True)) == PASS

            if isinstance(v.type, T.StructType):
                held = [(f.name, Val(v.col[f.name], f.dataType, None, v.nullable or f.nullable)) for f in v.type.fields]
                own = F.array_compact(F.array(*[F.when(passes(x), F.lit(k)) if isinstance(part, Filter) else F.lit(k) for k, x in held]))
            elif isinstance(part, Filter):
                t = VARIANT if v.dynamic else v.type.valueType
                passing = F.filter(F.map_entries(as_map(v)), lambda e: passes(Val(e["value"], t)))
                own = F.transform(passing, lambda e: e["key"])
            else:
                own = F.map_keys(as_map(v))
            return F.coalesce(own, none)

        found = F.transform(values.array, lambda e: F.when(e["k"] == RESOLVED, keys(Val(e["v"], values.type))).otherwise(F.array().cast("array<string>")))
        own = Many(F.transform(F.flatten(found), lambda k: entry(RESOLVED, k, k)), STRING)
        owner = scope if scope.in_lambda else scope.top()
        owner.known[part.capture] = [*owner.known.get(part.capture, []), own]

    def all_of(self, part: AllIndices | AllValues, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        into_maps = isinstance(part, AllValues) or part.capture is not None

        def further(inner: Scope | None) -> Callable[[Val], list[Piece]]:
            return lambda x: self.steps(parts, at + 1, x, Scope(inner.root if inner else x, scope, in_lambda=True), spelling)

        def passed(x: Val) -> list[Piece]:
            return self.steps(parts, at + 1, x, scope, spelling)

        if v.dynamic:
            own, alone = self.or_missing(self.elements(v), v, VARIANT), F.array(entry(RESOLVED, v.col, v.path))
            lists = each_of(Many(own, VARIANT), further(scope), self.detail)
            cases: list[tuple[Column, Many]] = [(is_kind(v, "list"), many(lists, VARIANT))]
            if into_maps:
                cases.append((is_kind(v, "map"), many(each_of(Many(self.or_missing(self.members(v), v, VARIANT), VARIANT), further(None), self.detail), VARIANT)))
            rest = many(each_of(Many(alone, VARIANT), further(scope), self.detail), VARIANT)
            return [Many(choose([(c, m.array) for c, m in cases], rest.array), VARIANT)]
        kind = kind_of_type(v.type)
        if kind == "list":
            t = v.type.elementType
            own = self.or_missing(self.elements(v), v, t)
            if v.nullable:
                own = F.when(v.col.isNull(), F.array(entry(RESOLVED, nothing(t), v.path))).otherwise(own)
            return each_of(Many(own, t), further(scope), self.detail)
        if kind == "map" and into_maps:
            if isinstance(v.type, T.StructType):
                found: list[Piece] = []
                for f in v.type.fields:
                    own_val = Val(v.col[f.name], f.dataType, joined(v.path, f.name), v.nullable or f.nullable)
                    found += self.steps(parts, at + 1, own_val, Scope(own_val, scope), spelling)
                return found or self.unresolved(v)
            t = v.type.valueType
            own = self.or_missing(self.members(v), v, t)
            if v.nullable:
                own = F.when(v.col.isNull(), F.array(entry(RESOLVED, nothing(t), v.path))).otherwise(own)
            return each_of(Many(own, t), further(None), self.detail)
        return passed(v)

    # -- filters

    def tested(self, part: Filter, parts: list[Any], at: int, v: Val, test: Scope, then: Scope, spelling: int | None) -> list[Piece]:
        """v's further results, if the clauses PASS within the scope test; nothing else."""
        status = self.clauses(part.clauses, test)
        further = many(self.steps(parts, at + 1, v, then, spelling))
        none = F.filter(further.array, lambda e: F.lit(False))
        wrong = F.array(entry(ERROR, nothing(further.type), v.path))
        return [Many(F.when(status == PASS, further.array).when(status == ERROR, wrong).otherwise(none), further.type)]

    def filtered(self, part: Filter, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        before = parts[at - 1]
        all_before = isinstance(before, (AllIndices, AllValues))

        def of_elements(x: Val) -> list[Piece]:
            return self.tested(part, parts, at, x, Scope(x, scope, in_lambda=True), Scope(scope.root, scope, in_lambda=True), spelling)

        def of_members(x: Val) -> list[Piece]:
            own = Scope(x, scope, in_lambda=True)
            return self.tested(part, parts, at, x, own, own, spelling)

        def itself() -> list[Piece]:
            own = scope if self.compat else Scope(v, scope)
            return self.tested(part, parts, at, v, own, scope, spelling)

        def on_map() -> list[Piece]:
            if all_before:
                return itself()
            if not isinstance(before, Key):
                return [Many(F.array(entry(ERROR, nothing(VARIANT), v.path)), VARIANT)]
            if isinstance(v.type, T.StructType):
                found: list[Piece] = []
                for f in v.type.fields:
                    own = Val(v.col[f.name], f.dataType, joined(v.path, f.name), v.nullable or f.nullable)
                    found += self.tested(part, parts, at, own, Scope(own, scope), Scope(own, scope), spelling)
                return [many(found)] if found else []
            t = VARIANT if v.dynamic else v.type.valueType
            return each_of(Many(self.members(v), t), of_members, self.detail)

        def on_list() -> list[Piece]:
            return each_of(Many(self.elements(v), element(v)), of_elements, self.detail)

        def on_scalar() -> list[Piece]:
            if isinstance(before, AllIndices):
                return self.tested(part, parts, at, v, Scope(v, scope), scope, spelling)
            return self.unresolved(v)

        if v.dynamic:
            lists, maps, rest = many(on_list(), VARIANT), many(on_map(), VARIANT), many(on_scalar(), VARIANT)
            return [Many(choose([(is_kind(v, "list"), lists.array), (is_kind(v, "map"), maps.array)], rest.array), VARIANT)]
        kind = kind_of_type(v.type)
        if kind not in ("list", "map"):
            return on_scalar()
        found = on_list() if kind == "list" else on_map()
        if not v.nullable:
            return found
        own = many(found)
        other = many(on_scalar(), own.type)
        return [Many(F.when(v.col.isNull(), other.array).otherwise(own.array), own.type)]

    def by_key(self, part: KeyFilter, parts: list[Any], at: int, v: Val, scope: Scope, spelling: int | None) -> list[Piece]:
        """`[ keys == ... ]`: the values whose keys compare so."""
        if is_kind(v, "map") is False:
            return self.unresolved(v)
        right = self.value(part.value, Scope(v, scope))

        def picked(key: Val) -> Column:
            return self.key_matches(part, key, right)

        def further(x: Val) -> list[Piece]:
            return self.steps(parts, at + 1, x, Scope(scope.root, scope, in_lambda=True), spelling)

        if isinstance(v.type, T.StructType):
            found: list[Piece] = []
            for f in v.type.fields:
                own = many(further(Val(v.col[f.name], f.dataType, joined(v.path, f.name), v.nullable or f.nullable)))
                none = F.filter(own.array, lambda e: F.lit(False))
                found.append(Many(F.when(picked(Val(F.lit(f.name), STRING, nullable=False)), own.array).otherwise(none), own.type))
            return [many(found)] if found else []
        t = VARIANT if v.dynamic else v.type.valueType
        entries = F.filter(F.map_entries(as_map(v)), lambda e: picked(Val(e["key"], STRING, nullable=False)))
        chosen = Many(F.transform(entries, lambda e: entry(RESOLVED, e["value"], joined(v.path, e["key"]))), t)
        found = each_of(chosen, further, self.detail)
        if is_kind(v, "map") is True:
            return found
        own = many(found)
        missing = F.array(entry(UNRESOLVED, nothing(own.type), v.path))
        return [Many(F.when(is_kind(v, "map"), own.array).otherwise(missing), own.type)]

    def key_matches(self, part: KeyFilter, key: Val, right: list[Piece]) -> Column:
        def holds(found: Column) -> Column:
            """A comparison under the clause's negation; what isn't comparable never matches."""
            return found == (0 if part.negated else HOLDS)

        def among(items: tuple[Literal, ...]) -> Column:
            each = [compare("==", key, x) for x in items]
            found = F.lit(part.negated)
            for c in each:
                found = found | (c == HOLDS) if not part.negated else found & (c != HOLDS)
            for c in each:  # one that isn't comparable spoils all
                found = found & (c != -1)
            return found

        def contained(text: Column) -> Column:
            found = F.contains(text, key.col)
            return ~found if part.negated else found

        if len(right) == 1 and isinstance(right[0], Lit):
            lit = right[0].literal
            if part.comparator == "in":
                if lit.kind == "list":
                    return among(lit.value)
                if lit.kind == "string":
                    return contained(F.lit(lit.value))
            if lit.kind == "list" and len(lit.value) == 1:
                lit = lit.value[0]
            return holds(compare("==", key, lit))
        own = many(right)

        def one(e: Column, within: bool) -> Column:
            val = Val(e["v"], own.type)
            text = is_kind(val, "string")
            if text is False:
                return F.lit(False)
            s = scalar(val, "string")
            found = contained(s) if within else (s != key.col if part.negated else s == key.col)
            found = found if text is True else F.coalesce(text & found, F.lit(False))
            return (e["k"] == RESOLVED) & found

        loose = F.exists(own.array, lambda e: one(e, True))
        if part.comparator == "in":
            return loose
        return F.when(F.size(own.array) > 1, loose).otherwise(F.exists(own.array, lambda e: one(e, False)))
