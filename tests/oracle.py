"""A plain evaluator of rules over one document, as an oracle: it walks the tree value by value, with errors raised."""

from __future__ import annotations

import re

from rulestone.plans.ast import (
    Access,
    AllIndices,
    AllValues,
    Call,
    Filter,
    Index,
    Key,
    KeyFilter,
    Literal,
    QueryBlock,
    RuleCall,
    RuleReference,
    This,
    TypeBlock,
    WhenBlock,
)
from rulestone.plans.query import spellings

SKIP, PASS, FAIL, ERROR = "SKIP", "PASS", "FAIL", "ERROR"


class Failed(Exception):
    """An evaluation that can't go on."""


class Missing:
    pass


MISSING = Missing()


def kind(v):
    if isinstance(v, Literal):
        return v.kind
    return {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", list: "list", dict: "map"}[type(v)]


def plain(v):
    """A literal without patterns and ranges as a value."""
    if not isinstance(v, Literal):
        return v
    if v.kind == "list":
        return [plain(x) for x in v.value]
    if v.kind == "map":
        return {k: plain(x) for k, x in v.value}
    return v if v.kind in ("regex", "range", "char") else v.value


def items(v):
    return list(v.value) if isinstance(v, Literal) else v


class Apart(Exception):
    """Values that don't compare."""


def order(a, b):
    a, b = plain(a), plain(b)
    if kind(a) != kind(b) or kind(a) not in ("null", "int", "float", "string"):
        raise Apart
    return 0 if a is None or a == b else -1 if a < b else 1


def equal(a, b):
    a, b = plain(a), plain(b)
    for s, r in ((a, b), (b, a)):
        if kind(s) == "string" and kind(r) == "regex":
            return re.search(r.value, s) is not None
    if kind(a) == kind(b) == "map":
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    if kind(a) == kind(b) == "list":
        return len(a) == len(b) and all(equal(x, y) for x, y in zip(a, b, strict=True))
    if kind(a) == kind(b) == "bool":
        return a == b
    if kind(b) == "range" and kind(a) == b.value[0]:
        _, low, high, low_in, high_in = b.value
        return (a >= low if low_in else a > low) and (a <= high if high_in else a < high)
    return order(a, b) == 0


def same(a, b):
    try:
        return equal(a, b)
    except Apart:
        return False


class Scope:
    def __init__(self, root, parent=None, lets=None):
        self.root, self.parent, self.lets, self.known = root, parent, lets or {}, {}


class Oracle:
    def __init__(self, rules, doc):
        self.rules = rules
        self.top = Scope(doc, lets={x.name: x.value for x in rules.lets})

    def run(self):
        found = {}
        for rule in self.rules.rules:
            try:
                found[rule.name] = self.rule(rule, Scope(self.top.root, self.top))
            except Failed:
                found[rule.name] = ERROR
        return found

    # results are ("lit" | "ok", value) or ("un", None)

    def variable(self, name, scope):
        while scope is not None:
            if name in scope.known:
                return scope.known[name]
            if name in scope.lets:
                scope.known[name] = self.value(scope.lets[name], scope)
                return scope.known[name]
            scope = scope.parent
        raise Failed(name)

    def value(self, value, scope):
        if isinstance(value, Literal):
            return [("lit", value)]
        if isinstance(value, Call):
            return self.call(value, scope)
        found = self.query(value.parts, scope)
        return found if value.every else [r for r in found if r[0] == "ok"]

    def query(self, parts, scope):
        if isinstance(parts[0], Key) and parts[0].variable:
            found = []
            for tag, v in self.variable(parts[0].variable, scope):
                if tag == "un":
                    found.append((tag, v))
                    continue
                at = 2 if len(parts) > 1 and isinstance(parts[1], AllIndices) else 1
                v = plain(v) if at < len(parts) else v
                found += self.steps(parts, at, v, Scope(v, scope), None) if at < len(parts) else [(tag, v)]
            return found
        return self.steps(parts, 0, scope.root, scope, None)

    def steps(self, parts, at, v, scope, way):
        if at == len(parts):
            return [("ok", v)]
        p = parts[at]
        rest = lambda x, s=scope, w=way: self.steps(parts, at + 1, x, s, w)
        lost = [("un", None)]
        if isinstance(p, This):
            return rest(v)
        if isinstance(p, Key) and p.variable:
            return self.look_up(parts, at, v, scope, way) if isinstance(v, dict) else lost
        if isinstance(p, Key) and not re.fullmatch(r"[+-]?\d+", p.name):
            if not isinstance(v, dict):
                return lost
            if p.name in v:
                return rest(v[p.name])
            for i, other in enumerate(spellings(p.name)):
                if way in (None, i) and other in v:
                    return rest(v[other], scope, i)
            return lost
        if isinstance(p, (Index, Key)):
            i = abs(p.at if isinstance(p, Index) else int(p.name))
            return rest(v[i]) if isinstance(v, list) and i < len(v) else lost
        if isinstance(p, (AllIndices, AllValues)):
            if isinstance(v, list):
                return [r for x in v for r in rest(x)] if v else lost
            if isinstance(v, dict) and isinstance(p, AllValues):
                return [r for k in sorted(v) for r in rest(v[k], Scope(v[k], scope))] if v else lost
            return rest(v)
        before = parts[at - 1]
        if isinstance(p, Filter):
            if isinstance(v, list):
                return [r for x in v if self.cnf(p.clauses, Scope(x, scope)) == PASS for r in rest(x)]
            if isinstance(v, dict):
                if isinstance(before, (AllIndices, AllValues)):
                    return rest(v) if self.cnf(p.clauses, scope) == PASS else []
                if not isinstance(before, Key):
                    raise Failed
                return [r for k in sorted(v) if self.cnf(p.clauses, Scope(v[k], scope)) == PASS for r in rest(v[k], Scope(v[k], scope))]
            if isinstance(before, AllIndices):
                return rest(v) if self.cnf(p.clauses, Scope(v, scope)) == PASS else []
            return lost
        assert isinstance(p, KeyFilter)
        if not isinstance(v, dict):
            return lost
        right = self.value(p.value, Scope(v, scope))
        return [r for k in sorted(v) if self.key_matches(p, k, right) for r in rest(v[k])]

    def look_up(self, parts, at, v, scope, way):
        keys = self.variable(parts[at].variable, scope)
        following = parts[at + 1] if at + 1 < len(parts) else None
        if isinstance(following, Index):
            keys = keys[abs(following.at) : abs(following.at) + 1]
        found = []
        for tag, k in keys:
            if tag == "un":
                found.append((tag, k))
                continue
            k = plain(k)
            for one in k if isinstance(k, list) else [k]:
                if not isinstance(one, str):
                    raise Failed
                found += self.steps(parts, at + 1, v[one], scope, way) if one in v else [("un", None)]
        return found

    def key_matches(self, p, key, right):
        def test(a, b):
            try:
                return equal(a, b) != p.negated
            except Apart:
                return False

        if p.comparator == "==" and len(right) == 1:
            b = right[0][1]
            if kind(b) == "list" and len(items(b)) == 1:
                b = items(b)[0]
            return right[0][0] != "un" and test(key, b)
        for tag, b in right:
            if tag == "un":
                continue
            if kind(b) == "string":
                if (key in plain(b)) != p.negated:
                    return True
            elif kind(b) == "list":
                try:
                    if any([equal(key, x) for x in items(b)]) != p.negated:
                        return True
                except Apart:
                    continue
            elif test(key, b):
                return True
        return False

    # functions

    def call(self, c, scope):
        args = [self.value(a, scope) for a in c.arguments]
        if c.name == "count":
            return [("ok", sum(t != "un" for t, _ in args[0]))]
        if c.name == "join":
            texts = [plain(v) for t, v in args[0]]
            if any(not isinstance(s, str) for s in texts):
                raise Failed
            return [("ok", plain(args[1][0][1]).join(texts))]
        found = []
        for t, v in args[0]:
            v = plain(v)
            if t == "un":
                continue
            if c.name in ("to_lower", "to_upper") and isinstance(v, str):
                found.append(("ok", v.lower() if c.name == "to_lower" else v.upper()))
            elif c.name == "parse_int" and isinstance(v, (str, float, int)) and not isinstance(v, bool):
                if isinstance(v, str) and not re.fullmatch(r"[+-]?\d+", v):
                    raise Failed
                found.append(("ok", int(v)))
            elif c.name == "substring" and isinstance(v, str):
                a, b = (plain(x[0][1]) for x in args[1:])
                if a < b <= len(v):
                    found.append(("ok", v[a:b]))
        return found

    # clauses

    def rule(self, rule, scope):
        if rule.conditions is not None and self.cnf(rule.conditions, scope) != PASS:
            return SKIP
        return self.block(rule.block, scope)

    def block(self, block, scope):
        return self.cnf(block.clauses, Scope(scope.root, scope, {x.name: x.value for x in block.lets}))

    @staticmethod
    def worst(found):
        return FAIL if FAIL in found else PASS if PASS in found else SKIP

    def cnf(self, clauses, scope):
        found = []
        for d in clauses:
            own = []
            for item in d:
                own.append(self.item(item, scope))
                if own[-1] == PASS:
                    break
            found.append(PASS if PASS in own else FAIL if FAIL in own else SKIP)
        return self.worst(found)

    def item(self, x, scope):
        if isinstance(x, Access):
            return self.access(x, scope)
        if isinstance(x, WhenBlock):
            return self.block(x.block, scope) if self.cnf(x.conditions, scope) == PASS else SKIP
        if isinstance(x, QueryBlock):
            return self.each(self.query(x.query.parts, scope), x.query.every, x.block, scope, FAIL if x.not_empty else SKIP)
        if isinstance(x, TypeBlock):
            if x.conditions is not None and self.cnf(x.conditions, scope) != PASS:
                return SKIP
            found = self.query(x.query.parts, scope)
            status = self.each([r for r in found if r[0] != "un"], True, x.block, scope, SKIP)
            if any(t == "un" for t, _ in found):
                raise Failed
            return status
        if isinstance(x, RuleReference):
            own = [self.rule(r, Scope(self.top.root, self.top)) for r in self.rules.rules if r.name == x.name]
            status = next((s for s in own if s != SKIP), SKIP)
            return PASS if (status == PASS) != x.inverse else FAIL
        assert isinstance(x, RuleCall)
        macro = self.rules.macros[x.name]
        inner = Scope(scope.root, scope)
        for name, value in zip(macro.parameters, x.arguments, strict=True):
            found = self.value(value, scope)
            inner.known[name] = [("ok", plain(found[0][1]))] if isinstance(value, Literal) else found
        return self.rule(macro, inner)

    def each(self, found, every, block, scope, empty):
        if not found:
            return empty
        own = [FAIL if t == "un" else self.block(block, Scope(plain(v), scope)) for t, v in found]
        if every:
            return self.worst(own)
        return PASS if PASS in own else FAIL if FAIL in own else SKIP

    def access(self, a, scope):
        left = self.query(a.query.parts, scope)
        if a.comparator in ("exists", "empty") or a.comparator.startswith("is_"):
            return self.unary(a, left)
        right = self.value(a.value, scope)
        if not left or not right:
            return SKIP
        found = self.binary(a.comparator, a.negated, left, right)
        if a.query.every:
            return FAIL if False in found else PASS
        return PASS if True in found else FAIL

    def unary(self, a, left):
        last = a.query.parts[-1]
        selected = isinstance(last, (Filter, KeyFilter)) or isinstance(last, Key) and last.variable and len(a.query.parts) == 1
        flip = a.negated != a.inverse
        if not left:
            return SKIP if not (selected and a.comparator == "empty") else FAIL if flip else PASS

        def test(t, v):
            if a.comparator == "exists":
                return t != "un"
            if a.comparator == "empty":
                if t == "un":
                    return True
                if selected:
                    return kind(v) == "null"
                if kind(v) == "bool":
                    return False
                if kind(v) not in ("string", "list", "map"):
                    raise Failed
                return not plain(v)
            return t != "un" and kind(v) == {"is_struct": "map"}.get(a.comparator, a.comparator[3:])

        found = [test(t, v) != flip for t, v in left]
        if a.query.every:
            return PASS if all(found) else FAIL
        return PASS if any(found) else FAIL

    def binary(self, op, negated, left, right):
        out = []

        def leaf(a, b, test=equal):
            try:
                out.append(test(a, b) != negated)
            except Apart:
                out.append(False)

        def chosen(rs):
            return [v for t, v in rs if t != "un"]

        one_left = left[0][1] if len(left) == 1 and left[0][0] == "lit" else MISSING
        one_right = right[0][1] if len(right) == 1 and right[0][0] == "lit" else MISSING
        if op in ("<", "<=", ">", ">="):
            tests = {"<": lambda o: o < 0, "<=": lambda o: o <= 0, ">": lambda o: o > 0, ">=": lambda o: o >= 0}
            flat = [[x for v in chosen(rs) for x in (items(v) if kind(v) == "list" else [v])] for rs in (left, right)]
            out += [False] * sum(t == "un" for t, _ in left)
            out += [False] * (sum(t == "un" for t, _ in right) * len(flat[0]))
            for x in flat[0]:
                for y in flat[1]:
                    try:
                        out.append(tests[op](order(x, y)))
                    except Apart:
                        out.append(False)
            return out
        if op == "==" and one_right is not MISSING:
            if one_left is not MISSING:
                leaf(one_left, one_right)
                return out
            for t, v in left:
                if t == "un":
                    out.append(False)
                elif kind(one_right) == "list":
                    leaf(v, one_right.value[0] if len(one_right.value) == 1 and kind(v) not in ("list", "map") else one_right)
                else:
                    for x in v if isinstance(v, list) else [v]:
                        leaf(x, one_right)
            return out
        if op == "==" and one_left is not MISSING:
            for t, v in right:
                if t == "un":
                    out.append(False)
                else:
                    for x in v if isinstance(v, list) and kind(one_left) != "list" else [v]:
                        leaf(one_left, x)
            return out
        if one_right is not MISSING and one_left is not MISSING:
            if kind(one_left) == kind(one_right) == "string" and one_left.value in one_right.value:
                return [not negated]
            return [self.inside(one_left, one_right, negated)]
        if one_right is not MISSING:
            for t, v in left:
                if t == "un":
                    out.append(False)
                elif kind(one_right) == "string":
                    for x in v if isinstance(v, list) else [v]:
                        out.append(isinstance(x, str) and (x in one_right.value) != negated)
                else:
                    out.append(self.inside(v, one_right, negated))
            return out
        r, lost = chosen(right), sum(t == "un" for t, _ in right)
        if one_left is not MISSING:
            out += [False] * lost
            if kind(one_left) == "list" and not any(isinstance(x, list) for x in r):
                every = all(any(same(x, y) for y in r) for x in items(one_left))
                out.append(False if negated else every)
            else:
                out += [self.inside(one_left, x, negated) for x in r]
            return out
        ls = chosen(left)
        out += [False] * sum(t == "un" for t, _ in left)
        out += [False] * (lost * len(ls))
        if op == "==":
            long, short = (ls, r) if len(ls) > len(r) else (r, ls)
            diff = [x for x in long if not any(same(x, y) for y in short)]
            other = [x for x in (r if len(right) >= len(left) else ls) if not any(same(x, y) for y in diff)]
        else:
            diff = [x for x in ls if not any(self.inside(x, y, False) for y in r)]
            other = [x for x in ls if not any(same(x, y) for y in diff)]
        out.append((not diff) if not negated else bool(diff) and not other)
        return out

    @staticmethod
    def inside(v, right, negated):
        if kind(v) == "list":
            if kind(right) != "list":
                return False
            if items(right) and kind(items(right)[0]) == "list":
                found = any(same(v, y) for y in items(right))
                return (not found and not items(v)) if negated else found
            kept = [any(same(x, y) for y in items(right)) for x in items(v)]
            return not any(kept) and not all(kept) if negated else all(kept)
        if kind(right) == "list":
            return any(same(v, y) for y in items(right)) != negated
        try:
            return equal(v, right) != negated
        except Apart:
            return False
