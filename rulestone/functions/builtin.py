"""The functions that rules may call, as Columns. Each maps over the results of its first argument; values of kinds that it
doesn't take are dropped, ill-formed ones are errors, which make the clause that asks for them an ERROR."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ast import Literal
from ..plans.query import ERROR, RESOLVED, Lit, Many, One, Piece, UnsupportedRuleError, entry, many, nothing
from ..plans.values import BOOLEAN, CHAR, DOUBLE, LONG, STRING, VARIANT, Val, both, choose, is_kind, java_pattern, literal_value, scalar

#: (condition, value): what a value of some kind becomes; a value of None is an error.
Case = tuple[Column | bool, Column | None]


def mapped(pieces: list[Piece], t: T.DataType, cases: Callable[[Val], list[Case]]) -> list[Piece]:
    empty = F.filter(F.array(entry(RESOLVED, nothing(t), None)), lambda e: F.lit(False))

    def of(v: Val) -> Column:
        own = [(c, F.array(entry(ERROR, nothing(t), v.path) if x is None else entry(RESOLVED, x, v.path))) for c, x in cases(v) if c is not False]
        return choose(own, empty)

    found: list[Piece] = []
    for p in pieces:
        if isinstance(p, Lit):
            own = literal_value(p.literal)
            if own is None:
                continue
            p = One(own)
        if isinstance(p, One):
            if p.ok is False:
                continue
            first = next(((c, x) for c, x in cases(p.val) if c is not False), None)
            if first is None:
                continue
            if p.ok is True and first[0] is True and first[1] is not None:
                found.append(One(Val(first[1], t, p.val.path, nullable=False)))
            else:
                found.append(Many(of(p.val) if p.ok is True else F.when(p.ok, of(p.val)).otherwise(empty), t))
            continue

        def step(e: Column) -> Column:
            wrong = F.array(entry(ERROR, nothing(t), e["p"]))
            return F.when(e["k"] == RESOLVED, of(Val(e["v"], p.type, e["p"]))).when(e["k"] == ERROR, wrong).otherwise(empty)

        found.append(Many(F.flatten(F.transform(p.array, step)), t))
    return found


def with_kind(v: Val, kind: str, value: Callable[[Column], Column | None]) -> Case:
    condition = is_kind(v, kind)
    return (condition, None) if condition is False else (condition, value(scalar(v, kind)))


def checked(v: Val, kind: str, good: Callable[[Column], Column], value: Callable[[Column], Column]) -> list[Case]:
    """Values of a kind that are well-formed, and an error for the others."""
    condition = is_kind(v, kind)
    if condition is False:
        return []
    own = scalar(v, kind)
    return [(both(condition, F.coalesce(good(own), F.lit(False))), value(own)), (condition, None)]


def literal_argument(pieces: list[Piece]) -> Literal | None:
    return pieces[0].literal if len(pieces) == 1 and isinstance(pieces[0], Lit) else None


def first_of(pieces: list[Piece], kind: str, function: str) -> Column:
    """The first value that a query finds, if it is of that kind, or else null."""
    if not pieces:
        raise UnsupportedRuleError(f"{function} has an argument that never finds anything")
    p = pieces[0]
    if isinstance(p, Lit):
        raise UnsupportedRuleError(f"{function} takes no {p.literal.kind} there")
    v, ok = (p.val, p.ok) if isinstance(p, One) else (Val(F.get(p.array, F.lit(0))["v"], p.type), F.get(p.array, F.lit(0))["k"] == RESOLVED)
    condition = both(ok, is_kind(v, kind))
    return F.lit(None).cast("string" if kind == "string" else "int") if condition is False else choose([(condition, scalar(v, kind))], F.lit(None))


def text_argument(pieces: list[Piece], function: str) -> str | Column:
    own = literal_argument(pieces)
    return own.value if own is not None and own.kind in ("string", "char") else first_of(pieces, "string", function)


def number_argument(pieces: list[Piece], function: str) -> int | Column:
    """Numbers wrap to 16 bits without a sign."""
    own = literal_argument(pieces)
    if own is not None and own.kind == "int":
        return own.value & 0xFFFF
    if own is not None and own.kind == "float":
        return max(0, min(0xFFFF, int(own.value)))
    return F.pmod(first_of(pieces, "int", function), F.lit(1 << 16)).cast("int")


def as_column(x: str | int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def count(args: list[list[Piece]]) -> list[Piece]:
    total, wrong = F.lit(0).cast("long"), None
    for p in args[0]:
        if isinstance(p, Lit) or (isinstance(p, One) and p.ok is True):
            total = total + 1
        elif isinstance(p, One):
            total = total if p.ok is False else total + F.when(p.ok, 1).otherwise(0)
        else:
            total = total + F.size(F.filter(p.array, lambda e: e["k"] == RESOLVED))
            own = F.exists(p.array, lambda e: e["k"] == ERROR)
            wrong = own if wrong is None else wrong | own
    if wrong is None:
        return [One(Val(total, LONG, nullable=False))]
    return [Many(F.array(entry(F.when(wrong, ERROR).otherwise(RESOLVED), total, None)), LONG)]


def join(args: list[list[Piece]]) -> list[Piece]:
    """One string of all; an error if any isn't a string."""
    delimiter, texts = as_column(text_argument(args[1], "join")), []
    fine = delimiter.isNotNull()
    for p in args[0]:
        own = many([p])
        if own.type != STRING and own.type != VARIANT:
            return [Many(F.array(entry(ERROR, nothing(STRING), None)), STRING)]

        def as_text(e: Column) -> Column:
            v = Val(e["v"], own.type)
            return choose([(is_kind(v, "string"), F.when(e["k"] == RESOLVED, scalar(v, "string")))], nothing(STRING))

        texts.append(F.transform(own.array, as_text))
        fine = fine & ~F.exists(texts[-1], lambda s: s.isNull())
    whole = texts[0] if len(texts) == 1 else F.concat(*texts) if texts else F.array().cast("array<string>")
    return [Many(F.array(entry(F.when(fine, RESOLVED).otherwise(ERROR), F.call_function("array_join", whole, delimiter), None)), STRING)]


def json_parse(args: list[list[Piece]]) -> list[Piece]:
    def cases(v: Val) -> list[Case]:
        return checked(v, "string", lambda s: F.try_parse_json(s).isNotNull(), F.try_parse_json)

    return mapped(args[0], VARIANT, cases)


def regex_replace(args: list[list[Piece]]) -> list[Piece]:
    """The replacements of all matches one after the other; what isn't matched is left out."""
    pattern, into = text_argument(args[1], "regex_replace"), text_argument(args[2], "regex_replace")
    fixed = isinstance(pattern, str) and isinstance(into, str)
    pattern = F.lit(java_pattern(pattern)) if isinstance(pattern, str) else pattern
    if isinstance(into, str):
        into = into.replace("\\", "\\\\").replace("${", "\x00{")
        into = F.lit(re.sub("\x00\\{(\\w+)\\}", lambda m: f"${m[1]}" if m[1].isdigit() else "${" + m[1] + "}", into))
    else:
        into = F.regexp_replace(F.replace(into, F.lit("\\"), F.lit("\\\\")), r"\$\{(\d+)\}", "\\$$1")

    def cases(v: Val) -> list[Case]:
        def replaced(s: Column) -> Column:
            matches = F.regexp_extract_all(s, pattern, F.lit(0))
            return F.array_join(F.transform(matches, lambda m: F.regexp_replace(m, pattern, into)), "")

        condition = is_kind(v, "string")
        unknown = [] if fixed or condition is False else [(both(condition, pattern.isNull() | into.isNull()), None)]
        return [*unknown, with_kind(v, "string", replaced)]

    return mapped(args[0], STRING, cases)


def substring(args: list[list[Piece]]) -> list[Piece]:
    """Bytes from (in) to (out); dropped where these are out of range."""
    first, end = number_argument(args[1], "substring"), number_argument(args[2], "substring")
    never = isinstance(first, int) and isinstance(end, int) and first >= end
    first, end = as_column(first), as_column(end)

    def cases(v: Val) -> list[Case]:
        condition = is_kind(v, "string")
        if condition is False or never:
            return []
        s = scalar(v, "string")
        cut = F.decode(F.substring(F.encode(s, "UTF-8"), first + 1, end - first), "UTF-8")
        inside = (F.octet_length(s) >= end) & (first < end) & (s != "")
        return [(both(condition, F.coalesce(inside, F.lit(False))), cut)]

    return mapped(args[0], STRING, cases)


def of_strings(change: Callable[[Column], Column]) -> Callable[[list[list[Piece]]], list[Piece]]:
    return lambda args: mapped(args[0], STRING, lambda v: [with_kind(v, "string", change)])


def url_decode(args: list[list[Piece]]) -> list[Piece]:
    """A plus stays a plus; text that doesn't decode is dropped."""

    def cases(v: Val) -> list[Case]:
        condition = is_kind(v, "string")
        if condition is False:
            return []
        decoded = F.try_url_decode(F.replace(scalar(v, "string"), F.lit("+"), F.lit("%2B")))
        return [(both(condition, decoded.isNotNull()), decoded)]

    return mapped(args[0], STRING, cases)


_FLOAT_TEXT = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def parse_int(args: list[list[Piece]]) -> list[Piece]:
    def cases(v: Val) -> list[Case]:
        def digits(s: Column) -> Column:
            return s.rlike(r"^[+-]?[0-9]+$") & s.try_cast("bigint").isNotNull()

        return [
            *checked(v, "string", digits, lambda s: s.try_cast("bigint")),
            *checked(v, "char", lambda c: c.rlike("^[0-9]$"), lambda c: c.try_cast("bigint")),
            with_kind(v, "float", lambda x: F.when(F.isnan(x), 0).otherwise(F.greatest(F.least(x, F.lit(9.2e18)), F.lit(-9.2e18))).cast("long")),
            with_kind(v, "int", lambda x: x),
        ]

    return mapped(args[0], LONG, cases)


def parse_float(args: list[list[Piece]]) -> list[Piece]:
    def cases(v: Val) -> list[Case]:
        return [
            *checked(v, "string", lambda s: s.rlike(_FLOAT_TEXT), lambda s: s.try_cast("double")),
            *checked(v, "char", lambda c: c.rlike("^[0-9]$"), lambda c: c.try_cast("double")),
            with_kind(v, "int", lambda x: x.cast("double")),
            with_kind(v, "float", lambda x: x),
        ]

    return mapped(args[0], DOUBLE, cases)


def parse_boolean(args: list[list[Piece]]) -> list[Piece]:
    def cases(v: Val) -> list[Case]:
        words = checked(v, "string", lambda s: F.lower(s).isin("true", "false"), lambda s: F.lower(s) == "true")
        return [*words, with_kind(v, "bool", lambda x: x)]

    return mapped(args[0], BOOLEAN, cases)


def parse_string(args: list[list[Piece]]) -> list[Piece]:
    def shown(x: Column) -> Column:
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(x.cast("string"))

    def cases(v: Val) -> list[Case]:
        return [
            with_kind(v, "string", lambda s: s),
            with_kind(v, "int", lambda x: x.cast("string")),
            with_kind(v, "float", shown),
            with_kind(v, "bool", lambda x: x.cast("string")),
            with_kind(v, "char", lambda c: c),
        ]

    return mapped(args[0], STRING, cases)


def parse_char(args: list[list[Piece]]) -> list[Piece]:
    """Strings of one byte and ints of one digit become chars; longer ones are errors; chars become strings, which a
    result of one type can't hold, so they stay chars."""

    def as_char(text: Column) -> Column:
        return F.struct(text.alias("__char"))

    def cases(v: Val) -> list[Case]:
        condition = is_kind(v, "string")
        found: list[Case] = []
        if condition is not False:
            s = scalar(v, "string")
            found = [(both(condition, F.octet_length(s) == 1), as_char(s)), (both(condition, F.octet_length(s) > 1), None)]
        return [
            *found,
            *checked(v, "int", lambda x: (x >= 0) & (x <= 9), lambda x: as_char(x.cast("string"))),
            with_kind(v, "char", as_char),
        ]

    return mapped(args[0], CHAR, cases)


_RFC_3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_epoch(args: list[list[Piece]]) -> list[Piece]:
    """Whole seconds of an RFC 3339 time with an offset."""

    def cases(v: Val) -> list[Case]:
        def at(s: Column) -> Column:
            return F.try_to_timestamp(F.upper(s))

        return checked(v, "string", lambda s: s.rlike(_RFC_3339) & at(s).isNotNull(), lambda s: F.unix_seconds(at(s)))

    return mapped(args[0], LONG, cases)


def now(args: list[list[Piece]]) -> list[Piece]:
    """Epoch seconds, the same throughout a query."""
    return [One(Val(F.unix_seconds(F.current_timestamp()), LONG, nullable=False))]


FUNCTIONS: dict[str, Callable[[list[list[Piece]]], list[Piece]]] = {
    "count": count,
    "join": join,
    "json_parse": json_parse,
    "regex_replace": regex_replace,
    "substring": substring,
    "to_lower": of_strings(F.lower),
    "to_upper": of_strings(F.upper),
    "url_decode": url_decode,
    "parse_int": parse_int,
    "parse_float": parse_float,
    "parse_boolean": parse_boolean,
    "parse_string": parse_string,
    "parse_char": parse_char,
    "parse_epoch": parse_epoch,
    "now": now,
}
