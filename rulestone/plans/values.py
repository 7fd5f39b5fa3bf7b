"""Values of documents as Columns: their kinds, children and text.

A value is a Column with a Spark type known when rules are compiled. Of a plain type its kind is settled then; a VARIANT
tells its kind row by row. A row's null is a present null; what is missing is never a value but an unresolved result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import Literal

VARIANT = T.VariantType()
STRING, LONG, DOUBLE, BOOLEAN = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
SCALARS = ("null", "bool", "int", "float", "string", "char")


@dataclass
class Val:
    """nullable: whether the Column may be null, as a present null. path: Column of the value's place, in detail mode."""

    col: Column
    type: T.DataType
    path: Column | None = None
    nullable: bool = True

    @property
    def dynamic(self) -> bool:
        return isinstance(self.type, T.VariantType)


def kind_of_type(t: T.DataType) -> str | None:
    """None: known per row only."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ArrayType):
        return "list"
    if isinstance(t, (T.StructType, T.MapType)):
        return "char" if is_char(t) else "map"
    if isinstance(t, T.NullType):
        return "null"
    return None


CHAR = T.StructType([T.StructField("__char", STRING)])


def is_char(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names == ["__char"]


def is_kind(v: Val, kind: str) -> Column | bool:
    """True and False are settled when rules are compiled."""
    own = kind_of_type(v.type)
    if own is None:
        if kind == "null":
            return F.is_variant_null(v.col)
        if kind == "list":
            return as_list(v).isNotNull()
        if kind == "map":
            return F.coalesce(F.try_variant_get(v.col, "$", "map<string,variant>").isNotNull(), F.lit(False))
        names = {"bool": ["BOOLEAN"], "int": ["BIGINT", "INT", "SMALLINT", "TINYINT"], "float": ["DOUBLE", "FLOAT"], "string": ["STRING"]}
        if kind not in names:
            return False
        shown = F.schema_of_variant(v.col)
        found = shown.isin(names[kind])
        return F.coalesce((found | shown.startswith("DECIMAL")) if kind == "float" else found, F.lit(False))
    if kind == "null":
        return own == "null" or (v.col.isNull() if v.nullable else False)
    if kind != own:
        return False
    return v.col.isNotNull() if v.nullable else True


def both(a: Column | bool, b: Column | bool) -> Column | bool:
    if a is False or b is False:
        return False
    if a is True:
        return b
    return a if b is True else a & b


def choose(cases: list[tuple[Column | bool, Column]], otherwise: Column) -> Column:
    """CASE WHEN, without cases that are settled."""
    chain, done = None, None
    for condition, value in cases:
        if condition is False:
            continue
        if condition is True:
            done = value
            break
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    final = otherwise if done is None else done
    return final if chain is None else chain.otherwise(final)


def scalar(v: Val, kind: str) -> Column:
    """The value as that kind, where is_kind() says it is."""
    if v.dynamic:
        return F.try_variant_get(v.col, "$", {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}[kind])
    if is_char(v.type):
        return v.col["__char"]
    if isinstance(v.type, T.DateType):
        return F.date_format(v.col, "yyyy-MM-dd")
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        stamp = F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
        return F.concat(stamp, F.lit("Z")) if isinstance(v.type, T.TimestampNTZType) else F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if isinstance(v.type, T.BinaryType):
        return F.decode(v.col, "UTF-8")
    if kind == "float" and not isinstance(v.type, T.DoubleType):
        return v.col.cast("double")
    if kind == "int" and not isinstance(v.type, T.LongType):
        return v.col.cast("long")
    return v.col


def as_list(v: Val) -> Column:
    return F.try_variant_get(v.col, "$", "array<variant>") if v.dynamic else v.col


def element(v: Val) -> T.DataType:
    return VARIANT if v.dynamic else v.type.elementType


def as_map(v: Val) -> Column:
    return F.try_variant_get(v.col, "$", "map<string,variant>") if v.dynamic else v.col


def to_variant(v: Val) -> Column:
    if v.dynamic:
        return v.col
    if kind_of_type(v.type) in ("list", "map"):
        found = F.to_variant_object(v.col)
    else:
        kind = kind_of_type(v.type)
        found = (v.col if kind == "null" else scalar(v, kind)).cast("variant")
    return F.coalesce(found, F.parse_json(F.lit("null"))) if v.nullable else found


def json_text(v: Val) -> Column:
    """JSON text; equal for equal values of one kind, different for those of different kinds."""
    if v.dynamic:
        return F.to_json(v.col)
    kind = kind_of_type(v.type)
    if kind == "string":
        # JSON of a list of one, without its brackets
        found = F.to_json(F.array(scalar(v, "string")))
        found = F.substring(found, F.lit(2), F.length(found) - 2)
    elif kind in ("bool", "int"):
        found = scalar(v, kind).cast("string")
    elif kind == "float":
        found = scalar(v, kind).cast("string")
    elif kind == "null":
        return F.lit("null")
    elif kind == "char":
        found = v.col["__char"]
    else:
        return F.coalesce(F.to_json(to_variant(v)), F.lit("null"))
    return F.coalesce(found, F.lit("null")) if v.nullable else found


def kind_text(v: Val) -> Column:
    own = kind_of_type(v.type)
    if own is not None:
        return F.when(v.col.isNull(), "null").otherwise(own) if v.nullable else F.lit(own)
    return choose([(is_kind(v, k), F.lit(k)) for k in ("null", "string", "int", "float", "bool", "list")], F.lit("map"))


def canonical(v: Val) -> Column:
    """Text that is equal for values that compare as equal."""
    return F.concat(kind_text(v), F.lit(":"), json_text(v))


# -- literals


def literal_value(lit: Literal) -> Val | None:
    """A literal as a value; None for patterns and ranges, and for lists and maps that hold them."""
    if lit.kind in ("bool", "int", "float", "string"):
        t = {"bool": BOOLEAN, "int": LONG, "float": DOUBLE, "string": STRING}[lit.kind]
        return Val(F.lit(lit.value).cast(t), t, F.lit(""), nullable=False)
    if lit.kind == "null":
        return Val(F.lit(None), T.NullType(), F.lit(""))
    if lit.kind == "char":
        return Val(F.struct(F.lit(lit.value).alias("__char")), CHAR, F.lit(""), nullable=False)
    plain = literal_json(lit)
    return None if plain is None else Val(F.parse_json(F.lit(plain)), VARIANT, F.lit(""), nullable=False)


def literal_json(lit: Literal) -> str | None:
    """JSON text as VARIANT reads it: floats with an exponent."""
    if lit.kind in ("regex", "range", "char"):
        return None
    if lit.kind == "float":
        return f"{lit.value!r}E0" if "e" not in repr(lit.value) else repr(lit.value)
    if lit.kind == "list":
        items = [literal_json(x) for x in lit.value]
        return None if None in items else f"[{','.join(items)}]"
    if lit.kind == "map":
        pairs = [(k, literal_json(x)) for k, x in dict(lit.value).items()]
        return None if any(x is None for _, x in pairs) else "{" + ",".join(f"{json.dumps(k)}:{x}" for k, x in pairs) + "}"
    return json.dumps(lit.value)


def literal_text(lit: Literal) -> str:
    """As it is shown in messages."""
    if lit.kind == "regex":
        return f'"/{lit.value}/"'
    if lit.kind == "range":
        _, low, high, low_in, high_in = lit.value
        return f"{'[' if low_in else '('}{low},{high}{']' if high_in else ')'}"
    if lit.kind == "list":
        return "[" + ",".join(map(literal_text, lit.value)) + "]"
    if lit.kind == "map":
        return "{" + ",".join(f'"{k}":{literal_text(v)}' for k, v in lit.value) + "}"
    return "null" if lit.kind == "null" else json.dumps(lit.value)


def java_pattern(pattern: str) -> str:
    """Named groups as Java writes them."""
    return pattern.replace("(?P<", "(?<")


def plain(lit: Literal) -> Any:
    return [plain(x) for x in lit.value] if lit.kind == "list" else {k: plain(x) for k, x in lit.value} if lit.kind == "map" else lit.value
