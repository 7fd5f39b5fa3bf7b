"""YAML and JSON text as VARIANT documents, with the places of their values.

Two ways of typing plain scalars: "located" (for validating files: whole numbers, then floats, then a short list of bool
words, then null, else a string; aliases are errors; only the first of several YAML documents is read) and "plain" (for
test inputs: the core schema of YAML). Floats are written with an exponent, so that VARIANT keeps 1 and 1.0 apart.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # YAML needs its library; JSON is read without
    yaml = None

SCHEMA = "name string, json string, locations array<struct<path:string,line:int,column:int>>, error string"

# Bool words of the located way, and intrinsic tags with their long forms.
TRUE_WORDS, FALSE_WORDS, NULL_WORDS = ("true", "yes", "on", "y"), ("false", "no", "off", "n"), ("~", "null")
LONG_FORM = {
    "Ref": "Ref", "GetAtt": "Fn::GetAtt", "Base64": "Fn::Base64", "Sub": "Fn::Sub", "GetAZs": "Fn::GetAZs",
    "ImportValue": "Fn::ImportValue", "Condition": "Condition", "RefAll": "Fn::RefAll", "Select": "Fn::Select",
    "Split": "Fn::Split", "Join": "Fn::Join", "FindInMap": "Fn::FindInMap", "And": "Fn::And", "Equals": "Fn::Equals",
    "Contains": "Fn::Contains", "EachMemberIn": "Fn::EachMemberIn", "EachMemberEquals": "Fn::EachMemberEquals",
    "ValueOf": "Fn::ValueOf", "If": "Fn::If", "Not": "Fn::Not", "Or": "Fn::Or",
}
OF_SCALARS = ("Ref", "Base64", "Sub", "GetAZs", "ImportValue", "GetAtt", "Condition", "RefAll")
OF_SEQUENCES = (
    "GetAtt", "Sub", "Select", "Split", "Join", "FindInMap", "And", "Equals", "Contains", "EachMemberIn",
    "EachMemberEquals", "ValueOf", "If", "Not", "Or",
)


class DocumentError(ValueError):
    pass


def wrapped(i: int) -> int:
    """Numbers that only fit without a sign lose their meaning and become negative."""
    return i - (1 << 64) if (1 << 63) <= i < (1 << 64) else i


def scalar_located(text: str) -> Any:
    if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < (1 << 63):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))", text):
        return float(text)
    if text in TRUE_WORDS or text in FALSE_WORDS:
        return text in TRUE_WORDS
    return None if text.lower() in NULL_WORDS else text


def scalar_plain(text: str) -> Any:
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text) and (text.lstrip("+-") == "0" or not text.lstrip("+-").startswith("0")):
        return wrapped(int(text))
    if re.fullmatch(r"0x[0-9a-fA-F]+|0o[0-7]+", text):
        return int(text, 0)
    if re.fullmatch(r"[+-]?(\d+\.\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|\d+[eE][+-]?\d+)", text):
        return float(text)
    if re.fullmatch(r"[+-]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", text):
        return float(text.replace(".", ""))
    return text


class Loader:
    """One text. located: which way; places: (path, line, column), lines from 1, columns from 0, as they are met."""

    def __init__(self, located: bool):
        self.located = located
        self.places: list[tuple[str, int, int]] = []

    def load(self, text: str) -> Any:
        if not text.strip():
            raise DocumentError("blank document")
        if yaml is None:
            return self.numbers(json.loads(text))
        # the C parser keeps no text behind marks, by which tags that the text names itself are told
        kind = yaml.SafeLoader if "!!" in text else getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        try:
            events = yaml.compose_all(text, Loader=kind) if not self.located else self.first(text, kind)
            node = next(iter(events), None)
        except yaml.YAMLError as e:
            raise DocumentError(str(e).replace("\n", " ")) from None
        if node is None:
            raise DocumentError("no document")
        return self.value(node, "", set())

    @staticmethod
    def first(text: str, kind: Any) -> list[Any]:
        for event in yaml.parse(text, Loader=kind) if "*" in text else ():
            if isinstance(event, yaml.AliasEvent):
                raise DocumentError(f"alias *{event.anchor} at line {event.start_mark.line + 1}")
            if isinstance(event, yaml.DocumentEndEvent):
                break
        return [next(yaml.compose_all(text, Loader=kind), None)]

    def numbers(self, value: Any) -> Any:
        if isinstance(value, dict):
            return {k: self.numbers(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.numbers(v) for v in value]
        return wrapped(value) if isinstance(value, int) and not isinstance(value, bool) else value

    def value(self, node: Any, path: str, above: set[int]) -> Any:
        if id(node) in above:
            raise DocumentError("a value holds itself")
        self.places.append((path, node.start_mark.line + 1, node.start_mark.column))
        tag = node.tag[1:] if node.tag.startswith("!") else ""
        if isinstance(node, yaml.ScalarNode):
            if tag and tag in LONG_FORM and tag in OF_SCALARS:
                return {LONG_FORM[tag]: node.value}
            return self.scalar(node)
        inner = above | {id(node)}
        if isinstance(node, yaml.SequenceNode):
            if tag and tag in OF_SEQUENCES:
                return {LONG_FORM[tag]: [self.value(x, f"{path}/{LONG_FORM[tag]}/{i}", inner) for i, x in enumerate(node.value)]}
            return [self.value(x, f"{path}/{i}", inner) for i, x in enumerate(node.value)]
        found: dict[str, Any] = {}
        for key, x in node.value:
            if not isinstance(key, yaml.ScalarNode):
                raise DocumentError(f"key is no string at line {key.start_mark.line + 1}")
            if not key.style and not isinstance(scalar_located(key.value) if self.located else scalar_plain(key.value), str):
                raise DocumentError(f"key {key.value} is no string at line {key.start_mark.line + 1}")
            found[key.value] = self.value(x, f"{path}/{key.value}", inner)
        if tag and not self.located and tag in LONG_FORM:
            return {LONG_FORM[tag]: found}
        return found

    def scalar(self, node: Any) -> Any:
        core = node.tag.removeprefix("tag:yaml.org,2002:")
        if self.explicit(node):
            return self.typed(core, node.value)
        if node.style or node.tag.startswith("!"):  # plain scalars have no style
            return node.value
        return scalar_located(node.value) if self.located else scalar_plain(node.value)

    @staticmethod
    def explicit(node: Any) -> bool:
        """Whether the text itself names the scalar's tag."""
        mark = node.start_mark
        return mark.buffer is not None and mark.buffer[mark.pointer : mark.pointer + 2] == "!!"

    @staticmethod
    def typed(core: str, text: str) -> Any:
        try:
            if core == "int":
                return int(text)
            if core == "float":
                return float(text)
        except ValueError:
            raise DocumentError(f"{text} is no {core}") from None
        if core == "bool":
            return text.lower() == "true"
        return None if core == "null" else text


def canonical_json(value: Any) -> str:
    """JSON whose numbers VARIANT reads with their kinds."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, float):
        if math.isnan(value) or math.isinf(value):
            raise DocumentError(f"{value} can't be kept")
        shown = repr(value)
        return shown if "e" in shown else f"{shown}E0"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return f"[{','.join(map(canonical_json, value))}]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in value.items()) + "}"


def load_text(text: str, located: bool = True) -> tuple[Any, list[tuple[str, int, int]]]:
    """A text's value and the places in it."""
    loader = Loader(located)
    return loader.load(text), loader.places


def load_documents(texts: DataFrame, located: bool = True, keep_content: bool = False) -> DataFrame:
    """texts: name, content. Returns name, document (VARIANT, null where there is an error), locations, error, and with
    keep_content the text. One pass without a shuffle; a text that can't be read is a row with its error, and others go
    on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str | None, list, str | None]] = []
            for content in batch.column(1).to_pylist():
                try:
                    value, places = load_text(content or "", located)
                    rows.append((canonical_json(value), [{"path": p, "line": x, "column": y} for p, x, y in places], None))
                except (DocumentError, ValueError, RecursionError) as e:
                    rows.append((None, [], str(e) or "bad document"))
            kind = pa.list_(pa.struct([("path", pa.string()), ("line", pa.int32()), ("column", pa.int32())]))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), kind, pa.string()))]
            kept = [batch.column(1)] if keep_content else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *kept], names=["name", "json", "locations", "error", "content"][: 4 + len(kept)])

    schema = f"{SCHEMA}, content string" if keep_content else SCHEMA
    loaded = texts.select(F.col("name").cast("string"), F.col("content").cast("string")).mapInArrow(run, schema)
    return loaded.select("name", F.try_parse_json("json").alias("document"), "locations", "error", *(["content"] if keep_content else []))
