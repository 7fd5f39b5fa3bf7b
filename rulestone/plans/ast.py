"""What rule text is parsed into. Literals are wrapped so that their kinds stay apart; everything else is plain data."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Literal:
    """kind: null, bool, int, float, string, regex, char, range, list or map. A range holds (kind of its ends, lower,
    upper, lower is in, upper is in); a list holds literals and a map (key, literal) pairs."""

    kind: str
    value: Any = None


@dataclass(frozen=True)
class Location:
    line: int
    column: int


@dataclass
class Query:
    parts: list[Any]
    every: bool = True
    text: str = ""


@dataclass(frozen=True)
class This:
    pass


@dataclass(frozen=True)
class Key:
    name: str

    @property
    def variable(self) -> str | None:
        return self.name[1:] if self.name.startswith("%") else None


@dataclass(frozen=True)
class Index:
    at: int


@dataclass(frozen=True)
class AllValues:
    capture: str | None = None


@dataclass(frozen=True)
class AllIndices:
    capture: str | None = None


@dataclass
class Filter:
    capture: str | None
    clauses: list[list[Any]]


@dataclass
class KeyFilter:
    capture: str | None
    comparator: str
    negated: bool
    value: Any


@dataclass
class Call:
    name: str
    arguments: list[Any]
    location: Location


@dataclass
class Let:
    name: str
    value: Any


@dataclass
class Access:
    """query comparator [value], with `not` before the comparator (negated) or before the clause (inverse)."""

    query: Query
    comparator: str
    negated: bool
    inverse: bool
    value: Any
    message: str | None
    location: Location
    text: str = ""


@dataclass
class Block:
    lets: list[Let]
    clauses: list[list[Any]]


@dataclass
class QueryBlock:
    query: Query
    not_empty: bool
    block: Block
    location: Location


@dataclass
class WhenBlock:
    conditions: list[list[Any]]
    block: Block


@dataclass
class TypeBlock:
    type_name: str
    query: Query
    conditions: list[list[Any]] | None
    block: Block
    location: Location


@dataclass
class RuleReference:
    name: str
    inverse: bool
    message: str | None
    location: Location


@dataclass
class RuleCall:
    name: str
    arguments: list[Any]
    inverse: bool
    message: str | None
    location: Location


@dataclass
class Rule:
    name: str
    conditions: list[list[Any]] | None
    block: Block
    parameters: list[str] = field(default_factory=list)


@dataclass
class RuleFile:
    lets: list[Let]
    rules: list[Rule]
    macros: dict[str, Rule]
    name: str = ""

    def to_dict(self) -> dict:
        return tree(self)


def tree(node: Any) -> Any:
    """The parse tree as plain lists and dictionaries, each node with its kind."""
    if is_dataclass(node):
        return {"kind": type(node).__name__} | {("literal" if f.name == "kind" else f.name): tree(getattr(node, f.name)) for f in fields(node)}
    if isinstance(node, dict):
        return {k: tree(v) for k, v in node.items()}
    if isinstance(node, (list, tuple)):
        return [tree(x) for x in node]
    return node
