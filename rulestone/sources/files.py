"""Documents, rules and test specifications from files, payloads and parameters."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ast import RuleFile
from ..plans.parser import parse_rules
from .loader import load_documents

# Endings of files.
DATA_ENDINGS = ("yaml", "yml", "json", "jsn", "template")
RULE_ENDINGS = ("guard", "ruleset")
TEST_ENDINGS = ("yaml", "yml", "json", "jsn")

PAYLOAD = "rules array<string>, data array<string>"
#: Parameter documents that are merged at most; more are an error.
MOST_PARAMETERS = 10_000


def scan_texts(spark: SparkSession, paths: str | Iterable[str], endings: Iterable[str] = DATA_ENDINGS, order: str = "alphabetical") -> DataFrame:
    """name (path), content, modified of the files below paths, at any depth. order: alphabetical (by name), modified
    (by time, then name) or none."""
    given = [paths] if isinstance(paths, str) else list(paths)
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(endings)}}}").load(given)
    )
    name = F.regexp_replace(F.col("path"), "^file:/+", "/")
    texts = files.select(name.alias("name"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
    if order == "none":
        return texts
    return texts.orderBy("modified", "name") if order == "modified" else texts.orderBy("name")


def texts_of(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """name, content of texts at hand, as of standard input."""
    return spark.createDataFrame(list(texts), "name string, content string")


def scan_documents(spark: SparkSession, paths: str | Iterable[str], order: str = "alphabetical", keep_content: bool = False) -> DataFrame:
    """name, document, locations, error, and with keep_content the text."""
    return load_documents(scan_texts(spark, paths, DATA_ENDINGS, order), keep_content=keep_content)


def read_rules(paths: str | Iterable[str], order: str = "alphabetical") -> list[RuleFile]:
    """Rule files on the driver, as rules are plans. A file is taken whatever its ending, a folder's files by theirs."""
    found: list[str] = []
    for path in [paths] if isinstance(paths, str) else paths:
        if os.path.isdir(path):
            below = [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.rpartition(".")[2] in RULE_ENDINGS]
            found += sorted(below) if order == "alphabetical" else sorted(below, key=lambda p: (os.path.getmtime(p), p)) if order == "modified" else below
        else:
            found.append(path)
    files = []
    for path in found:
        with open(path, encoding="utf-8") as text:
            rules = parse_rules(text.read(), os.path.basename(path))
        if rules is not None:
            files.append(rules)
    return files


def read_payload(spark: SparkSession, payloads: DataFrame, column: str = "value") -> tuple[list[RuleFile], DataFrame]:
    """Rules and documents of a JSON payload {"rules": [...], "data": [...]}, named by their places. Rules come to the
    driver, as they are plans; data stay distributed. More than one payload is an error."""
    parsed = payloads.select(F.from_json(F.col(column), PAYLOAD).alias("p"))
    given = parsed.select("p.rules").limit(2).collect()
    if len(given) > 1:
        raise ValueError("rules of several payloads can't be told apart: read them one by one")
    texts = [t for r in given for t in r.rules or []]
    rules = [parse_rules(t or "", f"RULES_STDIN[{at}]") for at, t in enumerate(texts, 1)]
    data = parsed.select(F.posexplode("p.data").alias("at", "content"))
    named = data.select(F.format_string("DATA_STDIN[%d]", F.col("at") + 1).alias("name"), "content")
    return [r for r in rules if r is not None], load_documents(named)


def merge_documents(documents: Iterable[Column]) -> Column:
    """Documents that are maps as one map, documents that are lists as one list, in their order. A key of several maps,
    and documents of different kinds, or of other kinds, are errors; where one is null so is the whole."""
    given = list(documents)
    maps = [F.try_variant_get(d, "$", "map<string,variant>") for d in given]
    lists = [F.try_variant_get(d, "$", "array<variant>") for d in given]
    all_maps, all_lists = F.lit(True), F.lit(True)
    for m, x in zip(maps, lists, strict=True):
        all_maps, all_lists = all_maps & m.isNotNull(), all_lists & x.isNotNull()
    keys = F.concat(*[F.map_keys(m) for m in maps])
    twice = F.size(keys) != F.size(F.array_distinct(keys))

    def wrong(text: str) -> Column:
        return F.raise_error(F.lit(text)).cast("variant")

    return (
        F.when(F.greatest(F.lit(0), *[d.isNull().cast("int") for d in given]) == 1, F.lit(None).cast("variant"))
        .when(all_maps & twice, wrong("input parameters and data share a key"))
        .when(all_maps, F.to_variant_object(F.map_concat(*maps)))
        .when(all_lists, F.to_variant_object(F.concat(*lists)))
        .otherwise(wrong("input parameters and data are of kinds that don't merge"))
    )


def with_parameters(docs: DataFrame, parameters: DataFrame, document: str = "document") -> DataFrame:
    """docs with all parameter documents merged with each document. parameters: documents of a few files; together they
    are literals of at most 8 MB of JSON. More than MOST_PARAMETERS documents, and ones that couldn't be read, are errors;
    documents that couldn't be read stay as they are."""
    texts = [r[0] for r in parameters.select(F.to_json(F.col("document"))).limit(MOST_PARAMETERS + 1).collect()]
    if len(texts) > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} documents of input parameters")
    if None in texts:
        raise ValueError("input parameters that can't be read")
    if sum(map(len, texts)) > 8 << 20:
        raise ValueError("input parameters of more than 8 MB")
    literals = [F.parse_json(F.lit(t)) for t in texts]
    return docs.withColumn(document, merge_documents([*literals, F.col(document)])) if literals else docs


def pair_tests(rule_paths: Iterable[str], test_paths: Iterable[str]) -> dict[str, list[str]]:
    """Test files of each rule file: X.guard goes with tests/X*.yaml and so on in the folder beside it; a test file goes
    with the first rule file, by name, that begins so."""
    found: dict[str, list[str]] = {}
    taken: set[str] = set()
    tests = sorted(t for t in test_paths if re.search(rf"\.({'|'.join(TEST_ENDINGS)})$", t))
    for rule in sorted(rule_paths):
        folder, name = os.path.split(rule)
        stem = name.rpartition(".")[0]
        own = [t for t in tests if t not in taken and os.path.dirname(t) == os.path.join(folder, "tests") and os.path.basename(t).startswith(stem)]
        taken |= set(own)
        found[rule] = own
    return found
