"""Rules generated from templates: for each resource type, its properties with the values they have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.parser import parse_rules


def shown(value: Column) -> Column:
    """A value as rule text: strings in quotes, without line ends and space around them."""
    text = F.try_variant_get(value, "$", "string")
    is_text = F.schema_of_variant(value) == "STRING"
    plain = F.replace(F.trim(F.when(is_text, text).otherwise(F.to_json(value))), F.lit("\n"), F.lit(""))
    return F.when(is_text, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(plain)


def properties(docs: DataFrame, document: str = "document") -> DataFrame:
    """type, property, value (rule text): one row for each property of each resource of a VARIANT document."""
    as_map = "map<string,variant>"
    resources = docs.select(F.explode(F.map_values(F.try_variant_get(F.try_variant_get(F.col(document), "$.Resources", "variant"), "$", as_map))).alias("r"))
    typed = resources.select(
        F.try_variant_get("r", "$.Type", "string").alias("type"),
        F.explode(F.try_variant_get(F.try_variant_get("r", "$.Properties", "variant"), "$", as_map)).alias("property", "v"),
    )
    return typed.filter(F.col("type").isNotNull()).select("type", "property", shown(F.col("v")).alias("value"))


def distinct_values(pairs: DataFrame) -> DataFrame:
    """pairs: type, property, value. Returns type, property, values (distinct, in order). Values are made distinct before
    they are gathered, so what a group gathers is its distinct values only."""
    return pairs.distinct().groupBy("type", "property").agg(F.array_sort(F.collect_list("value")).alias("values"))


def clauses(values: DataFrame) -> DataFrame:
    """type, property, clause: == for one value, IN for several."""
    variable = F.concat(F.lit("%"), rule_name(F.col("type")), F.lit("_resources.Properties."), F.col("property"))
    many = F.concat(variable, F.lit(" IN ["), F.array_join("values", ", "), F.lit("]"))
    one = F.concat(variable, F.lit(" == "), F.get("values", F.lit(0)))
    return values.select("type", "property", F.when(F.size("values") > 1, many).otherwise(one).alias("clause"))


def rule_name(kind: Column) -> Column:
    return F.lower(F.replace(kind, F.lit("::"), F.lit("_")))


def generated(docs: DataFrame, document: str = "document") -> DataFrame:
    """type, rules (text of its variable and rule)."""
    each = clauses(distinct_values(properties(docs, document)))
    name = rule_name(F.col("type"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("property", "clause"))), lambda c: F.concat(F.lit("  "), c["clause"], F.lit("\n"))), "")
    head = F.concat(
        F.lit("let "), name, F.lit("_resources = Resources.*[ Type == '"), F.col("type"), F.lit("' ]\nrule "), name, F.lit(" when %"), name, F.lit("_resources !empty {\n")
    )
    return each.groupBy("type").agg(body.alias("body")).select("type", F.concat(head, "body", F.lit("}\n")).alias("rules"))


def generate_rules(docs: DataFrame, document: str = "document") -> str:
    """Rule text for all types of the documents, which is parsed again to be sure of it. There is a rule for each type,
    so the text is small enough for the driver."""
    text = "".join(r.rules for r in generated(docs, document).orderBy("type").toLocalIterator())
    parse_rules(text)
    return text
