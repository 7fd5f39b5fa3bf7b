"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from rulestone import queries as rules
from rulestone.operators.evaluate import compile_rules, evaluate, tallies

SCALAR = "\n".join(
    [
        "rule r1 { l_quantity > 0.0 }",
        "rule r2 { l_discount in r[0.0,0.1] }",
        "rule r3 when l_returnflag == 'R' { l_discount <= 0.05 }",
        "rule r4 { l_linestatus in ['O', 'F'] }",
        "rule r5 { l_tax < 0.08 or l_discount < 0.02 }",
        "rule r6 { l_linenumber <= 7 }",
        "rule r7 { l_extendedprice is_float }",
        "rule r8 { l_returnflag == /^[ANR]$/ }",
        "rule r9 {\n r3\n}",
        "rule r10 { l_shipdate exists }",
    ]
)
TEXT = "\n".join(
    [
        "rule secrets { text != /AKIA[0-9A-Z]{12,}/ }",
        "rule shouting { text != /([A-Z]{4,}!! ){3}/ }",
        "rule junk { text != /[%&$#*]{3}\\s/ }",
        "rule licensed { text == /(?i)licen[cs]e/ }",
    ]
)


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    nested = "let heavy = items[ l_quantity > 40.0 ]\nrule a when %heavy !empty { %heavy.l_discount <= 0.08 }\nrule b { some items[*].l_returnflag == 'R' }\nrule c { items[*] { l_quantity > 0.0\n when l_returnflag == 'R' { l_discount < 0.1 } } }"
    # nested documents are built beforehand, so that rules are measured and not the join
    docs = rules.nested_orders(spark, folder).cache()
    variants = rules.nested_variants(spark, folder).cache()
    docs.count(), variants.count()
    runs = {
        "scalar_rules_typed": lambda: noop(evaluate(table("lineitem"), SCALAR, ["l_orderkey", "l_linenumber"])),
        "scalar_rules_tallies": lambda: noop(tallies(table("lineitem"), SCALAR)),
        "nested_rules_typed": lambda: noop(evaluate(docs, nested, ["o_orderkey"])),
        "nested_rules_variant": lambda: noop(evaluate(variants, nested, ["o_orderkey"], "doc")),
        "nested_checks_typed": lambda: noop(compile_rules(docs, nested, detail=True).frame),
        "text_rules": lambda: noop(evaluate(table("documents"), TEXT, ["doc_id"])),
        "alternatives_40": lambda: noop(evaluate(table("orders"), "rule r { " + " or ".join(f"o_custkey == {k}" for k in range(40)) + " }", ["o_orderkey"])),
        "rules_100": lambda: noop(evaluate(table("orders"), "\n".join(f"rule r{k} {{ o_custkey > {k} }}" for k in range(100)), ["o_orderkey"])),
        "flagship": lambda: noop(rules.flagship(spark, folder)),
        "a8_rulegen": lambda: noop(rules.QUERIES["a8_rulegen"](spark, folder)),
        "s6_s8_load_yaml": lambda: noop(rules.QUERIES["s6_s8_load_yaml"](spark, folder)),
        "k7_k16_report": lambda: noop(rules.QUERIES["k7_k16_report"](spark, folder)),
        "x3_json_parse": lambda: noop(rules.QUERIES["x3_json_parse"](spark, folder)),
        "k8_a7_junit": lambda: noop(rules.QUERIES["k8_a7_junit"](spark, folder)),
        "k11_event_trees": lambda: noop(rules.QUERIES["k11_event_trees"](spark, folder)),
    }
    counts = {"lineitem": table("lineitem").count(), "orders": docs.count(), "documents": table("documents").count()}
    took = {}
    for name, run in runs.items():
        best = None
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            run()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    per_second = {
        "scalar_rules_typed": round(counts["lineitem"] / took["scalar_rules_typed"]),
        "nested_rules_typed": round(counts["orders"] / took["nested_rules_typed"]),
        "nested_rules_variant": round(counts["orders"] / took["nested_rules_variant"]),
        "text_rules": round(counts["documents"] / took["text_rules"]),
    }
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_sec": per_second, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
