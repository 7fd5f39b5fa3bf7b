"""Parser, functions, sources, reports, tests of rules, rule generation and streams."""

import json
import os
import time
import xml.etree.ElementTree as ElementTree

import pytest
from pyspark.sql import functions as F

from rulestone import api
from rulestone.functions.builtin import FUNCTIONS
from rulestone.operators import reports as R
from rulestone.operators import testing
from rulestone.operators.evaluate import compile_rules, evaluate
from rulestone.operators.rulegen import generate_rules
from rulestone.operators.testing import read_specs, run_tests
from rulestone.plans.ast import Literal
from rulestone.plans.compiler import RuleError
from rulestone.plans.parser import FUNCTIONS as ARITIES
from rulestone.plans.parser import RuleSyntaxError, parse_rules
from rulestone.plans.query import UnsupportedRuleError, spellings
from rulestone.sources import files as files_module
from rulestone.sources.files import merge_documents, pair_tests, read_rules, scan_documents, scan_texts, texts_of, with_parameters
from rulestone.sources.loader import DocumentError, canonical_json, load_documents, load_text
from rulestone.streaming.stream import stream_results, windowed_tallies

# -- parser


def literal(text):
    return parse_rules(f"let x = {text}\na exists").lets[0].value


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("5", "int", 5), ("-5", "int", -5), ("1.5", "float", 1.5), ("2e+3", "float", 2000.0), ("'it\\'s'", "string", "it's"), ('"a"', "string", "a"),
        ("true", "bool", True), ("False", "bool", False), ("null", "null", None), ("/a\\/b/", "regex", "a/b"), ("r[1,5)", "range", ("int", 1, 5, True, False)),
        ("r(a,z]", "range", ("char", "a", "z", False, True)), ("[1, 'a']", "list", (Literal("int", 1), Literal("string", "a"))),
        ("{a: 1, 'b c': [2]}", "map", (("a", Literal("int", 1)), ("b c", Literal("list", (Literal("int", 2),))))),
    ],
)
def test_literals(text, kind, value):
    assert literal(text) == Literal(kind, value)


def test_rule_file():
    text = """# comment
let v = some a.*[ k == 1 ].%x['q'][ name | keys == /z/ ]
rule one when v exists or %v !empty <<why>> { a exists <<must
be there>> }
rule two(p, q) { %p == %q }
rule three {
  one
  not one <<msg>>
  A::B::C when a exists { b exists }
  two(a, count(b[*])) or c empty
}
x.y == 1
"""
    rules = parse_rules(text, "file.guard")
    assert [r.name for r in rules.rules] == ["file.guard/default", "one", "three"]
    assert list(rules.macros) == ["two"]
    one = rules.rules[1]
    assert one.conditions[0][1].message == "why" and one.block.clauses[0][0].message == "must\nbe there"
    assert one.block.clauses[0][0].location.line == 3
    tree = api.parse_tree(text)
    assert tree["kind"] == "RuleFile" and json.dumps(tree)
    assert parse_rules("  # only a comment\n") is None


@pytest.mark.parametrize(
    "text",
    ["rule x { a == }", "rule x {", "rule { a exists }", "a == /(/", "let x 5", "rule x { }", "a exists }", "rule x { a[ keys < 1 ] exists }", "let x = join(a)\na exists", "a exists <<open"],
)
def test_syntax_errors(text):
    with pytest.raises(RuleSyntaxError):
        parse_rules(text)


def test_names_and_cycles_are_checked(spark):
    docs = spark.range(1)
    for text in ("rule a {\n b\n}", "rule a {\n b\n}\nrule b {\n a\n}", "rule a { f(id) }", "rule f(x) { %x exists }\nrule a { f(id, id) }", "rule f(x) { f(%x) }\nrule a { f(id) }"):
        with pytest.raises(RuleError):
            evaluate(docs, text, ["id"])
    with pytest.raises(UnsupportedRuleError):
        evaluate(docs, "rule a { %nothing exists }", ["id"])
    assert set(FUNCTIONS) == set(ARITIES)


def test_spellings():
    assert spellings("bucket_names") == ["bucketNames", "BucketName", "bucket-names", "BucketNames", "bucket_names", "Bucket Names", "Bucket-Names"]


# -- functions


def one(spark, rules, value):
    docs = spark.createDataFrame([(canonical_json({"v": value}),)], "t string").select(F.parse_json("t").alias("d"))
    return evaluate(docs, f"{rules}", [], "d").first()[0]


@pytest.mark.parametrize(
    ("call", "value", "clause", "status"),
    [
        ("regex_replace(v, '^a(.)c', '${1}!')", "abc and more", "%x == 'b!'", "PASS"),
        ("regex_replace(v, 'q', 'z')", "abc", "%x == ''", "PASS"),
        ("substring(v, 1, 3)", "añb", "%x == 'ñ'", "PASS"),
        ("substring(v, 2, 2)", "abc", "%x exists", "SKIP"),
        ("url_decode(v)", "a%20b+c", "%x == 'a b+c'", "PASS"),
        ("parse_int(v)", "-12", "%x == -12", "PASS"),
        ("parse_int(v)", 2.9, "%x == 2", "PASS"),
        ("parse_int(v)", "1.5", "%x exists", "ERROR"),
        ("parse_int(v)", [1], "%x exists", "SKIP"),
        ("parse_float(v)", "1e3", "%x == 1000.0", "PASS"),
        ("parse_float(v)", 3, "%x == 3.0", "PASS"),
        ("parse_boolean(v)", "TRUE", "%x == true", "PASS"),
        ("parse_boolean(v)", "maybe", "%x == true", "ERROR"),
        ("parse_string(v)", 1.0, "%x == '1'", "PASS"),
        ("parse_string(v)", True, "%x == 'true'", "PASS"),
        ("parse_char(v)", "x", "%x == r[a,z]", "PASS"),
        ("parse_char(v)", "xy", "%x exists", "ERROR"),
        ("parse_char(v)", 7, "%x == r[0,9]", "FAIL"),
        ("parse_epoch(v)", "1970-01-02T00:00:00+01:00", "%x == 82800", "PASS"),
        ("parse_epoch(v)", "1970-01-02", "%x exists", "ERROR"),
        ("json_parse(v)", '{"k": [1, {"z": "q"}]}', "%x.k[1].z == 'q'", "PASS"),
        ("json_parse(v)", "{", "%x exists", "ERROR"),
        ("join(v[*], ',')", ["a", "b"], "%x == 'a,b'", "PASS"),
        ("join(v[*], ',')", ["a", 1], "%x exists", "ERROR"),
        ("count(v[*])", [], "%x == 0", "PASS"),
        ("to_upper(to_lower(v))", "aB", "%x == 'AB'", "PASS"),
        ("now()", 1, "%x > 1700000000", "PASS"),
    ],
)
def test_functions(spark, call, value, clause, status):
    assert one(spark, f"let x = {call}\nrule r {{ {clause} }}", value) == status


def test_errors_hide_behind_alternatives_and_strict_raises(spark):
    assert one(spark, "rule r { v exists or v empty }", 1) == "PASS"
    assert one(spark, "rule r { v empty or v exists }", 1) == "ERROR"
    docs = spark.range(1)
    with pytest.raises(Exception, match="could not be evaluated"):
        evaluate(docs, "rule r { id empty }", ["id"], strict=True).collect()
    assert api.exit_code(docs, "rule r { id empty }") == 5
    assert api.exit_code(docs, "rule r { id > 5 }") == 19
    assert api.exit_code(docs, "rule r { id < 5 }") == 0


def test_plain_columns_stay_in_generated_code_and_push_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) AS s", "id * 2 AS unused").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    plan = evaluate(docs, "rule r when s == '5' { id < 5 }", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "*(1) Project" in plan


# -- sources


def test_located_loader():
    value, places = load_text("a: 1\nb: [1.5, yes, True, ~, '7', \"x\"]\nc: !Ref me\nd: !Join [',', [a]]\ne:\nf: !!int '5'\ng: !Sub\n  - x\n")
    assert value == {"a": 1, "b": [1.5, True, "True", None, "7", "x"], "c": {"Ref": "me"}, "d": {"Fn::Join": [",", ["a"]]}, "e": "", "f": 5, "g": {"Fn::Sub": ["x"]}}
    assert ("/b/1", 2, 9) in places
    assert load_text("---\na: 1\n---\nb: 2\n")[0] == {"a": 1}
    for bad in ("", "  \n", "a: &x 1\nb: *x", "1: foo", "[1, 2]: foo", "a: [", "a: !!int x"):
        with pytest.raises(DocumentError):
            load_text(bad)


def test_plain_loader():
    assert load_text("a: yes\nb: null\nc:\nd: True\ne: 0x10\nf: 1e3\ng: '1'", False)[0] == {"a": "yes", "b": None, "c": None, "d": True, "e": 16, "f": 1000.0, "g": "1"}
    assert load_text('{"a": [1, 2.0, "x"]}', False)[0] == {"a": [1, 2.0, "x"]}
    with pytest.raises(DocumentError):
        canonical_json(float("nan"))


def test_files(spark, tmp_path):
    (tmp_path / "data/deep").mkdir(parents=True)
    (tmp_path / "data/b.yaml").write_text("x: 1\n")
    (tmp_path / "data/deep/a.json").write_text('{"x": 2.0}')
    (tmp_path / "data/c.txt").write_text("x: 3\n")
    (tmp_path / "data/d.yml").write_text("x: [\n")
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules/one.guard").write_text("x is_int\n")
    (tmp_path / "rules/blank.guard").write_text("# nothing\n")
    (tmp_path / "params.yaml").write_text("limit: 5\n")
    docs = scan_documents(spark, str(tmp_path / "data"))
    assert [os.path.basename(r.name) for r in docs.select("name").collect()] == ["b.yaml", "d.yml", "a.json"]
    assert [bool(r.error) for r in docs.select("error").collect()] == [False, True, False]
    assert scan_texts(spark, [str(tmp_path / "data")], order="modified").count() == 3
    files = read_rules(str(tmp_path / "rules"))
    assert [f.name for f in files] == ["one.guard"]
    fine = docs.filter("error IS NULL")
    merged = with_parameters(fine, scan_documents(spark, str(tmp_path / "params.yaml")))
    assert {r[0] for r in evaluate(merged, "rule r { limit == 5 }", [], "document").collect()} == {"PASS"}
    with pytest.raises(Exception, match="share a key"):
        fine.select(merge_documents([F.col("document"), F.parse_json(F.lit('{"x": 1}'))])).collect()
    (tmp_path / "data/d.yml").unlink()
    found, code = api.validate_files(spark, str(tmp_path / "data"), str(tmp_path / "rules"))
    assert code == 19 and {os.path.basename(r["name"]): r["status"] for r in found} == {"b.yaml": "PASS", "a.json": "FAIL"}
    paths = [str(tmp_path / p) for p in ("x.guard", "xy.guard", "tests/x_test.yaml", "tests/xy.json", "tests/z.yaml")]
    assert [len(v) for v in pair_tests(paths[:2], paths[2:]).values()] == [2, 0]


def test_odd_documents(spark):
    docs = load_documents(texts_of(spark, [("empty", ""), ("null", "~"), ("list", "[]"), ("fine", "a: 1")]))
    found = {r.name: r.r for r in evaluate(docs.filter("error IS NULL"), "rule r { a exists }", ["name"], "document").collect()}
    assert found == {"null": "FAIL", "list": "FAIL", "fine": "PASS"}
    assert evaluate(docs.limit(0), "rule r { a exists }", ["name"], "document").count() == 0


# -- reports

TEMPLATE = """Resources:
  one:
    Type: A::B::C
    Properties: {Size: 5, Name: nm}
  two:
    Type: A::B::C
    Properties: {Size: 50, Name: nm}
"""
RULES = "rule small { Resources.*.Properties.Size < 10 <<too large>> }\nrule named { Resources.*.Properties.Name exists }\nrule other when nothing exists { a exists }"


@pytest.fixture
def template(spark):
    return load_documents(texts_of(spark, [("t.yaml", TEMPLATE)]))


def test_reports(spark, template):
    report = api.reports(template, RULES, "name", "document")
    data = R.structured(report)
    assert data[0]["status"] == "FAIL" and data[0]["compliant"] == ["named"] and data[0]["not_applicable"] == ["other"]
    check = data[0]["not_compliant"][0]["checks"][0]
    assert check["path"] == "/Resources/two/Properties/Size" and check["custom_message"] == "too large" and check["value"] == "50" and check["line"] == 1
    assert json.loads(R.to_json(report)) == data and "t.yaml" in R.to_yaml(report)
    tree = ElementTree.fromstring(R.junit({"r.guard": report}))
    assert tree.attrib["failures"] == "1" and "too large" in tree.find(".//failure").text
    failed = R.failed_with_names(template, RULES, "name", "document")
    places = template.select("name", F.explode("locations").alias("l")).select("name", "l.path", "l.line", "l.column")
    log = json.loads(R.sarif(R.sarif_results(failed, places)))
    region = log["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert region == {"startLine": 7, "startColumn": 23} and log["runs"][0]["results"][0]["ruleId"] == "SMALL"
    assert [tuple(r) for r in R.by_resource(failed).select("resource", "n_checks").collect()] == [("two", 1)]
    rows = R.summary(template, RULES, "name", "document", ("all",))
    assert {(r.rule, r.status) for r in rows.collect()} == {("small", "FAIL"), ("named", "PASS"), ("other", "SKIP")}
    assert R.summary(template, RULES, "name", "document", ("none",)).count() == 0
    assert "small" in R.summary_text(rows, "name") and "too large" in R.console(report)
    assert api.validate_text(spark, TEMPLATE, RULES)[0]["status"] == "FAIL"


def test_messages(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, s string")
    rules = "rule r { s == 'b'\n missing exists\n s in ['x']\n s !exists\n missing == 1 }\nrule q {\n r <<dep>>\n}\nrule e { this[ keys == 'zz' ] !empty }\nrule b { this[ keys == 'zz' ] !empty { a exists } }"
    said = [r.message for r in api.checks(docs, rules, ["id"]).collect()]
    assert said[0] == 'Check was not compliant as property value [Path=/s Value="a"] not equal to value ["b"].'
    assert said[1] == "Check was not compliant as property [] did not exist." or "missing" in said[1]
    assert any("not present in" in m for m in said) and any("dependent rule [r]" in m for m in said)
    assert any("query for block clause" in m for m in said) and any("variable in context" in m for m in said)


def test_captured_keys(spark):
    docs = spark.createDataFrame([(canonical_json({"m": {"x": {"k": 1}, "y": {"k": 2}}, "d": {"x": 5}}),)], "t string").select(F.parse_json("t").alias("d"))
    rules = "rule r { m[ name | k == 1 ] exists\n d.%name == 5 }\nrule s { m.*.k >= 1 }"
    assert tuple(evaluate(docs, rules, [], "d").first()) == ("PASS", "PASS")


CAPTURES = """
rule filtered { m[ name | k > 1 ] exists
 picked.%name == true }
rule nested { list[*].one[ deep | q == 1 ] !empty
 %deep == 'b' }
rule inside { m.* { p[ own ] exists
 p[ two | this is_int ] exists
 %own == 'k'
 %two == 'k' } }
rule every { m[ all ].k exists
 %all in ['x', 'y'] }
"""


@pytest.mark.parametrize("typed", [False, True])
def test_captured_keys_of_filters_elements_and_structs(spark, typed):
    value = {"m": {"x": {"k": 1, "p": {"k": 1}}, "y": {"k": 2, "p": {"k": 2}}}, "picked": {"y": True}, "list": [{"one": {"a": {"q": 0}, "b": {"q": 1}}}]}
    docs = spark.createDataFrame([(canonical_json(value),)], "t string")
    if typed:
        kind = "struct<m:struct<x:struct<k:int,p:struct<k:int>>,y:struct<k:int,p:struct<k:int>>>,picked:map<string,boolean>,list:array<map<string,map<string,struct<q:int>>>>>"
        docs, document = docs.select(F.from_json("t", kind).alias("j")).select("j.*"), None
    else:
        docs, document = docs.select(F.parse_json("t").alias("d")), "d"
    found = evaluate(docs, CAPTURES, [], document).first().asDict()
    assert found == dict.fromkeys(("filtered", "nested", "inside", "every"), "PASS")


def test_functions_take_queries_as_arguments(spark):
    docs = spark.createDataFrame([("abc-def", "-", "b", "x", 1, 3, ["p", "q"], None)], "s string, d string, pat string, into string, a int, z int, l array<string>, no string")
    rules = """
let j = join(l, d)
let r = regex_replace(s, pat, into)
let c = substring(s, a, z)
let w = join(l, no)
rule r { %j == 'p-q'
 %r == 'x'
 %c == 'bc' }
rule w { %w == 'pq' }
"""
    assert tuple(evaluate(docs, rules, []).first()) == ("PASS", "ERROR")


def test_parameters_merge_by_kind(spark):
    def merged(*texts):
        columns = [F.parse_json(F.lit(t)) for t in texts]
        return spark.range(1).select(F.to_json(merge_documents(columns)).alias("m")).first().m

    assert merged('{"a": 1}', '{"b": [2]}') == '{"a":1,"b":[2]}'
    assert merged("[1]", "[2, {}]") == "[1,2,{}]"
    for clash in (("[1]", '{"a": 1}'), ("1", '{"a": 1}'), ("null", '{"a": 1}'), ('{"a": 1}', '{"a": 2}')):
        with pytest.raises(Exception, match="parameters and data"):
            merged(*clash)
    docs = spark.createDataFrame([("bad", None), ("good", '{"x": 1}')], "name string, t string").select("name", F.parse_json("t").alias("document"))
    found = with_parameters(docs, spark.range(1).select(F.parse_json(F.lit('{"y": 2}')).alias("document"))).select("name", F.to_json("document").alias("t"))
    assert dict(map(tuple, found.collect())) == {"bad": None, "good": '{"x":1,"y":2}'}
    with pytest.raises(ValueError, match="can't be read"):
        with_parameters(docs, docs)


@pytest.mark.parametrize("detail", [False, True])
def test_many_alternatives_are_a_plan_of_their_number(spark, detail):
    """A plan that doubled with each alternative would not end."""
    docs = spark.range(50).withColumn("b", F.lit("x"))
    many = " or ".join(f"id == {i}" for i in range(40))
    rules = f"rule r {{ {many} }}\nrule n {{ this {{ {many.replace(' or ', ' or this { b == 1 or b == 2 } or ', 13)} }} }}\nrule e {{ id > 100 or id empty or id >= 0 }}"
    began = time.perf_counter()
    done = compile_rules(docs, rules, detail=detail)
    found = done.frame.select("id", *[done.status(r).alias(r) for r in "rne"]).collect()
    assert time.perf_counter() - began < 60
    assert all(tuple(r)[1:] == ((1, 1) if r.id < 40 else (2, 2)) + (3,) for r in found)


def test_rules_that_do_not_read_each_other_share_a_projection(spark):
    rules = "let v = l[*]\n" + "\n".join(f"rule r{i} {{ %v == {i} }}" for i in range(30)) + "\nrule last {\n r1\n r2\n}"
    docs = spark.createDataFrame([([1],)], "l array<int>")
    done = compile_rules(docs, rules)
    assert done.frame._jdf.queryExecution().analyzed().toString().count("Project") == 3
    assert done.frame.select(done.status("last").alias("s")).first().s == 2


def test_pointers():
    at = R.at_pointer
    assert [at("/a/b/c", p) for p in ("", "0", "0#", "1", "2#", "1/x/0", "/r/s", "3")] == ["/a/b/c", "/a/b/c", "c", "/a/b", "a", "/a/b/x/0", "/r/s", "/"]
    with pytest.raises(ValueError, match="beyond the root"):
        at("/a", "2")


def test_details_of_plans_and_other_layouts(spark):
    texts = [
        ("plan", '{"resource_changes": [{"address": "a.b", "type": "a", "change": {"after": {"x": {"z": 1}}}}]}'),
        ("template", "Resources:\n  r:\n    Type: T\n    Properties:\n      x: {z: 1}\n"),
        ("other", "x: {z: 1}"),
    ]
    docs = load_documents(texts_of(spark, texts), keep_content=True)
    rules = "rule p when resource_changes exists { resource_changes[*].change.after.x.z == 2 }\nrule t when Resources exists { Resources.r.Properties.x.z == 2 }\nrule o when x exists { x.z == 2 }"
    found = R.resource_details(R.failed_with_names(docs, rules, "name", "document"), docs).orderBy("name").collect()
    assert [(r.name, r.layout, r.resource, r.type, r.property, r.value) for r in found] == [("plan", "plan", "a.b", "a", "x/z", "1"), ("template", "template", "r", "T", "Properties/x/z", "1")]
    assert found[1].code == ["    3.    Type: T", "    4.    Properties:", "    5.      x: {z: 1}", "    6."]


# -- rule tests

SPECS = """
- name: first
  input: {Size: 5}
  expectations: {rules: {small: PASS, big: FAIL}}
- input: {Size: 50}
  expectations: {rules: {small: PASS, big: SKIP}}
"""


def test_rule_tests(spark):
    rules = "rule small { Size < 10 }\nrule big when Size > 10 { Size > 20 }\nrule extra { Size exists }"
    outcomes = run_tests(read_specs(spark, SPECS), rules)
    found = {(r.case_id, r.rule): r.outcome for r in outcomes.collect()}
    assert found == {(1, "small"): "PASS", (1, "big"): "FAIL", (1, "extra"): "NONE", (2, "small"): "FAIL", (2, "big"): "FAIL", (2, "extra"): "NONE"}
    assert testing.test_exit_code(outcomes) == 7
    text = testing.test_text(outcomes)
    assert "Test Case #1\nName: first" in text and "No Test expectation was set for Rule extra" in text
    assert testing.test_report(outcomes).count() == 2
    with pytest.raises(ValueError, match="needs input"):
        read_specs(spark, "- name: x\n")


def test_generated_rules_hold_on_their_templates(spark, template):
    text = generate_rules(template)
    assert "%a_b_c_resources.Properties.Size IN [5, 50]" in text and '%a_b_c_resources.Properties.Name == "nm"' in text
    assert evaluate(template, text, ["name"], "document").first().a_b_c == "PASS"
    assert generate_rules(template.limit(0)) == ""


# -- streams


def test_streams(spark, tmp_path):
    spark.sql("SELECT id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(id), 0) AS ts FROM range(120)").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rules = "rule low { id < 60 }"
    query = stream_results(stream, rules, ["id"]).writeStream.format("memory").queryName("low").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT count(*) FROM low WHERE status = 'PASS'").first()[0] == 60
    query = windowed_tallies(stream, rules, "ts", "30 minutes", "1 minute").writeStream.outputMode("append").format("memory").queryName("wins").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.start.minute, r.start.hour, r.status, r.n) for r in spark.sql("SELECT * FROM wins").collect()} >= {(0, 0, "PASS", 30), (30, 0, "PASS", 30), (0, 1, "FAIL", 30)}


def test_internal_columns_do_not_leak(spark):
    done = compile_rules(spark.range(3), ["rule a { id > 0 }", "rule a { id < 2 }"])
    assert list(done.names) == ["a", "1:a"]
    assert evaluate(spark.range(3), ["rule a { id > 0 }", "rule b { id < 2 }"], ["id"]).columns == ["id", "a", "b"]


def test_too_many_parameters_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(files_module, "MOST_PARAMETERS", 3)
    docs = spark.range(1).select(F.parse_json(F.lit('{"x": 1}')).alias("document"))
    some = [spark.range(n).select(F.parse_json(F.concat(F.lit('{"p'), F.col("id").cast("string"), F.lit('": 1}'))).alias("document")) for n in (3, 4)]
    assert len(with_parameters(docs, some[0]).select(F.explode(F.map_keys(F.try_variant_get("document", "$", "map<string,variant>")))).collect()) == 4
    with pytest.raises(ValueError, match="more than 3 documents"):
        with_parameters(docs, some[1])
