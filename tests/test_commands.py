"""The command line."""

import io
import json
import xml.etree.ElementTree as ElementTree

from rulestone.__main__ import main


def test_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/t.yaml").write_text("Resources:\n  a:\n    Type: X::Y::Z\n    Properties: {Size: 5}\n")
    (tmp_path / "ok.guard").write_text("rule ok { Resources.*.Properties.Size < 10 }\n")
    (tmp_path / "bad.guard").write_text("rule bad { Resources.*.Properties.Size > 10 <<small>> }\n")
    (tmp_path / "broken.guard").write_text("rule {")
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/ok_1.yaml").write_text("- input: {Resources: {a: {Properties: {Size: 1}}}}\n  expectations: {rules: {ok: PASS}}\n")
    (tmp_path / "tests/bad_1.yaml").write_text("- input: {Resources: {a: {Properties: {Size: 1}}}}\n  expectations: {rules: {bad: PASS}}\n")
    data, ok, bad = str(tmp_path / "d"), str(tmp_path / "ok.guard"), str(tmp_path / "bad.guard")

    def run(*args):
        code = main(list(args))
        return code, capsys.readouterr().out

    assert run("validate", "-r", ok, "-d", data)[0] == 0
    code, out = run("validate", "-r", ok, bad, "-d", data)
    assert code == 19 and "small" in out and "FAIL" in out
    code, out = run("validate", "-r", bad, "-d", data, "-o", "json")
    assert json.loads(out)["status"] == "FAIL"
    quiet = ("-z", "-S", "none")
    code, out = run("validate", "-r", bad, "-d", data, "-o", "json", *quiet)
    assert code == 19 and json.loads(out)[0]["status"] == "FAIL"
    assert "<testsuite" in run("validate", "-r", bad, ok, "-d", data, "-o", "junit", *quiet)[1]
    assert json.loads(run("validate", "-r", bad, "-d", data, "-o", "sarif", *quiet)[1])["version"] == "2.1.0"
    assert "status: FAIL" in run("validate", "-r", bad, "-d", data, "-o", "yaml", *quiet)[1]
    for wrong in (("-o", "junit"), ("-o", "sarif"), ("-o", "json", "-z"), ("-z", "-S", "none"), (*quiet, "-o", "json", "-v"), (*quiet, "-o", "json", "-p"), ("-a", "-m"), ("-P",)):
        assert run("validate", "-r", bad, "-d", data, *wrong)[0] == 5, wrong
    assert run("validate", "-d", data)[0] == 5
    code, out = run("validate", "-r", bad, "-d", data, "-v", "-p", "-t", "CFNTemplate", "-S", "pass,fail")
    assert code == 19 and "  bad.guard FAIL\n    rule bad FAIL\n      Resources.*.Properties.Size > 10 FAIL" in out
    tree = json.loads(out[out.index("\n{") :])
    assert tree["children"][0]["children"][0] == {"context": "Resources.*.Properties.Size > 10", "status": "FAIL", "children": []}
    assert """Number of non-compliant resources 1
  Resource = a {
    Type = X::Y::Z
    bad: Resources.*.Properties.Size > 10
      PropertyPath    = Properties/Size
      Value           = 5
      ComparedWith    = 10
      Message         = small
      Code:
            2.  a:
            3.    Type: X::Y::Z
            4.    Properties: {Size: 5}""" in out
    assert run("validate", "-r", str(tmp_path / "broken.guard"), "-d", data)[0] == 5
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps({"rules": ["rule r { x == 1 }"], "data": ['{"x": 1}', "x: 2"]})))
    code, out = run("validate", "--payload")
    assert code == 19 and "DATA_STDIN[1] Status = PASS" in out and "DATA_STDIN[2] Status = FAIL" in out
    assert run("test", "-r", ok, "-t", str(tmp_path / "tests/ok_1.yaml"))[0] == 0
    code, out = run("test", "-d", str(tmp_path))
    assert code == 7 and "bad: Expected = PASS, Evaluated = [FAIL]" in out
    code, out = run("test", "-d", str(tmp_path), "-o", "json")
    found = {r["rule_file"].rpartition("/")[2]: r for r in json.loads(out)}
    assert found["bad.guard"]["test_cases"][0]["failed_rules"] == [{"name": "bad", "expected": "PASS", "evaluated": ["FAIL"]}] and "error" in found["broken.guard"]
    assert "rule_file:" in run("test", "-d", str(tmp_path), "-o", "yaml")[1]
    suites = ElementTree.fromstring(run("test", "-d", str(tmp_path), "-o", "junit")[1])
    assert (suites.attrib["failures"], suites.attrib["errors"], len(suites)) == ("1", "1", 3)
    assert json.loads(run("parse-tree", "-r", ok)[1])["kind"] == "RuleFile"
    assert "Properties.Size == 5" in run("rulegen", "-t", data)[1]
