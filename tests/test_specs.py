import json

import pytest

from foliant.plans import specs

SPEC = {
    "name": "contracts",
    "columns": ["名称", "页码", "结论"],
    "group": {"mode": "value_run", "field": "标题"},
    "filters": [{"field": "类型", "op": "neq", "value": "空白"}],
    "aggregates": [{"column": "名称", "op": "group_key"}, {"column": "页码", "op": "page"}, {"column": "证据", "op": "evidence", "field": "签字", "clip": 3}],
    "verdict": {"column": "结论", "rules": [{"label": "已签", "when": {"any": [{"field": "签字"}, {"field": "盖章", "op": "contains_any", "values": ["章", "印"]}]}}], "default": "未签"},
    "sort": [{"column": "页码", "order": "desc"}],
}


def test_a_document_runs_over_maps_and_over_columns(spark):
    rows = [(1, 0, {"标题": "甲", "类型": "x"}), (2, 1, {"签字": "张三"}), (3, 2, {"标题": "乙", "类型": "x", "盖章": "公章"}), (4, 3, {"标题": "丙", "类型": "空白"}), (5, 4, {"标题": "丁"})]
    maps = spark.createDataFrame(rows, "page int, ord int, data map<string,string>")
    got = [tuple(r) for r in specs.run_view(maps, json.dumps(SPEC), data="data").collect()]
    assert got == [("甲", "1-2", "已签"), ("丁", "5", "未签"), ("乙", "3", "已签")]
    wide = spark.createDataFrame([(p, o, d.get("标题"), d.get("类型"), d.get("签字")) for p, o, d in rows], "page int, ord int, `标题` string, `类型` string, `签字` string")
    assert [tuple(r) for r in specs.run_view(wide, SPEC).collect()] == [("甲", "1-2", "已签"), ("丁", "5", "未签"), ("乙", "3", "未签")]


def test_bad_documents_are_named_without_running(spark):
    assert specs.check_view(spark, SPEC) == []
    assert specs.check_view(spark, SPEC | {"columns": ["没有"]}) and specs.check_view(spark, SPEC | {"group": {"mode": "odd"}}) and specs.check_view(spark, {"filters": [{}]})


def test_registry(tmp_path):
    r = specs.Registry(tmp_path, check=lambda d: [] if "fields" in d else ["no fields"])
    first = r.put("voucher", {"fields": ["a"], "category": "book"})
    again = r.put("voucher", {"fields": ["b"], "category": "book"})
    assert again["created_at"] == first["created_at"] and r.get("voucher")["fields"] == ["b"]
    r.enable("voucher", False)
    (tmp_path / "broken.json").write_text("{")
    assert [d["id"] for d in r.list()] == ["voucher"] and r.list(enabled=True) == [] and r.list(keyword="BOOK")
    with pytest.raises(ValueError):
        r.put("x", {})
    with pytest.raises(ValueError):
        r.put("../x", {"fields": []})
    assert r.keep_only(["other"]) == ["broken", "voucher"] and not r.delete("voucher")
    assert specs.fingerprint({"b": 1, "a": 2}) == specs.fingerprint({"a": 2, "b": 1})


def test_manifests_and_uploads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"batch_id": "b1", "created_at": "t", "source": "zip", "files": [{"path": "p", "name": "n", "rel": "n", "size": 3, "skip": False}, {"path": "q", "name": "m", "rel": "m", "size": 0, "skip": True, "skip_reason": "empty"}]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    files = specs.manifests(spark, str(tmp_path))
    runs = spark.createDataFrame([("b1", "failed", 1), ("b1", "succeeded", 2)], "batch_id string, status string, created_at int")
    assert [tuple(r) for r in specs.uploads(files, runs).collect()] == [("b1", 2, 3, 1, 2, "succeeded")]
