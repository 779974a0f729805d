import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant.functions import paths
from foliant.plans import pipeline
from foliant.sources import files, office

STATE = {"input": {"a": {"b": [1, {"c": "x"}]}, "0": "zero", "n": 1.0, "t": True, "null": None, "s": "1", "list": [1, "a"], "2": {"1": "key"}}, "prev": {"output": {"n": 2}}, "steps": [{"output": {"ok": "ja"}}]}


def state(spark):
    own = {"input": STATE["input"], "prev.output": STATE["prev"]["output"], "step[0].output": STATE["steps"][0]["output"]}
    frame = spark.createDataFrame([tuple(json.dumps(v) for v in own.values())], "a string, b string, c string")
    frame = frame.select(*[F.parse_json(c).alias(c) for c in "abc"])
    return frame, {k: F.col(c) for k, c in zip(own, "abc", strict=True)}


WHENS = [{}, {"input.a.b.0": 1}, {"input.a.b.1.c": "x"}, {"input.a.b.2": 1}, {"input.a.b.x": 1}, {"input.0": "zero"}, {"input.2.1": "key"}, {"input.n": 1}, {"input.s": 1}, {"input.s": "1"}, {"input.t": True}, {"input.t": False}, {"input.null": None}, {"input.gone": None}, {"input.null@exists": True}, {"input.gone@exists": False}, {"input.gone@exists": True}, {"input.list": [1, "a"]}, {"input.list": ["a", 1]}, {"prev.output.n": 2, "step[0].output.ok": "ja"}, {"prev.output.n": 2, "step[0].output.ok": "nein"}, {"step[1].output.ok": "ja"}, {"nothing.x": 1}]


def test_conditions_as_on_the_driver(spark):
    frame, own = state(spark)
    got = frame.select(*[paths.conditions_hold(w, own).alias(f"w{i}") for i, w in enumerate(WHENS)]).first()
    assert list(got) == [pipeline.holds(w, STATE) for w in WHENS]


TEMPLATES = [{"x": "{{ input.a.b.1.c }}", "n": "{{input.n}}", "whole": "{{ input.a }}", "in": "a {{ input.s }} b {{ prev.output.n }}", "gone": "{{ input.gone }}", "blank": "[{{ input.gone }}]", "k": 5, "l": [None, True, "{{ step[0].output.ok }}"], "q": 'a "quote" \\ {{ input.s }}'}, "plain", 7, None]


def test_templates_as_on_the_driver(spark):
    frame, own = state(spark)
    got = frame.select(*[paths.resolved(t, own).alias(f"t{i}") for i, t in enumerate(TEMPLATES)]).first()
    assert [json.loads(x) for x in got] == [pipeline.resolve(t, STATE) for t in TEMPLATES]
    with pytest.raises(Exception, match="nothing at prev.output.x"):
        frame.select(paths.resolved("{{ prev.output.x }}", own)).collect()
    with pytest.raises(ValueError, match="quote"):
        paths.value_at(F.col("a"), "it's")


# ---- files


def test_archives_are_judged_before_anything_is_moved(spark, tmp_path):
    def archive(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, size in entries:
                info = zipfile.ZipInfo(path)
                if path.endswith("link"):
                    info.external_attr = 0o120777 << 16
                z.writestr(info, b"x" * size)

    archive("a.zip", [("ok.pdf", 3), ("d/", 0), ("d/../../x.pdf", 3), ("a.link", 3), ("e.pdf", 0), ("y.exe", 1)])
    archive("many.zip", [(f"{i}.pdf", 1) for i in range(12)])
    archive("large.zip", [("l.pdf", 2000)])
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = files.judged_entries(files.archive_entries(spark, str(tmp_path)), ("pdf",), 10, 1500).collect()
    by = {}
    for r in got:
        by.setdefault(r.archive.rsplit("/", 1)[-1], []).append((r.path, r.skip_reason, r.refused))
    assert sorted(by["a.zip"]) == [("a.link", "link", None), ("d/../../x.pdf", "unsafe", None), ("e.pdf", "empty", None), ("ok.pdf", None, None), ("y.exe", "type", None)]
    assert {x[2] for x in by["many.zip"]} == {"entries"} and {x[2] for x in by["large.zip"]} == {"bytes"} and [x[2] for x in by["broken.zip"]] == ["no archive"]


def test_an_entry_of_a_manifest_is_replaced_once(spark):
    rows = spark.createDataFrame([([("a", 1), ("b", 2), ("a", 3)],), ([("c", 1)],), (None,)], "files array<struct<path:string,size:int>>")
    new = F.struct(F.lit("n").alias("path"), F.lit(9).alias("size"))
    got = [r[0] and [tuple(x) for x in r[0]] for r in rows.select(files.replaced_entry("files", F.lit("a"), new)).collect()]
    assert got == [[("n", 9), ("b", 2), ("a", 3)], [("c", 1)], None]


def test_workbooks_are_written_by_tasks(spark, tmp_path):
    table = spark.createDataFrame([(f"b/{k % 3}", f"s{k % 2}", k, f"0{k}", None) for k in range(40)], "book string, sheet string, k int, code string, none string")
    rows = office.sheet_rows(table, F.col("book"), F.col("sheet"), ["k"], ["k", "code", "none"])
    to = tmp_path / "books"
    done = sorted(office.write_workbooks(rows, f"file://{to}").collect(), key=lambda r: r.workbook)
    assert [(r.workbook, r.sheets, r.rows) for r in done] == [("b/0", 2, 16), ("b/1", 2, 15), ("b/2", 2, 15)]
    assert sorted(p.name for p in to.iterdir()) == ["b_0.xlsx", "b_1.xlsx", "b_2.xlsx"]
    read = {(r.path.rsplit("/", 1)[-1], r.unit_id): r.rows for r in office.read_workbooks(spark, str(to)).collect()}
    assert read[("b_0.xlsx", "s0")][:2] == [["k", "code", "none"], ["0", "00", ""]] and len(read[("b_0.xlsx", "s0")]) == 8
    assert done[0].bytes == (to / "b_0.xlsx").stat().st_size


def test_renderings_in_many_workbooks_at_once(spark, tmp_path):
    cells = spark.createDataFrame([(b, u, r, c, f"{u}{r}{c}", f"{u}{r}{c}!") for b in ("x", "y") for u in ("u2", "u1") for r in range(2) for c in range(2)], "workbook string, unit_id string, row int, col int, value string, rendered string")
    words = spark.createDataFrame([("x", "a", "A", "ok", 1, 1), ("x", "b", "B", "ok", 5, 2)], "workbook string, norm string, target string, status string, refs int, first int")
    for layout, want in (("dict", {"u1", "u2", office.DICTIONARY[0]}), ("sheets", {"u1", f"u1{office.RESULT}", "u2", f"u2{office.RESULT}"})):
        to = tmp_path / layout
        done = office.write_workbooks(office.backfilled_rows(cells, words, layout), f"file://{to}")
        assert done.count() == 2
        read = {(r.path.rsplit("/", 1)[-1], r.unit_id): r.rows for r in office.read_workbooks(spark, str(to)).collect()}
        assert {u for p, u in read if p == "x.xlsx"} == want
        if layout == "dict":
            assert read[("x.xlsx", "u1")] == [["u100!", "u101!"], ["u110!", "u111!"]] and [r[0] for r in read[("x.xlsx", office.DICTIONARY[0])]][1:] == ["b", "a"]
        else:
            assert read[("y.xlsx", "u1")][0] == ["u100", "u101"] and read[("y.xlsx", f"u1{office.RESULT}")][0] == ["u100!", "u101!"]
        with zipfile.ZipFile(io.BytesIO((to / "x.xlsx").read_bytes())) as z:
            order = [s for s in z.read("xl/workbook.xml").decode().split('name="')[1:]]
        assert order[0].startswith("u1")
    with pytest.raises(ValueError, match="no layout"):
        office.backfilled_rows(cells, layout="other")


def test_csv_files_have_a_mark_each(spark, tmp_path):
    rows = spark.createDataFrame([(k, "ü,\"x\" " if k % 2 else None) for k in range(20)], "k int, v string")
    office.write_csv_files(rows, str(tmp_path / "c"), 3, ["k"])
    found = sorted((tmp_path / "c").glob("*.csv"))
    texts = [p.read_bytes() for p in found]
    assert len(found) == 3 and all(t.startswith(b"\xef\xbb\xbfk,v\n") for t in texts)
    lines = [x for t in texts for x in t.decode("utf-8-sig").splitlines()[1:]]
    assert lines[:3] == ["0,", '1,"ü,""x"" "', "2,"] and len(lines) == 20


def test_documents_tell_what_they_leave_out(spark, tmp_path):
    p = lambda text, more="", style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}{more}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = lambda *rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    body = p("Heading") + p("") + table(("a", "1"), ("b", "2")) + p("12/3") + p("Contents", style="TOC1") + p("Page", "<w:r><w:fldChar/></w:r>") + table(("1", "2")) + p("End")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    r = office.document_stats(office.read_document_elements(spark, str(tmp_path))).first()
    assert (r.paragraphs, r.tables, r.skipped_empty, r.skipped_number, r.skipped_field, r.units, r.text_chars) == (6, 2, 2, 1, 2, 3, 14)
    units = office.read_documents(spark, str(tmp_path)).collect()
    assert [(u.unit_id, u.text) for u in units] == [("p0", "Heading"), ("t2", None), ("p7", "End")]
    assert [u.unit_id for u in office.read_documents(spark, str(tmp_path), tables=False).collect()] == ["p0", "p7"]
