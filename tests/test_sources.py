import json
import zipfile

import pytest

from quillon.plans import report
from quillon.plans.ablation import select_variants, variant_tag
from quillon.config import Config
from quillon.plans.policy import variant_runs
from quillon.plans.workflow import Checkpoint
from quillon.sources import files


def _workbook(path, rows):
    cells = lambda r, i: "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{i}">{cells(r, i)}</row>' for i, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks_of_a_folder(spark, tmp_path):
    head = ["Data", "Ticker", "Duration", "Setor"]
    _workbook(tmp_path / "quotes_IDA_1.xlsx", [head, ["2020-01-06", "a", "1.5", None], ["2020-01-07", "a", None, "bank"]])
    _workbook(tmp_path / "quotes_IDA_2.xlsx", [["Data", "Debênture", "Rating"], ["2020-01-06", "b", "AA"]])
    _workbook(tmp_path / "quotes_IDA_3.xlsx", [["Nothing"], ["x"]])
    (tmp_path / "quotes_IDA_4.xlsx").write_text("no zip")
    with pytest.warns(UserWarning):
        rows = files.scan_folder(spark, str(tmp_path), "ida").orderBy("debenture_id", "date").collect()
    assert [(r.debenture_id, r.duration, r.rating, r.universe) for r in rows] == [("a", 1.5, None, "ida"), ("a", None, None, "ida"), ("b", None, "AA", "ida")]
    assert files.scan_folder(spark, str(tmp_path / "none"), "ida") is None


def test_workbooks_as_a_source(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    _workbook(tmp_path / "a.xlsx", [["k", "v", "v", None, "z"], ["1", "x", "y", "w", None], ["2"]])
    _workbook(tmp_path / "b.xlsx", [["w", "k"], *[[f"{i}", f"{i % 7}"] for i in range(23_000)]])
    _workbook(tmp_path / "deep/c.xlsx", [["k"]])
    (tmp_path / "notes.txt").write_text("no workbook")
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        rows = files.read_workbook(spark, path)
        assert rows.columns == ["k", "v", "v.1", "column_3", "z", "w"] and rows.rdd.getNumPartitions() == 3 and rows.count() == 23_002
    assert [tuple(r) for r in rows.where("w is null").orderBy("k").collect()] == [("1", "x", "y", "w", None, None), ("2", None, None, None, None, None)]
    assert rows.groupBy("k").count().where("k = '3'").first()[1] == len(range(3, 23_000, 7))
    named = spark.read.format("workbook").schema("w string, absent string, _file string").option("pathGlobFilter", "b*").load(str(tmp_path))
    assert named.rdd.getNumPartitions() == 1 and named.where("absent is null and _file like '%b.xlsx'").selectExpr("max(cast(w as int))").first()[0] == 22_999
    assert files.read_workbook(spark, str(tmp_path / "a.xlsx")).count() == 2
    with pytest.raises(Exception, match="absent"):
        files.read_workbook(spark, str(tmp_path / "absent.xlsx")).count()


def test_unreadable_workbooks_by_mode(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["k"], ["1"], ["2"]])
    (tmp_path / "b.xlsx").write_text("no zip")
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:  # breaks off in the middle
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>k</v></c></row><row r="2"><c r="A2"><v>9</v></c></row>')
    files.read_workbook(spark, str(tmp_path / "a.xlsx"))
    source = lambda mode: spark.read.format("workbook").schema("k string, _error string, _file string").option("mode", mode).load(str(tmp_path))
    assert sorted(r.k for r in source("DROPMALFORMED").collect()) == ["1", "2"]
    told = source("permissive").collect()
    assert sorted(r.k for r in told if r._error is None) == ["1", "2"] and sorted(r._file[-6:] for r in told if r._error) == ["b.xlsx", "c.xlsx"]
    with pytest.raises(Exception, match="zip|no element"):
        source("FAILFAST").collect()
    with pytest.raises(Exception, match="mode"):
        source("other").collect()
    with pytest.raises(Exception, match="text"):
        spark.read.format("workbook").schema("k int").load(str(tmp_path / "a.xlsx")).collect()
    assert spark.read.format("workbook").option("mode", "DROPMALFORMED").load(str(tmp_path)).columns == ["k"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbook").schema("k string").load(str(tmp_path / "none")).count() == 0


def test_scans_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for name in ("t.parquet", "t.csv"):
        files.write_table(df, str(tmp_path / name))
        assert files.scan(spark, str(tmp_path / name)).count() == 2
    with pytest.raises(ValueError):
        files.scan(spark, "panel.pkl")
    with pytest.warns(UserWarning):
        assert files.scan_or_none(spark, str(tmp_path / "absent.csv")) is None
    assert json.loads(files.to_json_rows(df).orderBy("value").first()[0])["a"] == 1
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(str(tmp_path / "bad.json"), {"x": 1}) == {"x": 1}
    assert files.resolve_panel_path(str(tmp_path)) == "panel.parquet"
    (tmp_path / "config_resolved.yaml").write_text("data:\n  panel_path: p.parquet\n")
    assert files.resolve_panel_path(str(tmp_path)) == "p.parquet"
    files.write_json({"panel_path": "q.parquet"}, str(tmp_path / "config_resolved.json"))
    assert files.resolve_panel_path(str(tmp_path)) == "q.parquet"
    text = report.write_report(str(tmp_path / "r.md"), "T", {"A": df.orderBy("a"), "B": "words"})
    assert "| 1 | x |" in text and "words" in text
    files.write_json({"é": [1]}, str(tmp_path / "sub/d.json"), spark)
    assert files.read_json(str(tmp_path / "sub/d.json"), spark=spark) == {"é": [1]} and files.read_json(str(tmp_path / "no.json"), {"x": 1}, spark) == {"x": 1}
    assert files.file_sizes(spark, str(tmp_path / "sub"))["d.json"] > 5


def test_steps_run_once(spark, tmp_path):
    ran, path = [], str(tmp_path / "c.json")
    assert Checkpoint(path, spark).run("a", lambda: ran.append(1)) and not Checkpoint(path, spark).run("a", lambda: ran.append(2))
    with pytest.raises(RuntimeError):
        Checkpoint(path, spark).run("b", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert Checkpoint(path, spark).run("b", lambda: None) and Checkpoint(path, spark).run("a", lambda: None, force=True) and ran == [1]


def test_variants():
    assert variant_tag({"b": 2, "a": 1}) == "a=1__b=2"
    assert [r.name for r in select_variants(variant_runs(Config()), [{"alpha": 0.2}])] == ["base", "alpha=0.2"]
    assert all(r.cfg.alpha_for(21) == 0.05 for r in variant_runs(Config(alpha_by_h={21: 0.1})) if r.name == "alpha=0.05")
