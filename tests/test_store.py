import datetime as dt
import io
import zipfile

import pytest

from loomspan.sources import archives, store, tables

D = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_zipped_csv(spark, tmp_path):
    for name, text in (("a.zip", "代码,收盘\n000001,1.5\n000002,\n\n000003"), ("b.zip", "收盘,代码,额\n2.5,000001,7\n")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("day/x.CSV", text.encode("gbk"))
            z.writestr("note.txt", "no rows")
            z.writestr("empty.csv", "")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    df = archives.read_zipped_csv(spark, str(tmp_path), {"代码": "code", "收盘": "close", "none": "other"})
    got = sorted((r["archive"][-5:], r["member"], r["code"], r["close"], r["other"]) for r in df.collect())
    assert got == [("a.zip", "day/x.CSV", "000001", "1.5", None), ("a.zip", "day/x.CSV", "000002", "", None), ("a.zip", "day/x.CSV", "000003", None, None), ("b.zip", "day/x.CSV", "000001", "2.5", None)]
    last = {r["code"]: r["close"] for r in archives.latest_archive(df.select("archive", "code", "close"), ["code"]).collect()}
    assert last == {"000001": "2.5", "000002": "", "000003": None}


def workbook(rows) -> bytes:
    cells, strings = [], []
    for i, row in enumerate(rows, 1):
        cs = ""
        for j, v in enumerate(row):
            ref = f"{chr(65 + j)}{i}"
            if isinstance(v, str):
                strings.append(v)
                cs += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
            elif v is not None:
                cs += f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f'<row r="{i}">{cs}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in strings)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([["代码", "市值", "名"], ["000001", 1.5e9, "x"], ["000002", "1.2亿", None], [None, None, None], ["000003", None, "y"]]))
    (tmp_path / "b.xlsx").write_bytes(b"none")
    df = archives.read_sheets(spark, str(tmp_path), {"代码": "code", "市值": "mv", "名": "name", "无": "other"}, numbers=["mv"])
    assert sorted(tuple(r)[1:] for r in df.collect()) == [("000001", 1.5e9, "x", None), ("000002", 1.2e8, None, None), ("000003", None, "y", None)]


def test_cache_follows_its_files(spark, tmp_path):
    src, cache = str(tmp_path / "src"), str(tmp_path / "cache")
    spark.range(5).write.parquet(src)
    read = lambda k="a": store.cached(spark.read.parquet(src).where("id > 1"), cache, "id > 1", k)
    assert read().count() == 3 and read().count() == 3 and len(list((tmp_path / "cache").iterdir())) == 1
    assert read("b").count() == 3 and len(list((tmp_path / "cache").iterdir())) == 2
    spark.range(9).write.mode("overwrite").parquet(src)
    assert read().count() == 7 and len(list((tmp_path / "cache").iterdir())) == 3
    assert store.prune(spark, cache) == [] and len(store.prune(spark, cache, max_bytes=0)) == 3 and store.prune(spark, str(tmp_path / "none")) == []


def test_panel_store(spark, tmp_path):
    s = store.PanelStore(spark, str(tmp_path / "p"))
    assert s.factors() == []
    rows = [(D(i), c, float(i)) for i in range(60) for c in "ab"]
    df = spark.createDataFrame(rows, "date date, code string, signal double")
    s.write("f", df)
    s.write("g", df.where("code = 'a'"))
    s.write("f", df.where("month(date) = 2").selectExpr("date", "code", "-signal as signal"))
    assert s.factors() == ["f", "g"] and s.dates("f").count() == 60
    got = {(r["date"], r["code"]): r["signal"] for r in s.load("f", D(20), D(40)).collect()}
    assert len(got) == 42 and got[D(20), "a"] == 20.0 and got[D(40), "b"] == -40.0
    assert sorted(s.aligned(["f", "g"], start=D(31)).columns) == ["code", "date", "f", "g"] and s.aligned(["f", "g"], start=D(31)).count() == 29
    assert "month" in s.load("f", D(20), D(40))._jdf.queryExecution().executedPlan().toString()


def test_artefacts_need_no_local_files(spark, tmp_path):
    df = spark.createDataFrame([(D(0), "a", 1.0), (D(1), "a", None)], "date date, code string, signal double")
    one = tables.write_artifact(df, str(tmp_path / "x"), {"name": "f"})
    two = tables.write_artifact(df.orderBy("signal"), str(tmp_path / "y"), {"name": "f"})
    assert one["digest"] == two["digest"] and one["rows"] == 2
    back, meta = tables.read_artifact(spark, str(tmp_path / "x"))
    assert back.count() == 2 and meta["name"] == "f"
    assert tables.write_artifact(df.limit(1), str(tmp_path / "y"), {})["digest"] != one["digest"]
    with pytest.raises(FileNotFoundError):
        tables.read_artifact(spark, str(tmp_path / "none"))
