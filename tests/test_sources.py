from __future__ import annotations

import os
import zipfile

import pytest

from tabloom.errors import QueryError, SourceError
from tabloom.plans.sql import check_select, qualify, run_select, run_sql
from tabloom.sources import readers, writers


def put(path, text):
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_csv_missing_texts_and_types(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'id,x,f,s,only\n1,1.5,True,NA,\n2,null,False,"b, c",NaN\n3,NaN,,"say ""hi""",N/A\n')
    df = readers.load(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "f": "boolean", "s": "string", "only": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 1.5, True, None, None), (2, None, False, "b, c", None), (3, None, None, 'say "hi"', None),
    ]


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    df = readers.load(spark, put(tmp_path / "a.csv", 'id,s\n1,"two\nlines"\n2,one\n'))
    assert df.count() == 2 and df.where("id = 1").first()["s"] == "two\nlines"


def test_csv_with_schema_and_glob(spark, tmp_path):
    put(tmp_path / "d" / "a.csv", "id,x\n1,2\n")
    put(tmp_path / "d" / "b.csv", "id,x\n2,NA\n")
    df = readers.load(spark, str(tmp_path / "d" / "*.csv"), "csv", schema="id int, x double")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2.0), (2, None)]


@pytest.mark.parametrize("cell, schema", [("bad", "id int, x double"), ("2.5", "id int, x bigint"), ("maybe", "id int, x boolean")])
def test_csv_cells_that_do_not_fit_fail_the_read(spark, tmp_path, cell, schema):
    path = put(tmp_path / "a.csv", f"id,x\n1,{cell}\n")
    with pytest.raises(Exception, match="column x: not a"):
        readers.read_csv(spark, path, schema).collect()


def test_json_folder_of_lines_and_arrays(spark, tmp_path):
    put(tmp_path / "d" / "a.json", '{"a": 1}\n{"a": 2, "b": "x"}\n')
    put(tmp_path / "d" / "b.json", '[{"a": 3}, {"a": 4, "b": "y"}]')
    put(tmp_path / "d" / "c.json", '{\n "a": 5\n}')
    for schema in (None, "a bigint, b string"):
        got = readers.read_json(spark, str(tmp_path / "d"), schema).select("a", "b").collect()
        assert sorted(map(tuple, got)) == [(1, None), (2, "x"), (3, None), (4, "y"), (5, None)]
    put(tmp_path / "d" / "d.json", '{"a": 6}\n{"a": }\n')
    with pytest.raises(Exception):
        readers.read_json(spark, str(tmp_path / "d"), "a bigint").collect()


@pytest.mark.parametrize("text", ['{"a": 1, "b": "x"}\n{"a": 2}\n', '[{"a": 1, "b": "x"}, {"a": 2}]', '[\n {"a": 1, "b": "x"},\n {"a": 2}\n]'])
def test_json_lines_and_arrays(spark, tmp_path, text):
    path = put(tmp_path / "a.json", text)
    for schema in (None, "a bigint, b string"):
        df = readers.read_json(spark, path, schema)
        assert sorted((r["a"], r["b"]) for r in df.collect()) == [(1, "x"), (2, None)]


def workbook(path, rows):
    cells = lambda r, row: "".join(
        f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + i)}{r}"><v>{v}</v></c>'
        for i, v in enumerate(row)
        if v is not None
    )
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks_by_extension_and_by_content(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["id", "name", "v"], [1, "x", 2.5], [2, None, 3]])
    df = readers.load(spark, str(tmp_path / "a.xlsx"))
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", 2.5), (2, None, 3.0)]
    (tmp_path / "b.bin").write_bytes((tmp_path / "a.xlsx").read_bytes())
    assert readers.load(spark, str(tmp_path / "b.bin")).count() == 2
    with pytest.raises(SourceError):
        readers.load(spark, str(tmp_path / "b.bin"), strict=True)


def test_header_and_preview(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,x\n" + "1,2\n" * 6 + "3,text\n")
    assert readers.header(spark, path) == ["id", "x"]
    assert readers.preview_schema(spark, path).simpleString() == "struct<id:bigint,x:bigint>"


def test_publishing_never_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "a int, b double")
    path = writers.publish(df, str(tmp_path), "my set", "csv", owner="7")
    assert "/7/datasets/" in path and path.endswith("my_set.csv")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.save(df, path, "csv")
    assert sorted(r["json"] for r in writers.json_rows(df).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":null}']


def test_sql_panel_is_lazy_and_prunes(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    out = run_sql(orders, "SELECT o_custkey FROM data WHERE o_totalprice > 1000")
    plan = out._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert not spark.catalog.tableExists("data")
    assert run_sql(orders, "SELECT count(*) AS n FROM df").first()["n"] == orders.count()


@pytest.mark.parametrize(
    "sql,message",
    [
        ("WITH a AS (SELECT 1) SELECT * FROM TABLE", "Only SELECT"),
        ("SELECT 1", "TABLE placeholder"),
        ("SELECT 'TABLE'", "TABLE placeholder"),
        ("SELECT * FROM TABLE; DROP TABLE x", "'drop'"),
    ],
)
def test_guard_refuses(sql, message):
    with pytest.raises(QueryError, match=message):
        check_select(sql)


def test_guard_accepts_lookalikes(spark, tmp_path):
    path = put(tmp_path / "a.csv", "created_at,updated\n1,2\n")
    sql = "SELECT created_at, updated, 'drop TABLE' AS note FROM TABLE WHERE updated = 2"
    assert tuple(run_select(spark, path, sql).first()) == (1, 2, "drop TABLE")
    with pytest.raises(QueryError, match="file type"):
        run_select(spark, path, sql, "xlsx")


def test_qualify(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    top = qualify(df, F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"))), lambda rn: rn == 1)
    assert sorted(tuple(r) for r in top.collect()) == [("a", 2), ("b", 3)]
