"""Limits, numbering, import and export that must hold for tables of many files."""

import json
import struct

import pytest
from pyspark.sql import functions as F, types as T

from deskdb.__main__ import main
from deskdb.catalog import Database
from deskdb.engine import Engine
from deskdb.errors import AnalysisError
from deskdb.functions.values import Style, double_text, rendered, single_text
from deskdb.operators import select
from deskdb.operators.ingest import import_csv, read_csv
from deskdb.render import lines
from deskdb.sources import pagefile, pages
from deskdb.sources.pagewriter import Writer
from deskdb.sql.parser import fold


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of five files of different sizes, one of them empty."""
    path = tmp_path_factory.mktemp("many")
    for k, n in enumerate((300, 0, 1, 700, 50)):
        spark.range(1000 * k, 1000 * k + n).select("id", (F.col("id") % 7).cast("int").alias("m"), F.concat(F.lit("it's "), "id").alias("t")).coalesce(1).write.mode("append").parquet(f"{path}/t.parquet")
    return str(path)


def stored(spark, folder):
    db = Database(spark, folder)
    return [tuple(r)[:3] for r in db.table("t", storage_order=True).orderBy("__desk_file", "__desk_row").collect()]


@pytest.mark.parametrize("n", [0, 1, 5, 6, 299, 300, 301, 700, 1050, 1051, 5000])
@pytest.mark.parametrize("where", ["", " WHERE m = 3 OR id > 4010"])
def test_large_limits_take_the_same_rows(spark, folder, monkeypatch, n, where):
    monkeypatch.setattr(select, "FEW", 4)
    monkeypatch.setattr(select, "BLOCK_BITS", 5)
    got = Engine(spark, folder).execute(f"SELECT TOP {n} id, m, t FROM t{where}")
    rows = [r for r in stored(spark, folder) if not where or r[1] == 3 or r[0] > 4010]
    assert sorted(map(tuple, got.collect())) == sorted(rows[:n])
    plan = got._jdf.queryExecution().toString()
    assert n <= 4 or ("TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan)


def test_large_limits_of_given_tables(spark, monkeypatch):
    monkeypatch.setattr(select, "FEW", 4)
    db = Database(spark, tables={"t": spark.range(100)})
    assert Engine(spark, db).execute("SELECT TOP 30 PERCENT id FROM t").count() == 30


@pytest.mark.parametrize("where", ["", "m = 2 OR id > 3500"])
def test_rows_are_numbered_in_storage_order(spark, folder, monkeypatch, where):
    monkeypatch.setattr(lines, "BLOCK_BITS", 5)
    df = Database(spark, folder).table("t", storage_order=True)
    df = df.filter(where) if where else df
    got = lines.numbered_rows(df)
    want = [r[0] for r in stored(spark, folder) if not where or r[1] == 2 or r[0] > 3500]
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["__desk_n"])] == want and sorted(r["__desk_n"] for r in got.collect()) == list(range(1, len(want) + 1))
    if not where:
        assert "Window" not in got._jdf.queryExecution().toString()


def test_rows_of_tables_without_files_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BITS", 5)
    df = Database(spark, tables={"t": spark.range(0, 500, 1, 7)}).table("t", storage_order=True)
    assert [r["id"] for r in sorted(lines.numbered_rows(df).collect(), key=lambda r: r["__desk_n"])] == list(range(500))


def test_export_to_folders(spark, folder, tmp_path, capsys):
    rows = stored(spark, folder)
    assert main(["json", folder, "t", "-o", f"{tmp_path}/json"], spark) == 0
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(f"{tmp_path}/json").collect()) == sorted(r[0] for r in rows)
    assert main(["export", folder, "t", "-o", f"{tmp_path}/csv", "-d", ";"], spark) == 0
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/csv").collect() if r["value"] != "id;m;t"]
    assert sorted(got) == sorted(f"{a};{b};\"{c}\"" for a, b, c in rows)
    assert main(["export", folder, "t", "-o", f"{tmp_path}/sql", "-I", "postgres", "-S", "100"], spark) == 0
    made = [r["value"] for r in spark.read.text(f"{tmp_path}/sql").select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k")).orderBy("f", "k").collect()]
    assert len(made) == 11 and "".join(made).count("(") == len(rows) + 11 and made[0].startswith("INSERT INTO \"t\" (\"id\", \"m\", \"t\") VALUES (0, 0, 'it''s 0'), (1,")
    assert capsys.readouterr().out == ""


def test_statements_from_and_to_files(spark, folder, tmp_path, capsys):
    (tmp_path / "in.sql").write_text("SELECT COUNT(*) FROM t;")
    assert main(["sql", folder, "-P", "-i", f"{tmp_path}/in.sql", "-o", f"{tmp_path}/out.txt"], spark) == 0
    assert (tmp_path / "out.txt").read_text() == "count\n1051\n1 Row retrieved\n" and capsys.readouterr().out == ""


SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def test_header_lines_of_each_file_are_dropped(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("title\n\na,b\n" + "".join(f"{100 * k + j},x{j}\n" for j in range(40)))
    (tmp_path / "short.csv").write_text("title\n")
    got = read_csv(spark, str(tmp_path), SCHEMA, skip=3)
    assert sorted(r["a"] for r in got.collect()) == [100 * k + j for k in range(3) for j in range(40)]


def test_records_over_lines_when_asked(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"two\nlines"\n2,x\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, multi_line=True).collect()] == [(1, "two\nlines"), (2, "x")]
    with pytest.raises(AnalysisError):
        read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, skip=2, multi_line=True)
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).collect()


def test_files_are_split_and_counted_as_they_are_written(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "".join(f"{k},t{k}\n" for k in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert read_csv(spark, str(tmp_path / "big.csv"), SCHEMA).rdd.getNumPartitions() > 4
        spark.createDataFrame([(1, "x")], SCHEMA).write.parquet(f"{tmp_path}/t.parquet")
        assert import_csv(spark, str(tmp_path / "big.csv"), f"{tmp_path}/t.parquet") == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 50_001


def test_numbers_as_text(spark):
    values = [0.0, -0.0, 1.0, -5.0, 9.3, 1 / 3, 1e15, 999999999999999.0, 1e16, 1e22, 1.5e300, 1e-7, float("nan"), float("inf"), -float("inf"), None, 123456.75]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = {r["k"]: (r["d"], r["s"]) for r in df.select("k", double_text("v").alias("d"), single_text(F.col("v").cast("float")).alias("s")).collect()}
    for k, v in enumerate(values):
        assert got[k][0] == (None if v is None else f"{v:.16g}")
        assert got[k][1] == (None if v is None else f"{struct.unpack('f', struct.pack('f', v))[0]:.8g}" if v is None or abs(v) < 1e38 or v != v or v in (float("inf"), -float("inf")) else got[k][1])


def test_stored_guids_obey_braces(spark):
    field = T.StructField("g", T.StringType(), True, {"kind": "Replication ID"})
    df = spark.createDataFrame([("03020100-0504-0706-0809-0a0b0c0d0e0f",), ("odd",), (None,)], "g string")
    assert [r[0] for r in df.select(rendered(field, Style(braces=True))).collect()] == ["{03020100-0504-0706-0809-0a0b0c0d0e0f}".replace("-0a0b", "0a0b"), "odd", None]


def test_constants_are_compared_by_lower_case():
    assert not fold("ILIKE", "ſ", "s") and fold("ILIKE", "ABC", "a%") and not fold("LIKE", "ABC", "a%")


def test_neighbouring_pages_are_read_at_once():
    w = Writer()
    columns = [{"name": "n", "code": 4, "fixed": True, "length": 4}]
    n = w.table(columns, [[struct.pack("<i", k)] for k in range(1000)], per_page=10, kind=1)
    data, reads = w.bytes([(n, "t", 1, 0, None)]), []
    f = pages.PageFile(lambda at, size: reads.append((at, size)) or data[at : at + size], len(data))
    table = f.find("t")
    run = list(f.data_pages(table))
    reads.clear()
    assert len(list(f.rows(table, run))) == 1000 and len(run) == 100 and len(reads) == 1


def test_tasks_get_the_definition(spark, tmp_path, monkeypatch):
    w = Writer()
    n = w.table([{"name": "n", "code": 4, "fixed": True, "length": 4}], [[struct.pack("<i", k)] for k in range(30)], per_page=10)
    path = tmp_path / "a.mdb"
    path.write_bytes(w.bytes([(n, "t", 1, 0, None)]))
    reader = pagefile.PageSource({"path": str(path), "table": "t"}).reader(T.StructType([T.StructField("n", T.IntegerType())]))
    (run,) = reader.partitions()
    monkeypatch.setattr(pages.PageFile, "find", lambda *a: pytest.fail("the catalog was read again"))
    assert sum(b.num_rows for b in reader.read(run)) == 30
