import io

import pytest

from deskdb.__main__ import main
from test_pages import sample


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("db")
    spark.createDataFrame([(1, "a,b", True), (2, None, False)], "k int, s string, b boolean").coalesce(1).write.parquet(str(at / "items.parquet"))
    spark.range(3).write.parquet(str(at / "other.parquet"))
    return str(at)


def run(spark, capsys, *argv, stdin="", monkeypatch=None):
    if monkeypatch:
        monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
    code = main(list(argv), spark)
    out = capsys.readouterr()
    return code, out.out


def test_commands(spark, capsys, folder, monkeypatch):
    assert run(spark, capsys, "tables", folder) == (0, "items other\n") and run(spark, capsys, "tables", "-1", "-T", folder)[1] == "table items\ntable other\n"
    assert run(spark, capsys, "count", folder, "ITEMS")[1] == "2\n" and run(spark, capsys, "ver", folder)[1] == "PARQUET\n"
    assert run(spark, capsys, "export", folder, "items")[1] == 'k,s,b\n1,"a,b",1\n2,,0\n'
    assert run(spark, capsys, "export", "-H", "-d", r"\t", "-Q", "-B", "-0", "NULL", folder, "items")[1] == "1\ta,b\tTRUE\n2\tNULL\tFALSE\n"
    assert run(spark, capsys, "export", "-I", "sqlite", folder, "items")[1] == 'INSERT INTO `items` (`k`, `s`, `b`) VALUES (1, "a,b", 1), (2, NULL, 0);\n'
    assert run(spark, capsys, "json", folder, "items")[1] == '{"k":1,"s":"a,b","b":1}\n{"k":2,"b":0}\n'
    text = run(spark, capsys, "schema", folder, "mysql", "-T", "items", "--drop-table", "--no-not-null")[1]
    assert "DROP TABLE IF EXISTS `items`;" in text and "`b`\t\t\tboolean\n" in text
    code, out = run(spark, capsys, "sql", "-P", "-F", folder, stdin="select k from items where b = 1;\n", monkeypatch=monkeypatch)
    assert (code, out) == (0, "k\n1\n")
    assert run(spark, capsys, "queries", folder)[1] == "\n" and run(spark, capsys, "count", folder, "nope")[0] == 1 and run(spark, capsys, "queries", folder, "nope")[0] == 1


def test_import(spark, capsys, folder, tmp_path):
    (tmp_path / "in.csv").write_text("k,s,b\n7,x,1\n")
    assert run(spark, capsys, "import", "-H", "1", folder, "items", str(tmp_path / "in.csv"))[1] == "1 rows\n"
    assert run(spark, capsys, "count", folder, "items")[1] == "3\n"


def test_page_files(spark, capsys, tmp_path):
    path = tmp_path / "a.mdb"
    path.write_bytes(sample()[0])
    assert run(spark, capsys, "ver", str(path))[1] == "JET4\n" and run(spark, capsys, "tables", str(path))[1] == "Asset Items\n" and run(spark, capsys, "count", str(path), "asset items")[1] == "5\n"
    assert run(spark, capsys, "tables", "-t", "query", str(path))[1] == "qry\n"
    assert "id\tRequired: yes\n" in run(spark, capsys, "prop", str(path), "Asset Items")[1]
    assert '"1900-01-02"' not in run(spark, capsys, "export", str(path), "Asset Items")[1]
