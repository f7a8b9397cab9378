import os

import pytest

from vitalshare.sources import checked

ALLOWED = ("UTF-8", "windows-1252", "ISO-8859-7")


def save(folder, name, content: bytes):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(content)


def test_lines_of_many_charsets(spark, tmp_path):
    root = str(tmp_path)
    save(root, "a.csv", b"\xef\xbb\xbfcode,name\n0010,S\xc3\xa3o\n0011\n\n0012,a,b\n0013,\xff\n0014,\n")
    save(f"{root}/charset=windows-1252", "b.csv", "code,name\n1,São – €\n".encode("cp1252") + b"2,\x81\n")
    save(f"{root}/charset=iso-8859-7", "c.csv", "code,name\n3,Αθήνα\n".encode("iso-8859-7") + b"4,\xd2\n")
    save(f"{root}/charset=koi8-r", "d.csv", "code,name\n5,Ж\n".encode("koi8-r"))
    lines = checked.read_checked(spark, root, ["code", "name"], ALLOWED)
    assert {tuple(r) for r in checked.kept(lines).collect()} == {
        ("0010", "São"), ("0014", None), ("1", "São – €"), ("3", "Αθήνα"),
    }
    bad = {(os.path.basename(r._file), r._reason, r._line) for r in checked.rejected(lines).collect()}
    assert bad == {
        ("a.csv", "columns", "0011"), ("a.csv", "columns", "0012,a,b"), ("a.csv", "bytes", "0013,ÿ"),
        ("b.csv", "bytes", "2,\x81"), ("c.csv", "bytes", "4,Ò"),
        ("d.csv", "charset", "5," + "Ж".encode("koi8-r").decode("latin-1")),
    }
    # nothing is lost whatever columns are read
    assert lines.count() == 10
    assert lines.groupBy("_reason").count().agg({"count": "sum"}).first()[0] == 10
    assert lines.where("_reason = 'columns'").select("code").count() == 2


def test_first_line_without_header_after_a_mark(spark, tmp_path):
    save(str(tmp_path), "a.csv", b"\xef\xbb\xbf0010;x\n")
    lines = checked.read_checked(spark, str(tmp_path), ["code", "name"], sep=";", header=False)
    assert [tuple(r) for r in checked.kept(lines).collect()] == [("0010", "x")]


def test_empty_folder_and_odd_parameters(spark, tmp_path):
    save(str(tmp_path), "a.csv", b"")
    assert checked.read_checked(spark, str(tmp_path), ["code"]).count() == 0
    for names in (["code", "_line"], ["code", "code"]):
        with pytest.raises(ValueError):
            checked.read_checked(spark, str(tmp_path), names)
    with pytest.raises(ValueError):
        checked.read_checked(spark, str(tmp_path), ["code"], ("utf-16",))


def test_one_scan_without_python(spark, tmp_path):
    save(f"{tmp_path}/charset=windows-1252", "b.csv", b"code,name\n1,x\n")
    lines = checked.read_checked(spark, str(tmp_path), ["code", "name"], ALLOWED)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Python" not in plan
