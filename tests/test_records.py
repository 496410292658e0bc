"""One read of text files: records across splits, open quotes, bytes that are not UTF-8."""

import dataclasses
import os
import random

import pytest
from pyspark.sql import functions as F

from sluicegate.model import ColumnConfig, TemplateConfig
from sluicegate.sources import files, records

AB = TemplateConfig(columns=tuple(ColumnConfig(n, column_order=i) for i, n in enumerate("ab")), template_id="ab")
MULTI = dataclasses.replace(AB, multi_line=True)


@pytest.fixture
def small_splits(spark):
    """File splits of a few bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def write(folder, name, content):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(str(folder), name), "wb") as f:
        f.write(content if isinstance(content, bytes) else content.encode())


def numbered(scan):
    rows = files.number_records(scan).rows
    return sorted(tuple(r) for r in rows.select(files.FILE_NAME, "row_number", "a", "b").filter("_ragged is null").collect())


def cell(draw):
    kind = draw.random()
    if kind < 0.4:
        return "".join(draw.choice("xy é'") for _ in range(draw.randint(1, 4))).strip() or "x"
    inner = "".join(draw.choice(["x", ",", "\n", '""', " ", "\n\n", "é", "\r\n"]) for _ in range(draw.randint(1, 9)))
    return f'"z{inner}"'


@pytest.mark.parametrize("size", [60, 400])
def test_quoted_line_breaks_across_splits(spark, tmp_path, small_splits, size):
    """The same records as one task for each file finds."""
    draw = random.Random(size)
    for k in range(2):
        lines = ["a,b"] + [f"{cell(draw)},{cell(draw)}" + draw.choice(["", "", "\n"]) for _ in range(50)]
        write(tmp_path, f"f{k}.csv", "\n".join(lines) + draw.choice(["", "\n"]))
    write(tmp_path, "long.csv", 'a,b\n1,"' + "one\n" * 100 + '"\n2,x\n')
    expected = numbered(files.scan_csv(spark, str(tmp_path), MULTI))
    small_splits(size)
    found = records.scan_records(spark, str(tmp_path), MULTI)
    assert found.unclosed.count() == 0
    assert numbered(found.rows) == expected
    assert len(expected) > 90


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    body = "".join(f'{i},"line\n{i}"\n' for i in range(1500))
    write(tmp_path, "one.csv", "a,b\n" + body)
    small_splits(1000)
    found = records.scan_records(spark, str(tmp_path), MULTI)
    splits = files.number_records(found.rows).splits
    assert splits.count() > 10
    rows = numbered(found.rows)
    assert rows == sorted([("one.csv", 0, "a", "b"), *(("one.csv", i + 1, str(i), f"line\n{i}") for i in range(1500))])


def test_a_file_that_ends_inside_quotes(spark, tmp_path):
    write(tmp_path, "open.csv", 'a,b\n1,"x\n2,y\n')
    write(tmp_path, "closed.csv", 'a,b\n1,"x\n"\n')
    found = records.scan_records(spark, str(tmp_path), MULTI)
    assert [os.path.basename(r.path) for r in found.unclosed.collect()] == ["open.csv"]
    assert numbered(found.rows) == [("closed.csv", 0, "a", "b"), ("closed.csv", 1, "1", "x\n")]


def test_lines_as_the_csv_source_reads_them(spark, tmp_path):
    text = 'a,b\n1,"x,y"\r\n\n  \n2\n3,4,5\n"say ""hi""",\n,"open\nlost,"\n é , z\n5"x,6\n'
    write(tmp_path, "f.csv", text)
    columns = ["a", "b", files.RAGGED]
    own = records.scan_records(spark, str(tmp_path), AB)
    assert own.unclosed is None
    expected = [tuple(r) for r in files.scan_csv(spark, str(tmp_path), AB).select(*columns).collect()]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in own.rows.select(*columns).collect())
    assert [r[0] for r in own.rows.filter("_open_line is not null").select("_open_line").collect()] == [',"open', 'lost,"']


def test_encodings(spark, tmp_path):
    write(tmp_path / "u", "u.csv", b"a,b\ncaf\xc3\xa9,x\n\xff,y\n\xef\xbf\xbd,z\n")
    own = records.scan_records(spark, str(tmp_path / "u"), AB).rows
    assert [tuple(r) for r in own.select("a", "_garbled").collect()] == [
        ("a", False), ("café", False), ("�", True), ("�", False),
    ]
    write(tmp_path / "l", "l.csv", 'a,b\ncafé,"x\ny"\n'.encode("latin-1"))
    latin = dataclasses.replace(MULTI, encoding="ISO-8859-1")
    assert numbered(records.scan_records(spark, str(tmp_path / "l"), latin).rows)[1] == ("l.csv", 1, "café", "x\ny")
    assert not records.can_scan(dataclasses.replace(AB, encoding="UTF-16"))


def plain_first_bad(data):
    try:
        data.decode()
    except UnicodeDecodeError as error:
        return error.start
    return None


def test_first_bad_byte(spark, tmp_path, small_splits):
    draw = random.Random(3)
    parts = [b"a", "é".encode(), "€".encode(), "\U0001f642".encode(), b"\n", b"\r\n", "�".encode(), b"x" * 30]
    broken = [b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\x80"]
    expected = {}
    for k in range(14):
        body = [draw.choice(parts) for _ in range(draw.randint(1, 200))]
        for _ in range(draw.choice([0, 1, 1, 3])):
            body.insert(draw.randint(0, len(body)), draw.choice(broken))
        data = draw.choice([b"", b"", b"\xef\xbb\xbf"]) + b"".join(body)
        write(tmp_path, f"f{k}.txt", data)
        if plain_first_bad(data) is not None:
            expected[f"f{k}.txt"] = (len(data), plain_first_bad(data))
    for size in (100, 100_000):
        small_splits(size)
        found = records.undecodable_files(spark, str(tmp_path))
        assert {os.path.basename(r.path): (r.length, r.first_bad_byte) for r in found.collect()} == expected
    assert 4 < len(expected) < 14


def test_no_files(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    write(tmp_path / "none", "empty.csv", "")
    assert numbered(records.scan_records(spark, str(tmp_path / "none"), MULTI).rows) == []
    assert records.scan_records(spark, str(tmp_path / "none"), AB).rows.count() == 0
    assert records.undecodable_files(spark, str(tmp_path / "none")).filter(F.lit(True)).collect() == []
