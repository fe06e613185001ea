"""CSV files by split against csv.reader, and names of merged tables."""

import csv
import io
import random

import pytest

from mergeloom.operators import merge
from mergeloom.sources import tables


def made(rng, rows):
    """A CSV text with quotes, line breaks in quotes, short and long rows, blank lines and cells that look like quotes."""
    cell = lambda: rng.choice(["", "a", "b c", '"x,y"', '"say ""hi"""', '"two\nlines"', '"\n\n"', '"a\r\nb"', '5" pipe', '""', "NULL", "ü日本", '"q"t', '"' + "long " * rng.randint(0, 40) + '\n"'])
    out = ["h1,h2,h3"]
    for _ in range(rows):
        out.append(rng.choice([",".join(cell() for _ in range(rng.randint(1, 4))), ",,", "", "1,2,3"]))
    return rng.choice(["\n", "\r\n"]).join(out) + rng.choice(["", "\n"])


def expected(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [tuple(None if c in ("", "NULL") else c for c in (r + [""] * 3)[:3]) for r in rows[1:]]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_csv_by_split(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {f"f{i}.csv": made(rng, n) for i, n in enumerate((0, 1, 40, 60))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = tables.read_table(spark, str(tmp_path), "_row")
        got = sorted(map(tuple, df.collect()), key=lambda r: r[-1])
        if size < 100:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [r for name in sorted(texts) for r in expected(texts[name])]
    assert [r[:3] for r in got] == want and [r[3] for r in got] == list(range(len(want)))


def test_empty_rows_stay(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,a,\n1,2\n,\n\n3,4,5\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"), "n")
    assert df.columns == ["a", "a1", "_c2", "n"]
    assert sorted(map(tuple, df.collect()), key=lambda r: r[-1]) == [("1", "2", None, 0), (None, None, None, 1), ("3", "4", "5", 2)]
    one = spark.createDataFrame([("x",), (None,)], "c string")
    tables.write_table(one, str(tmp_path / "one"))
    assert sorted(str(r[0]) for r in tables.read_table(spark, str(tmp_path / "one")).collect()) == ["None", "x"]
    (tmp_path / "none.csv").write_text("")
    assert tables.read_table(spark, str(tmp_path / "none.csv")).columns == []


def test_names_that_clash(spark):
    left = spark.createDataFrame([(1, "a", "b")], "id long, x string, x_right string")
    right = spark.createDataFrame([(7, "c", "d")], "id long, X string, y string")
    links = spark.createDataFrame([(1, 7)], "left_id long, right_id long")
    out = merge.merge_tables(left, right, {"x": None, "x_right": "y"}, links, "id", "id")
    assert out.columns == ["x", "x_right", "X_right2"] and tuple(out.first()) == ("a", "b", "c")
    audit = merge.match_audit(left, right, links, "id", "id")
    assert audit.columns == ["id", "x", "x_right", "id_right", "X_right2", "y"] and tuple(audit.first()) == (1, "a", "b", 7, "c", "d")
    assert merge.free_names(["a", "A", "a_right", "a"]) == ["a", "A_right2", "a_right", "a_right3"]
