"""CSV sources and sinks. All cells are strings; real nulls inside, the text NULL at the sinks.

A short row is padded with nulls, surplus cells and blank lines are dropped, an
empty cell is null, and so is the text NULL that the sinks write; a row whose cells are all empty is a row. A missing input raises, as every Spark source does.

Files are read by split, however large they are, although a quoted cell may hold line breaks. A first pass finds for every
split in which state it ends, inside or outside of quotes, and how many records end in it, for both states
that it may begin in. One row a split then gives every split its state and the number of its first record, by a
running sum; the second pass cuts records. What a record has in several splits is put together by its number.
"""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TEXT = "NULL"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the next line begins inside of quotes, if this one does or does not."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _by_split(batches, columns: int = 3):
    """(path, start of the split, lines) for each run of rows (line, path, start)."""
    for b in batches:
        lines, paths, starts = (b.column(i).to_pylist() for i in range(columns))
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and starts[j] == starts[i] and paths[j] == paths[i]:
                j += 1
            yield paths[i], starts[i], lines[i:j]
            i = j


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _scan(batches):
    """For every split: the states it ends in and the records that end in it, by the state it begins in."""
    found: dict[tuple[str, int], list] = {}
    for path, start, lines in _by_split(batches):
        state = found.setdefault((path, start), [False, 0, True, 0])
        for line in lines:
            for k in (0, 2):
                before = state[k]
                state[k] = ends_inside(line, before)
                state[k + 1] += not state[k] and (before or not _blank(line))
    rows = [(*key, *state) for key, state in found.items()]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "start", "out_end", "out_n", "in_end", "in_n"])


def cells_of(record: str) -> list[str]:
    csv.field_size_limit(1 << 30)
    return next(csv.reader(io.StringIO(record, newline="")), [])


def _records(begin: dict[tuple[str, int], tuple[bool, int, int]]):
    """(path, record, at, place, text, cells): whole records have cells; of others each split gives a piece of text, in order of place."""

    def batch(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "record", "at", "place", "text", "cells"])

    def run(batches):
        key, inside, number, shift, held, begun, rows = None, False, 0, 0, [], False, []
        for path, start, lines in _by_split(batches):
            if (path, start) != key:
                if held:
                    rows.append((key[0], number, number + shift, key[1], "\n".join(held) + "\n", None))
                key, (inside, number, shift), held = (path, start), begin[path, start], []
                begun = inside  # the first record began in an earlier split
            for line in lines:
                before, inside = inside, ends_inside(line, inside)
                if not before and not inside and not held and _blank(line):
                    continue
                held.append(line)
                if not inside:
                    text = "\n".join(held)
                    rows.append((path, number, number + shift, start, text, None) if begun else (path, number, number + shift, start, None, cells_of(text.removesuffix("\r"))))
                    held, begun, number = [], False, number + 1
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if held:
            rows.append((key[0], number, number + shift, key[1], "\n".join(held) + "\n", None))
        yield batch(rows)

    return run


def _whole(batches):
    for b in batches:
        cells = [cells_of(t.removesuffix("\n").removesuffix("\r")) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cells, pa.list_(pa.string()))], ["path", "record", "at", "cells"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, at, cells): the records of CSV files, numbered from 0 in each file; at: the row's position in all files; blank lines are none."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    splits = lines.mapInArrow(_scan, "path string, start long, out_end boolean, out_n long, in_end boolean, in_n long").collect()  # one row a split
    begin: dict[tuple[str, int], tuple[bool, int, int]] = {}
    path_, inside, number, shift = None, False, 0, 0
    for r in sorted(splits, key=lambda r: (r["path"], r["start"])):
        if r["path"] != path_:
            shift += max(0, number + inside - 1)  # a file's first record is its header; one without an end ends with the file
            path_, inside, number = r["path"], False, 0
        begin[r["path"], r["start"]] = inside, number, shift - 1
        inside, number = (r["in_end"], number + r["in_n"]) if inside else (r["out_end"], number + r["out_n"])
    cut = lines.mapInArrow(_records(begin), "path string, record long, at long, place long, text string, cells array<string>")
    pieces = cut.where("cells IS NULL").groupBy("path", "record", "at").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))  # at most two a split
    joined = pieces.select("path", "record", "at", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    return cut.where("cells IS NOT NULL").select("path", "record", "at", "cells").unionByName(joined.mapInArrow(_whole, "path string, record long, at long, cells array<string>"))


def column_names(header: list[str]) -> list[str]:
    """Names of a header: an empty one is numbered, and so is one that stood before."""
    out: list[str] = []
    for i, name in enumerate(header):
        name = name or f"_c{i}"
        while name.lower() in {x.lower() for x in out}:
            name += str(i)
        out.append(name)
    return out


def read_table(spark: SparkSession, path: str, row_col: str | None = None) -> DataFrame:
    """A table with its first file's header as column names; row_col: add the row's position, gapless from 0, in the order of files and lines."""
    records = read_records(spark, path)
    heads = records.where("record = 0").select("path", "cells").orderBy("path").first()
    if heads is None:
        return spark.createDataFrame([], T.StructType([]))
    names = column_names([c.removeprefix("\ufeff") for c in heads["cells"]])
    cell = lambda i: F.get("cells", F.lit(i))
    cells = [F.when((cell(i) != "") & (cell(i) != NULL_TEXT), cell(i)).alias(n) for i, n in enumerate(names)]
    rows = records.where("record > 0")
    if not row_col:
        return rows.select(*cells)
    return rows.select(*cells, F.col("at").alias(row_col))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, category, pos, alias): the alias file in long form.

    An empty alias of a row that has later cells stands for the text NULL, which
    therefore is an alias like any other.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    first, *rest = raw.columns
    rows = raw.withColumn("ordinal", F.monotonically_increasing_id())
    aliases = F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit(NULL_TEXT)) for c in rest))
    return rows.select("ordinal", F.col(f"`{first}`").alias("category"), F.posexplode(aliases).alias("pos", "alias"))


def alias_map(aliases: DataFrame) -> dict[str, list[str]]:
    """category -> aliases in file order; an alias file is a few rows."""
    out: dict[str, list[str]] = {}
    for r in aliases.orderBy("ordinal", "pos").collect():
        out.setdefault(r["category"], []).append(r["alias"])
    return out


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write a table, nulls as NULL. Writing stays distributed unless a single file is asked for."""
    out = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_TEXT)).alias(c) for c in df.columns))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """(LAYER, P, R, F): rescaling baselines, comma-separated whatever the suffix."""
    schema = T.StructType([T.StructField("LAYER", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "PRF")])
    return spark.read.csv(path, header=True, schema=schema)


def baseline_of(baselines: DataFrame, layer: int) -> tuple[float, float, float]:
    row = baselines.where(F.col("LAYER") == layer).first()
    if row is None:
        raise ValueError(f"no baseline for layer {layer}")
    return row["P"], row["R"], row["F"]
