"""Sharding with byte balance for indivisible groups, by Karmarkar-Karp differencing.

Groups are documents with equal text. Each task differences about TASK_UNITS groups
into bundles: the two partial partitions with the largest spread are combined,
oppositely ordered, until one is left. Groups above a fixed share of all bytes
stay single. The bundles are differenced in turn, level by level, until at most DRIVER_UNITS
are left, which the driver differences into the shards. So neither a task nor the driver
holds more, whatever the input.

Slots number the documents of a shard by ascending doc_id; they come from a range
partitioning and one total by partition and shard.

Cases: a null text counts as an empty one (size 1); rows that repeat a doc_id
are all placed, each by itself; a group with more bytes than a shard's fair share cannot be
kept whole under the law ``bytes`` and is dealt in turn, by ascending doc_id, to the fewest
parts that fit, which differ by one row at most (there are fewer such groups than shards); an
empty table gives no rows.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, load, materialize, numbered, own_names, partitions, whole_text

SHARDS = 8
BUNDLES = 64
TASK_UNITS = 32_768
DRIVER_UNITS = 65_536
LARGE = 16_384


def differencing(sizes: list, k: int) -> list[list[int]]:
    """Indices of sizes in k bins with nearly equal sums, by k-way Karmarkar-Karp."""
    if not sizes:
        return [[] for _ in range(k)]
    # an entry: (-spread, order, sums in descending order, bins as nested pairs)
    heap = [(-s, i, [s] + [0] * (k - 1), [(i,)] + [None] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, a, abins = heapq.heappop(heap)
        _, _, b, bbins = heapq.heappop(heap)
        merged = [(x + y, p if q is None else q if p is None else (p, q)) for x, y, p, q in zip(a, reversed(b), abins, reversed(bbins), strict=True)]
        merged.sort(key=lambda m: -m[0])
        low = merged[-1][0]  # only differences matter
        heapq.heappush(heap, (low - merged[0][0], tick, [m[0] - low for m in merged], [m[1] for m in merged]))
        tick += 1
    return [_flat(x) for x in heap[0][3]]


def _flat(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if x is None:
            continue
        if len(x) == 1:
            out.append(x[0])
        else:
            stack += x
    return out


def _bundler(large: int, k: int):
    """(unit, parent): single large units and at most k bundles of the others, named by the partition."""

    def run(batches):
        part = TaskContext.get().partitionId() << 24
        rows = sorted((-n, u) for b in batches for u, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        single = [r for r in rows if -r[0] >= large]
        rest = [r for r in rows if -r[0] < large]
        bins = differencing([-r[0] for r in rest], min(k, max(1, len(rest))))
        placed = [(r, k + i) for i, r in enumerate(single)] + [(rest[i], b) for b, ids in enumerate(bins) for i in ids]
        if placed:
            yield pa.RecordBatch.from_pydict({"unit": pa.array([r[1] for r, _ in placed], pa.int64()), "parent": pa.array([part + b for _, b in placed], pa.int64())})

    return run


def spread_units(units: DataFrame, shards: int, task_units: int = TASK_UNITS, driver_units: int = DRIVER_UNITS) -> DataFrame:
    """(unit, shard) for units (unit, bytes), in shards of nearly equal bytes."""
    spark = units.sparkSession
    total, n = units.agg(F.sum("bytes"), F.count("*")).first()
    levels: list[DataFrame] = []
    now = units
    while n > driver_units or not levels:
        tasks = max(-(-n // task_units), min(partitions(spark), -(-n // 1024)), 1)
        step = now.select("unit", "bytes").repartition(tasks, "unit").mapInArrow(_bundler(max(1, (total or 0) // LARGE), BUNDLES), "unit long, parent long")
        levels.append(materialize(step, f"bundles-{len(levels)}"))
        now = now.join(levels[-1], "unit").groupBy(F.col("parent").alias("unit")).agg(F.sum("bytes").alias("bytes"))
        now = materialize(now, f"bundle-sizes-{len(levels)}")
        before, n = n, now.count()
        if n >= before:
            break
    last = sorted((-r["bytes"], r["unit"]) for r in now.collect())  # driver_units at most, or as few as the levels leave
    bins = differencing([-x[0] for x in last], shards)
    homes = spark.createDataFrame([(last[i][1], b) for b, ids in enumerate(bins) for i in ids], "unit long, shard int")
    for level in reversed(levels):
        homes = level.join(homes.withColumnRenamed("unit", "parent"), "parent").select("unit", "shard")
    return homes


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, *keep) for every row of docs; equal texts share a shard."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("g"), *keep)
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("g").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    fair = max(1, total // shards)
    giants = {bytes(r["g"]): (i, -(-r["bytes"] // fair)) for i, r in enumerate(groups.where(F.col("bytes") > fair).collect())}  # fewer than shards
    rows = rows.withColumn("piece", F.lit(0).cast("long"))
    if giants:
        where, parts = F.lit(-1), F.lit(1)
        for g, (i, n) in giants.items():
            where, parts = F.when(F.col("g") == F.lit(g), i).otherwise(where), F.when(F.col("g") == F.lit(g), n).otherwise(parts)
        rows = rows.withColumn("shard", where.cast("int"))
        dealt = number_slots(rows.where("shard >= 0"), ["doc_id"]).withColumn("piece", F.pmod(F.col("slot"), parts)).drop("slot")
        rows = materialize(rows.where("shard < 0").unionByName(dealt).drop("shard"), "dealt")
        groups = rows.groupBy("g", "piece").agg(F.sum("size").alias("bytes"))
    else:
        groups = groups.withColumn("piece", F.lit(0).cast("long"))
    groups = materialize(groups.withColumn("unit", F.monotonically_increasing_id()), "units")
    homes = groups.join(spread_units(groups.select("unit", "bytes"), shards), "unit").select("g", "piece", "shard")
    placed = rows.join(materialize(homes, "homes"), ["g", "piece"]).select("doc_id", "size", "text_crc32", "shard", *keep)
    return number_slots(placed, ["doc_id", "text_crc32", "size"])


def number_slots(placed: DataFrame, order: list[str]) -> DataFrame:
    """placed with ``slot``: 0, 1, 2, ... within each shard, in the given order."""
    keys = ["shard", *order]
    ranged = placed.repartitionByRange(partitions(placed.sparkSession), *keys).sortWithinPartitions(*keys)
    at = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    at = at.withColumn("part", F.shiftright("at", 33))
    firsts = at.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect()  # shards + partitions rows at most
    base: dict[int, int] = {}
    rows = []
    for r in sorted(firsts, key=lambda r: r["first"]):
        rows.append((r["part"], r["shard"], r["first"] - base.get(r["shard"], 0)))
        base[r["shard"]] = base.get(r["shard"], 0) + r["n"]
    shift = placed.sparkSession.createDataFrame(rows, "part long, shard int, shift long")
    return at.join(F.broadcast(shift), ["part", "shard"]).withColumn("slot", F.col("at") - F.col("shift")).drop("at", "part", "shift")


@own_names
def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as one folder a shard, ``shard=0`` and so on, each in slot order within its files; columns of docs named shard or slot are replaced."""
    held = numbered(docs, "shard-rows")
    homes = assign_shards(held, shards, id_col, text_col, keep=(ROW,)).select(ROW, "shard", "slot")
    joined = held.drop("shard", "slot").join(homes.hint("merge"), ROW).drop(ROW)
    joined.repartitionByRange(partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
