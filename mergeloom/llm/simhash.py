"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Two fingerprints that differ in three bits meet at a fingerprint one bit from
one of them and two bits from the other. So every fingerprint emits its variants
within half the radius (0 and 1 flips, rounded up to 2 flips on one side), the
variants are shuffled, and those that collide are verified and linked.

Two facts, which lose no link, spare most two-flip variants. The parities of two
fingerprints at distance 3 differ, so only those of even parity emit two flips.
Of three positions two lie in the same half of the word, so both flips stay in
one half: 992 variants instead of 2016.

Variants travel in binary blocks by hash range, about two million to a bucket,
and every bucket is sorted on its own. The fingerprints that meet at one variant
and have a member within one flip of it are all within three bits of that
member, so a star on it links them without listing pairs.

Cases: a null or empty text, or one of white space, has no words and fingerprint
zero, linked like any other; fewer words than a shingle has give one shingle;
rows that repeat a doc_id are all kept; a null doc_id never names a component
unless all of it is null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import load, materialize, partitions, trimmed, whole_text

RADIUS = 3
BUCKET_VARIANTS = 2_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _masks() -> np.ndarray:
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for half in (range(32), range(32, 64)) for i in half for j in half if i < j]
    return np.array([0, *one, *two], np.uint64)


MASKS = _masks()
NEAR = 65  # codes below are variants of at most one flip


def fingerprint(text: str, words_per_shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lens + 1) - 1
    starts = (stops - lens)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts, stops[k - 1 :].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, h.size, 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > h.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants that fps emit, and the code (index in MASKS) of each."""
    near = (fps[:, None] ^ MASKS[None, :NEAR]).ravel()
    near_codes = np.tile(np.arange(NEAR, dtype=np.uint16), fps.size)
    even = fps[np.bitwise_count(fps) % 2 == 0]
    far = (even[:, None] ^ MASKS[None, NEAR:]).ravel()
    far_codes = np.tile(np.arange(NEAR, MASKS.size, dtype=np.uint16), even.size)
    return np.concatenate([near, far]), np.concatenate([near_codes, far_codes])


def _emit(buckets: int):
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(0, fps.size, 4096):
                v, code = variants(fps[i : i + 4096])
                at = (((v * MIX) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                order = np.argsort(at, kind="stable")
                v, code, at = v[order], code[order], at[order]
                ids, first = np.unique(at, return_index=True)
                ends = np.append(first[1:], at.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.astype(np.int64)), pa.array([v[s:e].tobytes() + code[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary())], ["bucket", "block"]
                )

    return run


def star_links(v: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (hub, other) between fingerprints that meet at a variant."""
    none = np.empty(0, np.uint64)
    s = np.sort(v)
    met = np.unique(s[1:][s[1:] == s[:-1]])
    if not met.size:
        return none, none
    place = np.searchsorted(met, v)
    place[place == met.size] = 0
    hit = met[place] == v
    v, code = v[hit], code[hit]
    fp = v ^ MASKS[code]
    order = np.lexsort((fp, code >= NEAR, v))
    v, code, fp = v[order], code[order], fp[order]
    first = np.append(True, v[1:] != v[:-1])
    hub = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), v.size)))
    ok = (code[hub] < NEAR) & (fp[hub] != fp) & (np.bitwise_count(fp[hub] ^ fp) <= RADIUS)
    pairs = np.unique(np.stack([fp[hub][ok], fp[ok]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    blocks = pdf["block"].tolist()
    v = np.concatenate([np.frombuffer(b, np.uint64, len(b) // 10) for b in blocks])
    code = np.concatenate([np.frombuffer(b, np.uint16, len(b) // 10, len(b) // 10 * 8) for b in blocks])
    a, b = star_links(v, code)
    return pd.DataFrame({"u": a.view(np.int64), "v": b.view(np.int64)})


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join every two of the distinct fingerprints ``fp`` at distance 3 or less, directly or over others."""
    spark = fps.sparkSession
    n = fps.count()
    parts = partitions(spark)
    buckets = max(4 * parts, -(-n * 561 // BUCKET_VARIANTS))
    blocks = fps.select("fp").repartition(parts).mapInArrow(trimmed(_emit(buckets)), "bucket long, block binary")
    return blocks.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_meet, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, its own included."""
    rows = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-nodes")
    roots = connected_components(ball_links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted, "fp-roots")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "fp-components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(load(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
