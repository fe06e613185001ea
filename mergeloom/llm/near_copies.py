"""Near copies of whole texts: SimHash, ball hashing, and an exact check of what collides.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles
is at least 0.8. Their SimHash fingerprints over the distinct words (not over the
shingles, of which one changed word changes five) then differ in few bits: over TABLES
independent fingerprints of BITS bits each, nearly every linked pair has one that differs in at most
RADIUS bits. So every fingerprint emits its variants within half the radius, the variants are
shuffled, and texts that meet at a variant are candidates.

Where FEW texts or fewer meet, all pairs of them are compared. Where more meet, first those with
equal fingerprints are compared with one of them, in a number of pairs in proportion to the texts,
which joins most. Then the texts that such crowds link are a set of their own. Of those sets that
are not one component yet, the texts outside of the largest component are first compared with
REPRESENTATIVES texts of it, again and again with others as long as that halves them, which is
linear in the texts and joins copies of one template. What is left outside is compared with
all others, in tiles of TILE texts, so no task holds a whole crowd and no pairs are written but
those that join. So every two that collide are compared or already joined, and every
comparison is of the whole sets.

Texts with the same words in the same order are one node. Variants travel in binary
blocks, eight bytes a variant. Only the sets of texts that met are moved: a bit array of fixed
size thins the rows before the join, and decides nothing.

What is lost is what no fingerprint brings together; tests and the README give the
recall against the exact join.

Cases: words are white-space tokens, in lower case for A-Z; null and empty texts and
those of white space are copies of each other; fewer words than a shingle has give one
shingle; rows that repeat a doc_id are rows of their own; of a group the smallest
doc_id stays, null last; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import ROW, bit_filter, materialize, numbered, own_names, partitions, trimmed, whole_text, without

WORDS = 5
NUM, DEN = 4, 5  # the similarity
TABLES, BITS, RADIUS = 8, 44, 2
FEW = 3
TILE = 256
REPRESENTATIVES = 8
BUCKET_VARIANTS = 2_000_000
LINKS_AT_ONCE = 1_000_000
SHINGLES_AT_ONCE = 4096
HASHED_WORDS = 500_000
_C, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_FLIPS = np.array([0, *(1 << i for i in range(BITS))], np.uint64)  # half of RADIUS
_KEY_BYTES = 6  # a variant, its table, and whether it is the fingerprint itself
_OWN = np.uint64(1 << 47)
#: A byte's bits, each in a byte of its own: sums of up to 255 of them stay apart.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def hashed(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The distinct shingles of hashed words, as sorted hashes."""
    if not h.size:
        return h
    k = min(k, h.size)
    m = h.size - k + 1
    total = h[:m] * _C
    for i in range(1, k):
        total ^= total >> np.uint64(29)
        total += h[i : m + i]
        total *= _GOLD
    total ^= total >> np.uint64(32)
    return np.unique(total)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of NUM / DEN or more."""
    if not x.size or min(x.size, y.size) * DEN < NUM * max(x.size, y.size):
        return x.size == y.size
    place = np.searchsorted(x, y)
    place[place == x.size] = 0
    common = int((x[place] == y).sum())
    return common * DEN >= NUM * (x.size + y.size - common)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = [np.uint64((i + 1) * int(_GOLD) & (1 << 64) - 1) for i in range(-(-TABLES * BITS // 64))]


def fingerprints(words: np.ndarray) -> np.ndarray:
    """TABLES SimHash fingerprints of BITS bits over distinct hashed words."""
    raw = np.stack([_mix(words + s) for s in _SEEDS], axis=1).view(np.uint8)
    total = np.zeros(raw.shape[1] * 8, np.int64)
    for i in range(0, words.size, 255):
        total += _LANES[raw[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    bits = (2 * total > words.size)[: TABLES * BITS].reshape(TABLES, BITS)
    padded = np.zeros((TABLES, 64), np.uint8)
    padded[:, :BITS] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


def _prints(batches):
    hashes = WordHashes()
    for b in batches:
        if len(hashes) > HASHED_WORDS:
            hashes.clear()
        same, prints = [], []
        for t in b.column(2).to_pylist():
            words = t.encode().lower().split()
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            prints.append(fingerprints(np.unique(hashed(words, hashes))).tobytes() if words else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(prints, pa.binary())], [ROW, "doc_id", "same", "prints"])


def _runs(nodes: np.ndarray, limit: int = 2048):
    """Slices of nodes that are numbered in a row."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(nodes) != 1) + 1, [nodes.size]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        for i in range(a, b, limit):
            yield i, min(i + limit, b)


_TABLES = (np.arange(TABLES, dtype=np.uint64) << np.uint64(BITS))[None, :, None]


def _emit(buckets: int):
    """Blocks of variants by bucket: the first node's number, then the variants, then the nodes' distances from the first."""

    def run(batches):
        for b in batches:
            nodes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, TABLES)
            for i, j in _runs(nodes):
                keys = (prints[i:j, :, None] ^ _FLIPS) | _TABLES
                at = ((_mix(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64).ravel()
                keys[:, :, 0] |= _OWN
                who = np.repeat(np.arange(j - i, dtype=np.uint16), TABLES * _FLIPS.size)
                order = np.argsort(at, kind="stable")
                keys, who, at = keys.ravel()[order].view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES], who[order], at[order]
                ids, first = np.unique(at, return_index=True)
                ends = np.append(first[1:], at.size)
                base = nodes[i : i + 1].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([base + keys[s:e].tobytes() + who[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary())], ["bucket", "block"])

    return run


def _unpacked(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(variant, node) of all entries."""
    keys, nodes = [], []
    for b in blocks:
        n = (len(b) - 8) // (_KEY_BYTES + 2)
        key = np.zeros((n, 8), np.uint8)
        key[:, :_KEY_BYTES] = np.frombuffer(b, np.uint8, n * _KEY_BYTES, 8).reshape(n, _KEY_BYTES)
        keys.append(key.view(np.uint64).ravel())
        nodes.append(np.frombuffer(b, np.int64, 1) + np.frombuffer(b, np.uint16, n, 8 + n * _KEY_BYTES))
    return np.concatenate(keys), np.concatenate(nodes)


def _met(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not twice.size:
        return np.zeros(keys.size, bool)
    place = np.searchsorted(twice, keys)
    place[place == twice.size] = 0
    return twice[place] == keys


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted keys where its group starts and ends."""
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.empty(0, np.int64)
    size = np.diff(np.append(cut, keys.size))
    return np.repeat(cut, size), np.repeat(cut + size, size)


def _stars(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(hub, other) for every other node of each group of sorted keys; the hub is its first node."""
    start, _ = _spans(keys)
    other = start != np.arange(keys.size)
    return np.stack([nodes[start[other]], nodes[other]], axis=1)


def met_pairs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs to compare, links of crowds), u < v: keys are variants, marked by _OWN if not flipped."""
    own, keys = keys & _OWN != 0, keys & ~_OWN
    hit = _met(keys)
    own, keys, nodes = own[hit], keys[hit], nodes[hit]
    order = np.lexsort((_mix(nodes.view(np.uint64)), keys))  # one order of nodes everywhere, so few are hubs
    own, keys, nodes = own[order], keys[order], nodes[order]
    start, end = _spans(keys)
    few = end - start <= FEW
    at = np.arange(keys.size)
    found = [np.stack([nodes[at[ok] - h], nodes[ok]], axis=1) for h in range(1, FEW) for ok in [few & (at - start >= h)]]
    crowd = ~few
    found.append(_stars(keys[crowd & own], nodes[crowd & own]))
    pairs = lambda parts: np.unique(np.sort(np.concatenate(parts), axis=1), axis=0)
    return pairs(found), pairs([_stars(keys[crowd], nodes[crowd])])


def forest(links: np.ndarray, root: dict[int, int] | None = None) -> np.ndarray:
    """Of links those that join something not yet joined; root: what earlier links have joined, added to."""
    root = {} if root is None else root

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i, (u, v) in enumerate(links.tolist()):
        a, c = find(u), find(v)
        if a != c:
            kept.append(i)
            root[max(a, c)] = min(a, c)
    return links[kept]


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """A row for every pair to compare, and one for the bucket with a forest of its crowds' links."""
    pairs, links = met_pairs(*_unpacked(pdf["block"].tolist()))
    out = pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]}).astype("Int64")
    out["links"] = None
    if len(links):
        out.loc[len(out)] = [pd.NA, pd.NA, forest(links).tobytes()]
    return out


def _forest(batches):
    """The links of buckets, of which only those that join something not yet joined in this task are passed on."""
    root: dict[int, int] = {}
    for b in batches:
        for raw in b.column(0).to_pylist():
            kept = forest(np.frombuffer(raw, np.int64).reshape(-1, 2), root)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["u", "v"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every set of left with every one of right."""
    flat = [np.concatenate([np.empty(0, np.uint64), *x]) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [y.size for y in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    if not common.size:
        return out
    place = [np.searchsorted(common, x) for x in flat]
    for p, x in zip(place, flat, strict=True):
        p[p == common.size] = 0
        p[common[p] != x] = -1
    for i in range(0, common.size, SHINGLES_AT_ONCE):
        sides = []
        for p, r, x in zip(place, rows, (left, right), strict=True):
            m = np.zeros((len(x), min(SHINGLES_AT_ONCE, common.size - i)), np.float32)
            hit = (p >= i) & (p < i + SHINGLES_AT_ONCE)
            m[r[hit], p[hit] - i] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _compare_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the texts of two tiles (or one with itself) the pairs of components that similar texts join."""
    a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
    left, right = pdf[pdf["tile"] == a], pdf[pdf["tile"] == b]
    sets = [[np.frombuffer(x, np.uint64) for x in side["items"]] for side in (left, right)]
    common = overlaps(*sets)
    sizes = [np.array([x.size for x in side], np.float64) for side in sets]
    roots = [side["root"].to_numpy() for side in (left, right)]
    ok = (common * DEN >= NUM * (sizes[0][:, None] + sizes[1][None, :] - common)) & (roots[0][:, None] != roots[1][None, :])
    i, j = np.nonzero(ok)
    joined = np.unique(np.sort(np.stack([roots[0][i], roots[1][j]], axis=1), axis=1), axis=0)
    return pd.DataFrame({"u": joined[:, 0], "v": joined[:, 1]})


def _sets(words_per_shingle: int):
    def run(batches):
        hashes = WordHashes()
        for b in batches:
            if len(hashes) > HASHED_WORDS:
                hashes.clear()
            items = [shingles(hashed(t.encode().lower().split(), hashes), words_per_shingle).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], ["node", "items"])

    return run


def _verify(batches):
    for b in batches:
        xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
        ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(xs, ys, strict=True)]
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _shape(members: DataFrame) -> DataFrame:
    """For each crowd of several components its largest one, the texts outside of it, and the tiles of both."""
    counts = members.groupBy("crowd", "root").agg(F.count("*").alias("n"))
    shape = counts.groupBy("crowd").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    outside = F.col("all") - F.col("most.n")
    return shape.select("crowd", F.col("most.root").alias("major"), outside.alias("outside"), F.ceil(outside / TILE).alias("others"), F.ceil(F.col("most.n") / TILE).alias("majors"))


def _with_representatives(members: DataFrame, shape: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Links (u, v) between the largest component of a crowd and those of texts outside that are similar to one of REPRESENTATIVES of its texts."""
    placed = members.join(shape, "crowd")
    outside = placed.where("root <> major").withColumn("a", F.pmod(F.xxhash64("node"), F.col("others")))
    # minima over differently salted hashes, so that no task holds the component
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(turn * REPRESENTATIVES + i)), "node"))["node"] for i in range(REPRESENTATIVES)]
    few = placed.where("root = major").groupBy("crowd", "major", "others").agg(F.array_distinct(F.array(*picks)).alias("nodes"))
    few = few.select("crowd", F.col("major").alias("root"), "others", F.explode("nodes").alias("node")).join(sets, "node")
    few = few.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))).withColumn("tile", F.lit(-1).cast("long"))
    columns = ["crowd", "tile", "node", "root", "a", "items"]
    dealt = outside.withColumn("tile", F.col("a")).join(sets, "node").select(columns).unionByName(few.select(columns))
    return dealt.withColumn("b", F.lit(-1).cast("long")).groupBy("crowd", "a", "b").applyInPandas(_compare_tiles, "u long, v long").distinct()


def _crowd_links(crowds: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between components that similar texts of one crowd join; crowds: links (u, v) of texts that met, roots: (node, root)."""
    members = connected_components(crowds).withColumnRenamed("root", "crowd").join(roots, "node", "left").select("crowd", "node", F.coalesce("root", "node").alias("root"))
    members = materialize(members, "crowd-members")
    joined, before, turn = [], None, 0
    while True:  # as long as a turn halves the texts outside; each is linear in them
        wide = _shape(members).where("others > 1")
        left = wide.agg(F.sum("outside")).first()[0] or 0
        if not left or (before is not None and 2 * left > before):
            break
        found = materialize(_with_representatives(members, wide, sets, turn), "crowd-found")
        if found.isEmpty():
            break
        joined.append(found)
        above = connected_components(found).select(F.col("node").alias("root"), F.col("root").alias("above"))
        members = materialize(members.join(above, "root", "left").select("crowd", "node", F.coalesce("above", "root").alias("root")), "crowd-members")
        before, turn = left, turn + 1
    h, major = F.xxhash64("node"), F.col("root") == F.col("major")
    placed = members.join(_shape(members), "crowd").withColumn("tile", F.when(major, F.col("others") + F.pmod(h, F.col("majors"))).otherwise(F.pmod(h, F.col("others"))))
    # the largest component is not compared with itself
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.when(major, F.col("others") - 1).otherwise(F.col("others") + F.col("majors") - 1)))
    dealt = placed.withColumn("partner", partner).select("crowd", "tile", "node", "root", F.least("tile", "partner").alias("a"), F.greatest("tile", "partner").alias("b"))
    return reduce(DataFrame.unionByName, joined, dealt.join(sets, "node").groupBy("crowd", "a", "b").applyInPandas(_compare_tiles, "u long, v long"))


def similar_roots(nodes: DataFrame, held: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """(node, root) for all of nodes (node, ROW, prints): root names the component of similar nodes; held: (ROW, text)."""
    everyone = nodes.select("node")
    nodes = nodes.where("prints IS NOT NULL")
    n = nodes.count()
    buckets = max(4 * partitions(nodes.sparkSession), -(-n * TABLES * _FLIPS.size // BUCKET_VARIANTS))
    blocks = nodes.select("node", "prints").mapInArrow(trimmed(_emit(buckets)), "bucket long, block binary").repartition(buckets, "bucket")
    met = materialize(blocks.groupBy("bucket").applyInPandas(_meet, "u long, v long, links binary"), "copies-met")
    pairs = materialize(met.where("links IS NULL").select("u", "v").distinct(), "copies-pairs")
    # texts that meet do so at many variants: a forest of the links that a task reads joins the same
    packed = met.where("links IS NOT NULL").select("links")
    n_links = packed.agg(F.sum(F.octet_length("links")) / 16).first()[0] or 0
    crowds = materialize(packed.coalesce(max(1, int(-(-n_links // LINKS_AT_ONCE)))).mapInArrow(_forest, "u long, v long"), "crowd-links")
    both_kinds = pairs.unionByName(crowds)
    who = both_kinds.select(F.col("u").alias("node")).union(both_kinds.select("v")).distinct()
    who = materialize(nodes.select("node", ROW).join(who, "node"), "copies-who")
    sets = held.where(bit_filter(who)).join(who.hint("merge"), ROW).select("node", "text").mapInArrow(trimmed(_sets(words_per_shingle)), "node long, items binary")
    sets = materialize(sets, "copies-sets")
    left, right = (sets.select(F.col("node").alias(x), F.col("items").alias(y)) for x, y in (("u", "x"), ("v", "y")))
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").select("u", "v", "x", "y")
    roots = materialize(connected_components(both.mapInArrow(_verify, "u long, v long")), "copies-roots")
    rooted = everyone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if crowds.isEmpty():
        return rooted
    above = connected_components(_crowd_links(crowds, roots, sets)).select(F.col("node").alias("root"), F.col("root").alias("above"))
    return rooted.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))


@own_names
def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = WORDS) -> DataFrame:
    """docs with one row of every group that similar rows link."""
    held = numbered(docs, "near-rows")
    text = held.select(ROW, F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    rows = materialize(text.mapInArrow(trimmed(_prints), f"{ROW} long, doc_id long, same binary, prints binary"), "prints")
    nodes = rows.groupBy("same").agg(F.min(F.struct(ROW, "prints")).alias("x")).select("same", f"x.{ROW}", "x.prints")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "copies-nodes")
    rooted = nodes.select("same", "node").join(similar_roots(nodes, text.select(ROW, "text"), words_per_shingle), "node").select("same", "root")
    grouped = materialize(rows.select(ROW, "doc_id", "same").join(rooted, "same").select(ROW, "doc_id", "root"), "copies-grouped")
    # a partial aggregation, so a group of any size is one row a task
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("x"))
    lost = grouped.select(ROW).join(best.select(F.col(f"x.{ROW}").alias(ROW)), ROW, "left_anti")
    return without(held, materialize(lost, "copies-lost")).select(docs.columns)
