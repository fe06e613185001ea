"""Benchmark decontamination by latent semantic retrieval.

Words are white-space tokens (of all of Unicode's white space) in lower case, of
which only letters and digits count; scripts written without spaces are cut into
characters. Words that
occur in the benchmark are the terms; no other word can take part in a match, so a
text becomes the positions and numbers of its terms, which all later passes read
instead of the text. Passages are windows of WINDOW words, every STRIDE words, over
whole texts, weighted by TF-IDF; frequencies count the blocks of STRIDE words, of
which a passage is two, over all texts. A term weighs something if it is in the
rarer half of an item's words, so every item keeps half of its words however often
the corpus repeats it, and function words weigh nothing.

A distributed randomised SVD of all passages, with the benchmark's own passages in
proportion, gives the latent space: each task adds up its part of Z = A'(A G) for a
Gaussian G, the sums are reduced by blocks of terms, and the left singular vectors of
Z (G'Z)^(-1/2), the Nystroem form that needs no second pass over the passages, are the
leading right singular vectors of A. Windows whose latent cosine with an item reaches COSINE are
candidates; for an item of fewer than FULL words, which is little of a window, the limit
shrinks with the root of its words. For those the longest common subsequence with the item, as a share of
the item's words, decides: VERBATIM or more is a leak, and so is PARAPHRASE or
more if the item's answer, its last sentence, is found in order as well.

The benchmark is sent to every task in blocks of about ITEM_CHARS characters, which bounds
the terms and so what is broadcast; a larger benchmark takes further rounds, over the positions of all
its words, for which texts are read once.

An item longer than a window is looked for by windows of its own.

Cases: null and empty texts and items hold no terms and match nothing; an item of
fewer than MIN_WORDS words is too short for shares and is reported where its words
stand in a row, but drop_contaminated drops no document for it, as a word or two prove no leak; very long
texts are searched whole, their windows in groups of bounded size; further columns are ignored, and kept by
drop_contaminated whatever their names are; items without item_id are skipped, as there is nothing to report them by; a
null doc_id is reported as null; rows that repeat a doc_id report once an item; ties cannot
arise, for every pair above the limits is reported; empty tables give no rows.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, load, materialize, numbered, own_names, trimmed, whole_text, without

WINDOW, STRIDE = 48, 24
RANK, EXTRA = 256, 16
COSINE, FULL = 0.35, 16
VERBATIM, PARAPHRASE = 0.75, 0.6
ITEM_CHARS = 400_000
MIN_WORDS = 5
ANSWER = 5  # a fifth
SEED = 4
TERM_BLOCK = 512
CHUNK_BYTES = 200_000
OVERLAP_TERMS = 1_000_000
HITS = 1 << 15
_OTHER = re.compile(r"[^\w\s]|_")
_ASCII_SPACED = bytes(32 if chr(c).isspace() else c for c in range(256))
_ASCII_OTHER = bytes(c for c in range(128) if _OTHER.match(chr(c)))
# Thai, Lao, Tibetan, Burmese, Khmer, kana, CJK ideographs
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)|[\u3002\uff0e\uff01\uff1f\uff61]+|\n+")
PAIRS = "doc_id long, item_id long, lcs double, cosine double, answer boolean, item_words int"


def words_of(text: str) -> list[bytes]:
    """White-space tokens in lower case, of which only letters and digits count; scripts without spaces by character."""
    text = text.lower()
    if text.isascii():
        return text.encode().translate(_ASCII_SPACED, _ASCII_OTHER).split()
    text = _OTHER.sub("", text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        if _UNSPACED.search(text):
            text = _UNSPACED.sub(r" \g<0> ", text)
    return " ".join(text.split()).encode("utf-8", "surrogatepass").split()


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence; where that is most of the text, or all of it, the last ANSWER of the words."""
    parts = [w for w in (words_of(p) for p in _SENTENCE.split(text)) if w]
    words = words_of(text)
    if parts and 2 * len(parts[-1]) <= len(words):
        return parts[-1]
    return words[len(words) - -(-len(words) // ANSWER) :]


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """A block of the benchmark: terms, the items as term numbers, and the passages of the items; short items apart."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.answers, self.short = [], [], [], []
        self.terms: dict[bytes, int] = {}
        self.passages, self.owners = [], []
        for item_id, text in rows:
            words = words_of(text or "")
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in words]
            if 0 < len(words) < MIN_WORDS:
                self.short.append((item_id, numbers))
            if len(words) < MIN_WORDS:
                continue
            for start in range(0, max(len(words) - WINDOW, 0) + STRIDE, STRIDE):
                self.owners.append(len(self.ids))
                self.passages.append(numbers[max(0, min(start, len(words) - WINDOW)) :][:WINDOW])
                if start + WINDOW >= len(words):
                    break
            self.ids.append(item_id)
            self.words.append(numbers)
            self.answers.append([self.terms.setdefault(w, len(self.terms)) for w in answer_of(text)])


def term_positions(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, at, term): positions and numbers of a text's terms, as 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        for b in batches:
            n_words, ats, numbers = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                numeric = np.fromiter(map(terms.get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(numeric >= 0).astype(np.int32)
                n_words.append(numeric.size)
                ats.append(at.tobytes())
                numbers.append(numeric[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int32()), pa.array(ats, pa.binary()), pa.array(numbers, pa.binary())], ["doc_id", "n_words", "at", "term"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_words int, at binary, term binary")


def vocabulary(texts: DataFrame) -> dict[bytes, int]:
    """Numbers of all words of a benchmark (text), which are as many as its vocabulary has, however long it is."""

    def run(batches):
        for b in batches:
            found = {w for t in b.column(0).to_pylist() for w in (*words_of(t), *answer_of(t))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary())], ["word"])

    words = texts.select("text").mapInArrow(run, "word binary").distinct().collect()
    return {w: i for i, w in enumerate(sorted(bytes(r["word"]) for r in words))}


def of_block(spots: DataFrame, every: dict[bytes, int], items: Items) -> DataFrame:
    """spots of all terms as those of a block's terms, by the block's numbers."""
    local = np.full(len(every), -1, np.int32)
    for w, k in items.terms.items():
        local[every[w]] = k
    shared = spots.sparkSession.sparkContext.broadcast(local)

    def run(batches):
        own = shared.value
        for b in batches:
            ats, numbers = [], []
            for at, term in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                number = own[np.frombuffer(term, np.int32)]
                held = number >= 0
                ats.append(np.frombuffer(at, np.int32)[held].tobytes())
                numbers.append(number[held].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ats, pa.binary()), pa.array(numbers, pa.binary())], ["doc_id", "n_words", "at", "term"])

    return spots.mapInArrow(run, "doc_id long, n_words int, at binary, term binary")


def slices(batches, column: int):
    """Runs of rows whose positions (in column) take about CHUNK_BYTES."""
    for b in batches:
        sizes = [0 if x is None else len(x) for x in b.column(column).to_pylist()]
        start = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= CHUNK_BYTES:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


class Chunk:
    """The terms of some texts, and which half-window (STRIDE words) each lies in; windows are two halves in a row."""

    def __init__(self, batch, start: int = 1):
        ats = [np.frombuffer(x, np.int32) for x in batch.column(start + 1).to_pylist()]
        self.at = np.concatenate(ats) if ats else np.empty(0, np.int32)
        self.term = np.frombuffer(b"".join(batch.column(start + 2).to_pylist()), np.int32)
        n_words = np.asarray(batch.column(start).to_pylist(), np.int64)
        self.halves = np.maximum(-(-n_words // STRIDE), 1) + 1  # an empty half after each text closes its last window
        self.base = np.cumsum(self.halves) - self.halves
        self.sizes = np.array([a.size for a in ats], np.int64)
        self.doc = np.repeat(np.arange(len(ats)), self.sizes)
        self.half = self.base[self.doc] + self.at // STRIDE
        self.total = int(self.halves.sum())

    def windows(self, weight: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(halves that start a window with weighted terms, the window's vector); vectors: of the terms, times their weights."""
        own = np.flatnonzero(weight[self.term] > 0)
        if not own.size:
            return np.empty(0, np.int64), np.empty((0, vectors.shape[1]), vectors.dtype)
        half, term = self.half[own], self.term[own]
        cut = np.flatnonzero(np.append(True, half[1:] != half[:-1]))
        sums = sums_of_runs(vectors, term, cut)
        held = half[cut]
        starts = np.union1d(held, held[held > 0] - 1)
        starts = starts[~np.isin(starts, self.base + self.halves - 1)]  # a window may not begin in a closing half
        out = np.zeros((starts.size, vectors.shape[1]), vectors.dtype)
        for shift in (0, 1):
            place = np.searchsorted(held, starts + shift)
            place[place == held.size] = 0
            hit = held[place] == starts + shift
            out[hit] += sums[place[hit]]
        return starts, out


def sums_of_runs(vectors: np.ndarray, term: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The sum of vectors[term] over each run of term that begins at cut; runs are short."""
    size = np.diff(np.append(cut, term.size))
    out = vectors[term[cut]]
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] += vectors[term[cut[more] + k]]
    return out


def document_frequencies(spots: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """By term, the number of blocks of STRIDE words that hold it; and the number of blocks."""

    def run(batches):
        df, n = np.zeros(n_terms, np.int64), 0
        for b in slices(batches, 1):
            c = Chunk(b, 0)
            n += int((c.halves - 1).sum())
            df += np.bincount(np.unique(c.half * n_terms + c.term) % n_terms, minlength=n_terms)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int64)), pa.array(np.append(df[hit], n))], ["term", "n"])

    rows = spots.select("n_words", "at", "term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row a term
    df = np.zeros(n_terms, np.int64)
    passages = 0
    for r in rows:
        if r["term"] < 0:
            passages = r["n"]
        else:
            df[r["term"]] = r["n"]
    return df, passages


def rarer_halves(items: Items, df: np.ndarray) -> np.ndarray:
    """Which terms are in the rarer half of some item's distinct words."""
    out = np.zeros(df.size, bool)
    for words in items.words:
        own = np.unique(words)
        out[own[np.argsort(df[own], kind="stable")][: -(-own.size // 2)]] = True
    return out


def _reduced(spots: DataFrame, make, n_rows: int, width: int) -> np.ndarray:
    """The sum over tasks of a matrix that make(batches) gives; summed by blocks of rows on the executors."""

    def run(batches):
        m = make(batches)
        blocks = range(0, n_rows, TERM_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([m[i : i + TERM_BLOCK].astype(np.float32).tobytes() for i in blocks], pa.binary())], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["part"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    parts = spots.select("n_words", "at", "term").mapInArrow(trimmed(run), "block long, part binary").groupBy("block").applyInPandas(add, "block long, part binary")
    out = np.zeros((n_rows, width))
    for r in parts.collect():  # terms * rank numbers, whatever the corpus
        m = np.frombuffer(bytes(r["part"]), np.float32).reshape(-1, width)
        out[r["block"] : r["block"] + m.shape[0]] = m
    return out


class Passages:
    """The passages of the benchmark as the rows of a sparse matrix of weights."""

    def __init__(self, items: Items, weight: np.ndarray):
        sizes = np.array([len(p) for p in items.passages], np.int64)
        self.n = sizes.size
        self.owner = np.repeat(np.arange(self.n), sizes)
        self.term = np.fromiter((t for p in items.passages for t in p), np.int64, int(sizes.sum()))
        self.weight = weight[self.term]

    def times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, m.shape[1]))
        for i in range(0, self.term.size, 8192):
            own = slice(i, i + 8192)
            np.add.at(out, self.owner[own], self.weight[own, None] * m[self.term[own]])
        return out

    def transposed_times(self, m: np.ndarray, n_terms: int) -> np.ndarray:
        out = np.zeros((n_terms, m.shape[1]))
        for i in range(0, self.term.size, 8192):
            own = slice(i, i + 8192)
            np.add.at(out, self.term[own], self.weight[own, None] * m[self.owner[own]])
        return out


def latent_basis(spots: DataFrame, items: Items, weight: np.ndarray, passages: int, rank: int = RANK) -> np.ndarray:
    """Terms x rank: leading right singular vectors of the passages, by randomised SVD."""
    spark, n = spots.sparkSession, weight.size
    width = min(n, rank + EXTRA)
    own = Passages(items, weight)
    own.weight = own.weight * np.sqrt(max(1.0, passages / max(1, own.n)))  # the benchmark's passages weigh as much as the corpus
    gauss = np.random.default_rng(SEED).standard_normal((n, width), np.float32)

    def project(shared):
        def make(batches):
            vectors, w = shared.value
            vectors = w[:, None] * vectors
            z = np.zeros((n, width))
            for b in slices(batches, 1):
                c = Chunk(b, 0)
                starts, y = c.windows(w, vectors)
                if not starts.size:
                    continue
                every = np.flatnonzero(w[c.term] > 0)
                for i in range(0, every.size, HITS):  # a long text is one chunk
                    hit = every[i : i + HITS]
                    half, term = c.half[hit], c.term[hit]
                    add = np.zeros((hit.size, width), y.dtype)
                    for shift in (0, 1):
                        place = np.searchsorted(starts, half - shift)
                        place[place == starts.size] = 0
                        ok = starts[place] == half - shift
                        add[ok] += y[place[ok]]
                    order = np.argsort(term, kind="stable")
                    cut = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
                    at = term[order][cut]
                    z[at] += w[at][:, None] * np.add.reduceat(add[order], cut, axis=0)
            return z

        return make

    z = _reduced(spots, project(spark.sparkContext.broadcast((gauss, weight.astype(np.float32)))), n, width)
    z += own.transposed_times(own.times(gauss), n)
    core = gauss.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > 1e-6 * max(values.max(initial=0.0), 1e-300)  # sums are of 32-bit floats
    return np.linalg.svd(z @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)[0][:, :rank]


def item_words(items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item * terms + term, how often the item has it), sorted: the words of all items."""
    n = len(items.terms)
    flat = np.fromiter((k * n + t for k, words in enumerate(items.words) for t in words), np.int64)
    return np.unique(flat, return_counts=True)


def overlaps(terms: np.ndarray, begin: np.ndarray, stop: np.ndarray, item: np.ndarray, n_terms: int, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each run terms[begin:stop], how many words of its item it holds, each as often as both do: no common subsequence is longer."""
    own, need = words
    out = np.zeros(begin.size)
    lens = stop - begin
    total, i = np.cumsum(lens), 0
    while i < begin.size:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + OVERLAP_TERMS, side="right")))
        size = lens[i:j]
        run = np.repeat(np.arange(i, j), size)
        held = terms[np.repeat(begin[i:j] - (np.cumsum(size) - size), size) + np.arange(run.size)] + item[run] * n_terms
        place = np.minimum(np.searchsorted(own, held), own.size - 1)
        hit = own[place] == held
        pair, count = np.unique(run[hit] * own.size + place[hit], return_counts=True)
        out += np.bincount(pair // own.size, np.minimum(count, need[pair % own.size]), begin.size)
        i = j
    return out


def runs_of(c: Chunk, short: list[tuple[int, list[int]]]):
    """(text, item number) wherever the words of a short item stand in a row."""
    order = np.argsort(c.term, kind="stable")
    ranked = c.term[order]
    for k, (_, words) in enumerate(short):
        at = order[np.searchsorted(ranked, words[0]) : np.searchsorted(ranked, words[0], side="right")]
        at = at[at + len(words) <= c.term.size]
        for i, w in enumerate(words[1:], 1):
            at = at[(c.term[at + i] == w) & (c.at[at + i] == c.at[at] + i) & (c.doc[at + i] == c.doc[at])]
        for d in np.unique(c.doc[at]).tolist():
            yield d, k


def _matcher(shared):
    def run(batches):
        items, weight, basis, latent = shared.value
        sizes = np.array([len(w) for w in items.words], np.int64)
        owners = np.array(items.owners, np.int64)
        words = item_words(items)
        basis = weight[:, None] * basis
        least = (COSINE * np.sqrt(np.minimum(sizes[owners] / FULL, 1.0))).astype(np.float32)
        for b in slices(batches, 2):
            c = Chunk(b)
            doc_ids = b.column(0).to_pylist()
            starts, y = c.windows(weight, basis)
            norm = np.sqrt((y**2).sum(axis=1))
            y = (y / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)
            best: dict[tuple[int, int], list] = {}
            span = int(c.halves.max(initial=1) * STRIDE + 2 * sizes.max(initial=0) + WINDOW)
            spot = c.doc * span + c.at  # ascending over the chunk
            for i in range(0, starts.size, 8192):
                cosines = y[i : i + 8192] @ latent.T
                window, passage = np.nonzero(cosines >= least)
                item = owners[passage]
                doc = np.searchsorted(c.base, starts[i + window], side="right") - 1
                first = (starts[i + window] - c.base[doc]) * STRIDE
                # the words before and after a window that an item reaching into it can hold
                begin = np.searchsorted(spot, doc * span + np.maximum(first - sizes[item], 0))
                stop = np.searchsorted(spot, doc * span + np.minimum(first + WINDOW + sizes[item], span - 1))
                enough = overlaps(c.term, begin, stop, item, len(items.terms), words) >= PARAPHRASE * sizes[item]
                for n in np.flatnonzero(enough).tolist():
                    k = int(item[n])
                    region = c.term[begin[n] : stop[n]].tolist()
                    share = lcs_length(items.words[k], region) / len(items.words[k])
                    if share < PARAPHRASE:
                        continue
                    answer = lcs_length(items.answers[k], region) == len(items.answers[k])
                    if share >= VERBATIM or answer:
                        seen = best.setdefault((int(doc[n]), k), [0.0, 0.0, False])
                        seen[:] = max(seen[0], share), max(seen[1], float(cosines[window[n], passage[n]])), seen[2] or answer
            # short items are numbered after the others, and match whole or not at all
            best |= {(d, len(items.ids) + k): [1.0, 1.0, True] for d, k in runs_of(c, items.short)}
            ids = items.ids + [i for i, _ in items.short]
            counts = [len(w) for w in items.words] + [len(w) for _, w in items.short]
            found = sorted(best.items())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids[d] for (d, _), _ in found], pa.int64()),
                    pa.array([ids[k] for (_, k), _ in found], pa.int64()),
                    pa.array([v[0] for _, v in found], pa.float64()),
                    pa.array([v[1] for _, v in found], pa.float64()),
                    pa.array([v[2] for _, v in found], pa.bool_()),
                    pa.array([counts[k] for (_, k), _ in found], pa.int32()),
                ],
                ["doc_id", "item_id", "lcs", "cosine", "answer", "item_words"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs, cosine, answer, item_words) for every document that holds a benchmark item."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col(item_col).cast("long").alias("item_id"), whole_text(item_text).alias("text")).where("item_id IS NOT NULL")
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, -(-chars // ITEM_CHARS))
    out = spark.createDataFrame([], PAIRS)
    every, spots_of_all = {}, None
    if rounds > 1:  # texts are cut into words once, for all rounds
        every = vocabulary(asked)
        spots_of_all = materialize(term_positions(docs, every, id_col, text_col), "all-spots")
    for r in range(rounds):
        own = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        items = Items(sorted((x["item_id"], x["text"]) for x in own.collect()))  # one block of the benchmark
        if not items.terms:
            continue
        spots = materialize(of_block(spots_of_all, every, items) if rounds > 1 else term_positions(docs, items.terms, id_col, text_col), "spots")
        df, passages = document_frequencies(spots, len(items.terms))
        weight = np.where(rarer_halves(items, df), np.log((passages + 1) / (df + 1)) + 1, 0.0)
        basis = latent_basis(spots, items, weight, passages)
        latent = Passages(items, weight).times(basis)
        norm = np.sqrt((latent**2).sum(axis=1))
        latent = (latent / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32)
        shared = spark.sparkContext.broadcast((items, weight.astype(np.float32), basis.astype(np.float32), latent))
        out = out.union(spots.mapInArrow(trimmed(_matcher(shared)), PAIRS))
    return out.groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine"), F.max("answer").alias("answer"), F.max("item_words").alias("item_words"))


@own_names
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item of MIN_WORDS words or more."""
    held = numbered(docs, "decontam-rows")
    bad = contaminated(held, benchmark, ROW, text_col).where(F.col("item_words") >= MIN_WORDS).select(F.col("doc_id").alias(ROW)).distinct()
    return without(held, materialize(bad, "leaks")).select(docs.columns)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
