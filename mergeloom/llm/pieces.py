"""SentencePiece encoding, decoding and sampling of distinct segmentations.

Encoding and decoding follow the public model. Sampling is Gumbel top-k without
replacement: an A* search that partitions the set of all segmentations of a text.
Every part has an upper bound, the Gumbel variable of its total probability
truncated at its parent's; the part with the highest bound is popped, a
segmentation is drawn from it, and the rest is split by where it leaves the drawn
path. The first k drawn are distinct, and follow the law of drawing k without
replacement. The bound of the best remaining part is the threshold T that gives a
segmentation of log-probability lp the inclusion score 1 - exp(-exp(lp - T)).

The lattice is cut at spaces, which pieces cross only in runs of spaces. Each
distinct word of a chunk of texts gets its lattice once: edges by a trie, total
probabilities of suffixes by one backward pass. Drawing then walks all words of the
chunk together. Random numbers are a hash of seed, row key, draw, word and step, and sums are taken word by word, so
nothing depends on the partitioning. Lattices of words stay for the next chunk, up to ``KEPT`` characters.

The public model is a BPE, so its pieces have ranks, not probabilities: a piece of
rank r weighs 1 / (r + 2.7), normalised; a character without a piece is spelled in
bytes at the weight of the last rank over ten. ``theta`` sharpens all weights.

Cases: null and empty texts have no pieces and one segmentation, the empty one, of
log-probability 0 and inclusion 1; a text with fewer segmentations than asked for
gives all of them, but for parts of a conditional probability under 1e-15; a literal
U+2581 is the model's space to the library, so such a text decodes with a space there and its
``decoded`` is false; rows that repeat a key and text give equal samples; a null key
counts as -1; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, text_chunks, trimmed, whole_text
from .piece_cache import PieceCache, public_tokenizer

SAMPLES = 2
SEED = 20
CHUNK = 800_000
KEPT = 700_000
MARK = "▁"
SCHEMA = "doc_id long, ids array<int>, samples array<struct<ids: array<int>, log_prob: double, inclusion: double>>"
SCHEMA_DIGEST = "doc_id long, ids array<int>, text string, n_pieces long, ids_crc32 long, decoded boolean, samples array<struct<ids: array<int>, log_prob: double, inclusion: double, n_pieces: long, ids_crc32: long, decoded: boolean>>"

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_MASK = (1 << 64) - 1
_DENSE, _WIDTH = 0x3000, 128
_LONG, _GROUP = 4096, 512


def _times(n: int, x: np.uint64) -> np.uint64:
    return np.uint64(n * int(x) & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    """Pieces of a model, as a trie over code points."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], theta: float = 1.0):
        """pieces: (id, piece, log weight); byte_ids: the ids of the 256 bytes."""
        top = max(i for i, _, _ in pieces) + 1
        self.theta = theta
        self.logw = np.full(max(top, max(byte_ids, default=0) + 1), -np.inf)
        self.bytes: list[bytes] = [b""] * self.logw.size
        children: dict[tuple[int, int], int] = {}
        final = [-1]
        for i, piece, w in pieces:
            self.logw[i], self.bytes[i] = w * theta, piece.replace(MARK, " ").encode()
            state = 0
            for c in piece:
                key = (state, ord(c))
                if key not in children:
                    children[key] = len(final)
                    final.append(-1)
                state = children[key]
            final[state] = i
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])
        self.byte_ids = np.array(byte_ids, np.int64)
        order = sorted(children)
        self.keys = np.array([s << 21 | c for s, c in order], np.int64)
        self.next = np.array([children[k] for k in order], np.int64)
        self.final = np.array(final, np.int64)
        # dense steps over the commonest code points of the pieces; the others are searched for
        seen = np.bincount(self.keys & 0x1FFFFF, minlength=_DENSE)[:_DENSE] if order else np.zeros(_DENSE, np.int64)
        common = np.flatnonzero(seen)[np.argsort(-seen[np.flatnonzero(seen)], kind="stable")][: _WIDTH - 1]
        self.column = np.full(_DENSE, _WIDTH - 1, np.int16)
        self.column[common] = np.arange(common.size)
        self.step = np.full((len(final), _WIDTH), -1, np.int32)
        code = self.keys & 0x1FFFFF
        dense = np.flatnonzero((code < _DENSE) & (self.column[np.minimum(code, _DENSE - 1)] < _WIDTH - 1))
        self.step[self.keys[dense] >> 21, self.column[code[dense]]] = self.next[dense]
        self.fallback = float(self.logw[np.isfinite(self.logw)].min()) - math.log(10) * theta
        lens = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_off = np.concatenate([[0], np.cumsum(lens)])
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def advance(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's next states, -1 where it has none."""
        column = np.where(code < _DENSE, self.column[np.minimum(code, _DENSE - 1)], _WIDTH - 1)
        out = self.step[state, column].astype(np.int64)
        rare = np.flatnonzero(column == _WIDTH - 1)
        if rare.size and self.keys.size:
            key = state[rare] << 21 | code[rare]
            place = np.searchsorted(self.keys, key)
            place[place == self.keys.size] = 0
            out[rare] = np.where(self.keys[place] == key, self.next[place], -1)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a whole segmentation, without the space put before it."""
        return self.raw(ids).tobytes()[1:]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        start = self.byte_off[ids]
        return self.byte_flat[spread(start, self.byte_off[ids + 1] - start)]


def spread(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (counts[0] of them), start[1], ..."""
    ends = np.cumsum(counts)
    at = np.repeat(start - (ends - counts), counts)
    return at + np.arange(at.size)


class Lattices:
    """The lattices of distinct words: nodes are positions, edges carry conditional probabilities.

    Up to ``limit`` nodes stay from one call of ``roots`` to the next, other words' until then; with
    them it holds ``limit`` nodes and those of one chunk of texts. A word's numbers do not depend on the others.
    """

    def __init__(self, vocab: Vocabulary, limit: int = KEPT):
        self.vocab, self.limit = vocab, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.nodes = self.edges = self.kept_nodes = self.kept_edges = 0
        self.first = np.zeros(1 << 12, np.int32)
        self.start, self.to, self.piece = (np.empty(1 << 14, np.int32) for _ in range(3))
        self.logp, self.cum = np.empty(1 << 14), np.empty(1 << 14)

    def roots(self, words: list[str]) -> np.ndarray:
        """The first node of every word, the mark before it included; valid until the next call."""
        self.nodes, self.edges = self.kept_nodes, self.kept_edges
        found = list(map(self.index.get, words))
        holes = [i for i, f in enumerate(found) if f is None]
        if holes:
            if self.kept_nodes > self.limit // 2 and 4 * len(holes) > 3 * len(words):  # other words than those held
                self.clear()
                holes = list(range(len(words)))
            fresh = [words[i] for i in holes]
            own = self._add([MARK + w for w in fresh])
            for i, node in zip(holes, own.tolist(), strict=True):
                found[i] = node
            if self.nodes <= self.limit:
                self.index.update(zip(fresh, own.tolist(), strict=True))
                self.kept_nodes, self.kept_edges = self.nodes, self.edges
        return np.array(found, np.int64)

    def _room(self, nodes: int, edges: int) -> None:
        def grown(x: np.ndarray, used: int, wanted: int) -> np.ndarray:
            if wanted <= x.size:
                return x
            out = np.empty(max(wanted, min(2 * x.size, x.size + (1 << 20))), x.dtype)
            out[:used] = x[:used]
            return out

        self.first = grown(self.first, self.nodes + 1, nodes + 1)
        for name in ("start", "to", "piece", "logp", "cum"):
            setattr(self, name, grown(getattr(self, name), self.edges, edges))

    def _add(self, words: list[str]) -> np.ndarray:
        """The first nodes of new words. Nodes are numbered by the characters to their word's end, nearest first."""
        vocab, size = self.vocab, self.vocab.logw.size
        lens = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(lens)
        n = codes.size
        left = np.repeat(ends, lens) - np.arange(n)
        place = np.argsort(left.astype(np.int16) if left.max() < 32768 else left, kind="stable")  # of each node
        rank = np.empty(n, np.int32)
        rank[place] = np.arange(n, dtype=np.int32)
        left = left[place]
        found = []  # by length, the nodes where pieces of that length start and their ids
        at, state, length = np.arange(n), np.zeros(n, np.int64), 0
        while at.size:
            state = vocab.advance(state, codes[place[at] + length])
            hit = state >= 0
            at, state, length = at[hit], state[hit], length + 1
            piece = vocab.final[state]
            whole = piece >= 0
            found.append((at[whole], piece[whole]))
            more = left[at] > length
            at, state = at[more], state[more]
        lone = np.ones(n, bool)
        lone[found[0][0]] = False
        alone = np.flatnonzero(lone)
        if alone.size:  # spelled in bytes: pseudo-ids above the vocabulary
            found[0] = np.concatenate([found[0][0], alone]), np.concatenate([found[0][1], size + codes[place[alone]]])
        degree = np.zeros(n, np.int64)
        for at, _ in found:
            degree[at] += 1
        first = np.concatenate([[0], np.cumsum(degree)])
        total = int(first[-1])
        start = np.repeat(np.arange(n, dtype=np.int32), degree)
        to, piece = np.empty(total, np.int32), np.empty(total, np.int32)
        free = first[:-1].copy()
        for length in range(len(found), 0, -1):  # long pieces first, as they are likely
            at, kind = found[length - 1]
            edge = free[at]
            piece[edge] = kind
            stays = left[at] > length
            to[edge] = -1
            to[edge[stays]] = rank[place[at[stays]] + length]
            free[at] += 1
        logp = vocab.logw[np.minimum(piece, size - 1)]
        if alone.size:
            logp[piece >= size] = vocab.fallback
        beta = np.zeros(n + 1)  # its last stands for all ends, as to is -1 there
        cuts = np.searchsorted(left, np.arange(1, int(left[-1]) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # backward: nodes nearest to their word's end first
            edge = slice(int(first[a]), int(first[b]))
            value = logp[edge] + beta[to[edge]]
            cut = first[a:b] - first[a]
            top = np.maximum.reduceat(value, cut)
            beta[a:b] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, degree[a:b])), cut))
        logp = np.minimum(logp + beta[to] - beta[start], 0.0)
        cum = np.exp(logp)
        deep, d = np.flatnonzero(degree > 1), 1
        while deep.size:
            edge = first[deep] + d
            cum[edge] += cum[edge - 1]
            d += 1
            deep = deep[degree[deep] > d]
        base, low, high = self.nodes, self.edges, self.edges + total
        self._room(base + n, high)
        self.first[base : base + n + 1] = low + first
        self.start[low:high] = start + np.int32(base)
        self.to[low:high] = np.where(to < 0, to, to + np.int32(base))
        self.piece[low:high], self.logp[low:high], self.cum[low:high] = piece, logp, np.minimum(cum, 1.0)
        self.nodes, self.edges = base + n, high
        return rank[ends - lens] + np.int64(base)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node."""
        e = self.first[node]
        last = self.first[node + 1] - 1
        live = np.flatnonzero((self.cum[e] < u) & (e < last))
        while live.size:
            e[live] += 1
            at = e[live]
            live = live[(self.cum[at] < u[live]) & (at < last[live])]
        return e

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its word's end, in order, and their number by node; keys seed the draws."""
        steps, live, cur, t = [], np.arange(nodes.size), nodes, 0
        counts = np.zeros(nodes.size, np.int64)
        while live.size:
            e = self.draw(cur, uniform(mix(keys + _times(t, _GOLD))))
            steps.append((live, e))
            counts[live] += 1
            to = self.to[e]
            going = to >= 0
            live, cur, keys, t = live[going], to[going], keys[going], t + 1
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for i, (who, e) in enumerate(steps):
            out[offsets[who] + i] = e
        return out, counts

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids that edges stand for, and their number by edge."""
        own = self.piece[edges]
        counts = np.ones(own.size, np.int64)
        spelled = np.flatnonzero(own >= self.vocab.logw.size)
        if not spelled.size:
            return own, counts
        code = own[spelled] - self.vocab.logw.size
        kinds, which = np.unique(code, return_inverse=True)
        ids = [self.vocab.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in kinds.tolist()]
        sizes = np.array([x.size for x in ids], np.int64)
        counts[spelled] = sizes[which]
        out = np.repeat(own, counts)
        begin = (np.cumsum(counts) - counts)[spelled]
        out[spread(begin, sizes[which])] = np.concatenate(ids)[spread((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return out, counts


class Words:
    """Texts cut at spaces: the distinct words, the number of every word, and the count of words by text."""

    def __init__(self, texts: list[str]):
        held = [i for i, t in enumerate(texts) if t]
        cut = pc.split_pattern(pa.array([texts[i] for i in held], pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.kinds = coded.indices.to_numpy().astype(np.int64)
        self.counts = np.zeros(len(texts), np.int64)
        self.counts[held] = np.diff(cut.offsets.to_numpy())


class _Path:
    """A drawn segmentation: edges, the word of each, and log-probabilities of its prefixes."""

    def __init__(self, edges: np.ndarray, words: np.ndarray, logp: np.ndarray):
        self.edges, self.words = edges, words
        self.cum = np.concatenate([[0.0], np.cumsum(logp)])


class _Search:
    """The A* search of one text. Parts are (path, lo, hi, barred): all that leave path at a piece in [lo, hi), at lo over no barred edge."""

    def __init__(self, lattices: Lattices, key: int):
        self.lat, self.key, self.found, self.heap, self.tick = lattices, key, [], [], 0

    def random(self) -> float:
        """The next number in (0, 1) of the key's row, as uniform(mix()) has it."""
        self.key = (self.key + int(_GOLD)) & _MASK
        x = self.key
        x = (x ^ (x >> 30)) * int(_M1) & _MASK
        x = (x ^ (x >> 27)) * int(_M2) & _MASK
        return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53

    def exponential(self) -> float:
        return -math.log(self.random())

    def mass(self, path: _Path, lo: int, hi: int, barred: tuple) -> tuple[float, float]:
        """Log of the probability of leaving at lo, and of leaving in (lo, hi)."""
        own = 1.0 - math.fsum(math.exp(self.lat.logp[e]) for e in (path.edges[lo], *barred))
        node = self.lat.start[path.edges[lo]]
        if self.lat.first[node + 1] - self.lat.first[node] <= 1 + len(barred):
            own = 0.0
        base = path.cum[lo]
        at = base + math.log(own) if own > 1e-15 else -math.inf
        after = -math.inf
        if hi > lo + 1:
            share = -math.expm1(path.cum[hi] - path.cum[lo + 1])
            after = path.cum[lo + 1] + math.log(share) if share > 1e-15 else -math.inf
        return at, after

    def push(self, path: _Path, lo: int, hi: int, barred: tuple, bound: float) -> None:
        if lo >= hi:
            return
        at, after = self.mass(path, lo, hi, barred)
        top = max(at, after)
        if top == -math.inf:
            return
        logm = top + math.log(math.exp(at - top) + math.exp(after - top))
        # Gumbel at logm, truncated at bound
        g = logm - math.log(self.exponential())
        value = bound if bound - g > 700 and g == -math.inf else -max(-bound, -g) - math.log1p(math.exp(-abs(g - bound)))
        heapq.heappush(self.heap, (-value, self.tick, path, lo, hi, barred))
        self.tick += 1

    def pop(self) -> tuple[_Path, int, int, float] | None:
        """(path, piece where to leave it, edge to take, bound) of the best part, the rest of it pushed back."""
        if not self.heap:
            return None
        neg, _, path, lo, hi, barred = heapq.heappop(self.heap)
        at, after = self.mass(path, lo, hi, barred)
        j = lo
        if after > -math.inf and (at == -math.inf or self.random() >= 1 / (1 + math.exp(min(after - at, 700)))):
            u = self.random() * -math.expm1(path.cum[hi] - path.cum[lo + 1])
            ahead = path.cum[lo + 2 : hi + 1] - path.cum[lo + 1]
            j = lo + 1 + min(int(np.searchsorted(-ahead, -math.log1p(-u), side="left")), hi - lo - 2)
            while self.lat.logp[path.edges[j]] > -1e-15 and j > lo + 1:  # rounding: leave where there is a choice
                j -= 1
        out = barred if j == lo else ()
        node = self.lat.start[path.edges[j]]
        choices = np.array([e for e in range(self.lat.first[node], self.lat.first[node + 1]) if e != path.edges[j] and e not in out], np.int64)
        if not choices.size:
            return self.pop()
        p = np.exp(self.lat.logp[choices])
        e = int(choices[min(int(np.searchsorted(np.cumsum(p), self.random() * p.sum())), choices.size - 1)])
        bound = -neg
        if j > lo:
            self.push(path, lo, j, barred, bound)
        self.push(path, j, j + 1, (*out, e), bound)
        self.push(path, j + 1, hi, (), bound)
        return path, j, e, bound


def sample(vocab: Vocabulary, texts: list[str], keys: list[int], k: int = SAMPLES, seed: int = SEED, words: Words | None = None, lattices: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float]]]:
    """For every text up to k distinct segmentations: (ids, log-probability, inclusion score), best bound first."""
    held = np.array([i for i, t in enumerate(texts) if t], np.int64)
    results: list[list] = [[] if t else [(np.empty(0, np.int32), 0.0, 1.0)] for t in texts]
    if not held.size:
        return results
    words = words or Words(texts)
    counts, lat = words.counts, lattices or Lattices(vocab)
    root = lat.roots(words.distinct)[words.kinds]
    first_word = np.cumsum(counts) - counts
    row = mix((np.array(keys, np.int64).view(np.uint64) * _GOLD) ^ np.uint64(seed))
    searches = [_Search(lat, key) if t else None for key, t in zip(mix(row ^ _M1).tolist(), texts, strict=True)]
    paths: list[list[_Path]] = [[] for _ in texts]
    bounds: list[list[float]] = [[] for _ in texts]
    who, begin, resume = held, np.zeros(held.size, np.int64), np.full(held.size, -1)
    jobs = [(None, 0, 0, -math.log(searches[i].exponential())) for i in held.tolist()]
    for r in range(k):
        if not jobs:
            break
        sizes = counts[who] - begin
        at = spread(first_word[who] + begin, sizes)
        own = at - np.repeat(first_word[who], sizes)
        nodes = root[at]
        word_cut = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.flatnonzero(resume >= 0)  # the rest of the word in which the path is left
        nodes[word_cut[inside]] = resume[inside]
        edges, steps = lat.walk(nodes, mix(np.repeat(row[who], sizes) + own.astype(np.uint64) * _M2 + _times(r, _M1)))
        owner, logp = np.repeat(own, steps), lat.logp[edges]
        edge_cut = np.concatenate([[0], np.cumsum(steps)])[word_cut].tolist()
        nxt, left = [], []
        for n, (i, (path, j, e, bound)) in enumerate(zip(who.tolist(), jobs, strict=True)):
            tail = slice(edge_cut[n], edge_cut[n + 1])
            if path is None:
                new, lo = _Path(edges[tail], owner[tail], logp[tail]), 0
            else:
                all_edges = np.concatenate([path.edges[:j], [e], edges[tail]])
                new, lo = _Path(all_edges, np.concatenate([path.words[: j + 1], owner[tail]]), lat.logp[all_edges]), j + 1
            paths[i].append(new)
            bounds[i].append(bound)
            s = searches[i]
            s.push(new, lo, new.edges.size, (), bound)
            if r + 1 < k and (got := s.pop()) is not None:
                nxt.append(got)
                left.append((i, int(got[0].words[got[1]]), int(lat.to[got[2]])))
        jobs = nxt
        who, begin, resume = np.array(left, np.int64).reshape(-1, 3).T
        begin = begin + (resume < 0)
    drawn = [(i, p) for i, own in enumerate(paths) for p in own]
    ids, sizes = lat.ids(np.concatenate([p.edges for _, p in drawn]))
    cuts = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(p.edges.size for _, p in drawn)])].tolist()
    for n, (i, p) in enumerate(drawn):
        limit = -searches[i].heap[0][0] if searches[i].heap else -math.inf
        lp = float(p.cum[-1])
        gap = lp - limit
        results[i].append((ids[cuts[n] : cuts[n + 1]], lp, 1.0 if gap > 700 else float(-math.expm1(-math.exp(gap)))))
    return results


class Pieces:
    """The public model: library encoding by distinct word, and sampling."""

    def __init__(self, model: str, theta: float = 1.0):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        special = lambda i: self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)
        normal = [(i, self.sp.id_to_piece(i)) for i in range(n) if not special(i)]
        total = math.log(sum(1 / (r + 2.7) for r in range(len(normal))))
        byte_ids = [0] * 256
        for i in range(n):
            if self.sp.is_byte(i):
                byte_ids[int(self.sp.id_to_piece(i)[3:5], 16)] = i
        self.vocab = Vocabulary([(i, p, -math.log(r + 2.7) - total) for r, (i, p) in enumerate(normal)], byte_ids, theta)
        self.lattices = Lattices(self.vocab)
        self.id_bytes = np.diff(self.vocab.byte_off)
        self.cache = PieceCache(self._many, 600_000)

    def _many(self, words: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids of words, in groups joined by spaces; their lengths in bytes tell them apart again."""
        done, ids, counts = [], [], []
        odd = [w for w in words if not w or MARK in w]
        plain = [w for w in words if w and MARK not in w] if odd else words
        for i in range(0, len(plain), _GROUP):
            group = plain[i : i + _GROUP]
            own = np.array(self.sp.encode(" ".join(group)), np.int64)  # the library puts a space before
            reached = np.cumsum(self.id_bytes[own])
            wanted = np.cumsum(np.fromiter((len(w.encode()) for w in group), np.int64, len(group)) + 1)
            cut = np.searchsorted(reached, wanted)
            if cut[-1] != own.size - 1 or (reached[cut] != wanted).any():
                odd += group
                continue
            done += group
            ids.append(own.astype(np.int32))
            counts.append(np.diff(cut, prepend=-1))
        rest = [np.array(x, np.int32) for x in self.sp.encode(odd, num_threads=1)] if odd else []
        counts.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        return done + odd, np.concatenate([np.empty(0, np.int32), *ids, *rest]), np.concatenate(counts)

    def encode(self, texts: list[str], words: Words | None = None) -> list[np.ndarray]:
        """The library's ids of every whole text."""
        words = words or Words(texts)
        longest = max(map(len, words.distinct), default=0)
        whole: dict[int, np.ndarray] = {}
        for i, t in enumerate(texts):
            # runs of spaces can be pieces, and the mark counts as one
            if t and (MARK in t or "  " in t or t[0] == " " or t[-1] == " " or (longest > _LONG and max(map(len, t.split(" "))) > _LONG)):
                whole[i] = np.array(self.sp.encode(t), np.int32)
        if longest > _LONG:  # such words are only in texts that went to the library whole
            short = [n for n, w in enumerate(words.distinct) if len(w) <= _LONG]
            rows = np.zeros(len(words.distinct), np.int64)
            rows[short] = self.cache.rows([words.distinct[n] for n in short])
        else:
            rows = self.cache.rows(words.distinct)
        ids, counts = self.cache.expand(rows[words.kinds])
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(words.counts)])]
        return [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]


_MODELS: dict[tuple[str, float], Pieces] = {}


def pieces(model: str, theta: float) -> Pieces:
    if (model, theta) not in _MODELS:
        _MODELS[model, theta] = Pieces(model, theta)
    return _MODELS[model, theta]


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some segmentations and where each begins and the last one ends."""
    cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return np.concatenate([np.empty(0, np.int32), *parts]).astype(np.int32), cuts


def _lists(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))


def _digests(vocab: Vocabulary, ids: np.ndarray, cuts: np.ndarray, raw: list[bytes]) -> tuple[list[pa.Array], list[bytes]]:
    """Of segmentations of raw: the number of pieces, the checksum of the ids and whether they decode to it; and what they decode to."""
    spelled, coded = vocab.raw(ids).tobytes(), memoryview(ids.astype("<u4")).cast("B")
    ends = np.concatenate([[0], np.cumsum(vocab.byte_off[ids + 1] - vocab.byte_off[ids])])[cuts].tolist()
    texts = [spelled[a + 1 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # without the space put before it
    at = (4 * cuts).tolist()
    sums = [zlib.crc32(coded[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return [pa.array(np.diff(cuts)), pa.array(sums, pa.int64()), pa.array([a == b for a, b in zip(texts, raw, strict=True)], pa.bool_())], texts


def segment(docs: DataFrame, model: str, k: int = SAMPLES, seed: int = SEED, theta: float = 1.0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Every row's library encoding and k sampled segmentations, as ids; with digest also the text decoded from the encoding, and of each segmentation its count, checksum and whether it decodes to the row's text. chunk: the characters that a task takes at once, which its memory follows and the result does not."""
    digests = ["n_pieces", "ids_crc32", "decoded"]

    def run(batches):
        own = pieces(model, theta)
        for b in batches:
            column, texts = b.column(0), b.column(1).to_pylist()
            keys = [-1 if x is None else x for x in column.to_pylist()]
            for i, j in text_chunks(texts, chunk):
                words = Words(texts[i:j])
                best = own.encode(texts[i:j], words)
                drawn = sample(own.vocab, texts[i:j], keys[i:j], k, seed, words, own.lattices)
                best, flat = _flat(best), _flat([x for d in drawn for x, _, _ in d])
                out = {"doc_id": column.slice(i, j - i), "ids": _lists(*best)}
                item = {"ids": _lists(*flat), "log_prob": pa.array([lp for d in drawn for _, lp, _ in d], pa.float64()), "inclusion": pa.array([q for d in drawn for _, _, q in d], pa.float64())}
                if digest:
                    raw = [t.encode() for t in texts[i:j]]
                    values, decoded = _digests(own.vocab, *best, raw)
                    out |= {"text": pa.array([t.decode("utf-8", "replace") for t in decoded], pa.string())} | dict(zip(digests, values, strict=True))
                    item |= dict(zip(digests, _digests(own.vocab, *flat, [t for t, d in zip(raw, drawn, strict=True) for _ in d])[0], strict=True))
                cuts = np.concatenate([[0], np.cumsum([len(d) for d in drawn])])
                out["samples"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(list(item.values()), list(item)))
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(trimmed(run), SCHEMA_DIGEST if digest else SCHEMA)


def decode(rows: DataFrame, model: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """rows with the text that a column of ids stands for; null ids give null."""

    @F.pandas_udf("string")
    def run(ids):
        vocab = pieces(model, 1.0).vocab
        return ids.map(lambda x: None if x is None else vocab.decode(np.asarray(x, np.int64)).decode("utf-8", "replace"))

    return rows.withColumn(to, run(ids_col))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(load(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), digest=True)
