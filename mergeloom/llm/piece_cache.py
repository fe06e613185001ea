"""Encode texts with a public tokenizer, word by word, behind a bounded cache.

A byte-level BPE with the public word pattern never merges across a line feed or
a space that is followed by a visible character, so a text is cut there and every
distinct cut is given to the tokenizers library once. Texts for which that cut
would not be exact (three white-space characters in a row, or two at the end)
go to the library whole, as do those with a NUL, which marks pieces here, and those
with one of the tokenizer's control strings, unless these are to be spelled out.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as str.isspace has it, spelled out for a linear-time matcher.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"\x00|{_WHITE}{{3}}|{_WHITE}{{2}}\z"
_LONG = 4096
_GROUP = 512
_SPACE = re.compile(r"\s")
_RUN = re.compile(rf"(?:\A| )[^ ]{{{_LONG + 1}}}")


class PieceCache:
    """Distinct pieces and their ids, in one flat array; emptied at ``limit``.

    ``encode_many(keys)`` gives the keys in an order of its own, their ids and their counts.
    """

    def __init__(self, encode_many, limit: int = 800_000):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.off = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _append(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        n, total = len(self.index), ids.size
        while n + len(keys) + 1 > self.off.size:
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        while self.used + total > self.flat.size:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.off[n + 1 : n + 1 + len(keys)] = self.used + np.cumsum(counts)
        self.flat[self.used : self.used + total] = ids
        self.used += total
        self.index.update(zip(keys, range(n, n + len(keys)), strict=True))

    def rows(self, keys: list) -> np.ndarray:
        """The cache row of every key; keys are distinct."""
        found = list(map(self.index.get, keys))
        if None in found:
            holes = [i for i, f in enumerate(found) if f is None]
            if self.index and len(self.index) + len(holes) > self.limit:
                self.clear()
                holes = range(len(keys))
            self._append(*self.encode_many([keys[i] for i in holes]))
            index = self.index
            for i in holes:
                found[i] = index[keys[i]]
        return np.array(found, np.int64)

    def split_rows(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The cache rows of all words of texts, cut at single spaces, and each text's word count."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        rows = self.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return rows[coded.indices.to_numpy()], np.diff(words.offsets.to_numpy())

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in order, and the count of each row."""
        start = self.off[rows]
        counts = self.off[rows + 1] - start
        ends = np.cumsum(counts)
        total = int(ends[-1]) if ends.size else 0
        at = np.repeat(start - (ends - counts), counts)
        at += np.arange(total)
        return self.flat[at], counts


class CachedEncoder:
    """``encode(texts)`` gives (ids, counts by text), the same ids as the library gives for whole texts.

    A control string in a text gets its reserved id, as the library has it; with spelled it is text like any other.
    """

    def __init__(self, tokenizer_path: str, spelled: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.tok.encode_special_tokens = spelled
        control = [] if spelled else [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([_UNSAFE, *control])
        vocab = self.tok.get_vocab()
        self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # in the byte-level alphabet a character is a byte
            self.id_bytes[i] = len(token)
        self.cache = PieceCache(self._pieces, 1_500_000)

    def _many(self, texts: list) -> list:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words without white space, each after mark, encoded as one text; lengths in bytes tell them apart."""
        text = mark + mark.join(words)
        ids = np.array(self._many([text])[0], np.int32)
        lens = list(map(len, words)) if text.isascii() else [len(w.encode()) for w in words]
        cut = np.searchsorted(np.cumsum(self.id_bytes[ids]), np.cumsum(np.array(lens) + 1)) + 1
        return ids, np.diff(cut, prepend=0)

    def _pieces(self, keys: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids of keys: a word stands for itself after a space, "\\n" for a line feed, and a NUL and a word for that word after neither."""
        spaced, bare, odd = [], [], []
        for k in keys:
            if k == "" or k == "\0" or k == "\n":
                odd.append(k)
            elif k[0] == "\0":
                bare.append(k)
            else:
                spaced.append(k)
        done, ids, counts = [], [], []
        for kind, mark in ((spaced, " "), (bare, "\n")):
            for at in range(0, len(kind), _GROUP):
                group = kind[at : at + _GROUP]
                if _SPACE.search("".join(group)):
                    odd += [k for k in group if _SPACE.search(k)]
                    group = [k for k in group if not _SPACE.search(k)]
                    if not group:
                        continue
                own, n = self._joined(group if mark == " " else [k[1:] for k in group], mark)
                if mark == "\n":  # the line feed is one id of its own
                    own = np.delete(own, np.cumsum(n) - n)
                    n = n - 1
                done += group
                ids.append(own)
                counts.append(n)
        texts = ["\n" if k == "\n" else k[1:] if k[:1] == "\0" else " " + k for k in odd]
        rest = [np.array(x, np.int32) for x in self._many(texts)] if odd else []
        counts.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        return done + odd, np.concatenate([np.empty(0, np.int32), *ids, *rest]), np.concatenate(counts)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        safe: list = []
        which: list = []
        whole: dict[int, np.ndarray] = {}
        unsafe = pc.match_substring_regex(pa.array(texts, pa.large_string()), self.unsafe).to_pylist()
        for i, (t, odd) in enumerate(zip(texts, unsafe, strict=True)):
            if not t:
                continue
            if odd or (len(t) > _LONG and _RUN.search(t)):
                whole[i] = np.array(self._many([t])[0], np.int32)
            else:
                safe.append("\0" + t.replace("\n", " \n \0"))
                which.append(i)
        cuts = np.zeros(len(texts), np.int64)
        rows, cuts[which] = self.cache.split_rows(safe)
        ids, counts = self.cache.expand(rows)
        ends = np.concatenate([[0], np.cumsum(counts)])
        bounds = ends[np.concatenate([[0], np.cumsum(cuts)])]
        lens = np.diff(bounds)
        if not whole:
            return ids, lens
        parts = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_ENCODERS: dict[tuple[str, bool], CachedEncoder] = {}


def encoder(tokenizer_path: str, spelled: bool = False) -> CachedEncoder:
    """One encoder a Python worker, file and treatment of control strings."""
    if (tokenizer_path, spelled) not in _ENCODERS:
        _ENCODERS[tokenizer_path, spelled] = CachedEncoder(tokenizer_path, spelled)
    return _ENCODERS[tokenizer_path, spelled]


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
