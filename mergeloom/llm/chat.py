"""Chat formatting by assembling tokens.

Every role and text is encoded on its own, so no content can turn into a control
id; reserved ids above the vocabulary are spliced in between, and the loss mask
is the prefix sum of +1 where an assistant text starts and -1 where it ends.
Control strings inside content are also escaped, so the rendered text parses
back: a backslash is doubled, and one is put into each control string.

An output row is one chunk of a conversation: ``ids`` and ``loss_mask``, at most
CHUNK_IDS ids beyond a turn. Chunks of a conversation concatenate in ``chunk``
order, so a conversation of any length streams through a task that holds one
chunk.

Layout: BOS, then for each turn TURN, role, TEXT, text, END. Common roles have
reserved ids, any other is spelled between NAME and TEXT.

Cases: a null text or role is empty; turns are ordered by turn (null first), ties
by role and text; rows without conv_id form one conversation of their own; repeated
rows are all kept; roles are compared exactly; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, partitions, scratch_path
from .piece_cache import encoder, public_tokenizer

CHUNK_IDS = 65536
#: Reserved ids, counted from the size of the vocabulary.
BOS, TURN, NAME, TEXT, END = range(5)
ROLES = ["system", "user", "assistant", "tool"]
LOSS_ROLE = "assistant"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|name|>", "<|text|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
RENDERED = {BOS: "<s>", TURN: "<|turn|>", NAME: "<|name|>", TEXT: "<|text|>", END: "<|end|>"}
CHUNK_SCHEMA = "conv_id long, chunk int, ids array<int>, loss_mask array<tinyint>"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """text without control strings; ``unescape`` gives it back."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Template:
    def __init__(self, tokenizer: str):
        self.encoder = encoder(tokenizer, spelled=True)
        self.base = self.encoder.tok.get_vocab_size()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        size = self.base
        self.bytes = [b""] * size
        for token, i in self.encoder.tok.get_vocab().items():
            self.bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()

    def assemble(self, turns: list[tuple[str, str]], first: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of some turns of a conversation; first: its first turns."""
        texts = [escape(x) for role, text in turns for x in (("" if role in ROLES else role), text)]
        flat, counts = self.encoder.encode(texts)
        ends = np.cumsum(counts)
        parts: list = [[self.base + BOS]] if first else []
        marks: list[tuple[int, int]] = []
        n = len(parts)
        for i, (role, _) in enumerate(turns):
            name, body = (flat[ends[2 * i + j] - counts[2 * i + j] : ends[2 * i + j]] for j in (0, 1))
            head = [self.base + TURN, self.base + 5 + ROLES.index(role)] if role in ROLES else [self.base + TURN, self.base + NAME]
            parts += [head, name, [self.base + TEXT], body, [self.base + END]]
            start = n + 2 + name.size + 1
            if role == LOSS_ROLE:
                marks.append((start, start + body.size))
            n = start + body.size + 1
        delta = np.zeros(n + 1, np.int8)
        for a, b in marks:
            delta[a] += 1
            delta[b] -= 1
        return np.concatenate(parts).astype(np.int32), np.cumsum(delta)[:n].astype(np.int8)


_TEMPLATES: dict[str, Template] = {}


def template(tokenizer: str) -> Template:
    if tokenizer not in _TEMPLATES:
        _TEMPLATES[tokenizer] = Template(tokenizer)
    return _TEMPLATES[tokenizer]


def _formatter(tokenizer: str, chunk_ids: int):
    def run(batches):
        t = template(tokenizer)
        conv, chunk, turns, size, started = None, 0, [], 0, False
        out: list = []

        def close():
            nonlocal chunk, turns, size
            ids, mask = t.assemble(turns, chunk == 0)
            out.append((conv, chunk, ids, mask))
            chunk, turns, size = chunk + 1, [], 0

        def batch():
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.list_(pa.int32())),
                    pa.array([o[3] for o in out], pa.list_(pa.int8())),
                ],
                ["conv_id", "chunk", "ids", "loss_mask"],
            )
            out.clear()
            return rows

        for b in batches:
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not started or c != conv:
                    if started:
                        close()
                    conv, chunk, turns, size, started = c, 0, [], 0, True
                elif size >= chunk_ids:
                    close()
                turns.append((role, text))
                size += len(text) // 2 + 8
                if len(out) >= 256:
                    yield batch()
        if started:
            close()
            yield batch()

    return run


def format_chats(turns: DataFrame, tokenizer: str, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Chunks (conv_id, chunk, ids, loss_mask) of all conversations in turns (conv_id, turn, role, text)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    rows = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(tokenizer, chunk_ids), CHUNK_SCHEMA)


def _reader(tokenizer: str):
    def run(batches):
        t = template(tokenizer)
        state: dict | None = None
        done: list = []

        def finish():
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            done.append((state["conv"], state["n"], turns, state["loss_chars"], loss, state["chars"]))

        def flush():
            rows = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), d, strict=True)) for d in done], schema=schema)
            done.clear()
            return rows

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            for i, c in enumerate(b.column(0).to_pylist()):
                ids = np.asarray(b.column(2)[i].values)
                mask = np.asarray(b.column(3)[i].values)
                if state is None or state["conv"] != c:
                    if state is not None:
                        finish()
                    state = {"conv": c, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                for role, text in parse(t, ids):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for text in masked_texts(t, ids, mask):
                    state["loss_chars"] += len(text)
                    state["loss"].update(text.encode())
                state["chars"] += len(render(t, ids))
                if len(done) >= 4096:
                    yield flush()
        if state is not None:
            finish()
        if done:
            yield flush()

    return run


def parse(t: Template, ids: np.ndarray) -> list[tuple[str, str]]:
    """(role, text) of the turns in ids, unescaped."""
    special = np.flatnonzero(ids >= t.base)
    kinds = (ids[special] - t.base).tolist()
    found, role = [], ""
    for j, (at, kind) in enumerate(zip(special.tolist(), kinds, strict=True)):
        stop = int(special[j + 1]) if j + 1 < special.size else ids.size
        if kind >= 5:
            role = ROLES[kind - 5]
        elif kind == NAME:
            role = unescape(t.decode(ids[at + 1 : stop].tolist()))
        elif kind == TEXT:
            found.append((role, unescape(t.decode(ids[at + 1 : stop].tolist()))))
    return found


def masked_texts(t: Template, ids: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the loss mask, unescaped, a run of ones each."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape(t.decode(ids[a:b].tolist())) for a, b in edges.reshape(-1, 2).tolist()]


def render(t: Template, ids: np.ndarray) -> str:
    """ids as text, control ids as their strings."""
    names = RENDERED | {5 + i: r for i, r in enumerate(ROLES)}
    special = np.flatnonzero(ids >= t.base).tolist()
    out, last = [], 0
    for at in special:
        out += [t.decode(ids[last:at].tolist()), names[int(ids[at]) - t.base]]
        last = at + 1
    out.append(t.decode(ids[last:].tolist()))
    return "".join(out)


def read_chats(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Digests of the conversations in written chunks."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    rows = chunks.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return rows.mapInArrow(_reader(tokenizer), DIGEST_SCHEMA)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizer("byte_bpe_50k.json")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = scratch_path(spark, "chats")
    format_chats(turns, tokenizer).write.option("compression", "zstd").parquet(path)
    return read_chats(spark, path, tokenizer)
