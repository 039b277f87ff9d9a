"""Vector bin packing of token sequences for training.

Items are placed into sequences under simultaneous limits on tokens, segments
and loss-bearing tokens.  The open sequence takes, of all waiting items that
fit, the one whose demand vector has the largest dot product with the
remaining capacity (weighted by how scarce each dimension is).  When nothing
fits, an item is cut to fill the rest, so sequences are full; a sequence that
another limit closes early, and what is left at the end, is cut to powers of
two, which need no padding.

Packing runs in place on each input partition with a bounded pool of waiting
items: no shuffle, no sequence over two partitions.

Defined results: a null or empty text is one segment holding the end id alone;
null ids and repeated rows are packed like any other row; an item over the
limits is cut into several sequences; an empty table gives an empty result; a
special string of the tokenizer file inside a text is its special id.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.bpe import chunks
from recolens.llm.frames import text_rows

#: Waiting items of a partition; packing starts when the pool is full.
POOL_ITEMS = 4096
BATCH_BYTES = 4 << 20
PIECES = ("doc_id long, start long, length long, loss long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


# -------------------------------------------------------------- tokenising

class Pieces:
    """Ids of texts as the tokenizer file gives them, computed by tiktoken.

    A byte-level BPE whose ids follow its merges is the same as ranks; the file is checked
    for that.  Special strings inside a text are their own ids, as the ``tokenizers``
    library reads them, and cut the text."""

    def __init__(self, tokenizer_file: str, pattern: str):
        import tiktoken

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or any(
                t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError("packing needs a byte-level BPE without a normalizer")
        ids, byte = model["vocab"], byte_letters()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [ids[m] for m in merged] != sorted(ids[m] for m in merged):
            raise ValueError("the ids of the tokenizer file do not follow its merges")
        own = {t["content"] for t in special}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in ids.items() if token not in own}
        self.encoding = tiktoken.Encoding(tokenizer_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            yield b"".join(self.special[part] if i % 2 else self._plain(part) for i, part in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        return b"".join(self.encoding.encode_to_numpy(part, disallowed_special=()).astype("<u4").tobytes()
                        for part in chunks(text))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level BPE files: printable bytes for
    themselves, the others in order from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def pieces(tokenizer_file: str, pattern: str) -> Pieces:
    return Pieces(tokenizer_file, pattern)


# ----------------------------------------------------------------- packing

@dataclass
class Item:
    doc_id: int | None
    start: int
    ids: np.ndarray
    bears: np.ndarray | None  # running loss count, or None when every token bears loss
    doc_tokens: int

    @property
    def size(self) -> tuple[int, int]:
        n = len(self.ids)
        return n, n if self.bears is None else int(self.bears[-1])

    def fitting(self, tokens: int, loss: int) -> int:
        """Longest prefix within both limits."""
        n = min(tokens, len(self.ids))
        if self.bears is None:
            return min(n, loss)
        return min(n, int(np.searchsorted(self.bears, loss, side="right")))

    def cut(self, n: int) -> tuple[Item, Item]:
        left, right = self.bears, self.bears
        if self.bears is not None:
            left, right = self.bears[:n], self.bears[n:] - self.bears[n - 1]
        return (Item(self.doc_id, self.start, self.ids[:n], left, self.doc_tokens),
                Item(self.doc_id, self.start + n, self.ids[n:], right, self.doc_tokens))


@dataclass
class Pool:
    """Waiting items by demand; equal demands share one class."""

    limits: Limits
    members: dict[tuple[int, int], list[Item]] = field(default_factory=lambda: defaultdict(list))
    number: dict[tuple[int, int], int] = field(default_factory=dict)
    demand: np.ndarray = field(default_factory=lambda: np.zeros((64, 3)))
    count: np.ndarray = field(default_factory=lambda: np.zeros(64, np.int64))
    keys: list[tuple[int, int]] = field(default_factory=list)
    items: int = 0

    def add(self, item: Item) -> None:
        key = item.size
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.keys)
            self.keys.append(key)
            if at == len(self.count):
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
                self.count = np.concatenate([self.count, np.zeros_like(self.count)])
            self.demand[at] = (key[0] / self.limits.tokens, 1 / self.limits.segments, key[1] / self.limits.loss)
        self.members[key].append(item)
        self.count[at] += 1
        self.items += 1

    def take(self, at: int) -> Item:
        self.count[at] -= 1
        self.items -= 1
        return self.members[self.keys[at]].pop()

    def compact(self) -> None:
        """Forget demands that no item has any more."""
        held = [i for members in self.members.values() for i in members]
        self.__init__(self.limits)
        for item in held:
            self.add(item)

    def weights(self) -> np.ndarray:
        n = len(self.keys)
        return self.count[:n] @ self.demand[:n] / max(self.items, 1)

    def best(self, left: np.ndarray, weights: np.ndarray) -> int:
        """The class with the largest dot product among those that fit, or -1."""
        n = len(self.keys)
        demand = self.demand[:n]
        fits = (self.count[:n] > 0) & (demand <= left + 1e-9).all(axis=1)
        score = np.where(fits, demand @ (weights * left), -1.0)
        at = int(score.argmax()) if n else -1
        return at if at >= 0 and score[at] >= 0 else -1

    def largest(self) -> int:
        n = len(self.keys)
        return int(np.where(self.count[:n] > 0, self.demand[:n, 0], -1.0).argmax())


class Packer:
    def __init__(self, limits: Limits, first_sequence: int, cut: bool = True):
        self.limits, self.cut, self.sequence = limits, cut, first_sequence
        self.pool = Pool(limits)

    def push(self, item: Item) -> Iterator[tuple]:
        """Full sequences of one item leave at once; its rest waits."""
        while True:
            n = item.fitting(self.limits.tokens, self.limits.loss)
            if n == len(item.ids) and n < self.limits.tokens:
                break
            piece, item = item.cut(n) if n < len(item.ids) else (item, None)
            yield from self._close([piece])
            if item is None:
                return
        self.pool.add(item)
        if self.pool.items >= POOL_ITEMS:
            while self.pool.items > POOL_ITEMS // 2:
                yield from self._fill()
            self.pool.compact()

    def flush(self) -> Iterator[tuple]:
        while self.pool.items:
            yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        left, chosen, weights = np.ones(3), [], self.pool.weights()
        tokens, loss = self.limits.tokens, self.limits.loss
        while self.pool.items and tokens and len(chosen) < self.limits.segments:
            at = self.pool.best(left, weights)
            if at < 0:
                break
            chosen.append(self.pool.take(at))
            n, bearing = chosen[-1].size
            tokens, loss = tokens - n, loss - bearing
            left = np.array([tokens / self.limits.tokens, 1 - len(chosen) / self.limits.segments,
                             loss / self.limits.loss])
        if self.cut and self.pool.items and tokens and len(chosen) < self.limits.segments:
            item = self.pool.take(self.pool.largest())
            n = item.fitting(tokens, loss)
            if 0 < n < len(item.ids):
                piece, item = item.cut(n)
                chosen.append(piece)
                tokens -= n
            self.pool.add(item)
        if self.cut and tokens:
            self._trim(chosen, self.limits.tokens - tokens)
        yield from self._close(chosen)

    def _trim(self, chosen: list[Item], total: int) -> None:
        """Cut a sequence that stays short to a power of two; the rest waits again."""
        excess = total - (1 << total.bit_length() - 1)
        while excess:
            item = chosen.pop()
            if len(item.ids) > excess:
                piece, item = item.cut(len(item.ids) - excess)
                chosen.append(piece)
            excess -= len(item.ids)
            self.pool.add(item)

    def _close(self, chosen: list[Item]) -> Iterator[tuple]:
        offset = 0
        for i in chosen:
            n, bearing = i.size
            yield i.doc_id, i.start, n, bearing, i.doc_tokens, self.sequence, offset, i.ids.tobytes()
            offset += n
        self.sequence += 1


def _packed(items, limits: Limits, cut: bool):
    """Arrow function over partitions; ``items`` reads a batch as Item rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss", pa.int64()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("ids", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        packer = Packer(limits, TaskContext.get().partitionId() << 40, cut)
        for batch in batches:
            for item in items(batch):
                if len(item.ids):
                    yield from packer.push(item)
        yield from packer.flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for row in rows(batches):
            out.append(row)
            size += len(row[-1]) + 64
            if size >= BATCH_BYTES:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def pack_documents(docs: DataFrame, tokenizer_file: str, pattern: str, limits: Limits = Limits(),
                   end_id: int = 0) -> DataFrame:
    """Tokenise whole texts, close each with ``end_id`` and pack them; every token bears loss."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def items(batch: pa.RecordBatch) -> Iterator[Item]:
        encoder = pieces(tokenizer_file, pattern)
        for doc_id, ids in zip(batch.column(0), encoder.ids(batch.column(1).to_pylist()), strict=True):
            ids = np.frombuffer(ids + end, dtype="<u4")
            yield Item(doc_id.as_py(), 0, ids, None, len(ids))

    return text_rows(docs).mapInArrow(_packed(items, limits, True), PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), cut: bool = False) -> DataFrame:
    """Pack rows of (doc_id, ids array, loss array of 0/1): instruction examples.

    A null loss array means that every token bears loss; null ids are no
    tokens; without ``cut`` only examples over a limit are cut."""
    def items(batch: pa.RecordBatch) -> Iterator[Item]:
        for doc_id, ids, loss in zip(*batch.columns, strict=True):
            tokens = np.array(ids.as_py() or [], dtype="<u4")
            bears = None if loss.as_py() is None else np.cumsum(np.array(loss.as_py(), np.int64)[:len(tokens)])
            yield Item(doc_id.as_py(), 0, tokens, bears, len(tokens))

    rows = examples.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>"),
                           F.col("loss").cast("array<int>"))
    return rows.mapInArrow(_packed(items, limits, cut), PIECES)


def piece_digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
