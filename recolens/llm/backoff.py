"""Stupid-backoff language-model scores from corpus n-gram counts.

Every document is scored by a model of all documents:

    S(w | context) = count(context w) / count(context)   if count(context w) >= min_count
                     alpha * S(w | shorter context)      otherwise
    S(w)           = count(w) / number of words

N-grams are 64-bit hashes and never cross documents.  Documents are dealt into
blocks by hash.  A block asks for each of its distinct n-grams once, with its
own count; the count tables are partitioned by ranges of the hash, add the
blocks' counts up and answer every block in the order it asked.  The join
therefore meets one row per block and n-gram however often the n-gram occurs,
so frequent n-grams are no hot keys.  Each block then adds up the logarithms
per document.

Defined results: a null or empty text has no words, score 0 and a null mean;
null ids keep their rows; repeated rows are counted and scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import text_rows

#: Words of a block and n-grams of a count-table partition: what one task holds.
BLOCK_WORDS = 2_000_000
TABLE_NGRAMS = 3_000_000
_K1, _K2, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F,
                                             0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n words that end at each word; 0 where
    the document has fewer before it (``place`` is a word's place in its document)."""
    out = [_mixed(words * _K2 + np.uint64(1))]
    for n in range(2, order + 1):
        h = np.zeros_like(words)
        h[1:] = _mixed(out[-1][:-1] * _K1 + words[1:] * _K2 + np.uint64(n))
        h[place < n - 1] = 0
        out.append(h)
    return out


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, text) rows to one compressed Arrow stream per batch and block."""
    schema = pa.schema([("block", pa.int32()), ("docs", pa.binary())])
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch["block"]))
        blocks, starts = np.unique(batch["block"].to_numpy(), return_index=True)
        packed = []
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]),
                                   options=options) as stream:
                stream.write_batch(pa.record_batch([batch["doc_id"].slice(a, b - a),
                                                    batch["text"].slice(a, b - a)], names=["doc_id", "text"]))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def block_words(packed: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, word counts, word hashes and word places of a block, in a fixed order of rows."""
    from xxhash import xxh3_64_intdigest

    table = pa.concat_tables([pa.ipc.open_stream(d.as_buffer()).read_all() for d in packed["docs"]])
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    seen: dict[bytes, int] = {}
    codes, sizes = [], []
    for text in table["text"]:
        found = text.as_py().encode("utf-8", "surrogatepass").split()
        codes.append(np.array([seen.setdefault(w, len(seen)) for w in found], dtype=np.uint32))
        sizes.append(len(found))
    hashes = np.fromiter(map(xxh3_64_intdigest, seen), dtype=np.uint64, count=len(seen))
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes)
    total = int(sizes.sum())
    words = hashes[np.concatenate(codes)] if total else np.zeros(0, np.uint64)
    return table["doc_id"].combine_chunks(), sizes, words, np.arange(total) - np.repeat(ends - sizes, sizes)


def _edges(partitions: int) -> np.ndarray:
    """First hash of each range of the count tables."""
    return np.array([(i << 64) // partitions for i in range(partitions)], dtype=np.uint64)


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences of 6 bytes (8 where one is longer)."""
    steps = np.diff(hashes, prepend=hashes[:1])
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    first = hashes[:1].tobytes() or bytes(8)
    return bytes([width]) + first + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data, "<u8", 1, 1)[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + first


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, compressed; 255 stands for the next of the long counts behind them."""
    short = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.compress(short.tobytes() + counts[short == 255].astype("<i8").tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    data = zstandard.decompress(data)
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _asked(order: int, partitions: int):
    schema = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("part", pa.int32()),
                        ("size", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, _, words, place = block_words(table)
        edges, out = _edges(partitions), []
        for n, h in enumerate(ngram_hashes(words, place, order), 1):
            grams, counts = np.unique(h[place >= n - 1], return_counts=True)
            bounds = np.append(np.searchsorted(grams, edges), len(grams))
            for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if b > a:
                    out.append((key[0].as_py(), n, p, int(b - a), pack_sorted(grams[a:b]), pack_counts(counts[a:b])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else
                        [pa.array([], f.type) for f in schema], schema=schema)
    return run


def _answered(table: pa.Table) -> pa.Table:
    """One range of a count table: total counts for each block, in its order."""
    sizes = table["size"].to_numpy()
    grams = np.concatenate([unpack_sorted(g.as_py()) for g in table["grams"]])
    counts = np.concatenate([unpack_counts(c.as_py(), n) for c, n in zip(table["counts"], sizes.tolist())])
    order = np.argsort(grams, kind="stable")
    new = np.diff(grams[order], prepend=grams[order[:1]]) != 0
    group = np.cumsum(new)
    total = np.zeros(group[-1] + 1, np.int64)
    np.add.at(total, group, counts[order])
    answer = np.empty_like(counts)
    answer[order] = total[group]
    ends = np.cumsum(sizes)
    return pa.table({"block": table["block"], "n": table["n"], "part": table["part"],
                     "counts": pa.array([pack_counts(answer[e - s:e]) for s, e in zip(sizes, ends)], pa.binary()),
                     "size": table["size"]})


def log_scores(counts: list[np.ndarray], place: np.ndarray, total: int, alpha: float, min_count: int) -> np.ndarray:
    """ln S of every word from the counts of the n-grams that end there."""
    out = np.log(np.maximum(counts[0], 1)) - math.log(max(total, 1))
    for n in range(2, len(counts) + 1):
        context = np.ones_like(counts[n - 2])
        context[1:] = np.maximum(counts[n - 2][:-1], 1)
        seen = (place >= n - 1) & (counts[n - 1] >= min_count)
        out = np.where(seen, np.log(np.maximum(counts[n - 1], 1)) - np.log(context),
                       np.where(place >= n - 1, out + math.log(alpha), out))
    return out


def _scored(order: int, total: int, alpha: float, min_count: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, words, place = block_words(docs)
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, part, size, data in zip(*(answers[c].to_pylist() for c in ("n", "part", "size", "counts"))):
            held.setdefault(n, []).append((part, unpack_counts(data, size)))
        counts = []
        for n, h in enumerate(ngram_hashes(words, place, order), 1):
            there = place >= n - 1
            at = np.zeros(len(words), np.int64)
            if there.any():
                _, back = np.unique(h[there], return_inverse=True)
                at[there] = np.concatenate([c for _, c in sorted(held[n], key=lambda x: x[0])])[back]
            counts.append(at)
        logs = log_scores(counts, place, total, alpha, min_count)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logs, minlength=len(sizes))
        return pa.table([ids, pa.array(sizes), pa.array(sums, pa.float64())], schema=schema)
    return run


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2,
          block_words_max: int = BLOCK_WORDS, table_ngrams: int = TABLE_NGRAMS) -> DataFrame:
    """(doc_id, n_words, score, mean_score): natural logarithms, summed and per word."""
    rows = text_rows(docs)
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = 1 + total // block_words_max
    tables = 1 + total // table_ngrams
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    dealt = (dealt.select("block", "doc_id", "text").mapInArrow(_dealt, "block int, docs binary")
             .repartition("block"))
    asked = dealt.groupBy("block").applyInArrow(
        _asked(order, tables), "block int, n int, part int, size int, grams binary, counts binary")
    answers = asked.groupBy("n", "part").applyInArrow(
        _answered, "block int, n int, part int, counts binary, size int")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(order, total, alpha, min_count), "doc_id long, n_words long, score double")
    return scored.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
