"""Exact top-k inner-product search over a bit-sliced index.

The index holds, for blocks of rows, one bitmap per attribute and bit.  A
query adds the slices of all attributes, by the bits of its own quantised
components, with carry-save bitmap arithmetic: attributes in groups of four, whose
sums a block holds once for all queries, then the sums of a bit, then the bits,
the sign bit's as a complement.  The sum is itself a stack of slices; the top rows
are selected from the most significant slice downward, and rows that tie at
the boundary are resolved by id.

The query set meets all index blocks in blocks of queries, and only the best k
rows of each pair of blocks leave a task.

Defined results: components become floor(256 * x), held to +-2^61, and scores
are exact, reported as the nearest 64-bit number beyond that range; vectors
that are null or hold null or non-finite components take no part; vectors of
different lengths are not compared; a query is compared with every row of
another id, repeated rows included, and repeated query rows give one answer
for the first of their vectors; rows with a null id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Components beyond this have scores beyond 64 bits with any other component but 0 and 1.
LIMIT = 2.0 ** 61
BLOCK_ROWS = 16384
QUERY_ROWS = 256
#: Bytes of sums of groups of attributes that a task holds for a block.
TABLE_BYTES = 1 << 26


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): finite vectors as packed little-endian 64-bit integers."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"),
                     F.col(vector_col).cast("array<double>").alias("x"))
    inf = float("inf")
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(
        F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < inf)), F.lit(False)))


def _packed(limit: int, slices: bool):
    """Rows to blocks of one vector length: (dim, ids, vectors or slices)."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("low", pa.binary()),
                        ("bits", pa.int32()), ("data", pa.binary())])

    def block(dim: int, ids: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        key, values = np.concatenate(ids), np.concatenate(vectors)
        if slices:
            low, bits, data = slice_block(values)
        else:
            low, bits, data = np.zeros(0, np.int64), 0, values
        return pa.record_batch([pa.array([dim], pa.int32()), pa.array([key.tobytes()]), pa.array([low.tobytes()]),
                                pa.array([bits], pa.int32()), pa.array([data.tobytes()])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for part in np.array_split(rows, -(-len(rows) // limit)):
                    x = flat[starts[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0))
                    with np.errstate(over="ignore"):
                        v = np.clip(np.floor(SCALE * x), -LIMIT, LIMIT).astype(np.int64)
                    key, vec, n = held.get(int(dim), ([], [], 0))
                    if n + len(part) > limit:
                        yield block(int(dim), key, vec)
                        key, vec, n = [], [], 0
                    held[int(dim)] = ([*key, ids[part].astype(np.int64)], [*vec, v], n + len(part))
        for dim, (key, vec, _) in held.items():
            yield block(dim, key, vec)
    return run


def slice_block(values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Lowest value per attribute, bits, and bitmaps (attribute, bit, 64-row word)."""
    n, dim = values.shape
    low = values.min(axis=0) if dim else np.zeros(0, np.int64)
    above = (values - low).T
    bits = max(1, int(above.max(initial=0)).bit_length())
    words = -(-n // 64)
    planes = np.zeros((dim, bits, words * 64), np.uint8)
    for b in range(bits):
        planes[:, b, :n] = (above >> b) & 1
    return low, bits, np.packbits(planes, axis=-1, bitorder="little").view("<u8")


def add_slices(addends: np.ndarray, width: int) -> np.ndarray:
    """Sums, of ``width`` slices, over the second axis of bit-sliced numbers (sum, count,
    slice, word) by carry-save adders; numbers grow by a slice at each level."""
    while addends.shape[1] > 2:
        n, held = addends.shape[1] // 3, addends.shape[2]
        a, b, c, rest = addends[:, :n], addends[:, n:2 * n], addends[:, 2 * n:3 * n], addends[:, 3 * n:]
        wide = min(width, held + 1)
        out = np.empty((len(addends), 2 * n + rest.shape[1], wide, addends.shape[3]), np.uint64)
        out[:, :, held:] = 0
        out[:, n:2 * n, 0] = 0
        half = a ^ b
        np.bitwise_xor(half, c, out=out[:, :n, :held])
        half &= c
        half |= a & b
        out[:, n:2 * n, 1:] = half[:, :, :wide - 1]
        out[:, 2 * n:, :held] = rest
        addends = out
    held = addends.shape[2]
    total = np.zeros((len(addends), width, addends.shape[3]), np.uint64)
    if addends.shape[1]:
        total[:, :held] = addends[:, 0]
    if addends.shape[1] == 2:
        carry = np.zeros_like(total[:, 0])
        for p in range(width):
            a = total[:, p].copy()
            if p < held:
                b = addends[:, 1, p]
                half = a ^ b
                total[:, p] = half ^ carry
                carry = (a & b) | (half & carry)
            else:
                total[:, p] ^= carry
                carry &= a
    return total


def subset_sums(index: np.ndarray) -> np.ndarray:
    """Bit-sliced sums (group, subset, slice, word) of every subset of each group of attributes:
    of four, or fewer where the table would pass ``TABLE_BYTES``."""
    dim, bits, words = index.shape
    size = next((g for g in (4, 2) if -(-dim // g) * 2 ** g * (bits + g) * words * 8 <= TABLE_BYTES), 1)
    groups = -(-dim // size)
    own = np.zeros((groups * size, bits, words), np.uint64)
    own[:dim] = index
    own = own.reshape(groups, size, bits, words)
    width = (size * ((1 << bits) - 1)).bit_length()
    table = np.zeros((groups, 1 << size, width, words), np.uint64)
    for subset in range(1, 1 << size):
        held = [d for d in range(size) if subset >> d & 1]
        table[:, subset] = add_slices(own[:, held], width)
    return table


def score_slices(query: np.ndarray, low: np.ndarray, bits: int, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices of (score - offset) for all rows of a block, and the offset.

    A component is read as two's complement: attributes that have a bit in common are
    summed, group by group, from ``subset_sums``; the sums are shifted and added, that of the
    sign bit by its complement."""
    groups, subsets, least, words = table.shape
    size = subsets.bit_length() - 1
    sign = int(np.abs(query).max(initial=0)).bit_length()
    planes = np.zeros((sign + 1, groups * size), np.int64)
    planes[:, :len(query)] = query >> np.arange(sign + 1)[:, None] & 1
    chosen = (planes.reshape(sign + 1, groups, size) << np.arange(size)).sum(axis=2)
    most = len(query) * ((1 << bits) - 1)
    m = max(least, most.bit_length())
    by_bit = add_slices(table[np.arange(groups), chosen], m)
    offset = sum(q * lo for q, lo in zip(query.tolist(), low.tolist(), strict=True)) - (((1 << m) - 1) << sign)
    by_bit[sign] = ~by_bit[sign]
    width = max(1, ((most << sign) + (((1 << m) - 1) << sign)).bit_length())
    sums = np.zeros((1, sign + 1, width, words), np.uint64)
    for s in range(sign + 1):
        sums[0, s, s:s + m] = by_bit[s]
    return add_slices(sums, width)[0], offset


def select_top(sums: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k highest sums among the bitmap ``rows``; ties to smaller ids."""
    sure, maybe = np.zeros_like(rows), rows
    n_sure = 0
    for p in range(len(sums) - 1, -1, -1):
        high = maybe & sums[p]
        n = n_sure + int(np.bitwise_count(high).sum())
        if n > k:
            maybe = high
        else:
            sure, n_sure, maybe = sure | high, n, maybe & ~sums[p]
            if n == k:
                return _rows(sure)
    boundary = _rows(maybe)
    order = np.argsort(ids[boundary], kind="stable")[:k - n_sure]
    return np.concatenate([_rows(sure), boundary[order]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def exact_scores(sums: np.ndarray, rows: np.ndarray, offset: int) -> list[int]:
    """Scores read back from the slices, held to 64 bits."""
    bits = (sums[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
    out = [sum(int(b) << p for p, b in enumerate(col)) + offset for col in bits.T]
    return [max(-(1 << 63), min((1 << 63) - 1, s)) for s in out]


def _searched(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, ids, low, bits, data, q_ids, q_data = (batch.column(i)[r].as_py() for i in range(7))
                ids, low = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
                words = -(-len(ids) // 64)
                index = np.frombuffer(data, "<u8").reshape(dim, bits, words)
                table = subset_sums(index)
                there = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view("<u8")
                queries = np.frombuffer(q_data, np.int64).reshape(len(q_ids) // 8, dim)
                out: list[tuple[int, int, int]] = []
                for q_id, query in zip(np.frombuffer(q_ids, np.int64).tolist(), queries, strict=True):
                    sums, offset = score_slices(query, low, bits, table)
                    rows = there
                    for own in np.flatnonzero(ids == q_id).tolist():
                        rows = rows.copy()
                        rows[own // 64] &= ~np.uint64(1 << own % 64)
                    best = select_top(sums, rows, ids, k)
                    out += zip([q_id] * len(best), ids[best].tolist(), exact_scores(sums, best, offset), strict=True)
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id",
          vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of
    each query with all rows of another id, ties to the smaller id."""
    spark = vectors.sparkSession
    block = "dim int, ids binary, low binary, bits int, data binary"
    index = (quantised(vectors, id_col, vector_col).mapInArrow(_packed(block_rows, True), block))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = (quantised(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("x").alias("x"))
             .mapInArrow(_packed(query_rows, False), block)
             .select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .repartition(shards, "dim", "shard"))
    # a count of partitions of its own: blocks are few bytes for their work, so they are not merged into a few tasks
    pairs = (index.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int")).repartition(shards, "dim", "shard")
             .join(asked, ["dim", "shard"])
             .select("dim", "ids", "low", "bits", "data", "q_ids", "q_data"))
    found = pairs.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
