"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` maps every text to its token ids, ``decode`` maps ids back to the
raw bytes.  Both run as Arrow batches in place: no shuffle, one batch of rows
in memory at a time.  The rank file is a path that every executor can open.

Defined results: a null or empty text has no ids and decodes to no bytes; a
null id column value stays null; repeated rows give repeated results; ids
outside the rank file raise an error; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import text_rows

#: Texts longer than this are cut at safe places before encoding.
CHUNK_CHARS = 1 << 16
#: Output batches are closed at about this many bytes.
BATCH_BYTES = 8 << 20

# A match of the pattern never spans a non-space followed by a blank, nor an
# ASCII letter next to an ASCII digit, so encoding may be cut there.
_SAFE = re.compile(r"[^\s](?=[ \n\r\t])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f.read().splitlines())}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Pieces of ``text`` that encode to the same ids as the whole."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit - 1)
        if found is None:
            break
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def encode_text(text: str, rank_file: str, pattern: str, limit: int = CHUNK_CHARS) -> bytes:
    """Token ids of a text as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_file, pattern)
    return b"".join(np.array(enc.encode_ordinary(part), dtype="<u4").tobytes()
                    for part in chunks(text, limit))


def decode_ids(ids: bytes, rank_file: str, pattern: str) -> bytes:
    return encoding(rank_file, pattern).decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def _mapped(work, schema: pa.Schema):
    """Arrow-batch function: (doc_id, value) rows to (doc_id, work(value))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, size = batch.column(0), [], 0
            first = 0
            for i, value in enumerate(batch.column(1)):
                out.append(work(value.as_py()))
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.record_batch([keys[first:i + 1], pa.array(out, pa.binary())], schema=schema)
                    out, size, first = [], 0, i + 1
            if out:
                yield pa.record_batch([keys[first:], pa.array(out, pa.binary())], schema=schema)
    return run


def encode(docs: DataFrame, rank_file: str, pattern: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, ids, n_tokens): ids are packed little-endian unsigned 32-bit."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    run = _mapped(lambda text: encode_text(text, rank_file, pattern, limit), schema)
    out = text_rows(docs).mapInArrow(run, "doc_id long, ids binary")
    return out.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the raw bytes of packed ``ids``; null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
    run = _mapped(lambda ids: decode_ids(ids, rank_file, pattern), schema)
    return (encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.lit(b"")).alias("ids"))
            .mapInArrow(run, "doc_id long, decoded binary"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
    ahead = _mapped(lambda text: encode_text(text, rank_file, pattern),
                    pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ahead(batches):
            back = [decode_ids(ids.as_py(), rank_file, pattern) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(back, pa.binary())],
                                  schema=schema)

    out = text_rows(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")
    return out.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes, per document."""
    return (round_trip(docs, rank_file, pattern)
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))
