"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model holds a whitespace marker behind another character, so no
merge crosses the place before such a marker and a text may be cut there: into
marked words, markers followed by other characters.  A task keeps a table of the
distinct words it has met.  The texts of a block become codes of that table; the
words that are new are segmented by the library, each once; ids are joined back to
the texts by position.

Texts stay where they are read: no shuffle, so no word or source is a hot key.  The
table is the task's own (one for all tasks would send every block's words and codes
through a shuffle).  It starts anew after ``TABLE_WORDS`` words and a block
ends after ``BLOCK_CHARS`` characters, which bounds memory but for one longer text.

Defined results: a null or empty text has no ids and decodes to the empty text;
null ids stay null; repeated rows give repeated results; an empty table gives an
empty result; a text without blanks is one word.  A model whose pieces cross
markers, or that normalises text, raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import text_rows

MARK = "▁"
BLOCK_CHARS = 2 << 20
TABLE_WORDS = 1 << 19
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_CROSSING = re.compile(f"[^{MARK}]{MARK}")


@lru_cache(maxsize=4)
def processor(model_file: str):
    """The model, loaded once per Python worker and checked for what the cuts need."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    spec = model.normalizer_spec
    if (spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix
            or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
        raise ValueError("marked words need a model that leaves texts as they are and puts one marker first")
    if any(_CROSSING.search(p.piece) for p in model.pieces):
        raise ValueError("a piece of the model crosses a whitespace marker")
    return sp


def marked_words(text: str) -> list[str]:
    """The words of a text with their markers; joined they are the marked text."""
    return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


def word_ids(words: list[str], model_file: str) -> list[list[int]]:
    """Ids of marked words: the library puts the first marker back itself."""
    sp = processor(model_file)
    found = sp.encode([w[1:] for w in words], num_threads=1)
    lone = sp.piece_to_id(MARK)
    return [ids if len(w) > 1 else [lone] for w, ids in zip(words, found)]


class WordTable:
    """Distinct marked words and their ids; a word is segmented when it first appears."""

    def __init__(self, model_file: str):
        self.model_file = model_file
        self.codes: defaultdict[str, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def coded(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def segment_new(self) -> None:
        """Ids of the words that have come since the last call."""
        new = list(islice(self.codes, len(self.sizes), None))
        if new:
            ids = word_ids(new, self.model_file)
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), "<u4")])

    def ids(self, texts: list[np.ndarray]) -> list[bytes]:
        """The ids of coded texts: each word's ids, gathered by position."""
        first = np.cumsum(self.sizes) - self.sizes
        out = []
        for codes in texts:
            n = self.sizes[codes]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(self.flat[np.repeat(first[codes], n) + inner].tobytes())
        return out


def encode(docs: DataFrame, model_file: str, block_chars: int = BLOCK_CHARS, table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids, n_tokens): the library's ids of every text, packed little-endian
    unsigned 32-bit, without begin and end ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, doc_ids, texts, chars = WordTable(model_file), [], [], 0

        def block():
            table.segment_new()
            return pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(table.ids(texts), pa.binary())], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                doc_ids.append(doc_id.as_py())
                texts.append(table.coded(marked_words(text)))
                chars += len(text) + 16
                if chars >= block_chars:
                    yield block()
                    doc_ids, texts, chars = [], [], 0
                    if len(table.codes) > table_words:
                        table = WordTable(model_file)
        if doc_ids:
            yield block()

    out = text_rows(docs).mapInArrow(run, "doc_id long, ids binary")
    return out.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))


def _decoded(encoded: DataFrame, work, fields: str, kinds: list[pa.DataType]) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), *zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [work(np.frombuffer(v.as_py(), "<u4").tolist()) for v in part.column(1)]
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], schema=schema)

    return (encoded.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.lit(b"")).alias("ids"))
            .mapInArrow(run, f"doc_id long, {fields}"))


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, decoded): the text of packed ``ids``; null ids are none."""
    return _decoded(encoded, lambda ids: (processor(model_file).decode(ids),), "decoded string", [pa.string()])


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, per document."""
    def work(ids: list[int]):
        return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(processor(model_file).decode(ids).encode()).hexdigest())

    return _decoded(encode(docs, model_file), work, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                    [pa.int64(), pa.string(), pa.string()])
