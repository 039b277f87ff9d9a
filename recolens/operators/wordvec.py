"""M4 (re-aimed): item vectors from Word2Vec, as the mean of the word vectors
of the item's text (MLlib ``Word2VecModel.transform`` semantics: words
outside the vocabulary count in the denominator with a zero vector).

Training sentences are the individual segments (item text, each review), so
no item's text is concatenated.

Training is MLlib's: skip-gram with hierarchical softmax, parts trained side by side,
the tables of a word averaged over the parts that met it.  MLlib keeps the vocabulary,
its code tree and both tables on the driver; here they stay tables:

* A word's code needs no tree.  Its count is rounded down to a power of two; words in
  falling order of that lie side by side on a line, and a word's code is its place on
  the line divided by its width, an exact number.  So the code follows from the word's
  number within its width (at most 63 widths).  It is at most two bits longer than the
  best code, and an inner node is a code's first bits.
* A part is some ``PART_TOKENS`` tokens of whole rows.  It meets the codes of its own words
  and holds vectors for these words and their nodes alone.  First vectors are hashes of
  the word, the same in all parts.
* Sums of word vectors over texts (``weighted_sums``) are taken in such parts too, one
  row a text, so no (text, word) row carries a vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators.ids import dense_ids
from recolens.session import written

# Fixed values of the reference's paragraph-vector settings that carry over.
VECTOR_SIZE = 128
WINDOW = 5
MIN_COUNT = 2
SEED = 42
# Values of this trainer (the rate is MLlib's).
RATE = 0.025
CHUNK = 16
PART_TOKENS = 4_000_000
MEAN_ROWS = 20_000


@dataclass
class WordVectors:
    vectors: DataFrame        # (word, vector array<float>)
    size: int

    def getVectors(self) -> DataFrame:  # noqa: N802 - as MLlib's model
        return self.vectors.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))

    def getVectorSize(self) -> int:  # noqa: N802
        return self.size

    def transform(self, df: DataFrame, tokens_col: str = "toks", output_col: str = "__v") -> DataFrame:
        """``df`` with the mean word vector of every row's tokens."""
        rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "texts")
        means = row_means(self, rows.select(F.col("__row").alias("item_id"), F.col(tokens_col).alias("toks")))
        means = means.select(F.col("item_id").alias("__row"),
                             array_to_vector(F.col("embedding").cast("array<double>")).alias(output_col))
        return rows.join(means, "__row").drop("__row")


def coded_words(tokens: DataFrame, min_count: int) -> DataFrame:
    """(word, code, bits) of the words that occur ``min_count`` times or more."""
    counts = (tokens.select(F.explode("toks").alias("word")).where("word is not null").groupBy("word")
              .agg(F.count("*").alias("n")).where(F.col("n") >= min_count))
    place = F.length(F.bin("n")) - 1            # floor of its binary logarithm, exact
    words = written(counts.select("word", F.struct((-place).alias("width"), "word").alias("at")), "words")
    numbered = dense_ids(words, "at", "number").select(F.col("at.word").alias("word"), (-F.col("at.width")).alias("width"), "number")
    sizes = sorted(((-r[0], r[1]) for r in words.groupBy("at.width").count().collect()), reverse=True)   # <= 63 rows
    total = sum(n << width for width, n in sizes)
    bits = max((total - 1).bit_length(), sizes[0][0] + 1) if sizes else 1
    start = first = 0
    classes = []
    for width, n in sizes:
        classes.append((width, bits - width, (start >> width) - first))
        start, first = start + (n << width), first + n
    table = tokens.sparkSession.createDataFrame(classes, "width int, bits int, shift long")
    return numbered.join(F.broadcast(table), "width").select("word", (F.col("number") + F.col("shift")).alias("code"), "bits")


def first_vectors(key: np.ndarray, size: int, seed: int) -> np.ndarray:
    """MLlib's range (+-0.5 / size) from hashes of words (splitmix64)."""
    x = key.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed * size))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24) - np.float32(0.5)) / np.float32(size))


def paths(code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes above every word, from the root (-1 past its bits), and the turn taken at each."""
    level = np.arange(int(bits.max()))
    left = bits[:, None].astype(np.int64) - level
    nodes = np.where(left > 0, (np.int64(1) << level) | (code[:, None] >> np.maximum(left, 0)), -1)
    return nodes, ((code[:, None] >> np.maximum(left - 1, 0)) & 1).astype(np.float32)


def train_row(wids: np.ndarray, words: np.ndarray, nodes: np.ndarray, way: np.ndarray, turns: np.ndarray,
              reach: np.ndarray, rate: float) -> None:
    """One pass over a row: every word within ``reach`` of a place predicts the turns to its
    word.  Both tables change in place, ``CHUNK`` places at a time."""
    n, window = len(wids), int(reach.max())
    for start in range(0, n, CHUNK):
        end = min(n, start + CHUNK)
        left, right = max(0, start - window), min(n, end + window)
        gap = np.abs(np.arange(left, right)[:, None] - np.arange(start, end))
        near = ((gap > 0) & (gap <= reach[start:end])).astype(np.float32)
        seen, at = np.unique(wids[left:right], return_inverse=True)
        same = np.zeros((len(seen), right - left), np.float32)
        same[at, np.arange(right - left)] = 1
        target = wids[start:end]
        row, level = np.nonzero(way[target] >= 0)
        met, where = np.unique(way[target][row, level], return_inverse=True)
        on = np.zeros((2, end - start, len(met)), np.float32)
        on[0, row, where] = 1
        on[1, row, where] = 1 - turns[target][row, level]
        pairs = (same @ near) @ on
        a, b = words[seen], nodes[met]
        pull = (pairs[1] - pairs[0] / (1 + np.exp(-np.clip(a @ b.T, -30, 30)))) * np.float32(rate)
        # many pairs at once: a step is held below the loss's curvature (a quarter of squared norms)
        word_slow = 1 + np.float32(rate / 4) * (pairs[0] @ np.einsum("ij,ij->i", b, b))
        node_slow = 1 + np.float32(rate / 4) * (np.einsum("ij,ij->i", a, a) @ pairs[0])
        words[seen] = a + (pull @ b) / word_slow[:, None]
        nodes[met] = b + (pull.T @ a) / node_slow[:, None]


def _lists(m: np.ndarray) -> pa.Array:
    ends = np.arange(len(m) + 1, dtype=np.int32) * np.int32(m.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))


def _matrix(column, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, size)


def _numbers(lists: pa.ChunkedArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows in one array (-1 if unknown), and where rows begin."""
    lists = lists.combine_chunks()
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy()
    return at, np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())])


def _trainer(size: int, window: int, seed: int, iteration: int, iterations: int):
    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        part = int(key[0].as_py())
        docs, known = docs.sort_by("row"), known.sort_by([("word", "ascending"), ("node", "ascending")])
        is_word = pc.is_valid(known["word"])
        inner, known = known.filter(pc.invert(is_word)), known.filter(is_word)
        found = known["word"].combine_chunks()
        if not len(found) or not docs.num_rows:
            return _changes(found[:0], np.zeros((0, size), np.float32), np.zeros(0, np.int64), np.zeros((0, size), np.float32))
        way, turns = paths(known["code"].to_numpy(), known["bits"].to_numpy())
        there = way >= 0
        ids, at = np.unique(way[there], return_inverse=True)
        way[there] = at
        way = way.astype(np.int32)
        words, nodes = first_vectors(known["hash"].to_numpy(), size, seed), np.zeros((len(ids), size), np.float32)
        if iteration:
            words = _matrix(known["vector"], size).copy()
            nodes[np.searchsorted(ids, inner["node"].to_numpy())] = _matrix(inner["vector"], size)
        flat, begins = _numbers(docs["toks"], found)
        total, done = int((flat >= 0).sum()), 0
        rng = np.random.default_rng([seed, iteration, part])
        for i in range(docs.num_rows):
            wids = flat[begins[i]:begins[i + 1]]
            wids = wids[wids >= 0]
            if len(wids) > 1:
                rate = RATE * max(1e-4, 1 - (iteration * total + done) / (iterations * total + 1))
                train_row(wids, words, nodes, way, turns, window - rng.integers(0, window, len(wids)), rate)
            done += len(wids)
        last = iteration + 1 == iterations
        return _changes(found, words, ids[:0] if last else ids, nodes[:0] if last else nodes)
    return run


def _changes(found: pa.Array, words: np.ndarray, ids: np.ndarray, nodes: np.ndarray) -> pa.Table:
    return pa.table({"word": pa.concat_arrays([found.cast(pa.string()), pa.nulls(len(ids), pa.string())]),
                     "node": pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(ids, pa.int64())]),
                     "vector": pa.concat_arrays([_lists(words), _lists(nodes)])})


def _means(size: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("word", "ascending"), ("node", "ascending"), ("part", "ascending")])
        word, node = t["word"].combine_chunks(), t["node"].combine_chunks()
        number = pc.fill_null(word.dictionary_encode().indices, -1).to_numpy()
        other = pc.fill_null(node, -1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (other[1:] != other[:-1])]))
        n = np.diff(np.concatenate([first, [len(number)]]))
        total = np.add.reduceat(_matrix(t["vector"], size).astype(np.float64), first, axis=0)
        return pa.table({"word": word.take(pa.array(first)), "node": node.take(pa.array(first)),
                         "vector": _lists((total / n[:, None]).astype(np.float32))})
    return run


def dealt(rows: DataFrame, tokens_col: str) -> tuple[DataFrame, int]:
    """``rows`` written with the number of a part each, and the number of parts: one a core
    at least, and as many as hold ``PART_TOKENS`` tokens each."""
    table = written(rows.withColumn("row", F.monotonically_increasing_id()), "dealt")
    n = table.agg(F.sum(F.greatest(F.size(tokens_col), F.lit(0)))).first()[0] or 0
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_TOKENS))
    return table.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))), parts


def fit(sentences: DataFrame, tokens_col: str = "toks", vector_size: int = VECTOR_SIZE,
        window: int = WINDOW, min_count: int = MIN_COUNT, seed: int = SEED,
        max_iter: int = 1, num_partitions: int | None = None) -> WordVectors:
    docs, parts = dealt(sentences.select(F.col(tokens_col).alias("toks")), "toks")
    if num_partitions:
        docs = docs.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(num_partitions)))
    words = coded_words(docs, min_count)
    known = written(docs.select("part", F.explode("toks").alias("word")).distinct().join(words, "word")
                    .select("part", "word", "code", "bits", F.xxhash64("word").alias("hash")), "known")
    rows = known.count()
    buckets = max(1, rows // MEAN_ROWS)
    state = None
    for iteration in range(max_iter):
        asked = known.withColumn("node", F.lit(None).cast("long"))
        if state is None:
            asked = asked.withColumn("vector", F.lit(None).cast("array<float>"))
        else:
            levels = F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("level")
            met = (known.select("part", "code", "bits", levels)
                   .select("part", F.expr("shiftleft(1L, level) | shiftright(code, bits - level)").alias("node")).distinct()
                   .join(state.where("node is not null").select("node", "vector"), "node"))
            asked = (asked.join(state.where("word is not null").select("word", "vector"), "word")
                     .unionByName(met, allowMissingColumns=True))
        changes = (docs.select("part", "row", "toks").groupBy("part")
                   .cogroup(asked.select(F.col("part").alias("of"), "word", "node", "code", "bits", "hash", "vector").groupBy("of"))
                   .applyInArrow(_with_part(_trainer(vector_size, window, seed, iteration, max_iter)),
                                 "part long, word string, node long, vector array<float>"))
        state = written(changes.withColumn("bucket", F.pmod(F.xxhash64("word", "node"), F.lit(buckets))).groupBy("bucket")
                        .applyInArrow(_means(vector_size), "word string, node long, vector array<float>"), "vectors")
    return WordVectors(state.where("word is not null").select("word", "vector"), vector_size)


def _with_part(run):
    def of(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        out = run(key, docs, known)
        return out.add_column(0, "part", pa.array(np.full(out.num_rows, key[0].as_py(), np.int64)))
    return of


def weighted_sums(bags: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(item_id, sums array<double>, n_known) for every row of ``bags`` (item_id, words, and
    tf array<double> or null for ones): sum of tf x vector over the words that ``vectors``
    (word, vector array) has, and sum of their tf."""
    rows, _ = dealt(bags.select("item_id", "words", "tf"), "words")
    asked = (rows.select("part", F.explode("words").alias("word")).distinct().join(vectors.select("word", "vector"), "word")
             .select(F.col("part").alias("of"), "word", "vector"))
    id_type = bags.schema["item_id"].dataType.simpleString()

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        flat, begins = _numbers(texts["words"], known["word"].combine_chunks())
        table = _matrix(known["vector"], size)
        tf = np.ones(len(flat))
        if texts["tf"].null_count < texts.num_rows:
            tf = texts["tf"].combine_chunks().flatten().to_numpy()
        sums, n = np.zeros((texts.num_rows, size)), np.zeros(texts.num_rows)
        for i in range(texts.num_rows):
            for at in range(begins[i], begins[i + 1], PART_TOKENS // 64):
                here = slice(at, min(begins[i + 1], at + PART_TOKENS // 64))
                has = flat[here] >= 0
                sums[i] += tf[here][has] @ table[flat[here][has]]
                n[i] += tf[here][has].sum()
        return pa.table({"item_id": texts["item_id"], "sums": _lists(sums), "n_known": pa.array(n)})

    return (rows.select("part", "item_id", "words", "tf").groupBy("part").cogroup(asked.groupBy("of"))
            .applyInArrow(run, f"item_id {id_type}, sums array<double>, n_known double"))


def _means_of(sums: DataFrame) -> DataFrame:
    """Sums divided by the count that rides with the id."""
    n = F.col("n")
    return (sums.select(F.col("item_id.item_id").alias("id"), F.col("item_id.n").alias("n"), "sums")
            .select(F.col("id").alias("item_id"),
                    F.transform("sums", lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")).alias("embedding")))


def row_means(model: WordVectors, tokens: DataFrame) -> DataFrame:
    """``(item_id, embedding ARRAY<FLOAT>)`` = mean word vector of every row of (item_id, toks)."""
    bags = tokens.select(F.struct("item_id", F.greatest(F.size("toks"), F.lit(0)).alias("n")).alias("item_id"),
                         F.col("toks").alias("words"), F.lit(None).cast("array<double>").alias("tf"))
    sums = weighted_sums(bags, model.vectors, model.size)
    return _means_of(sums)


def item_vectors(model: WordVectors, segments_tokens: DataFrame,
                 tokens_col: str = "toks") -> DataFrame:
    """``(item_id, embedding ARRAY<FLOAT>)`` = mean word vector per item; an item is one row
    with a count for each of its words, however many segments it has."""
    tf = (segments_tokens.select("item_id", F.explode(tokens_col).alias("word"))
          .groupBy("item_id", "word").agg(F.count(F.lit(1)).cast("double").alias("tf")))
    bags = tf.groupBy("item_id").agg(F.collect_list(F.struct("word", "tf")).alias("b"), F.sum("tf").alias("n"))
    bags = bags.select(F.struct("item_id", "n").alias("item_id"), F.col("b.word").alias("words"), F.col("b.tf").alias("tf"))
    sums = weighted_sums(bags, model.vectors, model.size)
    return _means_of(sums)


def segment_tokens(segments: DataFrame) -> DataFrame:
    """Whitespace tokens per segment (the cleaned text is already tokenised)."""
    return segments.select("item_id", "seg_order", T.split_tokens(F.col("text")).alias("toks"))
