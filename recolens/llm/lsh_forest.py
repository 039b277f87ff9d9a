"""N-gram Jaccard self-join through a MinHash LSH forest, verified exactly.

A document is the set of its word shingles.  Documents of the same set are one
member with a copy count, so copies never meet as pairs.  Every tree of the
forest labels a member with a sequence of min-hashes; members that share a
label prefix are candidates.  Prefixes start at full depth and are shortened
until the forest finds a pair at the threshold with the target recall.

Under each prefix, members with similar signatures are chained to a star, not
paired; a prefix of many members is split into parts, and every pair of parts is
a task of its own, so none is lost.  The stars' components are the groups to verify.  A group is split into
blocks, and every pair of blocks counts exact intersections as one matrix
product and returns link counts and a spanning forest of its links.  The
components of those are the classes.

Defined results: texts of fewer words than the shingle length are one shingle
of all their words; null and empty texts have no shingle, no link, and are a
class of their own each; null ids are rows of their own and never name a class
that has another id; repeated rows are copies of each other; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import LAST_ID, text_rows, written

WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 32, 8, 0.99999
#: Signature agreement below which a candidate pair is dropped unverified: some
#: seven standard deviations below the threshold for 256 hashes.
AGREEMENT = 0.62
BLOCK_MEMBERS = 256
#: Members of a part of a prefix; a prefix of more members meets by pairs of parts.
STAR_MEMBERS = 2048
#: Members of at most this many rows are broadcast to fetch their texts, more are shuffled.
BROADCAST_ROWS = 400_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def prefix_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """The longest prefix at which a pair at the threshold shares one with the target recall."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < target:
        depth -= 1
    return depth


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    from xxhash import xxh3_64_intdigest

    found = text.encode("utf-8", "surrogatepass").split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    seen: dict[bytes, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in found], dtype=np.int64)
    word = np.fromiter(map(xxh3_64_intdigest, seen), np.uint64, len(seen))[codes]
    key = np.full(n, len(found) if len(found) < words else words, np.uint64)
    for j in range(min(words, len(found))):
        key = _mixed(key + word[j:j + n])
    return np.unique(key)


def min_hashes(members: np.ndarray, count: int) -> np.ndarray:
    """``count`` min-hashes of a set, over blocks of its members."""
    salts = _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 1024):
        x = (members[i:i + 1024, None] ^ salts) * _M1
        np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0), out=low)
    return low


def _signed(batches: Iterator[pa.RecordBatch], words: int, trees: int, max_depth: int, depth: int):
    """(doc_id, text, th) to (doc_id, th, set_id, signature, keys); no shingles, no signature."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        sets, signatures, keys = [], [], []
        for text in batch.column(1):
            members = shingles(text.as_py(), words)
            if not len(members):
                sets.append(None), signatures.append(None), keys.append(None)
                continue
            sets.append(np.uint64(xxh3_64_intdigest(members.tobytes())).astype(np.int64))
            low = min_hashes(members, trees * max_depth)
            signatures.append(low.astype(np.uint8).tobytes())
            label = low.reshape(trees, max_depth)[:, :depth]
            key = np.arange(trees, dtype=np.uint64)
            for d in range(depth):
                key = _mixed(key * _M2 + label[:, d])
            keys.append(key.view(np.int64))
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sets, pa.int64()), pa.array(signatures, pa.binary()),
                               pa.array(keys, pa.list_(pa.int64()))],
                              names=["doc_id", "th", "set_id", "signature", "keys"])


def _set_ids(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, set_id) of (doc_id, text, th) rows; null where a text has no shingle."""
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        sets = []
        for text in batch.column(1):
            members = shingles(text.as_py(), words)
            sets.append(np.uint64(xxh3_64_intdigest(members.tobytes())).astype(np.int64) if len(members) else None)
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(sets, pa.int64())], names=["doc_id", "th", "set_id"])


def _stars(trees_depth: int, agreement: float):
    """Chain the members under one prefix whose signatures agree: (a, b) star edges."""
    def run(table: pa.Table) -> pa.Table:
        ids = table["set_id"].to_numpy()
        sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(ids), trees_depth)
        order = np.argsort(ids, kind="stable")
        ids, sig = ids[order], sig[order]
        label = np.full(len(ids), -1)
        for start in range(len(ids)):
            if label[start] >= 0:
                continue
            label[start], frontier = start, [start]
            while frontier:  # breadth first over agreeing, unlabelled members
                i, open_rows = frontier.pop(), np.flatnonzero(label < 0)
                if not len(open_rows):
                    break
                alike = np.concatenate([(sig[part] == sig[i]).sum(axis=1) for part in
                                        np.array_split(open_rows, 1 + len(open_rows) // 65536)])
                near = open_rows[alike >= agreement * trees_depth]
                label[near] = start
                frontier.extend(near.tolist())
        linked = label != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[label[linked]], pa.int64()), "b": pa.array(ids[linked], pa.int64())})
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by label propagation
    in rounds; every round is written, and stars need few."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")),
                     "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("root"))
        moved = written(moved.join(jump, "next").select("node", F.col("root").alias("label"),
                                                        (F.col("root") != F.col("label")).alias("changed")), "labels")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            return labels


def _verified(num: int, den: int):
    """Exact links between two blocks of a group (or within one): per member the
    copies it links to, and a spanning forest of the links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("copies", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        ids, block = table["set_id"].to_numpy(), table["block"].to_numpy()
        copies = table["copies"].to_numpy()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        common = np.bincount(column)[column] > 1
        owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.int64)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            dense = np.zeros((len(sets), 4096), np.float32)
            dense[owner[a:b], column[a:b] - at] = 1
            both += (dense @ dense.T).astype(np.int64)
        total = sizes[:, None] + sizes[None, :]
        link = (num + den) * both >= num * total
        np.fill_diagonal(link, False)
        if first != second:
            link &= block[:, None] != block[None, :]
        rows = [(int(i), int(i), int(c)) for i, c in zip(ids, link @ copies) if c]
        label = np.full(len(sets), -1)
        for start in range(len(sets)):
            if label[start] >= 0:
                continue
            label[start], frontier = start, [start]
            while frontier:
                near = np.flatnonzero(link[frontier.pop()] & (label < 0))
                label[near] = start
                frontier.extend(near.tolist())
                rows += [(int(ids[start]), int(ids[j]), 0) for j in near]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [[], [], []], schema=schema)
    return run


def jaccard_join(docs: DataFrame, words: int = WORDS, num: int = 4, den: int = 5, trees: int = TREES,
                 max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): per document the smallest id of its class and
    the number of other documents of similarity ``num / den`` or more."""
    return row_classes(docs, words, num, den, trees, max_depth, target).select("doc_id", "class_id", "n_links")


def row_classes(docs: DataFrame, words: int = WORDS, num: int = 4, den: int = 5, trees: int = TREES,
                max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, th, label, class_id, n_links): of every row also the hash of its
    text and its class, null where the text has no shingle."""
    depth = prefix_depth(num / den, trees, max_depth, target)
    rows = text_rows(docs)
    signed = rows.withColumn("th", F.xxhash64("text")).mapInArrow(lambda b: _signed(b, words, trees, max_depth, depth),
                             "doc_id long, th long, set_id long, signature binary, keys array<long>")
    sets = written(signed.where("set_id is not null").groupBy("set_id")
                   .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
                        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), "th")).alias("row"),
                        F.first("signature").alias("signature"), F.first("keys").alias("keys")), "sets")
    nodes = sets.select("set_id", F.explode("keys").alias("key"))
    shared = (nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
              .select("key", F.ceil(F.col("n") / STAR_MEMBERS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("set_id", "key"), F.col("parts")).cast("int")
    under = (nodes.join(shared, "key").withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", "set_id", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"))
             .join(sets.select("set_id", "signature"), "set_id"))
    edges = (under.groupBy("key", "first", "second")
             .applyInArrow(_stars(trees * max_depth, AGREEMENT), "a long, b long").distinct())
    groups = components(edges)
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    members = written(groups.join(sizes, "label").join(sets, groups.node == sets.set_id)
                      .select("label", "set_id", "row", "copies", "blocks",
                              F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block")), "members")
    links = written(_block_pairs(rows, members, words).groupBy("label", "first", "second").applyInArrow(
        _verified(num, den), "a long, b long, copies long"), "links")
    linked = links.where("copies > 0").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("others"))
    classes = components(links.where("a <> b").select("a", "b")).select(F.col("node").alias("set_id"), "label")
    known = (sets.select("set_id", "copies", "doc_id").join(classes, "set_id", "left").join(linked, "set_id", "left")
             .withColumn("label", F.coalesce("label", "set_id")))
    named = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    known = known.join(named, "label").select(
        "set_id", "label", "class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # the rows again, by their sets alone: signatures are not worked out twice
    narrow = rows.withColumn("th", F.xxhash64("text")).mapInArrow(
        lambda b: _set_ids(b, words), "doc_id long, th long, set_id long")
    return (narrow.join(known, "set_id", "left")
            .select("doc_id", "th", "label", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def _block_pairs(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """One row per member and pair of blocks that holds its block, with its shingles.

    A member's text is read from one of its rows, found by id and text hash, so rows
    without an id meet only their own text."""
    keyed = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("k"), F.xxhash64("text").alias("th"), "text")
    wanted = members.select("row.k", "row.th", "set_id")
    if members.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out = []
            for set_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = shingles(text.as_py(), words).tobytes()
                if np.uint64(xxh3_64_intdigest(data)).astype(np.int64) == set_id:
                    out.append((set_id, data))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))],
                                      names=["set_id", "shingles"])

    texts = (keyed.join(wanted, ["k", "th"]).select("set_id", "text").mapInArrow(run, "set_id long, shingles binary")
             .dropDuplicates(["set_id"]))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return (members.select("label", "set_id", "copies", "block", other.alias("other"))
            .select("label", "set_id", "copies", "block", F.least("block", "other").alias("first"),
                    F.greatest("block", "other").alias("second"))
            .join(texts, "set_id"))
