"""Line deduplication by an exact set-similarity join.

A line is the set of its words, as 64-bit hashes ordered by rarity and hash.
The rarity of a word is the logarithm of the count of its hash bucket over the
whole corpus (a fixed 4 million counts, one byte each), which gives every line
the same global order.  Two lines of similarity 4/5 or more share a code in
their prefixes (the rarest fifth and one more); a word that occurs once in the
corpus takes its place there but cannot be shared, so it makes no row.  Only
the first place of each distinct line enters the join.  Prefix rows meet by
code and pass length, positional and bitmap filters; what passes is verified on
the full sets.  A line is removed if an earlier line, by
(doc_id, line number), is similar or equal.

Texts are shuffled once, with the numbers of their lines to remove.  They are
read for the rarity, for a table of all lines (place and prefix) on which the
join works, for the full sets of lines in pairs, and for the removal.

Large groups of variants stay linear: under each code, lines that pass all filters
with a common earlier line follow that leader and are paired with it alone, and
with lines of other leaders.  A line whose pairs all fail verification is then
paired with the earlier followers of its leaders, which the table of pairs names.
Under a code a line makes at most ``LIKELY`` further pairs, the likeliest; if it has
more and those it made all fail verification, it meets the other lines of that code too.

Words are split, coded and sorted in Arrow batches, joins and aggregates are
DataFrame code (README: the native form could not meet the limits).  Tables
between the steps lie in one folder, which goes when the result is written.

Defined results: a null or empty text has no lines to remove and stays as the
empty text; lines without a word, or of fewer than ``min_words`` words
(1 unless the caller says otherwise), are never removed and match nothing; a null id sorts last; rows that repeat an id and a text are
treated alike (no line is later than itself); lines of equal position in
different texts of one id are not later than each other; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import LAST_ID, removed_folder, shared_path, shuffles_dropped, text_rows, unpacked, whole_rows, written

BUCKET_BITS = 22
#: Buckets whose counts make one row.
PART_BUCKETS = 1 << 14
#: Sides of at most this many rows (of some 100 bytes) are broadcast, others shuffled.
BROADCAST_ROWS = 400_000
#: Bytes of text coded at a time (a longer text is coded whole).
CHUNK_BYTES = 1 << 22
#: Bytes of lines hashed at a time, so that the arrays stay in the cache (a longer line whole).
HASH_BYTES = 1 << 18
#: Bytes of a word that is hashed with all others, eight bytes a step; longer ones by themselves.
LONG_WORD = 64
#: Rows of one code that a task pairs in memory; codes of more rows are joined by Spark.
HOT_ROWS = 20_000
PAIRS_AT_ONCE = 1 << 21
#: Leaders looked for under a code; lines that follow none of them are paired with all others.
LEADERS = 3
#: Pairs of a line under a code, but with leaders, that are verified before its other pairs are made.
LIKELY = 32

Batches = Iterator[pa.RecordBatch]


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): null ids last; an id and the hash of its text name a row."""
    return text_rows(docs).select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"),
                                  F.xxhash64("text").alias("th"), "text")


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``CHUNK_BYTES`` of text in column ``at`` (a longer text is alone)."""
    ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False), dtype=np.int64)
    done = 0
    while done < batch.num_rows:
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(done, upto - done)
        done = upto


def _hashes(values: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, values), np.uint64, len(values))


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(33)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words per line of UTF-8 bytes, and the hash of every word, from its length and its
    bytes by eights; of words of more than ``LONG_WORD`` bytes xxHash's."""
    gap = (data == 0x20) | (data - np.uint8(0x09) < 5)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])))
    ends = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]]))) + 1
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), 0, (1,))
    size = ends - starts
    h = _mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ eights[starts] & _LOW_BYTES[np.minimum(size, 8)])
    some = np.flatnonzero(size > 8)
    for at in range(8, LONG_WORD, 8):
        if not len(some):
            break
        left = size[some] - at
        h[some] = _mixed(h[some] ^ eights[starts[some] + at] & _LOW_BYTES[np.minimum(left, 8)])
        some = some[left > 8]
    if len(some):
        h[some] = _hashes([data[a:b].tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
    return np.diff(np.searchsorted(starts, offsets)), h


def _hashed(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per line, and the 64-bit hash of every word of all lines."""
    lines = lines.cast(pa.large_string())
    _, offsets, data = lines.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lines.offset:lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes, words, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while done < len(lines):
        upto = max(done + 1, int(np.searchsorted(offsets, offsets[done] + HASH_BYTES, "right")) - 1)
        ends = offsets[done:upto + 1]
        many, h = _word_hashes(data[ends[0]:ends[-1]], ends - ends[0])
        sizes.append(many)
        words.append(h)
        done = upto
    return np.concatenate(sizes), np.concatenate(words)


def coded(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per line, and for every word of all lines its place in a list of
    distinct 64-bit hashes, with that list."""
    sizes, words = _hashed(lines)
    return sizes, *pd.factorize(words)


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts end to end, and their number by text."""
    lines = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    return lines.flatten(), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(batches: Batches) -> Batches:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for part in _parts(batch, 0):
            np.add.at(total, _bucket(_hashed(part.column(0))[1]), 1)
    for k, counts in enumerate(total.reshape(-1, PART_BUCKETS)):
        held = np.flatnonzero(counts)
        if len(held):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([held.astype(np.uint16).tobytes()]),
                                   pa.array([counts[held].tobytes()])], names=["part", "buckets", "words"])


def _part_levels(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, buckets, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums = total.setdefault(k, np.zeros(PART_BUCKETS, np.int64))
            sums[np.frombuffer(buckets, np.uint16)] += np.frombuffer(words, np.int64)
    for k, sums in total.items():
        levels = np.floor(4 * np.log2(np.maximum(sums, 1))).astype(np.uint8)
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([levels.tobytes()])], names=["part", "levels"])


def rarity_levels(docs: DataFrame) -> np.ndarray:
    """Rarity of every hash bucket, one byte each: 0 for at most one word in all
    texts, else a step of a quarter octave of the count.

    A task's counts leave it packed, ``PART_BUCKETS`` buckets a row, and are added up by part."""
    counts = text_rows(docs).select("text").mapInArrow(_bucket_counts, "part int, buckets binary, words binary")
    parts = counts.repartition("part").mapInArrow(_part_levels, "part int, levels binary").toArrow()
    levels = np.zeros(((1 << BUCKET_BITS) // PART_BUCKETS, PART_BUCKETS), np.uint8)
    for k, part in zip(parts["part"].to_pylist(), parts["levels"].to_pylist(), strict=True):
        levels[k] = np.frombuffer(part, np.uint8)
    return levels.reshape(-1)


def _sets(sizes: np.ndarray, index: np.ndarray, hashes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes of each line in order of rarity, end to end, their number,
    and whether each may occur again."""
    rarity = levels[_bucket(hashes)]
    order = np.argsort(hashes)
    order = order[np.argsort(rarity[order], kind="stable")]  # a radix sort of bytes
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = np.sort(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(order)) + rank[index])
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    line, rank = np.divmod(key[new], max(1, len(order)))
    return hashes[order][rank], np.bincount(line, minlength=len(sizes)), (rarity[order] > 0)[rank]


_LINE = ("lh long, doc_id long, line_no int, th long, n int, bits long, w0 long, w1 long, w2 long, "
         "skipped int, prefix array<int>")


def _line_hashes(lines: pa.Array) -> np.ndarray:
    return _hashes(lines.cast(pa.large_binary()).to_pylist()).view(np.int64)


def line_rows(docs: DataFrame, levels: np.ndarray, min_words: int) -> DataFrame:
    """Every place of a line of ``min_words`` words or more: hash ``lh`` and place
    (doc_id, line_no, th); the number ``n`` of its distinct codes and their bitmap of 64
    bits, with three of the four (``w0`` to ``w2``) that it is the sum of; the codes of
    its prefix that may occur again, behind ``skipped`` codes that cannot.

    Codes of a prefix only make lines meet, so their upper half will do."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in _parts(batch, 2):
                lines, many = _lines(part.column(2))
                row = np.repeat(np.arange(len(many)), many)
                number = np.arange(len(row)) - (np.cumsum(many) - many)[row]
                sizes, index, hashes = coded(lines)
                wanted = sizes >= max(1, min_words)
                at = np.flatnonzero(wanted)
                if not len(at):
                    continue
                codes, n, again = _sets(sizes[at], index[np.repeat(wanted, sizes)], hashes, levels)
                starts = np.cumsum(n) - n
                bit, part_of = np.uint64(1) << (codes & np.uint64(63)), codes >> np.uint64(20) & np.uint64(3)
                bits, *wide = (np.bitwise_xor.reduceat(b, starts).view(np.int64)
                               for b in (bit, *(np.where(part_of == q, bit, np.uint64(0)) for q in range(3))))
                owner = np.repeat(np.arange(len(n)), n)
                short = np.flatnonzero(again & (np.arange(len(codes)) - starts[owner] < (n - (4 * n + 4) // 5 + 1)[owner]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[short], minlength=len(n)))]).astype(np.int32)
                rows = pa.array(row[at])
                yield pa.record_batch(
                    [pa.array(_line_hashes(lines.take(pa.array(at)))), part.column(0).take(rows), pa.array(number[at].astype(np.int32)),
                     part.column(1).take(rows), pa.array(n.astype(np.int32)), pa.array(bits), *map(pa.array, wide),
                     pa.array(np.bincount(owner[~again], minlength=len(n)).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((codes[short] >> np.uint64(32)).astype(np.uint32).view(np.int32)))],
                    names=["lh", "doc_id", "line_no", "th", "n", "bits", "w0", "w1", "w2", "skipped", "prefix"])

    return keyed_rows(docs).mapInArrow(run, _LINE)


def first_places(lines: DataFrame) -> DataFrame:
    """The first place of every distinct line with its prefix, and its number of places."""
    return (lines.groupBy("lh").agg(F.min(F.struct("doc_id", "line_no", "th", "n", "bits", "w0", "w1", "w2", "skipped", "prefix")).alias("first"),
                                    F.count("*").alias("places"))
            .select("lh", "first.*", "places"))


def prefix_rows(firsts: DataFrame) -> DataFrame:
    """(token, lh, n, i, bits, doc_id, line_no): one row per code of each line's prefix
    that may occur again."""
    return (firsts.select("lh", "n", "bits", "doc_id", "line_no", "skipped", F.posexplode("prefix").alias("at", "token"))
            .select("token", "lh", "n", (F.col("skipped") + F.col("at")).alias("i"), "bits", "doc_id", "line_no"))


def full_sets(docs: DataFrame, named: DataFrame, levels: np.ndarray) -> DataFrame:
    """(lh, codes): the whole set of each named line.

    One bit for each of 4 million slots of line hashes tells most other lines
    apart before they are coded; the join with ``named`` is exact."""
    slots = named.select(F.expr(f"cast(lh & {(1 << BUCKET_BITS) - 1} as int)").alias("slot")).distinct().toArrow()
    held = np.zeros(1 << BUCKET_BITS, bool)
    held[slots["slot"].to_numpy()] = True
    held = np.packbits(held)

    def run(batches: Batches) -> Batches:
        slot = np.unpackbits(held).astype(bool)
        for batch in batches:
            for part in _parts(batch, 0):
                lines, _ = _lines(part.column(0))
                lh, at = np.unique(_line_hashes(lines), return_index=True)
                some = slot[lh & ((1 << BUCKET_BITS) - 1)]
                codes, n, _ = _sets(*coded(lines.take(pa.array(at[some]))), levels)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.record_batch([pa.array(lh[some]), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.view(np.int64)))],
                                      names=["lh", "codes"])

    return (text_rows(docs).select("text").mapInArrow(run, "lh long, codes array<long>")
            .join(_shuffled(named), "lh").dropDuplicates(["lh"]))


def texts_with(docs: DataFrame, named: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with the first places of the named lines; all texts where the
    named lines are too many to be broadcast."""
    if named.count() > BROADCAST_ROWS:
        return text_rows(docs)
    ids = firsts.join(F.broadcast(named), "lh", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    return text_rows(docs).join(F.broadcast(ids), F.coalesce("doc_id", F.lit(LAST_ID)) == F.col("id"), "left_semi")


def _passes(a: str, b: str) -> Column:
    """Length, bitmap and positional filters for two prefix rows of one code; a
    before b.  A similar pair passes under the first code that it shares, with
    all its common codes from there on."""
    return F.expr(f"""
        ({a}doc_id < {b}doc_id or ({a}doc_id = {b}doc_id and {a}line_no < {b}line_no))
        and 5L * least({a}n, {b}n) >= 4L * greatest({a}n, {b}n)
        and 9L * least({a}n - {a}i, {b}n - {b}i) >= 4L * ({a}n + {b}n)
        and 9L * bit_count({a}bits ^ {b}bits) <= {a}n + {b}n""")


def _near(a: str, b: str) -> Column:
    """Length filter and bitmap filter on 256 bits for two lines, a before b."""
    differ = [f"({a}w{q} ^ {b}w{q})" for q in range(3)]
    differ.append(" ^ ".join([f"({a}bits ^ {b}bits)", *differ]))
    return F.expr(f"""
        ({a}doc_id < {b}doc_id or ({a}doc_id = {b}doc_id and {a}line_no < {b}line_no))
        and 5L * least({a}n, {b}n) >= 4L * greatest({a}n, {b}n)
        and 9L * ({" + ".join(f"bit_count({d})" for d in differ)}) <= {a}n + {b}n""")


_ROW = ("lh", "n", "i", "bits", "doc_id", "line_no")
_SKETCH = ("lh", "doc_id", "line_no", "n", "bits", "w0", "w1", "w2")
_PREFIX = "token int, lh long, n int, i int, bits long, doc_id long, line_no int"


def _pass_between(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_passes`` over row numbers of one sorted table."""
    na, nb = rows["n"][a].astype(np.int64), rows["n"][b].astype(np.int64)
    total = na + nb
    ok = np.flatnonzero((5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))
                        & (9 * np.minimum(na - rows["i"][a], nb - rows["i"][b]) >= 4 * total))
    a, b = a[ok], b[ok]
    differ = np.bitwise_count((rows["bits"][a] ^ rows["bits"][b]).view(np.uint64)).astype(np.int64)
    later = (rows["doc_id"][a] != rows["doc_id"][b]) | (rows["line_no"][a] != rows["line_no"][b])
    passed = np.zeros(len(total), bool)
    passed[ok] = (9 * differ <= total[ok]) & later
    return passed


def _in_ranges(rows: dict[str, np.ndarray], at: np.ndarray, starts: np.ndarray, many: np.ndarray,
               made: np.ndarray, cut: np.ndarray, likely: int) -> Iterator[tuple]:
    """Pairs (a, b) of row numbers, a first, that pass all filters: the row at each
    place of ``at`` with the rows at the ``many`` places from its start; and no leader's.
    Of each b the ``likely`` nearest by bitmap, some millions of pairs at a time, ``made`` of
    them before; it is marked in ``cut`` if it had more."""
    for x, y in _ranges(starts, many):
        a, b = np.minimum(at[x], at[y]), np.maximum(at[x], at[y])
        passed = _pass_between(rows, a, b)
        a, b = a[passed], b[passed]
        new = np.bincount(b, minlength=len(made))
        if (made + new > likely).any():
            order = np.lexsort((np.bitwise_count((rows["bits"][a] ^ rows["bits"][b]).view(np.uint64)), b))
            a, b = a[order], b[order]
            kept = np.arange(len(b)) - (np.cumsum(new) - new)[b] < likely - made[b]
            cut[b[~kept]] = True
            a, b = a[kept], b[kept]
            new = np.minimum(new, likely - made)
        made += new
        yield a, b, False


def _ranges(starts: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y) for every x and ``many[x]`` values y from ``starts[x]``, some millions at a time."""
    ends = np.cumsum(many)
    done = 0
    while done < len(many):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS_AT_ONCE, "right")))
        m = many[done:upto]
        x = np.repeat(np.arange(done, upto), m)
        yield x, np.arange(len(x)) + np.repeat(starts[done:upto] - (np.cumsum(m) - m), m)
        done = upto


def _run_pairs(rows: dict[str, np.ndarray], cut: np.ndarray, likely: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (a, b, led) of row numbers, in whole runs of equal tokens sorted by place; rows with
    more than ``likely`` pairs are marked in ``cut``.

    The first line of a run leads those that pass with it, then the first of the others, and so on."""
    size = len(rows["token"])
    if not size:
        return
    run, made = np.cumsum(np.concatenate([[False], rows["token"][1:] != rows["token"][:-1]])), np.zeros(size, np.int64)
    leader, rest = np.arange(size), np.arange(size)
    for _ in range(LEADERS):
        new = np.concatenate([[True], run[rest[1:]] != run[rest[:-1]]])[:len(rest)]  # the first of each run
        first = rest[np.maximum.accumulate(np.where(new, np.arange(len(rest)), 0))]
        a, b = first[~new], rest[~new]
        passed = _pass_between(rows, a, b)
        leader[b[passed]] = a[passed]
        yield a[passed], b[passed], True
        rest = b[~passed]
    grouped = np.bincount(leader, minlength=size)[leader] > 1
    # lines in no group, by length: each meets the shorter ones of four fifths of its length
    n = rows["n"].astype(np.int64)
    alone = np.flatnonzero(~grouped)
    alone = alone[np.lexsort((n[alone], run[alone]))]
    wide = int(n.max(initial=0)) + 1
    starts = np.searchsorted(run[alone] * wide + n[alone], run[alone] * wide + (4 * n[alone] + 4) // 5)
    yield from _in_ranges(rows, alone, starts, np.arange(len(alone)) - starts, made, cut, likely)
    # then the groups: each line meets the lines in no group, and the groups before its own
    at = np.lexsort((np.where(grouped, leader, -1), run))
    group = np.where(grouped, leader, -1)[at]
    place = np.arange(size)
    new = np.concatenate([[True], run[at[1:]] != run[at[:-1]]])
    starts = np.maximum.accumulate(np.where(new, place, 0))
    new |= np.concatenate([[True], group[1:] != group[:-1]])
    yield from _in_ranges(rows, at, starts, np.where(grouped[at], np.maximum.accumulate(np.where(new, place, 0)) - starts, 0),
                          made, cut, likely)


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of ``_PREFIX`` from rows with two of them in one long."""
    key, place, lh, bits, doc_id = (batch.column(c).to_numpy() for c in ("key", "place", "lh", "bits", "doc_id"))
    return {"token": (key >> 32).astype(np.int32), "lh": lh, "n": (place >> 32).astype(np.int32), "i": key.astype(np.int32), "bits": bits,
            "doc_id": doc_id, "line_no": place.astype(np.int32)}


def _paired(batches: Batches, hot_rows: int, likely: int) -> Batches:
    """Rows sorted by token to pairs; tokens of more than ``hot_rows`` rows are handed on as they
    are, and tokens with a row of more than ``likely`` pairs too, with ``cut`` (null for the former)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("led", pa.bool_()), ("cut", pa.bool_())])
    blank = {"token": pa.int32(), "lh": pa.int64(), "n": pa.int32(), "i": pa.int32(), "bits": pa.int64(), "doc_id": pa.int64(), "line_no": pa.int32()}

    def pairs(rows: dict) -> Batches:
        order = np.lexsort((rows["line_no"], rows["doc_id"], rows["token"]))
        rows = {c: v[order] for c, v in rows.items()}
        cut = np.zeros(len(order), bool)
        for a, b, led in _run_pairs(rows, cut, likely):
            if len(a):
                out = pa.record_batch([pa.array(rows["lh"][a]), pa.array(rows["lh"][b]), pa.array(np.full(len(a), led)),
                                       pa.nulls(len(a), pa.bool_())], schema=schema)
                for c, kind in blank.items():
                    out = out.append_column(c, pa.nulls(len(a), kind))
                yield out
        if cut.any():
            some = np.isin(rows["token"], rows["token"][cut])
            yield handed_on({c: v[some] for c, v in rows.items()}, pa.array(cut[some]))

    def handed_on(rows: dict, cut: pa.Array | None = None) -> pa.RecordBatch:
        size = len(rows["token"])
        return pa.record_batch([*(pa.nulls(size, f.type) for f in schema if f.name != "cut"), pa.nulls(size, pa.bool_()) if cut is None else cut,
                                *(pa.array(rows[c], blank[c]) for c in blank)], names=[*schema.names, *blank])

    held, hot = None, None
    for batch in batches:
        rows = _unpacked(batch)
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if hot is not None:
            known = int(np.searchsorted(rows["token"], hot, "right"))
            yield handed_on({c: v[:known] for c, v in rows.items()})
            rows = {c: v[known:] for c, v in rows.items()}
        if not len(rows["token"]):
            held = None
            continue
        hot, last = None, int(np.searchsorted(rows["token"], rows["token"][-1], "left"))
        yield from pairs({c: v[:last] for c, v in rows.items()})
        held = {c: v[last:] for c, v in rows.items()}
        if len(held["token"]) > hot_rows:
            hot = held["token"][0]
            yield handed_on(held)
            held = None
    if held is not None:
        yield from pairs(held)


def _named(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(f"{side}_{c}") for c in _ROW))


def candidate_pairs(prefixes: DataFrame, folder: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(a, b, led): pairs of lines, a earlier, that pass all filters under a code, but not
    two followers of one leader; ``led`` where a leads b under some code.  Codes of more than
    ``hot_rows`` lines meet in a join that Spark can split, the others in sorted batches.

    And the prefix rows of codes where a line has more than ``LIKELY`` pairs, ``cut`` if it is that line."""
    pack = "(cast({} as long) << 32) | {}"  # two columns in one long: narrower rows
    packed = prefixes.select(F.expr(pack.format("token", "i")).alias("key"), F.expr(pack.format("n", "line_no")).alias("place"),
                             "lh", "bits", "doc_id")
    ordered = packed.repartition(F.expr("key >> 32")).sortWithinPartitions("key")  # one key: radix sort
    likely = LIKELY
    out = written(ordered.mapInArrow(lambda b: _paired(b, hot_rows, likely), f"a long, b long, led boolean, cut boolean, {_PREFIX}"),
                  "met", folder)
    pairs = out.where("token is null").select("a", "b", "led")
    hot = out.where("token is not null and cut is null").drop("a", "b", "led", "cut")
    if not hot.isEmpty():
        pairs = pairs.unionByName(_hot_pairs(hot, folder))
    return pairs.groupBy("a", "b").agg(F.max("led").alias("led")), out.where("cut is not null").drop("a", "b", "led")


def _hot_pairs(rows: DataFrame, folder: str) -> DataFrame:
    """The same pairs by joins; the first line of each hot code, its one leader, is a small table."""
    leaders = _sized(written(rows.groupBy("token").agg(F.min(F.struct("doc_id", "line_no", "lh", "n", "i", "bits"))
                                                       .alias("f")), "leaders", folder))
    led = _named(rows, "b").join(leaders, "token").select("*", *(F.col(f"f.{c}").alias(f"a_{c}") for c in _ROW)).drop("f")
    passed = F.coalesce(_passes("a_", "b_"), F.lit(False))
    ends = (F.col("a_lh").alias("a"), F.col("b_lh").alias("b"))
    first = led.where(passed)
    rest = led.where(~passed & (F.col("a_lh") != F.col("b_lh"))).select("token", *(f"b_{c}" for c in _ROW))
    earlier_rest = rest.select("token", *(F.col(f"b_{c}").alias(f"a_{c}") for c in _ROW))
    met = (rest.join(_named(rows, "a"), "token").where(_passes("a_", "b_")).select(*ends)
           .unionByName(first.select("token", *(f"b_{c}" for c in _ROW)).join(earlier_rest, "token")
                        .where(_passes("a_", "b_")).select(*ends)))
    return (first.select(*ends, F.lit(True).alias("led"))
            .unionByName(met.select("a", "b", F.lit(False).alias("led"))))


def _sketches(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(F.col("lh").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _SKETCH[1:]))


def near_pairs(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b, led, near, b's sketch): pairs that the wide bitmaps let be similar (``near``),
    and all with a leader."""
    return (pairs.join(_shuffled(_sketches(firsts, "a")), "a").join(_shuffled(_sketches(firsts, "b")), "b")
            .withColumn("near", _near("a_", "b_")).where("led or near")
            .select("a", "b", "led", "near", *(f"b_{c}" for c in _SKETCH[1:])))


def _shuffled(df: DataFrame) -> DataFrame:
    """A table of lines or pairs, which grows with the input: never broadcast, at any size."""
    return df.hint("merge")


def _sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a written table proven small; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(lh): later lines of the pairs whose full word sets have similarity 4/5 or more."""
    left, right = (sets.select(F.col("lh").alias(c), F.col("codes").alias(f"{c}_codes")) for c in "ab")
    return (pairs.select("a", "b").join(left, "a").join(right, "b")
            .where("9L * size(array_intersect(a_codes, b_codes)) >= 4L * (size(a_codes) + size(b_codes))")
            .select(F.col("b").alias("lh")).distinct())


def verified(docs: DataFrame, pairs: DataFrame, firsts: DataFrame, levels: np.ndarray, folder: str) -> DataFrame:
    """(lh): later lines of the pairs that are similar to an earlier one."""
    named = written(pairs.select(F.col("a").alias("lh")).union(pairs.select("b")).distinct(), "named", folder)
    sets = written(full_sets(texts_with(docs, named, firsts), named, levels), "sets", folder)
    return written(_similar(pairs, sets), "matches", folder)


def followers_of_one_leader(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): followers b that are not found, with the earlier followers a of their
    leaders, where length and bitmap let them be similar.

    A similar pair is in ``pairs`` unless both lines follow one leader under their first common
    code, so these pairs complete the join without another look at the prefixes."""
    led = pairs.where("led")
    late = (led.join(_shuffled(found.withColumnRenamed("lh", "b")), "b", "left_anti")
            .select(F.col("a").alias("leader"), "b", *(f"b_{c}" for c in _SKETCH[1:])))
    early = led.select(F.col("a").alias("leader"), F.col("b").alias("a"),
                       *(F.col(f"b_{c}").alias(f"a_{c}") for c in _SKETCH[1:]))
    return (late.join(_shuffled(early), "leader").where(_near("a_", "b_")).select("a", "b").distinct()
            .join(pairs.where("near"), ["a", "b"], "left_anti"))


def rest_of_pairs(rows: DataFrame, found: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): cut lines b that are not found, with all lines of the codes they were cut under, where
    the filters let them be similar and they were not in ``pairs``."""
    late = rows.where("cut").join(_shuffled(found), "lh", "left_anti")
    met = (_named(late, "b").join(_shuffled(_named(rows, "a")), "token").where(_passes("a_", "b_"))
           .select(F.col("a_lh").alias("a"), F.col("b_lh").alias("b")).distinct().withColumn("led", F.lit(False)))
    return near_pairs(met, firsts).select("a", "b").join(pairs.where("near"), ["a", "b"], "left_anti")


def similar_lines(docs: DataFrame, firsts: DataFrame, levels: np.ndarray, folder: str) -> DataFrame:
    """(lh): lines whose first place has a similar, different line before it."""
    met, cut = candidate_pairs(prefix_rows(firsts), folder)
    pairs = written(near_pairs(met, firsts), "pairs", folder)
    found = verified(docs, pairs.where("near"), firsts, levels, folder)
    more = followers_of_one_leader(pairs, found)
    if not cut.isEmpty():
        more = more.union(rest_of_pairs(cut, found, pairs, firsts)).distinct()
    more = written(more, "more", folder)
    return found if more.isEmpty() else found.union(verified(docs, more, firsts, levels, folder)).distinct()


def removed_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, gone): per text, the numbers of its lines to remove."""
    folder = shared_path(docs.sparkSession, "line-dedup")
    with shuffles_dropped(docs.sparkSession):
        levels = rarity_levels(docs)
        lines = written(line_rows(docs, levels, min_words), "lines", folder)
        firsts = written(first_places(lines), "firsts", folder)
        similar = similar_lines(docs, firsts, levels, folder).withColumn("similar", F.lit(True))
        marked = written(firsts.join(_shuffled(similar), "lh", "left").where("places > 1 or similar")
                         .select("lh", F.struct("doc_id", "line_no").alias("first"), "similar"), "marked", folder)
        removed = (lines.select("lh", "doc_id", "line_no", "th").join(_sized(marked), "lh")
                   .where(F.col("similar") | (F.struct("doc_id", "line_no") > F.col("first")))
                   .groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("gone")))
        done = written(removed, "line-removed")
    removed_folder(docs.sparkSession, folder)
    return done


def _without(rows: DataFrame) -> DataFrame:
    """``rows`` whose text has lost the lines numbered in ``gone``."""
    # lines are a column of their own, since a lambda would split the text for every line
    rows = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n")))


def dedup_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): every document without its later similar lines."""
    rows = (text_rows(docs).withColumn("k", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("th", F.xxhash64("text"))
            .join(removed_lines(docs, min_words).withColumnRenamed("doc_id", "k").hint("shuffle_hash"), ["k", "th"], "left"))
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return (_without(rows.withColumn("n_lines", (ends + 1).cast("long")))
            .select("doc_id", "text", "n_lines",
                    F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")))


def without_later_lines(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """All columns of ``docs``; the text loses its later similar lines (a null one
    stays null), ``n_chars`` follows it."""
    gone = removed_lines(docs, min_words).withColumnRenamed("doc_id", "id")
    rows = _without(whole_rows(docs).withColumn("th", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
                    .join(gone.hint("shuffle_hash"), ["id", "th"], "left"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.coalesce(F.length("text").cast(kind), F.col("row.n_chars"))
    return unpacked(rows, docs.columns, **changed)
