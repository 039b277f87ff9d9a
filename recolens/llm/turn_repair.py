"""Conversation structure repair: alignment of turns to alternating target strings.

A repaired conversation's role initials match ``(s?(ua)+)?``.  The turns of a
conversation are aligned (Wagner-Fischer: keep 0, rerole 1, delete 2, insert 5,
undeleted truncated turns 5 more) to the target string of every feasible
length.  The cheapest alignment so far bounds the lengths still worth trying and
the band of diagonals within a table (Ukkonen).  The table holds costs to go,
so the backtrace from its first cell takes the ASCII-least edit that stays
optimal at each step and yields the least audit of that target; the audits of equally
cheap targets are then compared.

Long conversations are aligned in windows of ``WINDOW`` turns: the targets of a
window start at each state the grammar can be in (nothing yet, after s, u or a) and
the best history of each state is carried on.  Insertions belong to the window of the
next turn, so histories of equal cost are never prefixes of each other and their
order stays that of the whole audits.  A history is a state, its cost, its audit and a
running SHA-256, so turns stream past in sorted order and no conversation is held.
A conversation's digest is sequential: its turns pass through one task, sorted on
disk where need be.

Faults are found by Spark: later copies of a (role, text) of a conversation from a
table of repeated keys, and they are counted before the shuffle, so a
million equal turns are one row.

Defined results: a null role, text, turn or conv_id is one space in keys, roles and
texts; null turns come first and take no part in ``gaps``; a null conv_id is a
conversation of its own.  Turns of the same number follow by role, then text.
An empty role has no initial and is never kept.  Conversations that lose every turn
have zeros, an empty audit and the digest of the empty string.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WINDOW = 24
BLANKS = " \t\n\x0b\x0c\r"
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")

# States of the grammar by what was emitted last.
START, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
_NEXT = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
_ROLE = {"u": "user", "a": "assistant"}
_INF = 1 << 60

# A turn is one character: s, u, a or o (any other role), upper case if it is
# truncated, - if it must be deleted.


def target(state: str, system: bool, length: int) -> str:
    """The only legal continuation of ``state`` of that length, after an ``s`` or not."""
    out = "s" if system else ""
    while len(out) < length:
        out += _NEXT[out[-1:] or state]
    return out


def aligned(turns: str, goal: str, trailing: bool, most: int) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest alignment of turns with a target string,
    None if it costs more than ``most``.  Without ``trailing`` nothing is inserted
    after the last turn."""
    n, m = len(turns), len(goal)
    low, high = (5 * (m - n) - most) // 7, (most + 2 * (m - n)) // 7   # diagonals that can cost <= most
    if not low <= 0 <= high or not low <= m - n <= high:
        return None
    togo: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        row, below = togo[i], togo[i + 1] if i < n else {}
        turn = turns[i] if i < n else "-"
        lower, late = turn.lower(), TRUNCATED if turn.isupper() else 0
        for j in range(min(m, i + high), max(0, i + low) - 1, -1):
            if i == n and j == m:
                row[j] = 0
                continue
            best = below.get(j, _INF) + DELETE
            if j < m:
                if goal[j] != "s" and (i < n or trailing):
                    best = min(best, row.get(j + 1, _INF) + INSERT)
                if turn != "-" and (lower == goal[j] or goal[j] != "s"):
                    best = min(best, below.get(j + 1, _INF) + late + (KEEP if lower == goal[j] else REROLE))
            row[j] = best
    cost = togo[0][0]
    if cost > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        rest = togo[i][j]
        if i < n and togo[i + 1].get(j, _INF) + DELETE == rest:
            audit.append("D")
            i += 1
        elif j < m and goal[j] != "s" and (i < n or trailing) and togo[i].get(j + 1, _INF) + INSERT == rest:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == goal[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


@lru_cache(maxsize=1 << 16)
def alignments(turns: str, state: str, last: bool) -> tuple[tuple[str, int, str], ...]:
    """(end state, cost, least audit) of a window of turns that starts in ``state``.

    Each end state's cheapest alignment over all feasible lengths; in the last
    window the ends are those of a whole legal string, taken together."""
    n, useful = len(turns), sum(t != "-" for t in turns)
    best: dict[str, tuple[int, str, str]] = {}
    bound = INSERT * 2 + DELETE * n      # delete every turn, insert at most two
    for system in (False, True) if state == START and "s" in turns.lower() else (False,):
        lengths = range(int(system), useful + bound // INSERT + 1)
        for m in sorted(lengths, key=lambda m: (abs(m - useful), m)):
            goal = target(state, system, m)
            end = goal[-1:] or state
            if last and end not in (START, ASSISTANT):
                continue
            slot = "" if last else end
            least = DELETE * (n - m) if m <= useful else DELETE * (n - useful) + INSERT * (m - useful)
            most = best[slot][0] if slot in best else bound
            if least > most:
                continue
            found = aligned(turns, goal, last, most)
            if found is not None and (slot not in best or found < best[slot][:2]):
                best[slot] = (*found, end)
    return tuple((end, cost, audit) for cost, audit, end in best.values())


class History:
    """The cheapest way to a state: its cost, audit (linked pieces) and digest."""

    __slots__ = ("state", "cost", "pieces", "digest", "empty")

    def __init__(self, state, cost, pieces, digest, empty):
        self.state, self.cost, self.pieces, self.digest, self.empty = state, cost, pieces, digest, empty

    def extended(self, end: str, cost: int, audit: str, turns: list[tuple[str, str, str]], own: bool) -> History:
        """This history with a window's edits; ``own`` if no other one goes on from it."""
        digest, empty, state, i = self.digest if own else self.digest.copy(), self.empty, self.state, 0
        for edit in audit:
            role = text = None
            if edit != "I":
                symbol, role, text = turns[i]
                i += 1
            if edit == "D":
                continue
            if edit == "K":
                state = symbol.lower()
            else:
                state = _NEXT[state]
                role, text = _ROLE[state], text or ""
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
        return History(end, self.cost + cost, (self.pieces, audit), digest, empty)

    def audit(self) -> str:
        out, at = [], self.pieces
        while at is not None:
            at, piece = at
            out.append(piece)
        return "".join(reversed(out))


#: What a state can cost less than another and still be beaten by it for sure: the
#: other one inserts its way to the same phase, and deletes a system turn.
_CATCH_UP = {(ASSISTANT, START): 2, (USER, START): 7, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): 5,
             (ASSISTANT, USER): 5, (USER, ASSISTANT): 5}


def advanced(histories: list[History], turns: list[tuple[str, str, str]], last: bool) -> list[History]:
    """The best histories after a window, in the order of their audits."""
    window = "".join(t[0] for t in turns)
    best: dict[str, tuple] = {}
    for rank, h in enumerate(histories):
        for end, cost, audit in alignments(window, h.state, last):
            new = (h.cost + cost, rank, audit, end, cost)
            slot = "" if last else end
            if slot not in best or new < best[slot]:
                best[slot] = new
    ways = sorted(best.values(), key=lambda b: b[1:3])
    ways = [b for b in ways if not any(c[0] + _CATCH_UP.get((c[3], b[3]), _INF) < b[0] for c in ways)]
    used = [b[1] for b in ways]
    return [histories[rank].extended(end, cost, audit, turns, used.count(rank) == 1)
            for _, rank, audit, end, cost in ways]


class Conversation:
    """Turns of one conversation in order; keeps counts, one window and the histories."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.window: list[tuple[str, str, str]] = []
        self.histories = [History(START, 0, None, hashlib.sha256(), True)]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn, role: str, text: str, fault: str, copies: int) -> None:
        symbol = role[:1]
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        if self.before is not None:
            self.illegal += self.before + symbol not in ("su", "ua", "au")
        self.illegal += (copies - 1)         # a role never alternates with itself
        self.before = symbol
        kept = symbol if symbol in ("s", "u", "a") else "o"
        if fault == "blank":
            self.blank += copies
        elif fault == "duplicate":
            self.duplicate += copies
        elif fault == "truncated":
            self.truncated += copies
            kept = kept.upper()
        if fault in ("blank", "duplicate"):
            kept = "-"
        for _ in range(copies):
            if len(self.window) == WINDOW:
                self.histories = advanced(self.histories, self.window, False)
                self.window = []
            self.window.append((kept, role, text))

    def result(self) -> tuple:
        best = advanced(self.histories, self.window, True)[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost,
                best.audit(), best.digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by crc32("conv_id:turn") % 20:
    0 drops the turn, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes it
    the user's.  Dropped turns stay as rows of no copies."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn"))) % 20
    return (rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), either("role").alias("role"),
                        either("text").alias("text"), kind.alias("kind"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")))


def turns_with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault) of damaged rows, every turn's first
    fault; one row without copies for each conversation."""
    there = rows.where("copies > 0")
    same = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    early = F.coalesce(F.col("turn"), F.lit(-(1 << 63)))
    keyed = there.withColumn("same", same)
    # rows of one conversation that agree in role and text, and the turn of the first of them
    repeated = (keyed.withColumn("early", early).withColumn("later", F.col("turn").isNotNull())
                .groupBy("conv_id", "same").agg(F.sum("copies").alias("all"), F.min(F.struct("later", "early")).alias("first"))
                .where("`all` > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first"))
    met = keyed.join(repeated, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left")
    once = met.where("first is null").select("conv_id", "turn", "role", "text", "copies", F.lit(False).alias("copy"))
    # equal rows are counted before they are shuffled; the first of them goes on alone
    many = (met.where("first is not null").groupBy("conv_id", "turn", "role", "text", "first")
            .agg(F.sum("copies").alias("copies"))
            .withColumn("is_first", F.struct(F.col("turn").isNotNull().alias("later"), early.alias("early")) == F.col("first"))
            .select("conv_id", "turn", "role", "text", F.explode(F.filter(F.array(
                F.struct(F.when(F.col("is_first"), 1).otherwise(0).cast("long").alias("copies"), F.lit(False).alias("copy")),
                F.struct((F.col("copies") - F.when(F.col("is_first"), 1).otherwise(0)).alias("copies"), F.lit(True).alias("copy"))),
                lambda x: x["copies"] > 0)).alias("x"))
            .select("conv_id", "turn", "role", "text", "x.copies", "x.copy"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(body == "", "blank").when(F.col("copy"), "duplicate")
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none"))
    faulty = once.unionByName(many).withColumn("fault", fault).drop("copy")
    marks = rows.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("long").alias("copies"), F.lit("none").alias("fault"))
    return faulty.unionByName(marks)


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each conversation, in the columns of ``RESULT``."""
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, done = None, []
        for batch in batches:
            for conv_id, *row, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if open_one is None or conv_id != open_one.conv_id:
                    if open_one is not None:
                        done.append(open_one.result())
                    open_one = Conversation(conv_id)
                if copies:
                    open_one.add(*row, fault, copies)
            if len(done) >= 1024:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
                done = []
        if open_one is not None:
            done.append(open_one.result())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate"]
    return (turns.select("conv_id", "turn", "role", "text", "copies", "fault").repartition("conv_id")
            .sortWithinPartitions(*order).mapInArrow(run, RESULT))


def repair(rows: DataFrame) -> DataFrame:
    """Damage, count faults and repair every conversation of (conv_id, turn, role, text)."""
    return repaired(turns_with_faults(damaged(rows.select("conv_id", "turn", "role", "text"))))
