"""Whitening, marked words and turn repair against brute force and edge cases."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from recolens.llm import marked_words, turn_repair, whitening

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# --------------------------------------------------------------- whitening


def whitened_by_numpy(vectors):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, values[::-1], (centred @ axes[:, ::-1]) / np.sqrt(np.maximum(values[::-1], 1e-300))


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.linspace(3, 0.1, 12)
    data = [(i, [float(v) for v in row], 7, "x") for i, row in enumerate(mixed)]
    bad = [(900, None, 1, ""), (901, [None] + [1.0] * 11, 1, ""), (902, [float("nan")] * 12, 1, ""),
           (903, [float("inf")] + [0.0] * 11, 1, ""), (904, [], 1, ""), (905, [1.0, 2.0], 1, ""), (906, [1e300] * 12, 1, "")]
    more = [(None, data[0][1], 1, ""), data[5]]
    frame = spark.createDataFrame(data + bad + more, "vec_id long, embedding array<double>, n int, component string").repartition(5)
    got = whitening.whiten(frame).collect()
    used = data + more
    n, sums, x, values, white = whitened_by_numpy([v for _, v, _, _ in used])
    assert len(got) == 8 * len(used) and {r.n for r in got} == {n}
    wanted = {}
    for k, row in enumerate(used):
        wanted.setdefault(row[0], []).append((sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums)), white[k]))
    sign = {}
    for r in got:
        deviation, w = wanted[r.vec_id][0]
        assert int(r.deviation) == deviation
        assert abs(r.explained - values[r.component - 1] / values.sum()) <= 1e-9
        want = w[r.component - 1]
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 and r.identity_error <= 1e-9
    assert {r.vec_id for r in got if r.vec_id is None or r.vec_id >= 900} == {None}


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], schema)
    rows = whitening.whiten(line).collect()
    assert {r.component for r in rows} == {1} and abs(rows[0].explained - 1) < 1e-12
    assert whitening.whiten(spark.createDataFrame([(i, None) for i in range(3)], "vec_id int, embedding array<double>")).count() == 0


def test_exact_deviations_of_large_numbers():
    rng = random.Random(3)
    for size, n in ((1 << 20, 1000), (1 << 45, 10 ** 6), (1 << 61, 7)):
        whole = np.array([[rng.randrange(-size, size) for _ in range(4)] for _ in range(20)], dtype=np.int64)
        sums = [rng.randrange(-size, size) * n + 3 for _ in range(4)]
        got = whitening.deviations(whole, n, sums).to_pylist()
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in whole]
        assert [None if w >= 10 ** 38 else w for w in want] == got


@pytest.mark.parametrize("size,rank", [(1, 1), (2, 2), (7, 7), (16, 5), (65, 65)])
def test_cholesky_and_jacobi_match_eigh(size, rank):
    rng = np.random.default_rng(size)
    b = rng.normal(size=(size, rank)) * np.logspace(0, -2, rank)
    a = b @ b.T
    low, order = whitening.pivoted_cholesky(a)
    assert low.shape[1] == rank and np.allclose(low @ low.T, a[order][:, order], atol=1e-12 * a.max())
    values, axes = whitening.components(a, size)
    want = np.linalg.eigvalsh(a)[::-1][:rank]
    assert np.allclose(values, want, rtol=1e-7) and np.allclose(axes.T @ axes, np.eye(rank), atol=1e-7)
    assert np.allclose(axes * values @ axes.T, a, atol=1e-10 * a.max())


# ------------------------------------------------------------ marked words


def library(text):
    sp = marked_words.processor(MODEL)
    ids = sp.encode(text or "", num_threads=1)
    return ids, sp.decode(ids)


def hostile(rng, n):
    parts = ["ab", " ", "  ", "   ", "\n", "▁", "▁▁", "é", "漢字", "🙂", "\t", "\0", " the", "The", "123", "<s>", "</s>", "<0x0A>",
             "　", " ", "é", "‍", "’", ".", "word", "internationalisation"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_marked_words_equal_the_library(spark):
    rng = random.Random(11)
    texts = [None, "", " ", "  ", "▁", "a", " a", "a ", "a  b", *(hostile(rng, rng.randrange(1, 60)) for _ in range(300)),
             hostile(rng, 20_000), "word " * 30_000, "x" * 20_000, "漢" * 3000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "a b a", "", 2), (9, texts[9], "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, ids int").repartition(3)
    for chars, words in ((1, 1), (500, 40), (1, 1 << 19), (marked_words.BLOCK_CHARS, marked_words.TABLE_WORDS)):
        encoded = marked_words.encode(docs, MODEL, chars, words)
        got = {r.doc_id: r for r in encoded.collect()}
        assert len(got) == len(rows) - 1 and encoded.count() == len(rows)
        for i, t in [*enumerate(texts), (None, "a b a")]:
            ids = np.frombuffer(got[i].ids, "<u4").tolist()
            assert ids == library(t)[0] and got[i].n_tokens == len(ids), t
    back = {r.doc_id: r.decoded for r in marked_words.decode(marked_words.encode(docs, MODEL), MODEL).collect()}
    assert all(back[i] == library(t)[1] for i, t in enumerate(texts))
    for r in marked_words.digests(docs, MODEL).collect():
        ids, text = library(texts[r.doc_id] if r.doc_id is not None else "a b a")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_marked_words_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert marked_words.digests(empty, MODEL).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert marked_words.decode(none, MODEL).first().decoded == ""


# ------------------------------------------------------------- turn repair


def brute(turns):
    """Least (cost, audit) by a plain recursion over turns and grammar states, and the repair."""
    n = len(turns)

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == n and state in ("", "a") else []
        if i < n:
            kept, _, _ = turns[i]
            cost, audit = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit))
            if kept != "-":
                late = 5 if kept.isupper() else 0
                goal = "a" if state == "u" else "u"
                if kept.lower() == goal or (kept.lower() == "s" and state == ""):
                    cost, audit = best(i + 1, kept.lower(), 0)
                    ways.append((cost + late, "K" + audit))
                if kept.lower() != goal:
                    cost, audit = best(i + 1, goal, 0)
                    ways.append((cost + late + 1, "R" + audit))
        if inserted < 2:
            cost, audit = best(i, "a" if state == "u" else "u", inserted + 1)
            ways.append((cost + 5, "I" + audit))
        return min(ways) if ways else (10 ** 9, "")

    cost, audit = best(0, "", 0)
    out, i, state = [], 0, ""
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = {"u": "assistant"}.get(state, "user"), ""
        if edit in "KR":
            kept, own, text = turns[i]
            i += 1
            role = own if edit == "K" else role
        state = kept.lower() if edit == "K" else role[0]
        out.append(f"{role}:{text}")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def expected(rows):
    one = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = {}
    for conv, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        counts, seen, turns = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for turn, role, text in out:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kept = role[:1] if role[:1] in ("s", "u", "a") else "o"
            turns.append(("-" if fault in ("blank", "duplicate") else kept.upper() if fault else kept, role, text))
        numbers = [t for t, _, _ in out if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        result[conv] = (gaps, *counts.values(), illegal, *brute(turns))
    return result


def conversation(rng, conv, n):
    roles = ["user", "assistant"]
    out = [(conv, 0, "system", "Be brief.")] if rng.random() < 0.3 else []
    for i in range(n):
        role = roles[i % 2] if rng.random() < 0.85 else rng.choice(["user", "assistant", "system", "tool", "", None, "Ada"])
        text = rng.choice(["Yes.", "No!", "Why?  \n", "cut of", "", " \t", None, "é.", f"turn {rng.randrange(6)}.", "a, b"])
        out.append((conv, rng.choice([i + 1, i + 1, i + 1, i + 3, None, i]), role, text))
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(21)
    rows = [r for conv in range(120) for r in conversation(rng, conv, rng.randrange(0, 14))]
    rows += [r for conv in range(200, 206) for r in conversation(rng, conv, rng.randrange(60, 150))]
    rows += [(300, 1, "user", "Hi.")] * 200 + [(301, i, "user", "Hm?") for i in range(90)]
    rows += [(302, i, "user", f"Hm {i}?") for i in range(90)]
    rows += [(None, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(9)] + rows[:5]
    return rows


@pytest.mark.parametrize("window", [1, 3, 24])
def test_repair_matches_recursion(spark, conversations, window):
    rows = conversations if window == 24 else conversations[:300]
    # the window is a module constant; tasks see it through the closure of a patched copy
    frame = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)],
                                  "conv_id long, turn long, role string, text string, copies int, fault string").repartition(4)
    want = expected(rows)
    if window == 24:
        got = {r[0]: tuple(r[1:]) for r in turn_repair.repair(frame).collect()}
        assert got == want
        return
    turns = turn_repair.turns_with_faults(turn_repair.damaged(frame.select("conv_id", "turn", "role", "text"))).collect()
    old, turn_repair.WINDOW = turn_repair.WINDOW, window
    try:
        got = {}
        order = lambda r: (r.turn is not None, r.turn or 0, r.role.encode(), r.text.encode(), r.fault == "duplicate")
        for conv in want:
            one = turn_repair.Conversation(conv)
            for r in sorted((r for r in turns if r.conv_id == conv), key=order):
                if r.copies:
                    one.add(r.turn, r.role, r.text, r.fault, r.copies)
            got[conv] = one.result()[1:]
        assert got == want
    finally:
        turn_repair.WINDOW = old


def test_alignments_equal_recursion_on_all_short_patterns():
    import itertools

    for n in range(5):
        for pattern in itertools.product("suaoSUA-", repeat=n):
            (_, cost, audit), = turn_repair.alignments.__wrapped__("".join(pattern), "", True)
            assert (cost, audit) == brute(tuple((c, "r", "") for c in pattern))[:2], pattern


def test_band_holds_every_cheapest_alignment():
    rng = random.Random(2)
    for _ in range(300):
        turns = "".join(rng.choice("uauasoUA-") for _ in range(rng.randrange(1, 16)))
        goal = turn_repair.target("", rng.random() < 0.3 and "s" in turns, rng.randrange(0, 18))
        wide = turn_repair.aligned(turns, goal, True, 500)
        if wide is not None:
            assert turn_repair.aligned(turns, goal, True, wide[0]) == wide
            assert turn_repair.aligned(turns, goal, True, wide[0] - 1) is None


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turn_repair.repair(spark.createDataFrame([], schema)).count() == 0
    dropped = next(t for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = turn_repair.repair(spark.createDataFrame([(5, dropped, "user", "Hi.")], schema)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
