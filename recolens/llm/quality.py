"""Quality rules as a short-circuit cascade.

Every rule looks at one text and rejects it or not.  ``plan_cascade`` runs all
rules on a sample, measures each one's cost and selectivity, and orders them
by rejections per cost; ``apply_cascade`` then evaluates the rules in that
order over whole texts and stops at the first rejection.  The verdict does not
depend on the order, only the time does.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows give repeated results; an empty table gives an empty result (and
keeps the declared order of the rules).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import text_rows

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5
#: Bound of the sample that orders the rules; the rules themselves see all rows.
SAMPLE_DOCS = 500


class Text:
    """A text and the measures that rules share; each is computed once, when asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, _BLANKS)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return self.raw.split(b"\n")

    @cached_property
    def n_dup_lines(self) -> int:
        if len(set(self.lines)) == len(self.lines):
            return 0
        seen: set[bytes] = set()
        n = 0
        for line in self.lines:
            n += line in seen and bool(line.strip(_BLANKS))
            seen.add(line)
        return n

    @cached_property
    def codes(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.codes, WINDOW)


def repeated_words(codes: np.ndarray, window: int) -> int:
    """Words inside windows that occur twice or more.  Exact: window keys are
    positional numbers, recoded densely whenever 63 bits would not hold them."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    base = int(codes.max()) + 1
    key, bound = codes[:n], base
    for j in range(1, window):
        if bound * base >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
            bound = n
        key = key * base + codes[j:n + j]
        bound *= base
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(codes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def base_failed(t: Text) -> bool:
    return len(t.words) < 10 or 100 * t.n_repeat_words > 20 * len(t.words)


def _mean_length(t: Text) -> bool:
    """Mean word length outside 2 to 14 characters."""
    n = len(t.words)
    return n == 0 or not 2 * n <= t.word_chars <= 14 * n


def _symbols(t: Text) -> bool:
    """More than one symbol for every ten words."""
    return 10 * t.n_symbols > len(t.words)


def _dup_lines(t: Text) -> bool:
    """Of ten lines or more, over 30 % repeat an earlier one."""
    return len(t.lines) >= 10 and 10 * t.n_dup_lines > 3 * len(t.lines)


def _one_word(t: Text) -> bool:
    """One word makes up more than 30 % of a text of 20 words or more."""
    n = len(t.words)
    return n >= 20 and 10 * int(np.bincount(t.codes).max()) > 3 * n


def _letters(t: Text) -> bool:
    """Fewer than 40 % of the words hold a letter."""
    n = len(t.words)
    return 10 * sum(w.upper() != w.lower() or not w.isascii() for w in t.words) < 4 * n


def _stutter(t: Text) -> bool:
    """More than 20 % of the words repeat the word before."""
    return 5 * int((t.codes[1:] == t.codes[:-1]).sum()) > len(t.words)


def _braces(t: Text) -> bool:
    """Markup or code: a brace or angle bracket for every five words."""
    raw = t.raw
    return 5 * (len(raw) - len(raw.translate(None, b"{}<>"))) > len(t.words)


RULES = (Rule("mean_word_length", _mean_length), Rule("symbols", _symbols), Rule("dup_lines", _dup_lines),
         Rule("one_word", _one_word), Rule("letters", _letters), Rule("stutter", _stutter),
         Rule("braces", _braces))


def order_rules(texts: list[str], rules: tuple[Rule, ...]) -> list[str]:
    """Rule names by rejections per second of measured cost, highest first."""
    if not texts:
        return [r.name for r in rules]
    rate = {}
    for rule in rules:
        held = [Text(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(rule.rejects(t) for t in held)
        rate[rule.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return [r.name for r in sorted(rules, key=lambda r: -rate[r.name])]


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_docs: int = SAMPLE_DOCS,
                 sample_chars: int = 4_000_000) -> list[str]:
    """Order of the rules from a sample bounded in documents and characters:
    the rows of the lowest id hashes; only ids are ranked, texts are fetched for those."""
    rows = text_rows(docs)
    picked = (rows.where(F.length("text") <= sample_chars // sample_docs)
              .select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).orderBy("h").limit(sample_docs)
              .select("doc_id").distinct())
    picked = rows.where(F.length("text") <= sample_chars // sample_docs).join(F.broadcast(picked), "doc_id")
    picked = picked.select("text").limit(sample_docs)
    return order_rules([r.text for r in picked.collect()], rules)


def apply_cascade(docs: DataFrame, order: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, base verdict and cascade verdict of every document."""
    chosen = [next(r for r in rules if r.name == name) for name in order]
    types = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
             ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
             ("kept", pa.bool_())]
    schema = pa.schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                t = Text(text.as_py())
                failed = base_failed(t)
                kept = not failed and not any(rule.rejects(t) for rule in chosen)
                out.append((len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.record_batch([batch.column(0), *(pa.array(list(c), f.type) for c, f in
                                                      zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return text_rows(docs).mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, base_failed boolean, kept boolean")


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return apply_cascade(docs, plan_cascade(docs, rules), rules)
