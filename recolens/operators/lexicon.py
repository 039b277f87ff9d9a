"""Dictionary operators: token maps (J9) and token sets (J10), and the full
review-cleaning pipeline (T3, T4, T6-T9) built on them.

A dictionary that is proven small (row count checked against a bound) is
folded into the plan as literals: membership is an ``IN`` list, which the
optimizer turns into a hash-set lookup (``InSet``) inside the array
``transform`` / ``filter`` lambdas, so lookups stay in generated JVM code with
no shuffle at all.  A dictionary beyond the bound is applied by joining the
exploded tokens against it and re-assembling each text by token position.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolens.functions import text as T
from recolens.operators.joins import fits

INLINE_MAX_ENTRIES = 50_000


def _in(t: Column, keys) -> Column:
    return t.isin(list(keys)) if keys else F.lit(False)


def map_token(t: Column, mapping: Mapping[str, str], lower_key: bool = False) -> Column:
    """Replace one token by its dictionary value when the key is present."""
    if not mapping:
        return t
    key = F.lower(t) if lower_key else t
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(_in(key, mapping.keys()), F.try_element_at(lookup, key)).otherwise(t)


def map_tokens(tokens: Column, mapping: Mapping[str, str], lower_key: bool = False) -> Column:
    """J9 inline: element-wise dictionary replacement of a token array."""
    if not mapping:
        return tokens
    return F.transform(tokens, lambda t: map_token(t, mapping, lower_key))


def drop_tokens(tokens: Column, words: Iterable[str], lower_key: bool = False,
                min_len: int | None = None) -> Column:
    """J10 inline: remove tokens found in ``words`` (and, optionally, tokens
    with fewer than ``min_len`` characters)."""
    words = list(words)

    def keep(t):
        key = F.lower(t) if lower_key else t
        cond = ~_in(key, words) if words else F.lit(True)
        if min_len is not None:
            cond = cond & (F.length(t) >= min_len)
        return cond
    return F.filter(tokens, keep)


#: Up to so many keys are nested ``replace`` calls; more go through the automaton.
NESTED_MAX_KEYS = 64


def replace_in_order(text: str, keys: list[str], values: list[str], automaton) -> str:
    """``text.replace(key, value)`` for each key in order, touching only keys that occur.

    ``automaton`` finds (end, (place in ``keys``, length)).  The earliest key that occurs is
    replaced; a replacement can bring in new keys only where it touches the text, so
    those stretches alone are searched again, for later keys."""
    due = {i for _, (i, _) in automaton.iter(text)}
    heap = sorted(due)
    longest = max(map(len, keys))
    while heap:
        i = heappop(heap)
        key, value = keys[i], values[i]
        parts = text.split(key)
        if len(parts) == 1:
            continue                                  # an earlier replacement took it away
        text = value.join(parts)
        at = reach = 0
        for part in parts[:-1]:
            at += len(part)
            start, end = max(reach, at - longest), at + len(value) + longest
            for _, (j, _) in automaton.iter(text[start:end]):
                if j > i and j not in due:
                    due.add(j)
                    heappush(heap, j)
            at += len(value)
            reach = max(reach, at - longest)
    return text


def _automaton(keys: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, key in enumerate(keys):
        found.add_word(key, (i, len(key)))
    found.make_automaton()
    return found


#: Distinct runs whose result a task remembers, and the longest that it does.
RUNS_HELD, RUN_CHARS = 100_000, 64


def replacer(keys: list[str], values: list[str]):
    """text -> ``replace_in_order`` of it.  Values begin and end with a space, so if no key holds
    one, no match ever reaches over a space, old or new: the stretches between spaces are
    replaced one by one, and results of short ones are remembered (``RUNS_HELD`` of them)."""
    automaton = _automaton(keys)

    def whole(text: str) -> str:
        return replace_in_order(text, keys, values, automaton)

    if any(" " in k for k in keys) or not all(v[:1] == v[-1:] == " " for v in values):
        return whole
    inside = [sorted({j for _, (j, _) in automaton.iter(v) if j > i}) for i, v in enumerate(values)]

    def stretch(run: str) -> str:
        """As ``replace_in_order``: what a replacement brings in lies inside its value."""
        due = {i for _, (i, _) in automaton.iter(run)}
        if not due:
            return run
        heap = sorted(due)
        while heap:
            i = heappop(heap)
            if keys[i] in run:
                run = run.replace(keys[i], values[i])
                for j in inside[i]:
                    if j not in due:
                        due.add(j)
                        heappush(heap, j)
        return run

    held = lru_cache(maxsize=RUNS_HELD)(stretch)
    return lambda text: " ".join([held(run) if len(run) <= RUN_CHARS else stretch(run) for run in text.split(" ")])


def replace_by_automaton(c: Column, mapping: Mapping[str, str]) -> Column:
    """T3 for dictionaries of any number of keys: the result of replacing them one after
    another, in batches of texts; a worker builds the automaton once a task."""
    keys = [k for k in mapping if k]
    values = [f" {mapping[k]} " for k in keys]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        replaced = replacer(keys, values)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else replaced(t))
    return F.pandas_udf(run, "string")(c)


def replace_substrings(c: Column, mapping: Mapping[str, str], longest_first: bool = False) -> Column:
    """Substring replacement ``emo -> ' meaning '`` in dictionary order
    (the reference's order); ``longest_first`` applies longer keys first, for
    dictionaries whose keys contain one another.  Empty keys are left out."""
    items = [(k, v) for k, v in mapping.items() if k]
    if longest_first:
        items.sort(key=lambda kv: -len(kv[0]))
    if len(items) > NESTED_MAX_KEYS:
        return replace_by_automaton(c, dict(items))
    out = c
    for k, v in items:
        out = F.replace(out, F.lit(k), F.lit(f" {v} "))
    return out


def collect_map(df: DataFrame, key: str = "key", value: str = "value",
                max_entries: int = INLINE_MAX_ENTRIES) -> dict[str, str] | None:
    """Dictionary frame -> dict, only when its checked size is <= max_entries."""
    if not fits(df, max_entries):
        return None
    return {r[0]: r[1] for r in df.select(key, value).collect()}


def collect_set(df: DataFrame, key: str = "key",
                max_entries: int = INLINE_MAX_ENTRIES) -> list[str] | None:
    if not fits(df, max_entries):
        return None
    return sorted({r[0] for r in df.select(key).collect()})


# ------------------------------------------------------ compound stopwords

def _esc(ch: str) -> str:
    return ch if (ch.isalnum() or ch == " ") else "\\" + ch


def compound_regex(words: Iterable[str], joiner: str = "_") -> str | None:
    """Q13 option: multi-token dictionary entries (``a_lô``) as one regex that
    removes the token sequence ``a lô``.  The entries form a character trie,
    so at each character at most one branch can continue (no backtracking
    over alternatives); optional continuations are greedy, so the longest
    entry wins; matches are anchored on token boundaries and scan left to
    right."""
    trie: dict = {}
    for w in words:
        if joiner not in w:
            continue
        node = trie
        for ch in w.replace(joiner, " "):
            node = node.setdefault(ch, {})
        node[""] = True
    if not trie:
        return None

    def emit(node) -> str:
        branches = [_esc(ch) + emit(child) for ch, child in sorted(node.items()) if ch != ""]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{body})?" if "" in node else body

    return "(?<=^| )" + emit(trie) + "(?= |$)"


def drop_compounds(c: Column, words: Iterable[str], joiner: str = "_") -> Column:
    """Remove every dictionary compound (``joiner``-joined tokens) from a
    single-spaced, lower-cased text."""
    rx = compound_regex(words, joiner)
    return c if rx is None else T.collapse_ws(F.regexp_replace(c, rx, " "))


# ---------------------------------------------------------------- join forms

def _explode_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(tokens_col).alias("__pos", "__tok"))


def _reassemble(df: DataFrame, base: DataFrame, id_col: str, out_col: str) -> DataFrame:
    """Group exploded tokens back into one ordered array per text."""
    arr = (df.groupBy(id_col)
           .agg(F.array_sort(F.collect_list(F.struct("__pos", "__tok"))).alias("__a"))
           .select(id_col, F.transform("__a", lambda s: s["__tok"]).alias(out_col)))
    return (base.drop(out_col).join(arr, id_col, "left")
            .withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast("array<string>"))))


def map_tokens_join(df: DataFrame, id_col: str, tokens_col: str, dictionary: DataFrame,
                    key: str = "key", value: str = "value") -> DataFrame:
    """J9 join form: tokens left-joined to a dictionary of any size."""
    d = dictionary.select(F.col(key).alias("__tok"), F.col(value).alias("__val"))
    ex = (_explode_tokens(df, id_col, tokens_col).join(d, "__tok", "left")
          .withColumn("__tok", F.coalesce("__val", "__tok")))
    return _reassemble(ex, df, id_col, tokens_col)


def drop_tokens_join(df: DataFrame, id_col: str, tokens_col: str, words: DataFrame,
                     key: str = "key") -> DataFrame:
    """J10 join form: anti-join of tokens against a word table of any size."""
    w = words.select(F.col(key).alias("__tok")).distinct()
    ex = _explode_tokens(df, id_col, tokens_col).join(w, "__tok", "left_anti")
    return _reassemble(ex, df, id_col, tokens_col)


# ------------------------------------------------------- the review pipeline

class Lexicons:
    """The five dictionaries of the review pipeline, each optional.

    ``emoji`` substring map, ``teencode`` token map, ``wrong`` token set,
    ``en_vi`` token map (looked up lower-cased), ``stopwords`` token set
    (looked up lower-cased).  Absent dictionaries are skipped, as an absent
    file gives an empty dictionary in the reference.
    """

    def __init__(self, emoji=None, teencode=None, wrong=None, en_vi=None, stopwords=None,
                 stop_compounds: bool = False):
        self.emoji = dict(emoji or {})
        self.teencode = dict(teencode or {})
        self.wrong = list(wrong or [])
        self.en_vi = dict(en_vi or {})
        self.stopwords = list(stopwords or [])
        # Q13 option: also remove '_'-joined stopword compounds as token runs
        self.stop_compounds = stop_compounds


def preprocess(c, lex: Lexicons | None = None, null_token: str = "") -> Column:
    """Lower -> NFC -> emoji -> teencode -> clean -> wrong words ->
    English->Vietnamese -> stopwords (+ tokens of length <= 1 dropped)."""
    lex = lex or Lexicons()
    x = T.lower_nfc(T.as_text(c, null_token))
    x = replace_substrings(x, lex.emoji)
    if lex.teencode:
        x = T.join_tokens(map_tokens(T.split_tokens(x), lex.teencode))
    x = T.clean_text_basic(x)
    toks = T.clean_tokens(x)
    if lex.wrong:
        toks = drop_tokens(toks, lex.wrong)
    if lex.en_vi:
        # values may hold several words: re-split after mapping (Q14)
        toks = T.split_tokens(T.join_tokens(map_tokens(toks, lex.en_vi, lower_key=True)))
    if lex.stop_compounds:
        toks = T.split_tokens(drop_compounds(F.lower(T.join_tokens(toks)), lex.stopwords))
    toks = drop_tokens(toks, lex.stopwords, lower_key=True, min_len=2)
    return T.join_tokens(toks)
