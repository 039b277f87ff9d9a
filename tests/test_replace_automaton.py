"""Substring replacement by automaton against the plain loop."""

import random

from pyspark.sql import functions as F

from recolens.operators import lexicon


def loop(text, mapping):
    for k, v in mapping.items():
        text = text.replace(k, f" {v} ")
    return text


def dictionary(rng, n, letters, longest):
    out = {}
    while len(out) < n:
        key = "".join(rng.choice(letters) for _ in range(rng.randrange(1, longest)))
        out[key] = "".join(rng.choice(letters) for _ in range(rng.randrange(0, longest)))
    return out


def test_order_nested_keys_and_new_matches():
    rng = random.Random(8)
    for n, letters, longest in ((5, "ab", 4), (20, "ab ", 5), (40, "abc ", 5), (60, ":)(-D ", 4)):
        for _ in range(60):
            mapping = dictionary(rng, n, letters, longest)
            keys = list(mapping)
            found = lexicon._automaton(keys)
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
            if len(loop(text, mapping)) < 200_000:
                assert lexicon.replace_in_order(text, keys, [f" {v} " for v in mapping.values()], found) == loop(text, mapping)


def test_ten_thousand_keys(spark):
    rng = random.Random(9)
    mapping = dictionary(rng, 10_000, "abcdefgh:)", 7)
    mapping = {k: v[:2] + "!" for k, v in mapping.items() if len(k) > 2}
    texts = ["".join(rng.choice("abcdefgh:) ") for _ in range(80)) for _ in range(40)] + [None, "", "zz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.out for r in frame.select("i", lexicon.replace_substrings(F.col("t"), mapping).alias("out")).collect()}
    assert got == {i: None if t is None else loop(t, mapping) for i, t in enumerate(texts)}


def test_both_forms_agree(spark):
    rng = random.Random(10)
    mapping = dictionary(rng, lexicon.NESTED_MAX_KEYS, "abc:)", 4) | {"": "never"}
    frame = spark.createDataFrame([(":)abcab(" * 4,), ("",), (None,)], "t string")
    got = frame.select(lexicon.replace_substrings(F.col("t"), mapping).alias("a"),
                       lexicon.replace_by_automaton(F.col("t"), mapping).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_stretches_between_spaces_are_replaced_once(monkeypatch):
    """Whole texts were searched again around every replacement."""
    rng = random.Random(11)
    for letters, longest in (("ab", 4), ("abc\n", 5), ("ab ", 4)):
        for _ in range(80):
            mapping = dictionary(rng, 8, letters, longest)
            keys, values = list(mapping), [f" {v} " for v in mapping.values()]
            text = "".join(rng.choice(letters + "  ") for _ in range(rng.randrange(0, 70)))
            if len(loop(text, mapping)) < 200_000:
                assert lexicon.replacer(keys, values)(text) == loop(text, mapping)
    searched = []
    found = lexicon._automaton(["an", "b"])

    class Watched:
        def iter(self, text):
            searched.append(text)
            return found.iter(text)
    monkeypatch.setattr(lexicon, "_automaton", lambda keys: Watched())
    replaced = lexicon.replacer(["an", "b"], [" n ", "  "])
    searched.clear()
    long = "banana" * 20
    assert replaced(f"banana  ban banana {long}") == loop(f"banana  ban banana {long}", {"an": "n", "b": ""})
    assert searched == ["banana", "", "ban", long]
