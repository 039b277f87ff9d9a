"""A folder of CSV files in different encodings (S1) and eligibility at any threshold."""

import os
import random
import unicodedata

import pytest

from recolens.operators import overlap
from recolens.sources import files

TEXTS = ["Khách sạn rất đẹp, phòng sạch sẽ", "Nhân viên thân thiện – sẽ quay lại!", 'ngon "lắm" € ₫', "plain", "Đà Nẵng\nngày mai"]


def cp1258(text):
    """Vietnamese as Windows writes it: vowels composed, tones as combining marks."""
    out = ""
    for ch in text:
        try:
            ch.encode("cp1258")
            out += ch
        except UnicodeEncodeError:
            parts = unicodedata.normalize("NFD", ch)
            tone = [m for m in parts if m in "̣̀́̃̉"]
            out += unicodedata.normalize("NFC", "".join(m for m in parts if m not in tone)) + "".join(tone)
    return out.encode("cp1258")


def write(folder, name, first, encode, bom=b""):
    rows = "id,text\n" + "".join('%d,"%s"\n' % (first + i, t.replace('"', '""')) for i, t in enumerate(TEXTS))
    with open(os.path.join(folder, name), "wb") as f:
        f.write(bom + encode(rows))


def test_each_file_has_its_own_encoding(spark, tmp_dir):
    write(tmp_dir, "a.csv", 0, lambda t: t.encode(), b"\xef\xbb\xbf")
    write(tmp_dir, "b.csv", 10, lambda t: t.encode())
    write(tmp_dir, "c.csv", 20, cp1258)
    with open(os.path.join(tmp_dir, "d.csv"), "wb") as f:
        f.write(b"id,text\n30,caf\xe9 \x8a\n31,\n")             # a byte that cp1258 does not define
    df = files.read_csv_safely(spark, tmp_dir)
    assert df.columns == ["id", "text"]
    got = {int(r.id): r.text for r in df.collect()}
    want = {first + i: t for first in (0, 10, 20) for i, t in enumerate(TEXTS)}
    assert got == want | {30: "caf\xe9 \x8a", 31: None}
    kinds = {os.path.basename(r.file): r.encoding for r in files.file_encodings(spark, tmp_dir).collect()}
    assert kinds == {"a.csv": "UTF-8", "b.csv": "UTF-8", "c.csv": "cp1258", "d.csv": "ISO-8859-1"}


@pytest.mark.parametrize("encode,name", [(cp1258, "cp1258"), (lambda t: t.encode(), "UTF-8")])
def test_single_files_and_headers(spark, tmp_dir, encode, name):
    path = os.path.join(tmp_dir, "one.csv")
    with open(path, "wb") as f:
        f.write(encode("Tên,Điểm số\nLan,8\n"))
    df = files.read_csv_safely(spark, path)
    assert df.columns == ["Tên", "Điểm số"] and tuple(df.first()) == ("Lan", "8")
    typed = files.read_csv_safely(spark, path, inferSchema=True)
    assert dict(typed.dtypes)["Điểm số"] == "int"


@pytest.mark.parametrize("min_rel", [0, 1, 2, 3, 5])
def test_eligibility_at_any_threshold(spark, min_rel):
    rng = random.Random(min_rel)
    pairs = {(rng.randrange(60), rng.randrange(70)) for _ in range(130)} | {(99, i) for i in range(5)}
    items = {}
    for u, i in pairs:
        items.setdefault(i, set())
        items[i] |= {j for v, j in pairs if v == u and j != i}
    frame = spark.createDataFrame(sorted(pairs), "user_id long, item_id long")
    got = {r.item_id for r in overlap.eligible_items(frame, min_rel).collect()}
    assert got == {i for i, others in items.items() if len(others) >= min_rel}
