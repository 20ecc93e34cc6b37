import hashlib

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import text as X


def value(spark, column, kind="string", **cells):
    d = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {kind}" for k in cells)) if cells else spark.range(1)
    return d.select(column.alias("v")).head()[0]


@pytest.mark.parametrize("name", ["  Ada   Lovelace ", "A\tB\n C", "\x1cX\x1f", " nbsp in it", "ÉTÉ", ""])
def test_entity_key_as_python(spark, name):
    assert value(spark, X.entity_key(F.col("n")), n=name) == " ".join(name.strip().lower().split())


def test_ids(spark):
    assert value(spark, X.cite_hex(X.chunk_id(F.lit("a.pdf"), F.lit(3)))) == hashlib.sha1(b"a.pdf#3").hexdigest()[:12]


@pytest.mark.parametrize("t,n", [("01", 1), ("7", 7), ("12.", 12), ("3)", 3), ("1234", None), ("a1", None), ("", None), (" 5 ", 5)])
def test_label_number(spark, t, n):
    assert value(spark, X.label_number(F.col("t")), t=t) == n


@pytest.mark.parametrize("p,s", [("A > B", ["A", "B"]), ("A>B", ["A", "B"]), ("(root)", []), (" > x > ", ["x"]), (None, [])])
def test_segments(spark, p, s):
    assert value(spark, X.segments(F.col("p")), p=p) == s


@pytest.mark.parametrize("t,d", [("3. Scope", 1), ("2.1 Terms", 2), ("1.2.3. Deep", 3), ("Scope", None), ("3.", None)])
def test_section_depth(spark, t, d):
    assert value(spark, X.section_depth(F.col("t")), t=t) == d


def test_stray_glyphs(spark):
    assert value(spark, X.drop_stray_glyphs(F.col("t")), t="Propostas 277 目 Localizar") == "Propostas 277 Localizar"
    assert value(spark, X.drop_stray_glyphs(F.col("t")), t="日本 語") == "日本 語"


def test_header_like(spark):
    cells = lambda *c: F.array(*[F.lit(x) for x in c])
    assert value(spark, X.header_like(cells("Field", "Field Description")))
    assert not value(spark, X.header_like(cells("1.1", "Introduction")))
    assert not value(spark, X.header_like(cells("Field", "")))
    assert not value(spark, X.header_like(cells("Identify from the clearing file", "x")))


def test_pairs():
    wide = "".join(chr(ord(a) << 8 | ord(b)) for a, b in zip("Hlowrd", "el ol!", strict=True))
    assert X.is_pair_decoded(wide)
    assert X.undo_pairs(wide) == "Hello world!".replace("o w", "o w") or len(X.undo_pairs(wide)) == 2 * len(wide)
    assert not X.is_pair_decoded("日本語の文章")
    assert X.undo_pairs("plain") == "plain"


def test_find_word():
    assert X.find_word("a01 01 x", "01") == 4
    assert X.find_word("01 01", "01", 0, {0}) == 3
    assert X.find_word("x", "y") == -1


@pytest.mark.parametrize("d,b", [(1.2, "high"), (0.85, "high"), (0.84999, "medium"), (0.75, "medium"), (0.65, "low"), (0.6499, None), (float("nan"), None)])
def test_bands(spark, d, b):
    assert value(spark, X.band_of(F.lit(d))) == b


def test_json_payload(spark):
    assert value(spark, X.json_payload(F.col("t")), t='<think>x</think>```json\n{"a":1}\n```') == '{"a":1}'
