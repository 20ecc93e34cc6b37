"""The pipeline's stages against what each must do to its own input."""

import re
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, encoding, quality
from quarrymill.llm.common import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, f in P.STAGES:
        out.append(staged(f(spark, out[-1], SF), "stage"))
    return out


def test_stages(kept):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]
    counts = [d.select("doc_id").distinct().count() for d in kept]
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    assert all(d.columns == kept[0].columns for d in kept[:5])
    assert all(d.where(F.length("text") != F.col("n_chars")).count() == 0 for d in kept[:5])


def test_run_equals_stages(spark, kept):
    own = P.run(spark, SF)
    key = lambda d: sorted(tuple(r) for r in d.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert key(own) == key(kept[5])


def test_clean_documents_stay(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = kept[0].join(labels.where("quality = 1"), "doc_id").where(F.size(F.split("text", r"\s+")) >= 60)
    stay = good.join(kept[1].select("doc_id"), "doc_id", "left_semi").count()
    assert stay >= 0.95 * good.count()


# --- each stage against brute force, on its own input -------------------------------------------------------------------

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
words = lambda t: [w for w in SPLIT.split(t or "") if w]


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def line_fails(line):
    n = len(words(line))
    if not n:
        return False
    symbols, bars = sum(c in quality.SYMBOLS for c in line), sum(c in "|»•" for c in line)
    if symbols > quality.SYMBOLS_A_WORD * n or bars >= quality.BARS and 5 * bars >= n:
        return True
    if re.search(quality.NAVIGATION, line) or any(x in line.lower() for x in quality.BOILERPLATE):
        return True
    return n >= quality.LONG_LINE and not any(c in line for c in ".,;:!?…。、")


def test_quality_stage(kept):
    want = {}
    for d, t in by_id(kept[0]).items():
        t = t or ""
        w, lines = words(t), t.split("\n")
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for x in three:
            seen[x] = seen.get(x, 0) + 1
        repeated = len({i + k for i, x in enumerate(three) if seen[x] > 1 for k in range(3)})
        good = [x for x in lines if not line_fails(x)]
        all_, left = sum(map(len, lines)), sum(map(len, good))
        if len(w) >= 50 and 100 * repeated <= 50 * len(w) and not all_ - left > quality.MAX_LOST * all_:
            want[d] = "\n".join(good)
    assert by_id(kept[1]) == want


def test_line_stage(kept):
    first, want = {}, {}
    texts = sorted(by_id(kept[1]).items())
    solid = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in texts}
    for d, _ in texts:
        for j in range(len(solid[d]) - 2):
            first.setdefault(tuple(x for _, x in solid[d][j : j + 3]), (d, j))
    for d, t in texts:
        gone = {solid[d][j + k][0] for j in range(len(solid[d]) - 2) if first[tuple(x for _, x in solid[d][j : j + 3])] != (d, j) for k in range(3)}
        want[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t
    assert by_id(kept[2]) == want


def test_near_stage(kept):
    sets, own = {}, {}
    for d, t in by_id(kept[2]).items():
        w = words((t or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        own[d] = d

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    before = by_id(kept[2])
    assert by_id(kept[3]) == {d: before[d] for d in sets if find(d) == d}


def test_decontamination_stage(spark, kept):
    def edits(item, text):
        row, at, t = np.zeros(len(text) + 1, int), np.arange(len(text) + 1), np.array(list(text) or [""])[: len(text)]
        for i, c in enumerate(item, 1):
            best = np.append(i, np.minimum(row[:-1] + (t != c), row[1:] + 1))
            row = np.minimum.accumulate(best - at) + at
        return int(row.min())

    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    assert all(len(x) >= decontaminate.Q for x in items)
    before = by_id(kept[3])
    bad = set()
    for d, t in before.items():
        t = decontaminate.normal(t)
        grams = {t[i : i + 4] for i in range(len(t) - 3)}
        for x in items:  # an item that is within reach shares most of its 4-grams
            own = [x[i : i + 4] for i in range(len(x) - 3)]
            e = decontaminate.budget(len(x))
            if sum(g in grams for g in own) >= len(own) - 4 * e and edits(x, t) <= e:
                bad.add(d)
                break
    assert by_id(kept[4]) == {d: t for d, t in before.items() if d not in bad}


def test_packing_stage(kept):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.tokenizer_path("byte_bpe_50k.json"))
    got, bins = {}, {}
    for r in sorted(kept[5].collect(), key=lambda r: r.offset):
        got.setdefault(r.doc_id, []).append(r)
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    before = by_id(kept[4])
    assert set(got) == set(before) and max(bins.values()) <= 1024
    for d, t in before.items():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(got[d], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, versions, columns with clashing names; and an empty table."""
    prose = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(9))
    rows = [(None, None), (None, prose), (1, prose), (1, prose), (2, None), (3, ""), (1, prose + " End.")]
    d = spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key string")
    want = {"quality rules": 4, "line dedup": 7, "near dedup": 5, "decontamination": 7}
    for name, f in P.STAGES[:-1]:
        assert f(spark, d, SF).columns == d.columns and f(spark, d, SF).count() == want[name], name
        assert f(spark, d.where("false"), SF).count() == 0
    packed = P.STAGES[-1][1](spark, d, SF)
    assert packed.where("piece = 0").count() == 7 and P.STAGES[-1][1](spark, d.where("false"), SF).count() == 0
