"""Each operator against brute force on a small table with odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import charlm, components, cover, decontaminate, encoding, fingerprints, langid, lines, neardup, packing, quality, spans, substrings, tokens, toxicity
from quarrymill.llm.common import staged, texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, starts string, quality string, data string"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


def make(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", "r", "x", "q", "d") for i, t in pairs], SCHEMA)


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    prose = lambda n: "\n".join(say(12).capitalize() + "." for _ in range(n))
    out = {i: prose(r.randint(1, 9)) for i in range(40)}
    passage = say(70)
    hot = prose(4)
    for i in range(40, 60):
        out[i] = hot  # exact copies
    for i in range(60, 80):  # near copies
        w = prose(1).split() + hot.split()
        w[r.randrange(len(w))] = "edited"
        out[i] = " ".join(w)
    for i in range(80, 90):
        out[i] = say(r.randint(0, 30)) + "\n" + passage + "\n" + say(r.randint(0, 30))
    out |= {90: "", 91: None, 92: " \t\n ", 93: "a", 94: "aaaa " * 400, 95: "x" * 5000, 96: (hot + "\n") * 3, 97: "naïve café – 日本語 ½ İstanbul 😀 " * 9, 98: "one\ntwo\none\ntwo\none\ntwo", 99: prose(900)}
    return list(out.items())


PAIRS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return staged(make(spark, PAIRS), "docs")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column and repeated rows."""
    d = make(spark, [(None, None), (None, "a text"), (1, "same"), (1, "same"), (2, None)])
    return staged(d.unionByName(d.where("doc_id = 1").withColumn("text", F.lit("other"))), "odd")


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).where("false")


def rows(df, n):
    return {r[0]: tuple(r[1 : n + 1]) for r in df.collect()}


@pytest.mark.parametrize("cover_", ["content", "difference"])
def test_bytes(docs, cover_):
    seen, want = set(), {}
    for d, t in PAIRS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    d = texts(docs)
    got = spans.removed(d, substrings.repeated_bytes(docs, cover=cover_), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", substrings.without)
    assert rows(got, 4) == want


@pytest.mark.parametrize("batches", [1, 3])
def test_words(docs, batches):
    first, want = {}, {}
    for d, t in PAIRS:
        w = words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in PAIRS:
        w = words(t)
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    got = spans.removed(texts(docs), fingerprints.repeated_words(docs, batches=batches), "n_words long, n_removed long, kept_sha256 string", fingerprints.without)
    assert rows(got, 3) == want


def test_words_of_a_bucket_dealt_by_span(spark):
    """Later batches copy passages around a text that an earlier batch's task met amid different texts; theirs meet it once each."""
    r = random.Random(3)
    some = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    table, later = [], [[], []]
    for _ in range(20):
        common = some(44)
        own = [some(60) + common + some(60) for _ in range(8)]
        table += [" ".join(w) for w in own]
        for q in (0, 1):
            later[q].append(" ".join(some(50) + own[3 + q][54:110] + some(40)))
    table = list(enumerate(table)) + [(1000 * (q + 1) + i, t) for q in (0, 1) for i, t in enumerate(later[q] + [" ".join(some(70)) for _ in range(140)])]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(1)
    got = rows(ALL["words"](spark, docs), 2)
    assert got == {d: (len(words(t)), 56 if d >= 1000 and d % 1000 < 20 else 0) for d, t in table}


def test_index_over_sessions(spark, docs, tmp_path):
    """Three batches in two sessions give what one batch gives; old runs are not dealt again, and levels are merged."""
    d = texts(docs)
    path, merged = str(tmp_path / "index"), {}
    for k, session in enumerate((spark, spark, spark.newSession())):
        if k == 2:
            for r in fingerprints.Index(spark, path).about["runs"]:
                spark.sql(f"DROP TABLE IF EXISTS {r['folder']}")  # the session knows only the folder
        index = fingerprints.Index(session, path)
        own = session.read.schema(docs.schema).parquet(*docs.inputFiles())
        own = texts(own)
        batch = own.where(f"coalesce(doc_id, {spans.NO_ID}) >= {[0, 45, 85][k]} AND coalesce(doc_id, {spans.NO_ID}) < {[45, 85, 1 << 62][k]}")
        for r in index.add(batch, own).collect():
            merged.setdefault(r["doc_id"], []).append(r["data"])
    want = {r[0]: r[1] for r in fingerprints.repeated_words(docs, batches=1).collect()}
    plain = lambda x: {k: spans.merge_pairs(spans.pairs(v), 1 << 40).tolist() for k, v in x.items()}
    assert plain(merged) == plain(want)
    runs = fingerprints.Index(spark, path).about["runs"]
    assert sorted(r["level"] for r in runs) == [0, 1]
    for r in runs:
        for row in index.table(r["folder"]).where(f"kind = {spans.INDEX} AND length(data) > 0").collect():
            bucket, span = spans.unpack_columns(row["data"])[:2]
            order = np.lexsort((span, bucket))
            assert (bucket[order] == bucket).all() and (span[order] == span).all()
    plan = index._joined(runs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def gone_bytes(texts_):
    """Brute force over (doc, text) in order: the removed positions of each document."""
    seen, out = set(), {}
    for d, t in texts_:
        b = t.encode()
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = hash(b[i : i + 100])
            if w in seen:
                cut[i : i + 100] = True
            seen.add(w)
        out[d] = cut
    return out


@pytest.mark.parametrize("cover_", ["content", "difference"])
def test_long_texts_and_texts_without_words(spark, cover_):
    """A text beyond the cut of 524,288 symbols that repeats itself and others, scripts without spaces, very long words."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 12)))
    long = " ".join(word() for _ in range(170_000))
    cjk = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(600))
    solid = "".join(r.choice("abcdefgh") for _ in range(3000))
    mixed = " ".join("".join(r.choice("xyz") for _ in range(r.choice([3, 60]))) for _ in range(60))
    found = [(0, long + long[300_000:300_700]), (1, long[524_200:524_500] + "|" + cjk), (2, "z" + cjk[50:400] + solid[:1000]), (3, solid[37:1500] + " " + mixed), (4, "a " + mixed[3:] + long[-150:])]
    d = make(spark, found).repartition(3)
    got = {r[0]: spans.merge_pairs(spans.pairs(r[1]), 1 << 40) for r in substrings.repeated_bytes(d, cover=cover_).collect()}
    assert len(found[0][1]) > 1_000_000
    for doc, cut in gone_bytes(found).items():
        mine = np.zeros(len(cut), bool)
        for a, z in got.get(doc, []):
            mine[a:z] = True
        assert (mine == cut).all(), doc
    assert all(cut.any() for cut in gone_bytes(found).values())


def test_difference_covers():
    for v, d in cover.SETS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
        assert all(any(cover.sampled(np.array([i + x, j + x]), v).all() for x in range(v)) for i in range(v) for j in range(v))
    assert cover.period_of(100) == 73 and cover.period_of(12) == 7 and cover.period_of(3) == 0


def test_two_hashes_of_a_window():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    h[150_000:150_200] = h[100:300]
    a, b = spans.rolled(h, np.array([100, 101]), 100), spans.rolled(h, np.array([150_000, 150_002]), 100)
    assert a[0] == b[0] and a[1] != b[1]


def range_sizes(spark, docs, hashed, length, gram, parts, within):
    """Bytes of the runs that each range gets."""
    rows = spans.runs_of(texts(make(spark, docs)), hashed, length, gram, parts, within)
    return [r[0] for r in rows.where(f"kind = {spans.RUNS}").groupBy("p").agg(F.sum(F.length("data"))).select("sum(length(data))").collect()]


def test_byte_anchors_are_dealt_evenly(spark):
    r = random.Random(8)
    docs = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=4000))) for i in range(100)]
    sizes = range_sizes(spark, docs, substrings.hashed_bytes, substrings.LENGTH, substrings.GRAM, 16, True)
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


def test_word_anchors_are_dealt_evenly(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(2000)]
    docs = [(i, " ".join(r.choices(vocabulary, k=800))) for i in range(100)]
    sizes = range_sizes(spark, docs, fingerprints.hashed_words, fingerprints.LENGTH, fingerprints.GRAM, 16, False)
    assert len(sizes) == 16 and max(sizes) < 1.5 * sum(sizes) / 16


def test_index_of_other_ranges_is_refused(spark, tmp_path):
    fingerprints.Index(spark, str(tmp_path))._save([])
    assert fingerprints.Index(spark, str(tmp_path)).about["version"] == 1
    old = {k: v for k, v in fingerprints.Index(spark, str(tmp_path)).about.items() if k != "layout"}
    (tmp_path / "manifest-0000000002.json").write_text(json.dumps(old | {"version": 2}))
    with pytest.raises(AssertionError, match="other ranges"):
        fingerprints.Index(spark, str(tmp_path))


def test_other_runs_give_the_same(docs):
    """Other tasks and longer anchors give the same bytes."""
    before = {r[0]: sorted(map(tuple, spans.merge_pairs(spans.pairs(r[1]), 10**9).tolist())) for r in substrings.repeated_bytes(docs).collect()}
    other = {r[0]: sorted(map(tuple, spans.merge_pairs(spans.pairs(r[1]), 10**9).tolist())) for r in substrings.repeated_bytes(docs.repartition(7), gram=50).collect()}
    assert before == other


def test_near(docs):
    sets, want = {}, {}
    for d, t in PAIRS:
        w = words((t or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    own = {d: d for d in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                own[y] = x
    for d in sets:
        want[d] = (len(sets[d]), find(d), find(d) == d)
    assert rows(neardup.near_duplicates(docs, 85), 3) == want


def test_rows_of():
    assert neardup.rows_of(0.85) == 4 and neardup.rows_of(0.8) == 3


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(e.limit(0)).count() == 0


def test_lines(docs):
    first, want = {}, {}
    solid = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for d, t in PAIRS}
    for d, s in solid.items():
        for j in range(len(s) - 2):
            first.setdefault(tuple(x for _, x in s[j : j + 3]), (d, j))
    for d, t in PAIRS:
        s, gone = solid[d], set()
        for j in range(len(s) - 2):
            if first[tuple(x for _, x in s[j : j + 3])] != (d, j):
                gone |= {j, j + 1, j + 2}
        dead = {s[j][0] for j in gone}
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in dead)
        want[d] = (len((t or "").split("\n")), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {r.row.doc_id: (r.lines.n_lines, r.lines.n_removed, hashlib.sha256(r.lines.text.encode()).hexdigest()) for r in lines.dedup_lines(docs).collect()}
    assert got == want


def test_quality(docs):
    got = {r.doc_id: r.quality for r in quality.quality(docs).select("doc_id", "quality").collect()}
    for d, t in PAIRS:
        w, text = words(t), t or ""
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
        full = [x for x in text.split("\n") if words(x)]
        q = got[d]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)), d
        assert q.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (q.kept and q.base_failed)


def test_line_rules(spark):
    cases = {"Plain prose with an end.": False, "a | b | c | d": True, "Home": True, "All rights reserved 2020": True, "x### y$$$ z%%%": True, "": False, "- a bullet": False}
    d = spark.createDataFrame(list(cases.items()), "line string, want boolean")
    assert d.where(quality.line_fails(F.col("line")) != F.col("want")).collect() == []


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_encoder_equals_the_library(name, kind):
    from tokenizers import Tokenizer

    own, plain = encoding.Encoder(encoding.tokenizer_path(name), kind), Tokenizer.from_file(encoding.tokenizer_path(name))
    cases = [t or "" for _, t in PAIRS] + ["a  b\n c\t\td  ", "it's I'll 'S don't  ' s '", "\n\nx\n", "12 345 1st a1b2", " ", "#$%&&x|'re", "HELLO\x0bWorld\x0c é", "x ", "x²"]
    for t, ids in zip(cases, own.encode(cases), strict=True):
        assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_code(n):
    r = np.random.default_rng(n).choice([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype("<u4")
    control, data = tokens.encode_ranks(r)
    assert len(control) == -(-n // 4) and (tokens.decode_ranks(control, data, n) == r).all()


def through_files(spark, docs):
    ids = staged(tokens.encoded(docs, encoding.tokenizer_path("word_bpe_49k.json"), "words", 1), "ids")
    folder = tokens.new_folder(spark, "shards")
    bases = tokens.write_shards(ids, folder)
    return tokens.read_shards(spark, folder, bases, tokens.read_ranks(spark, folder))


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    start, want = 0, {}
    for d, t in sorted(PAIRS):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert rows(through_files(spark, docs), 3) == want


def test_packing(docs):
    from tokenizers import Tokenizer

    path = encoding.tokenizer_path("byte_bpe_50k.json")
    plain, got = Tokenizer.from_file(path), packing.pack_documents(docs, path, 2).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    total = 0
    for d, t in PAIRS:
        ids, at = plain.encode(t or "", add_special_tokens=False).ids + [2], 0
        total += len(ids)
        for i, r in enumerate(sorted(by[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and (i == 0 or r.length == 1024) and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024 and len(bins) <= 1.06 * total / 1024 + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    r = random.Random(2)
    counts = {r.randint(1, 100): r.randint(1, 50) for _ in range(60)}
    bins = packing.plan(counts, capacity=100, documents=6, attention=6000, rule=rule) if max(counts) ** 2 <= 6000 else packing.plan(counts, capacity=100, documents=6, attention=10000, rule=rule)
    seen = {}
    for n, pieces in bins:
        assert sum(k * m for k, m in pieces.items()) <= 100 and sum(pieces.values()) <= 6 and sum(k * k * m for k, m in pieces.items()) <= 10000
        for k, m in pieces.items():
            seen[k] = seen.get(k, 0) + n * m
    assert seen == counts
    for table in packing.slots(bins).values():
        assert (np.diff(table[:, 0]) > 0).all()


def sellers(item, text):
    row, at, t = np.zeros(len(text) + 1, int), np.arange(len(text) + 1), np.array(list(text))
    for i, c in enumerate(item, 1):
        best = np.append(i, np.minimum(row[:-1] + (t != c), row[1:] + 1))
        row = np.minimum.accumulate(best - at) + at
    return int(row.min())


def test_decontamination(spark, docs, empty):
    r = random.Random(1)
    benchmark = [(k, t[:200]) for k, t in PAIRS[:8] if t and len(t) > 150] + [(50, "short"), (51, None), (52, "")]
    other = [(1000 + i, t) for i, (_, t) in enumerate(PAIRS[20:32])]
    for k, t in [b for b in benchmark if b[1] and len(b[1]) > 150]:
        for edits in (0, 3, 12, 15, 18, 40):
            x = list(t)
            for _ in range(edits):
                p = r.randrange(len(x))
                if r.random() < 0.5:
                    x[p] = r.choice("xyz ")
                elif r.random() < 0.5:
                    del x[p]
                else:
                    x.insert(p, "q")
            other.append((2000 + 10 * k + edits % 10, "some words before " + "".join(x) + " and after"))
    d = make(spark, other)
    b = spark.createDataFrame(benchmark, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.matches(d, b).collect()}
    want = set()
    for i, t in other:
        for k, item in benchmark:
            m = decontaminate.normal(item or "")
            if len(m) >= decontaminate.LEAST and (e := sellers(m, decontaminate.normal(t))) <= decontaminate.budget(len(m)):
                want.add((i, k, e))
    assert got == want and len(want) > 5
    assert decontaminate.matches(empty, b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(d, b)
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in other} - {i for i, _, _ in want} and kept.columns == d.columns


def test_blocks_of_items(spark, monkeypatch):
    b = spark.createDataFrame([(i, f"item number {i} " + "words " * 10) for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 200)
    assert [i for ids, _ in decontaminate._blocks(b) for i in ids] == list(range(9)) and len(list(decontaminate._blocks(b))) > 2


def test_kneser_is_a_distribution():
    k, c = np.unique(charlm.windows(charlm.symbols("the cat sat on the mat and the rat ran " * 3)), return_counts=True)
    m = charlm.Kneser(k, c, (int((c == 1).sum()), int((c == 2).sum())))
    for context in (k >> np.uint64(12))[:5].tolist() + [0]:
        all_ = (np.uint64(context) << np.uint64(12)) | np.arange(4096, dtype=np.uint64)
        assert abs(m.probability(charlm.ORDER, all_).sum() - 1) < 1e-9
    model = charlm.Model({"a": (k, c)}, {"a": (3, 2)})
    assert np.allclose(model.log_probabilities(k)[:, 0], np.log(charlm.Kneser(k, c, (3, 2)).probability(charlm.ORDER, k)), atol=1e-4)


@pytest.fixture(scope="module")
def spoken(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language(spoken):
    got = langid.identify(spoken).join(spoken.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert right >= 0.97 * n and got.where("score < 0 OR score > 1").count() == 0


def test_toxicity(spark, spoken):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.toxicity(spoken, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9


def test_reading(spoken):
    r = toxicity.reader(spoken)
    assert r.restore("m0r0n p@thetic w.o.r.t.h.l.e.s.s clooown i d i o t") == "moron pathetic worthless clown idiot"
    assert r.restore("Plain words, call +1 (328) 555-2962.") == "plain words, call +1 (328) 555-2962."


PATH = encoding.tokenizer_path("byte_bpe_50k.json")
ALL = {
    "tokens": lambda s, d: through_files(s, d),
    "language": lambda s, d: langid.identify(d),
    "quality": lambda s, d: quality.quality(d),
    "keep_good": lambda s, d: quality.keep_good(d),
    "toxicity": lambda s, d: toxicity.toxicity(d, s.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")),
    "bytes": lambda s, d: spans.removed(texts(d), substrings.repeated_bytes(d), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", substrings.without),
    "words": lambda s, d: spans.removed(texts(d), fingerprints.repeated_words(d), "n_words long, n_removed long, kept_sha256 string", fingerprints.without),
    "packing": lambda s, d: packing.pack_documents(d, PATH, 2),
    "near": lambda s, d: neardup.near_duplicates(d, 80),
    "keep_one": lambda s, d: neardup.keep_one(d),
    "lines": lambda s, d: lines.dedup_lines(d),
    "drop_lines": lambda s, d: lines.drop_repeated_lines(d),
}
LESS = {"keep_good": 0, "keep_one": 4}


@pytest.mark.parametrize("name", list(ALL))
def test_odd_rows_and_empty_tables(spark, odd, empty, name):
    assert ALL[name](spark, empty).count() == 0
    assert ALL[name](spark, odd).count() == LESS.get(name, odd.count())


def test_stages_keep_columns(spark, docs, odd):
    for name in ("keep_good", "keep_one", "drop_lines"):
        for d in (docs, odd):
            assert ALL[name](spark, d).columns == d.columns


def test_reader_has_every_window(spark):
    """More distinct windows than any fixed number that a model once kept: all of them are read."""
    r = random.Random(3)
    own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(60_000)]
    got = toxicity.reader(spark.createDataFrame([(i, " ".join(own[i::50])) for i in range(50)], "doc_id long, text string"))
    w = np.concatenate([charlm.windows(charlm.symbols(" ".join(own[i::50]))) for i in range(50)])
    assert len(np.unique(w)) > 100_000
    k, n = np.unique(w, return_counts=True)
    full = charlm.Kneser(k, n, (int((n == 1).sum()), int((n == 2).sum())))
    three = full.p[3][0]
    read = [got.next(x >> 24, x >> 12 & 4095, x & 4095) for x in three.tolist()]
    assert np.allclose(read, np.log(full.probability(3, three)), atol=1e-4)


def test_every_disguise_is_read(spoken):
    """Look-alikes at an end, several in a row, beside one letter; runs of any length; punctuation stays punctuation."""
    r = toxicity.reader(spoken)
    assert r.restore("l053r 1d107 m0r0n m" + "o" * 50 + "ron id1" + "o" * 400 + "t") == "loser idiot moron moron idiot"
    assert r.restore("(moron) moron! **idiot** #loser") == "moron moron idiot loser"
    for w in ("a$$", "5h17", "sh17", "h473", "d13", "f001"):
        assert re.fullmatch("[a-z]{3,4}", r.restore(w)), w
    long = "m0r0n" * 40_000
    assert len(r.restore(long)) == len(long)


def test_short_items_are_found(spark):
    items = [(1, "what is 2 + 2?"), (2, "中国的首都是哪里?"), (3, "法国的首都在哪里呢?请回答"), (4, "cat"), (5, "cat"), (6, " "), (7, "who was first to go")]
    texts_ = [(1, "so What  is 2 + 2? four"), (2, "问:中国的首都是哪里?北京"), (3, "他问法国的首都在哪里呢?请回答我"), (4, "a category"), (5, "The Cat sat, concat"), (6, "who was first to be"), (7, None), (8, "")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.matches(make(spark, texts_), b).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 4, 0), (5, 5, 0)}
    assert {x.doc_id for x in decontaminate.drop_contaminated(make(spark, texts_), b).collect()} == {4, 6, 7, 8}


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_encoder_equals_the_library_on_added_tokens(name, kind):
    from tokenizers import Tokenizer

    own, plain = encoding.Encoder(encoding.tokenizer_path(name), kind), Tokenizer.from_file(encoding.tokenizer_path(name))
    literals = [t.content for t in plain.get_added_tokens_decoder().values()]
    cases = [x for t in literals for x in (t, f"x {t} y", f"a{t}b\n{t}{t}", f"日本 {t} é", f"X {t.upper()} y", t[:-1], f"{t[:-2]} {t[-2:]}", f"Plain words. {t}")] + ["Plain words.", "< | endoftext | >"]
    for t, ids in zip(cases, own.encode(cases), strict=True):
        assert ids == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_blocks_equal_the_whole_model(spark, monkeypatch):
    """In one block or many, a model has all windows of all classes, however many."""
    r = random.Random(4)
    own = [(f"l{k:03d}", " ".join("".join(r.choice("abcdefghij"[k % 5 :]) for _ in range(5)) for _ in range(40))) for k in range(230)]
    counted = {c: np.unique(charlm.windows(charlm.symbols(t)), return_counts=True) for c, t in own}
    whole = charlm.Model(counted, {c: (int((n == 1).sum()), int((n == 2).sum())) for c, (_, n) in counted.items()})
    lines_ = [t for _, t in own[:9]] + ["", "zzz abc", "other words"]
    want = np.array([-whole.log_probabilities(w).mean(axis=0, dtype=float) if len(w) else np.zeros(230) for w in (charlm.windows(charlm.symbols(t)) for t in lines_)])
    labelled = spark.createDataFrame(own, "class string, text string")
    for cells in (10**9, 300_000):
        monkeypatch.setattr(charlm, "CELLS", cells)
        m = langid.train(labelled)
        assert m.classes == sorted(counted) and (len(m.parts) > 3) == (cells < 10**9)
        _, got = m.cross_entropy(lines_)
        assert np.allclose(got, want, atol=1e-4)


def test_common_grams_are_searched_in_slices(spark, docs, monkeypatch):
    """Items that share most of their q-grams: slices of hits of any size give the same places."""
    stem = "the quick brown fox jumps over the lazy dog and runs away from "
    b = spark.createDataFrame([(i, stem + f"number {i} of the {i * 7} hunters") for i in range(40)], "item_id long, text string")
    d = make(spark, [(i, "before " + stem + f"number {i} of the {i * 7} hunters " + stem * (i % 3)) for i in range(0, 60, 3)])
    want = {tuple(r) for r in decontaminate.matches(d, b).collect()}
    items = decontaminate.Items([r.item_id for r in b.collect()], [decontaminate.normal(r.text) for r in b.collect()])
    texts_ = [(r.doc_id, decontaminate.normal(r.text)) for r in d.collect()]
    for hits in (7, 1000, 1 << 20):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        assert {tuple(r) for r in decontaminate.search(texts_, items)} == want
    assert {(i, i) for i in range(0, 40, 3)} <= {r[:2] for r in want}


def test_vector_limits_bind(docs):
    """Packing by tokens alone breaks limits that the vector keeps."""
    counts = {10: 400, 35: 60, 60: 40}
    plain = packing.plan(counts, capacity=100, documents=100, attention=10**6, weights=(1.0, 0.0, 0.0))
    broken = lambda bins: [p for _, p in bins if sum(p.values()) > 4 or sum(k * k * m for k, m in p.items()) > 4500]
    assert broken(plain)
    for rule in ("norm", "dot"):
        bins = packing.plan(counts, capacity=100, documents=4, attention=4500, rule=rule)
        assert not broken(bins) and sum(n * p.get(10, 0) for n, p in bins) == 400
    path = encoding.tokenizer_path("byte_bpe_50k.json")
    held = {}
    for r in packing.pack_documents(docs, path, 2, documents=2).collect():
        held[r.sequence_id] = held.get(r.sequence_id, 0) + 1
    assert max(held.values()) == 2


def test_viterbi_equals_every_reading(spoken):
    """The reading of least cost among all that a lattice has."""
    from itertools import product

    r = toxicity.reader(spoken)
    fold = charlm._fold()

    def cost(read):
        a = b = 0
        total = sum(price for _, price in read)
        for letter in [x for x, _ in read if x] + [" "]:
            s = int(fold[ord(letter)])
            total -= r.next(a, b, s)
            a, b = b, s
        return total

    for word in ("m0r0n", "!d10t", "a$$", "h3||0", "cl000wn", "1t", "x", "(4t!"):
        places = r.lattice(word)
        best = min(product(*places), key=cost)
        read, each = r.decode(places)
        letters = "".join(x for x, _ in best)
        assert abs(cost(best) - each * max(1, len(letters) + 1)) < 1e-6 or read == letters.strip()
        assert read == letters.strip(), word


def test_kneser_equals_counting():
    """Interpolated Kneser-Ney by its definition, over dictionaries."""
    text = "the cat sat on the mat and the rat ran to the hat " * 2 + "a cat"
    s = charlm.symbols(text).tolist()
    order = charlm.ORDER
    top = {}
    for i in range(len(s) - order + 1):
        w = tuple(s[i : i + order])
        top[w] = top.get(w, 0) + 1
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = {}
        for w in levels[k + 1]:
            levels[k][w[1:]] = levels[k].get(w[1:], 0) + 1

    def p(w):
        k = len(w)
        if not k:
            return 1 / (1 << charlm.SYMBOL)
        c = levels[k]
        one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(max(one / (one + 2 * two) if one and two else 0.75, 0.1), 0.9)
        own = [n for v, n in c.items() if v[:-1] == w[:-1]]
        if not own:
            return p(w[1:])
        return max(c.get(w, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * p(w[1:])

    keys, n = np.unique(charlm.windows(np.array(s, np.uint16)), return_counts=True)
    m = charlm.Kneser(keys, n, (int((n == 1).sum()), int((n == 2).sum())))
    unpack = lambda k: tuple(int(k) >> charlm.SYMBOL * i & (1 << charlm.SYMBOL) - 1 for i in reversed(range(order)))
    some = np.concatenate([keys, keys ^ np.uint64(3), keys ^ np.uint64(5 << 24)])
    assert np.allclose(m.probability(order, some), [p(unpack(k)) for k in some])


def test_hot_pivot_is_fanned_out(docs, monkeypatch):
    want = rows(neardup.near_duplicates(docs, 85), 3)
    monkeypatch.setattr(neardup, "SALT", 2)
    monkeypatch.setattr(neardup, "FAN", 2)
    assert rows(neardup.near_duplicates(docs, 85), 3) == want


def test_values_of_odd_rows(spark, odd):
    """Nulls, repeated rows and versions have the results that the docstrings state."""
    near = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(odd, 80).collect())
    assert near == sorted([("None", 0, "None", True), ("None", 1, "None", True), ("2", 0, "2", True)] + [("1", 1, "1", True)] * 4)
    kept = sorted((str(r.doc_id), str(r.text)) for r in neardup.keep_one(odd).collect())
    assert kept == [("1", "other"), ("2", "None"), ("None", "None"), ("None", "a text")]
    lang = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd).where("doc_id IS NULL OR doc_id = 2").collect()}
    assert (2, "und", 0.0) in lang and (None, "und", 0.0) in lang
    cut = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in spans.removed(texts(odd), fingerprints.repeated_words(odd), "n_words long, n_removed long, kept_sha256 string", fingerprints.without).collect())
    assert cut == [("1", 1, 0)] * 4 + [("2", 0, 0), ("None", 0, 0), ("None", 2, 0)]
    packed = packing.pack_documents(odd, PATH, 2).collect()
    assert sum(r.length == 1 and r.piece == 0 for r in packed) == 2 and len(packed) == odd.count()
    b = spark.createDataFrame([(1, "other"), (2, None)], "item_id long, text string")
    left = decontaminate.drop_contaminated(odd, b)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "None", "None"] and left.columns == odd.columns
    got = sorted((r.row.doc_id or 0, r.lines.n_lines, r.lines.n_removed, r.lines.text) for r in lines.dedup_lines(odd).collect())
    assert got == sorted([(0, 1, 0, ""), (0, 1, 0, "a text"), (2, 1, 0, "")] + [(1, 1, 0, "same")] * 2 + [(1, 1, 0, "other")] * 2)
    judged = [(r.quality.n_words, r.quality.base_failed, r.quality.kept) for r in quality.quality(odd.where("doc_id = 2")).collect()]
    assert judged == [(0, True, False)]
