import json
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.operators import chunking, corpus, extract, graph, layout, quality
from quarrymill.sources import readers

MD = "# A\n\nalpha\n\n### C\n\ngamma\n\n## B\n\n" + "\n\n".join("word " * 40 for _ in range(5)) + "\n\n# empty\n# A2\ntail"


def test_plain_chunks(spark):
    rows = chunking.plain_chunks(spark.createDataFrame([("d", MD), ("e", ""), ("f", None)], "doc string, text string")).orderBy("doc", "index").collect()
    assert [r.section_path for r in rows[:2]] == ["A", "A > C"]
    assert {r.section_path for r in rows} == {"A", "A > C", "A > B", "A2"}
    assert [r["index"] for r in rows] == list(range(len(rows)))
    assert all(r.text.startswith(r.section_path + "\n") for r in rows)
    assert {r.doc for r in rows} == {"d"}
    big = chunking.plain_chunks(spark.createDataFrame([("d", "x" * 5000)], "doc string, text string")).collect()
    assert len(big) == 1 and big[0].token_count == 1250  # one paragraph stays whole


@pytest.mark.parametrize("n", [0, 1, 5999, 6000, 6001, 11600, 11601, 17200, 17201, 30000])
def test_windows_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    rows = chunking.window_chunks(spark.createDataFrame([("d", text)], "doc string, text string")).orderBy("index").collect()
    whole = ""
    for r in rows:
        assert len(r.text) <= 6000 and r.start == r["index"] * 5600
        whole = whole[: r.start] + r.text
    assert whole == text


def test_context(spark):
    d = spark.createDataFrame([("A > b", "body"), ("(root)", "body"), ("T > A", "T > A\nbody")], "section_path string, text string")
    got = [r.text for r in chunking.with_context(d, "T").collect()]
    assert got == ["T > A > b\nbody", "T\nbody", "T > A\nbody"]


def test_html(spark):
    html = "<html><head><title>x</title></head><body><h1>Top</h1><p>one<p>two<script>bad()</script><ul><li>a<li>b</ul><table><tr><th>k</th><th>v</th></tr><tr><td>1</td></tr></table><h2>Sub</h2><p>end</body>"
    rows = readers.parse(spark.createDataFrame([("d", html)], "doc string, text string")).orderBy("index").collect()
    assert [(r.kind, r.text.split("\n")[0], r.section_path) for r in rows] == [
        ("heading", "Top", "Top"),
        ("paragraph", "one", "Top"),
        ("paragraph", "two", "Top"),
        ("list_item", "a", "Top"),
        ("list_item", "b", "Top"),
        ("table", "| k | v |", "Top"),
        ("heading", "Sub", "Top > Sub"),
        ("paragraph", "end", "Top > Sub"),
    ]


def test_pages_that_share_a_url(spark, tmp_path):
    """Titles keep a reference without its semicolon, as their SQL does; pages of one URL stay apart."""
    from quarrymill.plans import queries

    page = "<body><h1>A{} &amp; b &amp</h1><p>x{}</p></body>"
    spark.createDataFrame([(i, "u" if i < 3 else "v", page.format(i % 2, i)) for i in range(4)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = lambda n: sorted(tuple(r) for r in queries.QUERIES[n](spark, str(tmp_path)).collect())
    names = [("u", "A0 & b &amp"), ("u", "A0 & b &amp"), ("u", "A1 & b &amp"), ("v", "A1 & b &amp")]
    assert got("page_titles") == names
    assert got("structural_entities") == [(d, f"topic:{t.lower()}", t) for d, t in names]
    assert [x[0:4] for x in got("structural_chunks") if x[3][0] == "x"] == [("u", 1, "A0 & b &", "x0"), ("u", 1, "A0 & b &", "x2"), ("u", 1, "A1 & b &", "x1"), ("v", 1, "A1 & b &", "x3")]
    assert [x[4] for x in got("html_blocks") if x[3] == 1][0] == "A0 & b &"


def test_strategies():
    with pytest.raises(NotImplementedError):
        readers.get_chunker("markdown_render")
    with pytest.raises(ValueError):
        readers.get_chunker("nothing")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    (r,) = readers.read_texts(spark, str(tmp_path)).collect()
    assert (r.doc, r.text) == ("a.txt", "ok � end")


def test_damage(spark):
    pages = [("d", p, "header\n" + f"good text of page {p} here " * 20) for p in range(4)] + [("x", 1, "�" * 50)]
    got = {r.doc: r for r in quality.text_damage(spark.createDataFrame(pages, "doc string, page int, text string")).collect()}
    assert not got["d"].damaged and got["x"].damaged and got["x"].short
    lines = quality.repeated_lines(spark.createDataFrame(pages, "doc string, page int, text string")).collect()
    assert {(r.doc, r.line, r.seen) for r in lines} == {("d", "header", 4)}


def items(spark, rows):
    return spark.createDataFrame(rows, "doc string, chunk int, pos int, type string, name string, description string, confidence double, id string")


def test_dedupe_first_of_equals(spark):
    d = items(spark, [("d", 0, 0, "t", "A", "one", 0.5, "t:a"), ("d", 1, 0, "t", "a", "two", 0.5, "t:a"), ("d", 2, 0, "t", "a", "nan", float("nan"), "t:a")])
    (r,) = extract.dedupe(d).collect()
    assert r.description == "one"


def test_replies(spark):
    said = [
        '{"entities":[{"type":"Role","name":" CTO ","confidence":"0.9"},{"type":"role","name":""},{"type":"other","name":"x"}],"relations":[{"type":"R","from":"cto","to":"ACME"}]}',
        '```json\n[{"type":"org","name":"ACME","confidence":"high"}]\n```',
        "no json",
        None,
    ]
    p = extract.parsed(spark.createDataFrame([("d", i, s) for i, s in enumerate(said)], "doc string, chunk int, reply string"))
    got = extract.items_of(p, ["role", "org"])
    assert {(r.type, r.name, r.confidence) for r in got.collect()} == {("role", "CTO", 0.9), ("org", "ACME", 1.0)}
    links, lost = extract.resolve(got, extract.relations_of(p), ["R"])
    assert [(r.src, r.dst) for r in links.collect()] == [("role:cto", "org:acme")] and lost.head()[0] == 0
    none, lost = extract.resolve(got, extract.relations_of(p), ["R"], {"R": ("org", "role")})
    assert none.count() == 0 and lost.head()[0] == 1


def test_reconcile(spark):
    e = spark.createDataFrame([(0, "a:x", "a", "x", "short", 0.5), (1, "b:x", "b", "X", "longer one", 0.9), (2, "a:y", "a", "y", "", 1.0)], "pos long, id string, type string, name string, description string, confidence double")
    r = spark.createDataFrame([(0, "a:x", "a:y", "R"), (1, "b:x", "a:y", "R"), (2, "a:x", "b:x", "R")], "pos long, src string, dst string, type string")
    ents, rels = extract.reconcile(e, r)
    assert {(x.id, x.description) for x in ents.collect()} == {("b:x", "longer one"), ("a:y", "")}
    assert [(x.pos, x.src, x.dst) for x in rels.collect()] == [(0, "b:x", "a:y")]
    same, loops = extract.reconcile(e.where("pos <> 1"), r.where("pos = 0"))
    assert same.count() == 2 and loops.count() == 1


def test_renames_are_unique(spark):
    """Entities of one id on many rows rename an edge once, not once for each row (and each end)."""
    e = spark.range(4000).selectExpr("id AS pos", "concat(if(id % 2 = 0, 'a', 'b'), ':x') AS id", "'a' AS type", "'x' AS name", "'' AS description", "id / 4000 AS confidence")
    r = spark.range(2000).selectExpr("id AS pos", "'a:x' AS src", "if(id % 2 = 0, 'a:x', 'c:y') AS dst", "'R' AS type")
    ents, rels = extract.reconcile(e, r)
    assert [x.id for x in ents.collect()] == ["b:x"]
    assert [(x.pos, x.src, x.dst) for x in rels.collect()] == [(1, "b:x", "c:y")]
    key = spark.createDataFrame([("a:x", "x")] * 3 + [("b:x", "x")], "id string, key string")
    assert extract.renames(key, spark.createDataFrame([("x", "b:x")], "key string, to string")).count() == 1


def test_prompt():
    p = extract.build_prompt("a CV", {"role": {"definition": "a post", "examples": ["CTO"], "not": "a firm"}}, {"AT": {"from": "role", "to": "org", "definition": ""}}, "text", "A > B")
    head, passage, rest = p.split("\n---\n")[0], *p.split("\n---\n")[1].rsplit("\n", 1)
    asked = json.loads(head)
    assert passage == "text" and rest == "---" and asked["collection"] == "a CV" and asked["heading"] == "A > B"
    assert asked["kinds"] == {"role": {"meaning": "a post", "such_as": ["CTO"], "unlike": "a firm"}} and asked["links"] == {"AT": {"source_kind": "role", "target_kind": "org"}}
    assert set(asked["reply"]) == {"entities", "relations"}
    plain = json.loads(extract.build_prompt("a CV", {"role": {"definition": "a post"}}, {}, "text", "(root)").split("\n---\n")[0])
    assert "links" not in plain and "heading" not in plain and set(plain["reply"]) == {"entities"}


def test_similarity(spark):
    vs = {"a": [1.0, 0.0], "b": [0.8, 0.6], "c": [0.0, 1.0], "n": [float("nan"), 0.0], "z": None}
    d = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(vs.items())], "id string, pos int, embedding array<double>")
    got = {(r.src, r.dst): (r.similarity_band, r.weight) for r in graph.similar_to(d, 0.6, compat=True).collect()}
    assert got == {("a", "b"): ("medium", 0.5)}
    assert graph.similar_to(d, 0.85).count() == 0


def test_pairs_of_many_blocks_shuffle_no_copies(spark, monkeypatch):
    """Blocks meet in a product of files: each vector is dealt once, however many blocks there are; the pairs are brute force's."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    r = random.Random(2)
    v = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(60)]
    items = spark.createDataFrame([(f"n{i}", i // 2, x) for i, x in enumerate(v)] + [("none", 99, None)], "id string, pos long, embedding array<double>")
    pairs = graph.similar_pairs(items, 0.5)
    want = {(f"n{i}", f"n{j}") for i in range(60) for j in range(60) if i // 2 < j // 2 and sum(a * b for a, b in zip(v[i], v[j], strict=True)) >= 0.5}
    assert {(x.a, x.b) for x in pairs.collect()} == want and pairs.count() == len(want)
    assert "Exchange hash" not in pairs._jdf.queryExecution().executedPlan().toString()
    grouped = graph.similar_pairs(items.withColumn("g", F.lit("x")), 0.5, by="g")
    assert {(x.a, x.b) for x in grouped.collect()} == want


def test_nearest_holds_few_products(spark, monkeypatch):
    """Strips of a few rows give what all rows at once give; of equals the smallest ids are taken, in whatever order they come."""
    seen, real = [], graph.greatest
    monkeypatch.setattr(graph, "CELLS", 12)
    ids = np.array([5, 3, 9, 1, 7, 2])
    dots = np.array([[1.0, 0.5], [1.0, 2.0], [1.0, np.nan], [1.0, 0.1], [0.0, 2.0], [3.0, 2.0]])
    best = None
    for at in range(0, 6, 2):
        best = real(best, ids[at : at + 2], dots[at : at + 2], 3)
        seen.append(len(best[0]))
    assert seen == [4, 6, 6]
    assert [int(x) for x in best[1]] == [2, 1, 3, 9, 2, 3]
    v = spark.createDataFrame([(i, [float(i % 4), 1.0]) for i in range(40)], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "query long, embedding array<double>")
    got = {(x.query, x["rank"]): x.id for x in graph.nearest(v, q, 5).collect()}
    assert [got[0, r] for r in range(1, 6)] == [3, 7, 11, 15, 19] and [got[1, r] for r in range(1, 6)] == [0, 4, 8, 12, 16]


def test_louvain(spark):
    ring = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.1), ("c0", "c1", 1.0)]
    e = spark.createDataFrame(ring, "src string, dst string, weight double")
    c = graph.louvain(e)
    got = {r.node: r.community for r in c.collect()}
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and got["a0"] != got["b0"] and got["c0"] == got["c1"]
    assert sorted(set(got.values())) == [0, 1, 2]
    assert graph.modularity(e, c) > 0.4


def test_louvain_holds_columns():
    """A giant component costs its task some bytes an edge, not some objects."""
    r = np.random.default_rng(4)
    n, many = 2000, 100_000
    i = r.integers(0, n // 2, many) * 2 + r.integers(0, 2, 1)
    j = np.where(r.random(many) < 0.95, (i + 2 * r.integers(1, n // 2, many)) % n, (i + 1) % n)
    tracemalloc.start()
    own = graph.louvain_places(n, i, j, np.ones(many), passes=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(own) == n and peak < 150 * many, peak / many


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    got = graph.pagerank(e, rounds=6)
    assert abs(got.agg(F.sum("pagerank")).head()[0] - 1) < 1e-9
    assert graph.pagerank(e.limit(0)).count() == 0


BOX = [0.0, 0.0, 1.0, 1.0]


def layout_items(spark, rows):
    full = [(d, pos, label, 1, text, page, box, 100.0, layer, None) for d, pos, label, text, page, box, layer in rows]
    return spark.createDataFrame(full, layout.ITEMS)


def test_ancestry(spark):
    rows = [("d", i, label, text, 1, [0.0, 90.0 - i, 9.0, 91.0 - i], "body") for i, (label, text) in enumerate([("title", "Cert"), ("section_header", "One"), ("text", "x"), ("section_header", "Two"), ("text", "y"), ("section_header", "ALL"), ("text", "z"), ("section_header", "Last"), ("text", "w")])]
    got = {r.heading: r.ancestors for r in layout.ancestry(layout_items(spark, rows)).collect()}
    assert got == {"Cert": [], "One": ["Cert"], "Two": ["Cert"], "ALL": [], "Last": ["ALL"]}


def test_ancestry_by_brute_force():
    """Each heading's ancestors by a look at every other heading, and many headings in one document in a time that isn't quadratic."""
    r = random.Random(5)
    for _ in range(300):
        heads = [("d", i, r.choice(["ABC", "DEF", "1 Aa", "1.1 Bb", "2 Cc", "Name", "Other"]), r.choice([1, 2, 3, None]), r.choice([10.0, 20.0, 30.0, None]), r.random() < 0.8, r.random() < 0.3, r.random() < 0.1) for i in range(r.randrange(1, 14))]
        depth = [layout._depth(h[2]) for h in heads]
        ends = {i: next((k for k in range(i + 1, len(heads)) if heads[k][6] or heads[k][2].isupper() or (depth[i] and depth[k] and depth[k] <= depth[i])), len(heads)) for i, h in enumerate(heads) if h[6]}
        for k, (_, pos, text, found) in enumerate(layout.ancestors_of(heads)):
            want = [heads[c][2] for c, z in ends.items() if c < k < z and heads[c][2] != text]
            _, _, _, page, y, boxed, _, _ = heads[k]
            if not want and not text.isupper() and boxed and page is not None:
                far = []
                for c, (_, _, t, p, b, has, _, listed) in enumerate(heads):
                    if c != k and has and b is not None and p is not None and t.isupper() and not listed and (p < page or (p == page and y is not None and b >= y)):
                        far.append(((page - p) * 100000 + (b - y if p == page else 0), c, t))
                want = [min(far)[2]] if far else []
            assert (pos, found) == (k, want)
    many = [("d", i, "ABC" if i % 2 else f"Name {i}", i // 50, float(i % 50), True, False, False) for i in range(100_000)]
    begun = time.monotonic()
    assert len(layout.ancestors_of(many)) == 100_000 and time.monotonic() - begun < 20


def test_running_headers(spark):
    rows = [("d", p, "section_header", "Title", p, [0.0, 95.0, 9.0, 97.0], "body") for p in range(1, 7)] + [("d", 50, "section_header", "Title", 7, [0.0, 50.0, 9.0, 52.0], "body")]
    got = layout.drop_running_headers(layout_items(spark, rows))
    assert got.where("layer = 'furniture'").count() == 6


def test_slides(spark):
    rows = [("d", 0, "title", "Chapter", 1, [0.0, 90.0, 9.0, 92.0], "body"), ("d", 1, "section_header", "Long heading", 1, [0.0, 80.0, 9.0, 82.0], "body"), ("d", 2, "section_header", "goes on", 1, [0.0, 77.5, 9.0, 79.5], "body"), ("d", 3, "text", "t", 1, BOX, "body")]
    rows += [("d", 10 * p, "title", "Chapter", p, [0.0, 90.0, 9.0, 92.0], "body") for p in (2, 3)]
    got = {r.page: r for r in layout.page_headings(layout_items(spark, rows)).collect()}
    assert got[1].headings == ["Chapter", "Long heading goes on"] and got[1].aliases["goes on"] == "Long heading goes on" and got[2].chapter


def test_cards():
    boxes = [("02", [0, 8, 2, 10]), ("Second", [0, 5, 5, 7]), ("01", [10, 8, 12, 10]), ("First", [10, 5, 15, 7]), ("3.", [20, 8, 22, 10]), ("Third", [20, 5, 25, 7]), ("else", [50, 5, 55, 7])]
    cards, other = layout.cards_of([(t, list(map(float, b))) for t, b in boxes])
    assert [c[1] for c in cards] == ["01 First", "02 Second", "3. Third"] and other == ["else"]
    assert layout.cards_of([(t, list(map(float, b))) for t, b in boxes[:4]]) is None


def test_places():
    assert layout.places(["Second box", "First box", "01", "unseen"], "01 First  box, then “Second box”") == [2, 3, 1, 0] or layout.places(["Second box", "First box"], "First box Second box") == [1, 0]


def chunk(index, text, path="(root)", page=1, kind="text"):
    return ("d", index, path, text, 1, page, None, [(page, BOX, None)], kind)


def test_rollups(spark):
    d = spark.createDataFrame([chunk(0, "a first fragment"), chunk(1, "says a first fragment again"), chunk(2, "a second fragment"), chunk(3, "first frag")], layout.CHUNKS)
    (r,) = layout.page_rollups(d).collect()
    assert r.text == "a first fragment\n\na second fragment"  # what contains an earlier one goes, and so does what is short
    d = spark.createDataFrame([chunk(0, "says a first fragment again"), chunk(1, "a first fragment")], layout.CHUNKS)
    (r,) = layout.page_rollups(d).collect()
    assert r.text == "says a first fragment again\n\na first fragment"  # a part after the whole stays


def test_super_parents(spark):
    d = spark.createDataFrame([chunk(0, "a", "T > A"), chunk(1, "b", "T > A"), chunk(2, "c", "T > B"), chunk(3, "T > B\n- x", "T > B"), chunk(4, "z", "U > V")], layout.CHUNKS)
    (r,) = layout.super_parents(d).collect()
    assert r.text == "T\n\nA\na\n\nb\n\nB\nc" and len(r.regions) == 3


def test_tables(spark):
    c = lambda t, page, rows, head=False: [("d", t, page, i, j, x, head and i == 0) for i, row in enumerate(rows) for j, x in enumerate(row)]
    cells = spark.createDataFrame(c(1, 1, [["MTI", "Meaning"], ["1100", "Request"]]) + c(2, 2, [["1120", "Advice"]]) + c(3, 5, [["7", "x"]]), "doc string, table_id int, page int, row int, col int, text string, header boolean")
    got = layout.name_columns(cells)
    assert {(r.table_id, r.text) for r in got.where("header").collect()} == {(1, "MTI"), (1, "Meaning"), (2, "MTI"), (2, "Meaning")}
    named = layout.rows_named(got)
    assert {r.text for r in named.where("col = 0 AND NOT header").collect()} == {"MTI 1100", "MTI 1120", "7"}
    assert {r.text for r in layout.markdown_tables(got.where("table_id = 1")).collect()} == {"| MTI | Meaning |\n| --- | --- |\n| 1100 | Request |"}


def test_scan_layout(spark):
    rows = [("d", 0, "title", "Doc", 1, BOX, "body"), ("d", 1, "section_header", "Part", 1, BOX, "body"), ("d", 2, "text", "some words of a paragraph here", 1, BOX, "body"), ("d", 3, "list_item", "a bullet of some length", 1, BOX, "body"), ("d", 4, "section_header", "Alone", 2, BOX, "body")]
    for slides in (False, True):
        got = layout.scan_layout(layout_items(spark, rows), slides=slides).orderBy("index").collect()
        assert [r["index"] for r in got] == list(range(len(got))) and any(r.text == "Doc > Part\n- a bullet of some length" for r in got)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("a", None, "z", 1), ("a", 5, None, 2), ("c", 3, None, 3)], "id string, n int, s string, o int")
    got = {r.id: (r.n, r.s) for r in corpus.upsert(old, new, order="o").collect()}
    assert got == {"a": (5, "z"), "b": (2, "y"), "c": (3, None)}


def ingest(spark, store, docs, ents, links):
    d = spark.createDataFrame([(x,) for x in docs], "doc string")
    chunks = spark.createDataFrame([(x, 0, f"text of {x}", "(root)") for x in docs], "doc string, index int, text string, section_path string")
    e = spark.createDataFrame([(docs[0], f"t:{n}", "t", n, "", 1.0) for n in ents] or [], "doc string, id string, type string, name string, description string, confidence double")
    m = extract.mentions(spark.createDataFrame([(x, 0, f"t:{n}", 1.0) for x, n in links], "doc string, chunk int, id string, confidence double"))
    return store.commit(d, chunks, e, m, "p")


def test_corpus(spark, tmp_path):
    store = corpus.Corpus(spark, str(tmp_path / "c"), buckets=2)
    first = ingest(spark, store, ["a"], ["x", "shared"], [("a", "x"), ("a", "shared")])
    assert first == {"chunks": 1, "entities": 4, "relations": 3}
    ingest(spark, store, ["b_1%"], ["shared"], [("b_1%", "shared")])
    again = ingest(spark, store, ["a"], ["x", "shared"], [("a", "x"), ("a", "shared")])
    assert again["replaced"] == 1
    t = store.tables()
    assert t["chunks"].count() == 2 and t["relates"].count() == 5
    assert store.remove(spark.createDataFrame([("a",)], "doc string")) == {"chunks_removed": 1, "orphans_removed": 1}
    ids = {r.id for r in store.tables()["entities"].collect()}
    assert "t:shared" in ids and "t:x" not in ids and store.tables()["relates"].count() == 2
    store.remove(spark.createDataFrame([("b_1%",)], "doc string"))
    assert all(d.count() == 0 for d in store.tables().values())


def test_a_large_part_is_written_by_many_tasks(spark, tmp_path):
    """No task takes a whole part, however few parts a corpus has."""
    store = corpus.Corpus(spark, str(tmp_path / "c"), buckets=1)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("doc"), F.lit(0).alias("index"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit("(root)").alias("section_path"))
    none = spark.createDataFrame([], "doc string, id string, type string, name string, description string, confidence double"), spark.createDataFrame([], "doc string, src string, dst string, type string")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "40000")
    try:
        store.commit(rows.select("doc"), rows.repartition(8), *none, "p")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    chunks = store.tables()["chunks"]
    assert chunks.count() == 4000 and len(chunks.inputFiles()) > 3


def test_providers(spark):
    names = extract.dictionary_extractor({"org": ["ACME"]})
    assert json.loads(names(["x\n---\nACME Ltd\n---"])[0])["entities"][0]["name"] == "ACME"
    with pytest.raises(Exception, match="vectors for"):
        extract.embed(spark.createDataFrame([("a",)], "t string"), lambda x: [], F.col("t")).collect()
    (s,) = spark.createDataFrame([("b a b",)], "t string").select(extract.sparse_of(F.col("t")).alias("s")).collect()
    assert sorted(s.s.weights) == [1.0, 2.0]
