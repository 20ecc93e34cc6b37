import json
import time

import pytest

from quarrymill.operators import corpus, extract, layout
from quarrymill.operators.extract import dictionary_extractor
from quarrymill.plans.engine import Document, Engine, IngestError, Providers, Run, Suspend, ingest_all
from quarrymill.plans.pipeline import Judge, Pipeline
from quarrymill.streaming.feed import follow


def pipeline():
    return Pipeline("a test", "db").entity("org", "a firm").entity("topic", "a heading").relation("KNOWS", "org", "org")


def engine(spark, tmp_path, **kw):
    return Engine(spark, str(tmp_path / "e"), Providers(extract=dictionary_extractor({"org": ["ACME", "Initech"]}), **kw), buckets=2)


def test_validation():
    p = pipeline()
    assert p.validate() == ["the pipeline has no steps: it would only write chunks"]
    p.custom("").llm(["nothing"], ["LOST"]).index("gone")
    p.relations["BAD"] = {"from": "a", "to": "org", "definition": ""}
    p._step()
    assert len(p.validate()) == 6
    q = Pipeline.parse(pipeline().llm(["org"], ["KNOWS"]).derived(0.8).build())
    assert q.validate() == [] and q.build() == pipeline().llm(["org"], ["KNOWS"]).derived(0.8).build()


def test_ingest_and_remove(spark, tmp_path):
    e = engine(spark, tmp_path)
    p = pipeline().structural(["topic"]).llm(["org"], ["KNOWS"]).derived(0.0).communities()
    run = e.ingest(p, [Document("x/a.md", text="# Head\nACME and Initech"), Document("b.md", text="ACME again")])
    assert run.ok and run.committed["chunks"] == 2
    assert [y["name"] for y in run.reports[0]["layers"]] == ["parse", "embed", "structural", "llm", "derived", "communities", "commit"]
    t = e.corpus(p).tables()
    assert {"org:acme", "org:initech", "topic:head"} <= {r.id for r in t["entities"].collect()}
    gone = e.remove(p, ["x/a.md"])
    assert gone.deleted["chunks_removed"] == 1
    ids = {r.id for r in e.corpus(p).tables()["entities"].collect()}
    assert "org:acme" in ids and "org:initech" not in ids and "topic:head" not in ids
    assert [r.run_id for r in e.list()][0] in {gone.run_id, run.run_id} and e.get(run.run_id).ok
    assert len(list(e.events(run.run_id))) == 1


def test_suspend_and_resume(spark, tmp_path):
    e = engine(spark, tmp_path)
    p = pipeline().llm(["org"])
    run = e.ingest(p, [Document("a", text="nobody"), Document("b", text="ACME")])
    assert run.suspended and run.reports[0]["state"] == "failed" and run.blocked_on == "a"
    with pytest.raises(IngestError):
        e.get("none")
    again = e.resume(run.run_id, "retry")
    assert again.suspended
    done = e.resume(run.run_id, "skip")
    assert done.ok and [r["state"] for r in done.reports] == ["skipped", "completed"]
    with pytest.raises(IngestError) as x:
        e.resume(run.run_id, "retry")
    assert x.value.status == 409


def test_judge_suspends_and_stays(spark, tmp_path):
    e = engine(spark, tmp_path, judge=lambda prompt: '{"ok": false, "suspicion": "odd", "note": "n"}')
    run = e.ingest(pipeline().llm(["org"]), [Document("a", text="ACME")], Judge(on_suspicion="suspend"))
    assert run.suspended and run.reports[0]["state"] == "pending" and run.flags[0]["suspicion"] == "odd"
    assert e.resume(run.run_id, "retry").suspended
    assert e.resume(run.run_id, "abort").state == "cancelled"
    quiet = engine(spark, tmp_path, judge=lambda prompt: "nonsense").ingest(pipeline().llm(["org"]), [Document("a", text="ACME")], Judge(on_suspicion="suspend"))
    assert quiet.ok


def test_cancel_reap_and_errors(spark, tmp_path):
    e = engine(spark, tmp_path)
    run = e.submit(pipeline().llm(["org"]), [Document("a", text="ACME")])
    e.cancel(run.run_id)
    assert e.execute(e.get(run.run_id)).state == "cancelled"
    lost = Run("lost", {}, [], state="running", created_at="2000")
    e.store.save(lost)
    assert e.store.reap() == 1 and e.get("lost").state == "failed"
    with pytest.raises(IngestError):
        e.submit(pipeline(), [Document("a")])
    with pytest.raises(IngestError):
        e.submit(pipeline().llm(["org"]), [])
    with pytest.raises(IngestError):
        e.parse(spark.createDataFrame([("a", "b")], "doc string, text string"), "markdown_render")
    assert e.health()["status"] == "ok"


def test_custom_layer(spark, tmp_path):
    folder = tmp_path / "layers"
    folder.mkdir()
    (folder / "mine.py").write_text('"""Counts chunks."""\n\ndef run(chunks, **_):\n    return {"digest": {"seen": chunks.count()}}\n')
    (folder / "_hidden.py").write_text("")
    (folder / "bad.py").write_text("x = 1\n")
    e = Engine(spark, str(tmp_path / "e"), layers=str(folder), buckets=2)
    assert {x["name"] for x in e.layers() if x["kind"] == "custom"} == {"mine", "bad"}
    run = e.ingest(pipeline().custom("../layers/mine"), [Document("a", text="text")])
    assert run.ok and run.reports[0]["layers"][2]["digest"]["seen"] == 1
    assert e.ingest(pipeline().custom("bad"), [Document("a", text="text")]).suspended


def test_feed(spark, tmp_path):
    """Every tier in a batch and in a stream: structural, llm, derived, communities, custom; index fields; the last change counts."""
    folder = tmp_path / "layers"
    folder.mkdir()
    (folder / "mine.py").write_text(
        "from pyspark.sql import functions as F\n\ndef run(chunks, **_):\n    e = chunks.select('doc', F.lit('year:1999').alias('id'), F.lit('year').alias('type'), F.lit('1999').alias('name'), F.lit('').alias('description'), F.lit(1.0).alias('confidence')).distinct()\n"
        "    src = F.concat(F.lit('markdown_chunk:'), F.substring(F.sha1(F.concat_ws('#', 'doc', 'index')), 1, 12))\n    return {'entities': e, 'relations': chunks.select('doc', src.alias('src'), F.lit('year:1999').alias('dst'), F.lit('mentions').alias('type'))}\n"
    )
    rows = [("a", "# Head\nACME", "created", 1), ("a", "# Head\nInitech and ACME", "modified", 2), ("b", "ACME", "created", 3), ("b", None, "deleted", 4), ("c", "# Head\nACME", "created", 5), ("d", " ", "created", 6)]
    feed = spark.createDataFrame(rows, "doc string, text string, change string, ordinal long")
    p = pipeline().entity("year", "a year").structural(["topic"]).llm(["org"]).custom("mine").derived(0.0).communities().index("year", "int").index("org")
    providers = Providers(extract=dictionary_extractor({"org": ["ACME", "Initech"]}), summarise=lambda prompts: ['{"title": "T", "summary": "S"}'] * len(prompts))
    report = ingest_all(spark, str(tmp_path / "x"), p, feed, providers, str(folder), buckets=2)
    assert report["chunks"] == 2 and report["without_chunks"] == 1 and [y["name"] for y in report["layers"]] == ["structural", "llm", "custom:mine", "derived", "communities"]
    t = Engine(spark, str(tmp_path / "x")).corpus(p).tables()
    ents = {r.id: r for r in t["entities"].collect()}
    assert {"org:initech", "org:acme", "topic:head", "year:1999", "community:0", "community_summary:t"} <= set(ents)
    assert ents["org:acme"].pagerank > ents["org:initech"].pagerank > 0 and ents["org:acme"].embedding is not None
    assert {(r.doc, r.props.get("year"), r.props.get("org")) for r in t["chunks"].collect()} == {("a", "1999", "ACME"), ("c", "1999", "ACME")}
    kinds = {r.type for r in t["relates"].collect()}
    assert {"mentions", "chunked_into", "member_of", "summarizes"} <= kinds
    feed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "in"))
    plain = pipeline().structural(["topic"]).llm(["org"])
    follow(stream, str(tmp_path / "y"), plain, str(tmp_path / "ck"), providers).awaitTermination()
    assert {r.doc for r in Engine(spark, str(tmp_path / "y")).corpus(plain).tables()["chunks"].collect()} == {"a", "c"}
    with pytest.raises(Suspend):
        ingest_all(spark, str(tmp_path / "z"), plain, feed, Providers(extract=providers.extract, judge=lambda _: '{"ok": false, "suspicion": "odd", "note": ""}'), judge=Judge(on_suspicion="suspend"), buckets=2)


def item(pos, label, text, page=1, y=700.0):
    """A layout item as a provider gives it."""
    return {"pos": pos, "label": label, "level": 1, "text": text, "page": page, "bbox": [50.0, y, 500.0, y + 20.0], "page_height": 800.0, "layer": "body", "parent": None}


def test_layout_documents(spark, tmp_path):
    """Layout items through a run: tables by their cells, the layout provider with its options, OCR where the text is damaged."""
    seen, title, text = str(tmp_path / "seen"), item(0, "title", "Report", y=760.0), item(1, "text", "")

    def read(path, options):
        with open(seen, "a") as f:
            f.write(json.dumps([path, options]) + "\n")
        words = "Words of the page that OCR has read, enough of them to be believed, and ACME among them. " * 8
        return [title, text | {"text": words if options["ocr"] else "\ufffd\ufffd"}]

    e = engine(spark, tmp_path, layout=read)
    p = pipeline().chunk("pdf_layout", word_space_factor=0.2, tables="markdown").llm(["org"])
    run = e.ingest(p, [Document("scan.pdf")])
    assert run.ok, run.reports
    (chunk,) = e.corpus(p).tables()["chunks"].where("text LIKE '%OCR%'").limit(1).collect()
    assert chunk.section_path == "Report"
    assert [json.loads(x) for x in open(seen)] == [["scan.pdf", {"word_space_factor": 0.2, "ocr": False}], ["scan.pdf", {"word_space_factor": 0.2, "ocr": True}]]
    with pytest.raises(IngestError):
        engine(spark, tmp_path).submit(p, [Document("scan.pdf")])
    fields = "pos int, label string, level int, text string, page int, bbox array<double>, page_height double, layer string, parent int"
    names = [f.split()[0] for f in fields.split(", ")]
    given = [item(0, "title", "Report"), item(1, "table", "?"), item(2, "text", "said by ACME in the words of a paragraph")]
    spark.createDataFrame([tuple(r[k] for k in names) for r in given], fields).write.parquet(str(tmp_path / "items"))
    cells = [(1, 1, 0, 0, "Code", False), (1, 1, 0, 1, "Meaning", False), (1, 1, 1, 0, "1100", False), (1, 1, 1, 1, "a request", False)]
    spark.createDataFrame(cells, "table_id int, page int, row int, col int, text string, header boolean").write.parquet(str(tmp_path / "cells"))
    q = pipeline().chunk("pdf_layout", tables="markdown").llm(["org"])
    q.target_db = "other"
    assert engine(spark, tmp_path).ingest(q, [Document("t.pdf", items=str(tmp_path / "items"), cells=str(tmp_path / "cells"))]).ok
    texts = "\n".join(r.text for r in e.corpus(q).tables()["chunks"].collect())
    assert "| Code | Meaning |" in texts and "| Code 1100 | a request |" in texts


def test_slide_switches(spark):
    """Furniture that is given is left out, and the transcription gives the order."""
    e = Engine(spark, "/nowhere", Providers(transcribe=lambda doc, page, texts: "Second box of the slide then First box of the slide"))
    p = pipeline().chunk("pdf_layout", slides=True, slide_layout="preset", furniture={"1": ["Internal use"]}).llm(["org"])
    rows = [("s",) + tuple(r.values()) for r in (item(0, "title", "Slide"), item(1, "text", "First box of the slide", y=400.0), item(2, "text", "Second box of the slide", y=300.0), item(3, "text", "Internal use", y=10.0))]
    items = spark.createDataFrame(rows, layout.ITEMS)
    texts = [r.text for r in e._chunks(p, items.select("doc").distinct(), items).collect()]
    assert any(t.index("Second box") < t.index("First box") for t in texts if "Second box" in t and "First box" in t) and not any("Internal use" in t for t in texts)


def test_steady():
    asked = []

    def flaky(prompts):
        asked.append(list(prompts))
        if len(asked) == 1:
            raise OSError("gone")
        return ["no JSON" if p == "b" and len(asked) < 3 else '{"entities": []}' for p in prompts]

    ask = extract.steady(flaky, tries=3, wait=0.0, shape={"entities": list})
    assert ask(["a", "b"]) == ['{"entities": []}'] * 2 and asked == [["a", "b"], ["a", "b"], ["b"]]
    assert extract.steady(lambda p: time.sleep(5), tries=1, seconds=0.05)(["a"]) == [None]
    assert extract.json_of('<think>{</think>```json\n{"a": [1]}\n``` done') == {"a": [1]} and extract.json_of("none") is None


def test_two_writers(spark, tmp_path):
    """The second of two writers that began from one manifest begins again; nothing is lost. Old parts can be removed."""
    store = corpus.Corpus(spark, str(tmp_path / "c"), buckets=2)
    none_e = spark.createDataFrame([], "doc string, id string, type string, name string, description string, confidence double")
    none_r = spark.createDataFrame([], "doc string, src string, dst string, type string")
    chunks = lambda d: spark.createDataFrame([(d, 0, f"text of {d}", "(root)")], "doc string, index int, text string, section_path string")
    put = lambda s, d: s.commit(chunks(d).select("doc"), chunks(d), none_e, none_r, "p")
    other, swap = corpus.Corpus(spark, str(tmp_path / "c"), buckets=2), store.swap
    once = []

    def late(manifest, changed):
        if not once:
            once.append(put(other, "b"))
        return swap(manifest, changed)

    store.swap = late
    put(store, "a")
    assert {r.doc for r in store.tables()["chunks"].collect()} == {"a", "b"} and store.manifest()["version"] == 2
    assert store.vacuum(1) > 0 and {r.doc for r in store.tables()["chunks"].collect()} == {"a", "b"}


def test_cancel_by_another_process(spark, tmp_path):
    e = engine(spark, tmp_path)
    run = e.submit(pipeline().llm(["org"]), [Document("a", text="ACME")])
    engine(spark, tmp_path).cancel(run.run_id)
    assert e.execute(e.get(run.run_id)).state == "cancelled"
