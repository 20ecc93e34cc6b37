"""Chunks to entities and relations: providers' replies, merging, name resolution, reconciliation.

Orders matter (first or last wins), so chunks carry `chunk` (their index) and items their place `pos`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

REPLY = "struct<entities: array<struct<type: string, name: string, description: string, confidence: string>>, relations: array<struct<type: string, from: string, to: string>>>"


def structural_entities(chunks: DataFrame, types: list[str]) -> tuple[DataFrame, str | None]:
    """Each distinct heading of the chunks' paths (doc, index, section_path) as an entity, if exactly one type is asked for;
    and why it was skipped otherwise. The first spelling in order of chunks is the name."""
    if len(types) != 1:
        empty = chunks.where(F.lit(False)).select("doc", F.lit("").alias("id"), F.lit("").alias("type"), F.lit("").alias("name"), F.lit("").alias("description"), F.lit(1.0).alias("confidence"), F.lit(0).alias("chunk"), F.lit(0).alias("place"))
        return empty, f"structural needs exactly one entity type, {len(types)} were asked for"
    parts = chunks.select("doc", "index", F.posexplode(X.segments(F.col("section_path"))).alias("at", "name"))
    eid = X.entity_id(F.lit(types[0].lower()), F.col("name"))
    first = parts.groupBy("doc", eid.alias("id")).agg(F.min(F.struct(F.col("index").alias("chunk"), F.col("at").alias("place"), "name")).alias("e"))
    return first.select("doc", "id", F.lit(types[0].lower()).alias("type"), "e.name", F.lit("").alias("description"), F.lit(1.0).alias("confidence"), "e.chunk", "e.place"), None


def heading_mentions(chunks: DataFrame, kind: str) -> DataFrame:
    """mentions edges from chunks to the headings they stand under, so that those outlive the next collection of orphans."""
    parts = chunks.select("doc", F.concat(F.lit("markdown_chunk:"), X.cite_hex(X.chunk_id(F.col("doc"), F.col("index")))).alias("src"), F.explode(X.segments(F.col("section_path"))).alias("name"))
    return parts.select("doc", "src", X.entity_id(F.lit(kind), F.col("name")).alias("dst"), F.lit("mentions").alias("type"), F.lit("structural").alias("provenance")).distinct()


def build_prompt(context: str, entities: dict, relations: dict, text: str, section_path: str = "") -> str:
    """What an extractor is asked: one JSON object with the kinds to look for and the form of the reply, then the passage between
    two rules. entities: name to {definition, examples, not}; relations: name to {from, to, definition}."""
    kinds = {k: {"meaning": t["definition"]} | ({"such_as": t["examples"]} if t.get("examples") else {}) | ({"unlike": t["not"]} if t.get("not") else {}) for k, t in entities.items()}
    links = {k: {"source_kind": r["from"], "target_kind": r["to"]} | ({"meaning": r["definition"]} if r.get("definition") else {}) for k, r in relations.items()}
    reply: dict = {"entities": [{"type": "a kind", "name": "as the passage spells it", "description": "what the passage says of it", "confidence": "a number up to 1"}]}
    if links:
        reply["relations"] = [{"type": "a link", "from": "a listed name of source_kind", "to": "a listed name of target_kind"}]
    asked = {
        "task": "Read the passage below and list each thing of these kinds that it names" + (", and each link that it states between two of them." if links else "."),
        "collection": context,
        "heading": section_path if section_path != X.ROOT else "",
        "kinds": kinds,
        "links": links,
        "reply": reply,
        "notes": ["Reply with one object of the form `reply`, as JSON, and no other words.", "Lists may be empty.", "Take everything from the passage alone; where it has a short and a long form of a name, take the long one, once."],
    }
    return json.dumps({k: v for k, v in asked.items() if v}, ensure_ascii=False, indent=1) + f"\n---\n{text}\n---"


def call(chunks: DataFrame, provider: Callable[[list[str]], list[str | None]], prompt: Callable[[str, str], str], parallel: int | None = None) -> DataFrame:
    """chunks with `reply`: provider answers a batch of prompts; None where it failed. parallel: at most so many tasks call."""
    d = chunks.where(X.strip(F.coalesce(F.col("text"), F.lit(""))) != "").select("doc", "index", "text", "section_path")
    d = d.repartition(parallel, "doc", "index") if parallel else d

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            asked = [prompt(t, p) for t, p in zip(f["text"], f["section_path"].fillna(""), strict=True)]
            yield pd.DataFrame({"doc": f["doc"], "chunk": f["index"], "reply": provider(asked)})

    return d.mapInPandas(run, "doc string, chunk int, reply string")


def steady(provider: Callable[[list[str]], list[str | None]], tries: int = 3, seconds: float = 300.0, wait: float = 1.0, shape: dict[str, type] | None = None) -> Callable[[list[str]], list[str | None]]:
    """A provider that is asked up to `tries` times and given `seconds` each time. Only prompts without a usable reply are asked again:
    those of a call that failed, took too long or gave another number of replies, and, with `shape` (names of members and their
    types; a bare list passes), those whose reply is no such JSON. What is still without one is None."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    def usable(reply: str | None) -> bool:
        if reply is None or shape is None:
            return reply is not None
        said = json_of(reply)
        return isinstance(said, list) or isinstance(said, dict) and all(isinstance(said.get(k, kind()), kind) for k, kind in shape.items())

    def ask(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(prompts)
        left = list(range(len(prompts)))
        for n in range(tries):
            if n:
                time.sleep(wait * n)
            pool = ThreadPoolExecutor(1)
            try:
                said = pool.submit(provider, [prompts[i] for i in left]).result(seconds)
            except Exception:  # whatever a provider raises, its prompts are asked again
                said = None
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
            if said is not None and len(said) == len(left):
                for i, reply in zip(left, said, strict=True):
                    out[i] = reply if usable(reply) else None
            left = [i for i in left if out[i] is None]
            if not left:
                break
        return out

    return ask


def json_of(reply: str):
    """The JSON value in a reply, without thoughts and fences before and after it; None if there is none."""
    text = reply.rsplit("</think>", 1)[-1]
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    try:
        return json.JSONDecoder().raw_decode(text[min(starts) :])[0] if starts else None
    except ValueError:
        return None


def dictionary_extractor(names: dict[str, list[str]]) -> Callable[[list[str]], list[str]]:
    """A stand-in for a model: every listed name (by type) that stands in the prompt's excerpt as whole words."""
    listed = [(t, n) for t, own in names.items() for n in own]

    def answer(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            excerpt = p.split("\n---\n", 1)[-1]
            found = [{"type": t, "name": n, "description": "", "confidence": 1.0} for t, n in listed if X.find_word(excerpt, n) >= 0]
            out.append(json.dumps({"entities": found}))
        return out

    return answer


def parsed(replies: DataFrame) -> DataFrame:
    """doc, chunk, entities, relations of replies: an object, or a bare list of entities; anything else has none."""
    said = X.json_payload(F.col("reply"))
    listed = said.startswith("[")
    body = F.when(listed, F.concat(F.lit('{"entities":'), said, F.lit("}"))).otherwise(said)
    return replies.select("doc", "chunk", F.from_json(body, REPLY).alias("r")).select("doc", "chunk", F.coalesce("r.entities", F.expr("array()")).alias("entities"), F.coalesce("r.relations", F.expr("array()")).alias("relations"))


def confidence(c: Column) -> Column:
    """A number, or 1 where it isn't one; NaN stays and counts least."""
    return F.coalesce(c.try_cast("double"), F.lit(1.0))


def items_of(parsed_: DataFrame, types: list[str], floor: float = 0.0) -> DataFrame:
    """doc, chunk, pos, type, name, description, confidence, id of entities of the types asked for, with a name."""
    rows = parsed_.select("doc", "chunk", F.posexplode("entities").alias("pos", "e"))
    kind = F.lower(X.strip(F.coalesce("e.type", F.lit(""))))
    c = confidence(F.col("e.confidence"))
    d = rows.select("doc", "chunk", "pos", kind.alias("type"), X.strip(F.coalesce("e.name", F.lit(""))).alias("name"), X.strip(F.coalesce("e.description", F.lit(""))).alias("description"), c.alias("confidence"))
    return d.where(F.col("type").isin([t.lower() for t in types]) & (F.col("name") != "") & ((F.col("confidence") >= floor) | F.isnan("confidence"))).withColumn("id", X.entity_id(F.col("type"), F.col("name")))


def dedupe(items: DataFrame, by: list[str] = ["doc"]) -> DataFrame:  # noqa: B006
    """One row for each id: the greatest confidence, the first of equals; NaN is least unless it came first and stays alone."""
    sure = F.when(F.isnan("confidence"), F.lit(float("-inf"))).otherwise(F.col("confidence"))
    best = F.max_by(F.struct("type", "name", "description", "confidence", "chunk", F.col("pos").alias("place")), F.struct(sure, -F.col("chunk"), -F.col("pos")))
    return items.groupBy(*by, "id").agg(best.alias("e")).select(*by, "id", "e.*")


def mentions(items: DataFrame) -> DataFrame:
    """One edge for each item, repeats kept: from its chunk to its entity."""
    src = F.concat(F.lit("markdown_chunk:"), X.cite_hex(X.chunk_id(F.col("doc"), F.col("chunk"))))
    return items.select("doc", src.alias("src"), F.col("id").alias("dst"), F.lit("mentions").alias("type"), F.lit("llm").alias("provenance"), "confidence")


def name_key(c: Column) -> Column:
    """How relation ends are looked up: inner white space counts."""
    return F.lower(X.strip(c))


def resolve(items: DataFrame, relations: DataFrame, types: list[str], enforce: dict[str, tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Relations (doc, chunk, pos, type, from, to) whose ends are names of entities: doc, src, dst, type, provenance; and one
    row with the number that aren't. A name means the entity that was listed last under it. enforce: relation to the types of
    its ends."""
    last = items.groupBy("doc", name_key(F.col("name")).alias("key")).agg(F.max_by(F.struct("id", "type"), F.struct("chunk", "pos")).alias("e")).select("doc", "key", "e.id", F.col("e.type").alias("etype"))
    own = relations.where(F.col("type").isin(list(types))).withColumn("f", name_key(F.coalesce("from", F.lit("")))).withColumn("t", name_key(F.coalesce("to", F.lit(""))))
    j = own.join(last.select("doc", F.col("key").alias("f"), F.col("id").alias("src"), F.col("etype").alias("st")), ["doc", "f"], "left")
    j = j.join(last.select("doc", F.col("key").alias("t"), F.col("id").alias("dst"), F.col("etype").alias("dt")), ["doc", "t"], "left")
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if enforce:
        fits = F.lit(False)
        for r, (a, b) in enforce.items():
            fits = fits | ((F.col("type") == r) & (F.col("st") == a) & (F.col("dt") == b))
        known = known & fits
    return j.where(known).select("doc", "src", "dst", "type", F.lit("llm").alias("provenance")), j.where(~known).agg(F.count("*").alias("unresolved"))


def relations_of(parsed_: DataFrame) -> DataFrame:
    return parsed_.select("doc", "chunk", F.posexplode("relations").alias("pos", "r")).select("doc", "chunk", "pos", F.col("r.type").alias("type"), F.col("r.from").alias("from"), F.col("r.to").alias("to"))


def renames(entities: DataFrame, kept: DataFrame) -> DataFrame:
    """id, to: once for each id (id, key) that another (key, to) stands for, however many rows it has, so joins add no rows."""
    return entities.distinct().join(kept, "key").where("id <> to").select("id", "to")


def reconcile(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (pos, id, type, name, description, confidence) that share a name under several types become one: the most
    confident, with the longest description (first of equals); relations (pos, src, dst, type, ...) are pointed anew, without
    loops, first of repeats. Nothing changes where nothing is merged."""
    key = F.regexp_replace("id", r"^[^:]*:", "")
    sure = F.when(F.isnan("confidence"), F.lit(float("-inf"))).otherwise(F.col("confidence"))
    best = entities.groupBy(key.alias("key")).agg(
        F.max_by(F.struct("pos", "id", "type", "name", "confidence"), F.struct(sure, -F.col("pos"))).alias("e"),
        F.max_by("description", F.struct(F.length(F.coalesce("description", F.lit(""))), -F.col("pos"))).alias("longest"),
        F.count("*").alias("members"),
    )
    merged = best.select("e.pos", "e.id", "e.type", "e.name", F.col("longest").alias("description"), "e.confidence")
    renamed = renames(entities.select("id", key.alias("key")), best.select("key", F.col("e.id").alias("to")))
    if renamed.isEmpty():
        return entities, relations
    r = relations.join(renamed.toDF("src", "s2"), "src", "left").join(renamed.toDF("dst", "d2"), "dst", "left")
    r = r.withColumn("src", F.coalesce("s2", "src")).withColumn("dst", F.coalesce("d2", "dst")).drop("s2", "d2").where("src <> dst")
    rest = [c for c in relations.columns if c not in ("src", "dst", "type")]
    first = r.groupBy("src", "dst", "type").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("src", "dst", "type", "r.*")
    return merged, first.select(*relations.columns)


def extraction_digest(items: DataFrame, entities: DataFrame, unresolved: int, chunks: int) -> dict:
    n, m = items.count(), entities.count()
    out = {"mentions": n, "mentions_per_entity": round(n / m, 2) if m else 0, "chunks_processed": chunks}
    return out | ({"unresolved_relations": unresolved} if unresolved else {})


def layer_digest(entities: DataFrame, relations: DataFrame, sample: int = 12) -> dict:
    """Counts, counts by type, and the first entities (by pos where there is one), descriptions cut at 120."""
    order = [F.col(c) for c in ("doc", "pos", "id") if c in entities.columns]
    found = layer_digests(entities, relations).collect()
    by, rel = ({r["type"]: r["n"] for r in found if r["kind"] == kind} for kind in ("entity", "relation"))
    first = entities.orderBy(*order).limit(sample).select("type", "name", F.substring(F.coalesce("description", F.lit("")), 1, 120).alias("description")).collect()
    return {"entities": sum(by.values()), "by_type": by, "relations": sum(rel.values()), "by_relation": rel, "sample": [r.asDict() for r in first]}


def layer_digests(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind ("entity" or "relation"), type, n: what a layer made, by type."""
    tally = lambda d, kind: d.groupBy("type").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return tally(entities, "entity").unionByName(tally(relations, "relation"))


def promote(entities: DataFrame, mentions_: DataFrame, fields: dict[str, str]) -> DataFrame:
    """doc, src (chunk) and a column for each index field: the name of an entity of that type that the chunk mentions, cast to
    string, int or float (null where it isn't one)."""
    kinds = {"string": "string", "int": "int", "float": "float"}
    e = entities.select("doc", F.col("id").alias("dst"), F.col("type").alias("etype"), "name")
    j = mentions_.select("doc", "src", "dst").join(e, ["doc", "dst"]).where(F.col("etype").isin(list(fields)))
    return j.groupBy("doc", "src").agg(*[F.min(F.when(F.col("etype") == f, F.col("name"))).try_cast(kinds[k]).alias(f) for f, k in fields.items()])


def promoted(chunks: DataFrame, entities: DataFrame, mentions_: DataFrame, fields: dict[str, str]) -> DataFrame:
    """chunks (doc, index, ...) with `props`: a map of the index fields that have a value for the chunk (see `promote`), and of what
    `props` held before."""
    if not fields:
        return chunks
    found = promote(entities, mentions_, fields)
    own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f"p.`{f}`").cast("string") for f in fields])), lambda _, v: v.isNotNull())
    found = found.select("doc", "src", F.struct(*fields).alias("p")).select("doc", "src", own.alias("__props"))
    src = F.concat(F.lit("markdown_chunk:"), X.cite_hex(X.chunk_id(F.col("doc"), F.col("index"))))
    none = F.create_map().cast("map<string,string>")
    d = (chunks if "props" in chunks.columns else chunks.withColumn("props", none)).withColumn("src", src).join(found, ["doc", "src"], "left").drop("src")
    kept = F.map_filter(F.coalesce("props", none), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("__props", none)), k))
    return d.withColumn("props", F.map_concat(kept, F.coalesce("__props", none))).drop("__props")


def embed(items: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: Column, batch: int = 32, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """items with `embedding`, `batch` texts at a time. A provider that fails, or gives another number of vectors, `tries` times over
    fails the run."""
    import time

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for at in range(0, len(texts), batch):
            some = texts.iloc[at : at + batch].fillna("").tolist()
            for n in range(tries):
                try:
                    got = provider(some)
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                    break
                except Exception:
                    if n + 1 == tries:
                        raise
                    time.sleep(wait * (n + 1))
            out += got
        return pd.Series(out, index=texts.index)

    return items.withColumn("embedding", vectors(text))


def hashed_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for a model: signed hashes of words, of unit length. Its similarities are those of shared words only."""
    import zlib

    def vectors(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return vectors


def sparse_of(text: Column) -> Column:
    """Indices and weights of a text's words: hashed into 250,002 places, with their counts."""
    words = F.filter(F.split(F.lower(X.collapse(text)), " "), lambda w: w != "")
    places = F.array_sort(F.transform(words, lambda w: F.pmod(F.crc32(w), F.lit(250_002)).cast("int")))
    # of the sorted places, where each run of equals starts; a run's length is its weight
    starts = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i) != F.get(p, i - 1)))
    held = F.transform(F.array(F.struct(places.alias("p"))), lambda x: F.struct(x["p"].alias("p"), F.when(F.size(x["p"]) > 0, starts(x["p"])).otherwise(F.array().cast("array<int>")).alias("s")))
    made = F.transform(held, lambda x: F.struct(F.transform(x["s"], lambda i: F.get(x["p"], i)).alias("indices"), F.transform(x["s"], lambda i, k: (F.coalesce(F.get(x["s"], k + 1), F.size(x["p"])) - i).cast("float")).alias("weights")))
    return F.get(made, 0)
