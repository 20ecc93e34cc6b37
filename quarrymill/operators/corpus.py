"""The corpus in its four tables: staged versions, upserts, removals, orphans.

Tables live under one folder, each in BUCKETS parts: chunks and relations by the hash of their document, entities by that of their
id. A commit writes anew only the parts that it changes, beside the old ones, and then adds the next numbered manifest, which names the
parts that count. So a reader sees all of a commit or none. A manifest can be added once only: of two writers that began from the same
one, the second begins again. Parts that no recent manifest names are removed by `vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.files import create_small, list_folders, list_small, read_small, remove_tree
from .store import empty, staged

SCHEMAS = {
    "chunks": "doc string, chunk_id string, text string, source_path string, section_path string, page_no int, regions_json string, cite_hex string, embedding array<float>, sidx array<int>, swt array<float>, origin string, props map<string, string>",
    "entities": "id string, label string, type string, properties_json string, project_ids array<string>, embedding array<float>, pagerank double, doc_path string",
    "relates": "doc string, src string, dst string, type string, weight float, similarity float, similarity_band string, provenance string",
}
#: The column whose hash tells a row's part.
KEYS = {"chunks": "doc", "entities": "id", "relates": "doc"}
BUCKETS = 32
STRUCTURAL = ("markdown_doc", "markdown_chunk", "community", "community_summary")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Stored rows of chunks (doc, index, text, section_path and what else there is)."""
    has = lambda c, kind: F.col(c).cast(kind) if c in chunks.columns else F.lit(None).cast(kind)
    cid = X.chunk_id(F.col("doc"), F.col("index"))
    regions = F.to_json("regions") if "regions" in chunks.columns else F.lit(None).cast("string")
    return chunks.select(
        "doc", cid.alias("chunk_id"), "text", F.col("doc").alias("source_path"), "section_path", has("page_no", "int").alias("page_no"), regions.alias("regions_json"), X.cite_hex(cid).alias("cite_hex"),
        has("embedding", "array<float>").alias("embedding"), has("sidx", "array<int>").alias("sidx"), has("swt", "array<float>").alias("swt"), has("origin", "string").alias("origin"), has("props", "map<string,string>").alias("props"),
    )


def structural_rows(chunks: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Document and chunk entities of stored chunks, and the chunked_into edges between them."""
    empty = lambda *c: [F.lit(None).cast(k).alias(n) for n, k in c]
    rest = empty(("embedding", "array<float>"), ("pagerank", "double"))
    ent = lambda i, label, kind, props, path: [i.alias("id"), label.alias("label"), F.lit(kind).alias("type"), props.alias("properties_json"), F.array(F.lit(project)).alias("project_ids"), *rest, path.alias("doc_path")]
    did = F.concat(F.lit("markdown_doc:"), F.col("doc"))
    cid = F.concat(F.lit("markdown_chunk:"), F.col("cite_hex"))
    docs = chunks.select("doc").distinct().select(*ent(did, F.col("doc"), "markdown_doc", F.to_json(F.struct(F.col("doc").alias("doc_path"))), F.col("doc")))
    props = F.to_json(F.struct(F.col("doc").alias("doc_path"), "chunk_id", "section_path"))
    own = chunks.select(*ent(cid, F.col("chunk_id"), "markdown_chunk", props, F.col("doc")))
    edges = chunks.select("doc", did.alias("src"), cid.alias("dst"), F.lit("chunked_into").alias("type"), *empty(("weight", "float"), ("similarity", "float"), ("similarity_band", "string"), ("provenance", "string")))
    return docs.unionByName(own), edges


def thematic_rows(entities: DataFrame, project: str) -> DataFrame:
    """Stored rows of entities, with their pagerank and embedding where they have them; a column `order` stays."""
    props = F.to_json(F.struct("description", "confidence"))
    vector = F.col("embedding").cast("array<float>") if "embedding" in entities.columns else F.lit(None).cast("array<float>")
    return entities.select("id", F.col("name").alias("label"), "type", props.alias("properties_json"), F.array(F.lit(project)).alias("project_ids"), vector.alias("embedding"), (F.col("pagerank") if "pagerank" in entities.columns else F.lit(None)).cast("double").alias("pagerank"), F.lit(None).cast("string").alias("doc_path"), *[c for c in ("order",) if c in entities.columns])


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None, most_confident: bool = False) -> DataFrame:
    """old with new's rows put over it by key: only values that aren't null overwrite; among new rows of a key the last that has
    a value (by the column `order`; without one, the greatest value) gives it. most_confident: a description of less confidence than
    the old one is not taken."""
    columns = [c for c in old.columns if c != key]
    n, o = new, order
    last = n.groupBy(key).agg(*[(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(o, c))) if o else F.max(c)).alias(c) for c in columns])
    j = old.alias("a").join(last.alias("b"), key, "full_outer")
    values = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in columns}
    if most_confident and "properties_json" in columns:
        sure = lambda t: F.get_json_object(f"{t}.properties_json", "$.confidence").try_cast("double")
        values["properties_json"] = F.when(F.coalesce(sure("a"), F.lit(-1.0)) > F.coalesce(sure("b"), F.lit(-1.0)), F.coalesce("a.properties_json", "b.properties_json")).otherwise(values["properties_json"])
    return j.select(F.col(key), *[values[c].alias(c) for c in columns]).select(*old.columns)


def edges_between(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which both ends are entities; parallel ones stay."""
    ids = entities.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def orphans(entities: DataFrame, relates: DataFrame) -> DataFrame:
    """ids of thematic entities that no `mentions` edge leads to."""
    themes = entities.where(~F.col("type").isin(*STRUCTURAL)).select("id")
    return themes.join(relates.where("type = 'mentions'").select(F.col("dst").alias("id")), "id", "left_anti")


def remove_documents(tables: dict[str, DataFrame], docs: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the documents' own chunks (origin null), entities and relations, and without what that orphans; and doc,
    chunks_removed."""
    names = docs.select("doc").distinct()
    own = tables["chunks"].where("origin IS NULL").join(names, "doc", "left_semi")
    counts = names.join(own.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").select("doc", F.coalesce("n", F.lit(0)).alias("chunks_removed"))
    kept = tables["chunks"].where("origin IS NOT NULL").unionByName(tables["chunks"].where("origin IS NULL").join(names, "doc", "left_anti"))
    path = names.withColumnRenamed("doc", "doc_path")
    entities = tables["entities"].join(path, "doc_path", "left_anti").select(*tables["entities"].columns)
    relates = tables["relates"].join(names, "doc", "left_anti").select(*tables["relates"].columns)
    return {"chunks": kept, "entities": entities, "relates": relates}, counts


def collect_orphans(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    lost = orphans(tables["entities"], tables["relates"])
    entities = tables["entities"].join(lost, "id", "left_anti").select(*tables["entities"].columns)
    relates = tables["relates"]
    for end in ("src", "dst"):
        relates = relates.join(lost.withColumnRenamed("id", end), end, "left_anti")
    return tables | {"entities": entities, "relates": relates.select(*tables["relates"].columns)}


def totals(counters: DataFrame, column: str = "counters") -> DataFrame:
    """key, total of a column of maps."""
    return counters.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("total"))


def lost_by(tables: dict[str, DataFrame], candidates: DataFrame) -> DataFrame:
    """Those of the candidates (id) that no `mentions` edge leads to: orphans, given that there were none before."""
    return candidates.distinct().join(tables["relates"].where("type = 'mentions'").select(F.col("dst").alias("id")), "id", "left_anti")


class Conflict(Exception):
    """Another writer has committed in between."""


class Corpus:
    """Reads and commits the tables under a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifests(self) -> list[str]:
        return list_small(self.spark, f"{self.path}/manifests", ".json")

    def manifest(self) -> dict:
        """version, buckets, and for each table the folder of each part that has one."""
        last = self._manifests()[-1:]
        return json.loads(read_small(self.spark, last[0])) if last else {"version": 0, "buckets": self.buckets, "tables": {t: {} for t in SCHEMAS}}

    def _part(self, manifest: dict, key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")

    def _parts(self, manifest: dict, rows: DataFrame, key: str) -> list[int]:
        """The parts that rows belong to: at most as many as there are."""
        return sorted(r[0] for r in rows.select(self._part(manifest, key)).distinct().collect())

    def _table(self, manifest: dict, t: str, parts: list[int] | None = None) -> DataFrame:
        now = manifest["tables"][t]
        wanted = [now[k] for k in now if parts is None or int(k) in parts]
        return self.spark.read.schema(SCHEMAS[t]).parquet(*[f"{self.path}/{w}" for w in wanted]) if wanted else empty(self.spark, SCHEMAS[t])

    def tables(self) -> dict[str, DataFrame]:
        """The tables that count now; empty ones before the first commit."""
        now = self.manifest()
        return {t: self._table(now, t) for t in SCHEMAS}

    def swap(self, manifest: dict, changed: dict[str, tuple[list[int], DataFrame]]) -> None:
        """Write parts of tables anew (whole, as given) and add the manifest that names them."""
        tables = {t: dict(parts) for t, parts in manifest["tables"].items()}
        for t, (parts, d) in changed.items():
            version = f"data/{t}-{uuid.uuid4().hex[:12]}"
            kinds = T.StructType.fromDDL(SCHEMAS[t])
            rows = d.select(*[F.col(f.name).cast(f.dataType) for f in kinds], self._part(manifest, KEYS[t]).alias("part"))
            # a part may be large: its rows are dealt over as many tasks as their size calls for
            rows.hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/{version}")
            there = {int(x.removeprefix("part=")) for x in list_folders(self.spark, f"{self.path}/{version}") if x.startswith("part=")}
            for k in parts:
                tables[t].pop(str(k), None)
            tables[t] |= {str(k): f"{version}/part={k}" for k in sorted(there)}
        new = manifest | {"version": manifest["version"] + 1, "tables": tables}
        if not create_small(self.spark, f"{self.path}/manifests/{new['version']:010d}.json", json.dumps(new)):
            raise Conflict(f"version {new['version']} of {self.path} was committed by another writer")

    def _again(self, attempt, tries: int = 5):
        for i in range(tries):
            try:
                return attempt()
            except Conflict:
                if i + 1 == tries:
                    raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests but the last `keep`, and parts that these don't name. Not while others write. Returns the folders removed."""
        files = self._manifests()
        named = {w.split("/")[1] for f in files[-keep:] for parts in json.loads(read_small(self.spark, f))["tables"].values() for w in parts.values()}
        for f in files[:-keep]:
            remove_tree(self.spark, f)
        gone = [x for x in list_folders(self.spark, f"{self.path}/data") if x not in named]
        for x in gone:
            remove_tree(self.spark, f"{self.path}/data/{x}")
        return len(gone)

    def _replaced(self, now: dict, names: DataFrame, rows: DataFrame | None, new: DataFrame | None, rel: DataFrame | None, most_confident: bool) -> tuple[dict, dict[str, int]]:
        """What `swap` takes to put documents (names) in the place of what they were, and a report. Reads the documents' parts; looks at
        all edges for what may be orphaned, and writes no other parts than those that change."""
        of_docs = self._parts(now, names, "doc")
        old_chunks, old_rel = self._table(now, "chunks", of_docs), self._table(now, "relates", of_docs)
        left = remove_documents({"chunks": old_chunks, "entities": self._table(now, "entities", []), "relates": old_rel}, names)
        counts = staged(left[1], "replaced")
        gone_rel = old_rel.join(names, "doc", "left_semi")
        own = old_chunks.where("origin IS NULL").join(names, "doc", "left_semi").select(F.concat(F.lit("markdown_chunk:"), "cite_hex").alias("id"))
        touched = own.unionByName(names.select(F.concat(F.lit("markdown_doc:"), "doc").alias("id")))
        candidates = gone_rel.where("type = 'mentions'").select(F.col("dst").alias("id"))
        if new is not None:
            touched = touched.unionByName(new.select("id"))
            candidates = candidates.unionByName(new.where(~F.col("type").isin(*STRUCTURAL)).select("id"))
        candidates = staged(candidates.distinct(), "candidates")
        parts = self._parts(now, touched.unionByName(candidates), "id")
        entities = remove_documents({"chunks": self._table(now, "chunks", []), "entities": self._table(now, "entities", parts), "relates": self._table(now, "relates", [])}, names)[0]["entities"]
        merged = upsert(entities, new, order="order", most_confident=most_confident) if new is not None else entities
        merged = staged(merged, "merged")
        kept_rel = left[0]["relates"]
        if rel is not None:
            known = self._table(now, "entities").select("id").join(entities.select("id").unionByName(touched), "id", "left_anti").unionByName(merged.select("id"))
            edges = staged(edges_between(rel, known).select(*kept_rel.columns), "edges")
            kept_rel = kept_rel.unionByName(edges)
        others = self._table(now, "relates", [int(k) for k in now["tables"]["relates"] if int(k) not in of_docs])
        themes = candidates.join(merged.where(F.col("type").isin(*STRUCTURAL)).select("id"), "id", "left_anti")
        lost = staged(lost_by({"relates": kept_rel.unionByName(others)}, themes), "lost")
        hit = others.join(lost.withColumnRenamed("id", "src"), "src", "left_semi").select("doc").unionByName(others.join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi").select("doc"))
        more = self._parts(now, hit, "doc")
        edges_now = kept_rel.unionByName(self._table(now, "relates", more))
        for end in ("src", "dst"):
            edges_now = edges_now.join(lost.withColumnRenamed("id", end), end, "left_anti")
        chunks = left[0]["chunks"] if rows is None else left[0]["chunks"].unionByName(rows)
        report = {"replaced": counts.agg(F.sum("chunks_removed")).head()[0] or 0, "orphans": merged.join(lost, "id", "left_semi").count()}
        if rel is not None:
            report["relations"] = edges.count()
        return {"chunks": (of_docs, chunks), "entities": (parts, merged.join(lost, "id", "left_anti")), "relates": (sorted({*of_docs, *more}), edges_now.select(*old_rel.columns))}, report

    def commit(self, docs: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, project: str, most_confident: bool = False) -> dict[str, int]:
        """Put documents (doc) in the place of what they were. chunks: doc, index, ...; entities: doc, id, type, name,
        description, confidence, and perhaps pos, their place in the document; relations: doc, src, dst, type, ... Of several rows for
        an entity the last by (doc, pos) counts. A commit changes all tables or none."""
        names = staged(docs.select("doc").distinct(), "names")
        rows = staged(chunk_rows(chunks), "rows")
        own, links = structural_rows(rows, project)
        order = lambda doc, pos: F.struct(doc.cast("string").alias("doc"), pos.cast("long").alias("pos")).alias("order")
        pos = F.col("pos") if "pos" in entities.columns else F.lit(None)
        themes = thematic_rows(entities.withColumn("order", order(F.col("doc"), pos)), project)
        new = staged(own.withColumn("order", order(F.lit(None), F.lit(None))).unionByName(themes), "new")
        has = lambda c, k: F.col(c).cast(k) if c in relations.columns else F.lit(None).cast(k)
        rel = relations.select("doc", "src", "dst", "type", has("weight", "float").alias("weight"), has("similarity", "float").alias("similarity"), has("similarity_band", "string").alias("similarity_band"), has("provenance", "string").alias("provenance"))
        rel = staged(links.unionByName(rel), "relations")

        def attempt() -> dict[str, int]:
            now = self.manifest()
            changed, found = self._replaced(now, names, rows, new, rel, most_confident)
            self.swap(now, changed)
            return found

        found = self._again(attempt)
        report = {"chunks": rows.count(), "entities": new.count(), "relations": found["relations"]}
        return report | ({"replaced": found["replaced"]} if found["replaced"] else {})

    def remove(self, docs: DataFrame) -> dict[str, int]:
        names = staged(docs.select("doc").distinct(), "names")

        def attempt() -> dict[str, int]:
            now = self.manifest()
            changed, found = self._replaced(now, names, None, None, None, False)
            self.swap(now, changed)
            return {"chunks_removed": found["replaced"], "orphans_removed": found["orphans"]}

        return self._again(attempt)
