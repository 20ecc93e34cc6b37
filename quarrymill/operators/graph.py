"""Similarity links, PageRank, Louvain communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .store import staged

#: Vectors of a block; two blocks meet in a task, which multiplies STRIP rows of one by the other at a time.
BLOCK, STRIP = 2048, 256
#: Dot products that a search holds at once.
CELLS = 2_000_000


def similar_pairs(items: DataFrame, floor: float = 0.65, bands=X.BANDS, by: str | None = None) -> DataFrame:
    """a, b, dot (a before b by pos) of items (id, pos, embedding) with dot >= floor; with `by`, only within equal values of that
    column, which comes first in the result.

    Items are dealt over blocks by a hash of their id, as many as their number calls for; each two blocks meet in one task. So work is
    quadratic, as the exact result demands, but no row stands for a pair that isn't one, and no task holds more than a few blocks. With
    `by`, a vector is sent once for each block of its group.
    """
    own = items.where("embedding IS NOT NULL AND size(embedding) > 0").select((F.col(by) if by else F.lit("")).alias("by"), "id", F.col("pos").cast("long").alias("pos"), "embedding")
    if not by:
        return _all_pairs(own, floor).drop("by")
    own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    sizes = own.groupBy("by").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = own.join(sizes, "by")
    meets = own.withColumn("block", F.pmod(F.xxhash64("id", "pos"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tasks = meets.select("by", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "pos", "embedding")

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        i, j, key = f["i"].iloc[0], f["j"].iloc[0], f["by"].iloc[0]
        f = f.sort_values(["pos", "id"], kind="stable")
        left, right = f[f["block"] == i], f[f["block"] == j]
        found = [pd.DataFrame({"by": key, **x}) for x in _met(*[[c[n].to_numpy() for n in ("pos", "id", "embedding")] for c in (left, right)], i == j, floor)]
        return pd.concat(found) if found else pd.DataFrame({"by": [], "a": [], "b": [], "dot": []})

    kind, group = items.schema["id"].dataType.simpleString(), items.schema[by].dataType.simpleString()
    return tasks.groupBy("by", "i", "j").applyInPandas(meet, f"by {group}, a {kind}, b {kind}, dot double").withColumnRenamed("by", by)


def _met(left: list, right: list, same: bool, floor: float) -> Iterator[dict]:
    """Pairs of two blocks (pos, id, embedding), STRIP rows of the left one at a time."""
    (pl, il, vl), (pr, ir, vr) = left, right
    wide = max(map(len, [*vl, *vr]), default=0)
    grid = lambda x: np.array([np.pad(np.asarray(v, float), (0, wide - len(v))) for v in x]).reshape(len(x), wide)
    rows, columns = grid(vl), grid(vr)
    for at in range(0, len(rows), STRIP):
        with np.errstate(invalid="ignore"):
            dots = rows[at : at + STRIP] @ columns.T
            a, b = np.nonzero(dots >= floor)
        dot, a = dots[a, b], a + at
        before = pl[a] < pr[b]
        k = before if same else pl[a] != pr[b]
        a, b, dot, before = a[k], b[k], dot[k], before[k]
        yield {"a": np.where(before, il[a], ir[b]), "b": np.where(before, ir[b], il[a]), "dot": dot}


def _all_pairs(own: DataFrame, floor: float) -> DataFrame:
    """`similar_pairs` without `by`: blocks are staged, one row each, and the product of that table with itself is read from its files, so
    what is shuffled and written for it grows with the vectors, and only what is read with their square."""
    blocks = max(1, -(-own.count() // BLOCK))
    block = F.pmod(F.xxhash64("id", "pos"), F.lit(blocks)).cast("long")
    packed = own.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "embedding"))).alias("v"))
    packed = staged(packed.select("block", F.col("v.pos").alias("pos"), F.col("v.id").alias("id"), F.col("v.embedding").alias("embedding")).repartition(blocks), "blocks")
    one = lambda n: packed.select(*[F.col(c).alias(f"{c}{n}") for c in packed.columns])
    kind = own.schema["id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                of = lambda c: b.column(b.schema.get_field_index(c))[n].values  # noqa: B023, E731
                i, j = b.column(0)[n].as_py(), b.column(b.schema.get_field_index("block1"))[n].as_py()
                sides = [[of(f"pos{s}").to_numpy(), of(f"id{s}").to_numpy(zero_copy_only=False), of(f"embedding{s}").to_numpy(zero_copy_only=False)] for s in (0, 1)]
                ids = of("id0").type
                for x in _met(*sides, i == j, floor):
                    yield pa.RecordBatch.from_arrays([pa.array(x["a"], ids), pa.array(x["b"], ids), pa.array(x["dot"], pa.float64())], names=["a", "b", "dot"])

    met = one(0).crossJoin(one(1)).where("block0 <= block1").mapInArrow(meet, f"a {kind}, b {kind}, dot double")
    return met.withColumn("by", F.lit(""))


def similar_to(items: DataFrame, threshold: float = 0.75, bands=X.BANDS, compat: bool = False, by: str | None = None) -> DataFrame:
    """Relations: src, dst, type, similarity, similarity_band, weight, provenance, and `by` if given. compat: the threshold only lowers
    the floor."""
    least = min(low for _, low, _ in bands)
    floor = min(threshold, least) if compat else max(threshold, least)
    pairs = similar_pairs(items, floor, bands, by).withColumn("band", X.band_of(F.col("dot"), bands)).where("band IS NOT NULL")
    return pairs.select(
        *([by] if by else []), F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SIMILAR_TO").alias("type"), F.round("dot", 5).alias("similarity"), F.col("band").alias("similarity_band"), X.weight_of(F.col("band"), bands).alias("weight"), F.lit("derived").alias("provenance")
    )


def band_counts(pairs: DataFrame, bands=X.BANDS) -> DataFrame:
    return pairs.withColumn("band", X.band_of(F.col("dot"), bands)).where("band IS NOT NULL").groupBy("band").agg(F.count("*").alias("pairs"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """node, pagerank of a directed graph (src, dst), parallel edges counting. Ranks of nodes without a way out are spread evenly.

    Ranks start at 1 / n. Lineage is cut every few rounds by a table in the shared folder.
    """
    links = staged(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("many")), "links")
    degree = links.groupBy("src").agg(F.sum("many").alias("degree"))
    nodes = staged(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct().join(degree.withColumnRenamed("src", "node"), "node", "left"), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    ranks = nodes.select("node", "degree", F.lit(1.0 / n).alias("pagerank"))
    for i in range(rounds):
        given = links.join(ranks.where("degree > 0").withColumnRenamed("node", "src"), "src").select("dst", (F.col("pagerank") * F.col("many") / F.col("degree")).alias("part"))
        got = given.groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("part"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("pagerank"))), F.lit(0.0)).alias("lost"))
        new = (1 - damping) / n + damping * (F.coalesce("part", F.lit(0.0)) + F.col("lost") / n)
        ranks = nodes.join(got, "node", "left").crossJoin(F.broadcast(lost)).select("node", "degree", new.alias("pagerank"))  # lost is one row
        if i % every == every - 1 and i + 1 < rounds:
            ranks = staged(ranks, "ranks")
    return ranks.select("node", "pagerank")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (least node) of an undirected graph (src, dst), by minima of neighbours and of their components."""
    pairs = edges.where("src <> dst").select("src", "dst")
    both = staged(pairs.union(pairs.select("dst", "src")).distinct(), "neighbours")
    label = both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("component"))
    while True:
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        step = label.join(near, "node").select("node", F.least("component", "least").alias("to"), "component")
        jump = step.join(label.select(F.col("node").alias("to"), F.col("component").alias("further")), "to", "left")
        new = staged(jump.select("node", F.least("to", F.coalesce("further", "to")).alias("component"), F.col("component").alias("was")), "labels")
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label


def louvain_of(nodes: list, edges: list[tuple], passes: int = 20) -> dict:
    """Node to community of one weighted undirected graph: nodes in order of id, ties to the smallest community."""
    names = sorted(nodes)
    place = {v: i for i, v in enumerate(names)}
    ends = lambda k: np.fromiter((place[e[k]] for e in edges), np.int32, len(edges))
    own = louvain_places(len(names), ends(0), ends(1), np.fromiter((e[2] for e in edges), float, len(edges)), passes)
    return dict(zip(names, own.tolist(), strict=True))


def summed(i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of equal (i, j), i <= j, as one, in order of their first; sums run in the order given."""
    i, j = np.minimum(i, j), np.maximum(i, j)
    key = i.astype(np.int64) << 32 | j
    o = np.argsort(key, kind="stable")
    new = np.ones(len(o), bool)
    new[1:] = key[o][1:] != key[o][:-1]
    del key
    first = o[new]
    if len(first) == len(o):
        return i, j, w
    total = np.bincount(np.cumsum(new) - 1, w[o], len(first))
    o = np.argsort(first)
    first = first[o]
    return i[first], j[first], total[o]


def louvain_places(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, passes: int = 20) -> np.ndarray:
    """`louvain_of` of the nodes 0 to n - 1. Edges are columns and each node's neighbours a slice of sorted ones, about 80 bytes an edge at
    most; sums run in the order of the edges."""
    i, j, w = summed(i.astype(np.int32), j.astype(np.int32), w)
    own = np.arange(n)
    while True:
        loop = i == j
        inner = np.bincount(i[loop], w[loop], n)
        k = np.flatnonzero(~loop)
        src = np.empty(2 * len(k), np.int32)
        dst = np.empty(2 * len(k), np.int32)
        src[0::2], src[1::2], dst[0::2], dst[1::2] = i[k], j[k], j[k], i[k]
        o = np.argsort(src, kind="stable")
        weight = np.repeat(w[k], 2)[o]
        dst, src = dst[o], src[o]
        del o, k
        start = np.searchsorted(src, np.arange(n + 1)).tolist()
        degree = [sum(weight[a:z].tolist()) + 2 * x for a, z, x in zip(start[:-1], start[1:], inner.tolist(), strict=True)]
        del src
        total = sum(degree)
        at, size = np.arange(n, dtype=np.int32), degree[:]
        moved = False
        for _ in range(passes):
            change = False
            for v in range(n):
                a, z = start[v], start[v + 1]
                to: dict[int, float] = {}
                for c, x in zip(at[dst[a:z]].tolist(), weight[a:z].tolist(), strict=True):
                    to[c] = to.get(c, 0.0) + x
                d, was = degree[v], int(at[v])
                size[was] -= d
                best, most = was, to.get(was, 0.0) - d * size[was] / total if total else 0.0
                for c in sorted(to):
                    gain = to[c] - d * size[c] / total if total else 0.0
                    if gain > most + 1e-12:
                        best, most = c, gain
                size[best] += d
                change |= best != was
                at[v] = best
            moved |= change
            if not change:
                break
        if not moved:
            return own
        seen, first = np.unique(at, return_index=True)
        number = np.empty(n, np.int32)
        number[seen[np.argsort(first)]] = np.arange(len(seen), dtype=np.int32)
        own = number[at[own]]
        i, j, w = summed(number[at[i]], number[at[j]], w)
        n = len(seen)


def louvain(edges: DataFrame) -> DataFrame:
    """node, community (0..n-1, in order of the communities' least nodes) of weighted edges (src, dst, weight).

    Communities never cross connected components, so each component is clustered apart. A component is held in one task: the
    greedy moves depend on each other.
    """
    part = connected(edges)
    inside = edges.where("src <> dst").join(part.withColumnRenamed("node", "src"), "src").select("component", "src", "dst", F.col("weight").cast("double").alias("weight"))
    kind = edges.schema["src"].dataType.simpleString()

    def cluster(t: pa.Table) -> pa.Table:
        t = t.select(["src", "dst", "weight"]).combine_chunks()
        names = pc.unique(pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]))
        names = names.take(pc.sort_indices(names))
        i, j = (pc.index_in(t.column(c), value_set=names).to_numpy().astype(np.int32) for c in ("src", "dst"))
        w = t.column("weight").to_numpy()
        del t
        o = np.lexsort((j, i))
        own = louvain_places(len(names), i[o], j[o], w[o])
        least = np.full(int(own.max()) + 1, len(names))
        np.minimum.at(least, own, np.arange(len(names)))
        return pa.table({"node": names, "least": names.take(pa.array(least[own]))})

    found = staged(inside.groupBy("component").applyInArrow(cluster, f"node {kind}, least {kind}"), "communities")
    return numbered(found.withColumnRenamed("least", "old"))


def numbered(assigned: DataFrame) -> DataFrame:
    """node, community: old ids (old) become 0..n-1 in their order. Ids are ranked by ranges, not in one task."""
    ids = staged(assigned.select("old").distinct().repartitionByRange("old").sortWithinPartitions("old").select("old", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mono")), "ids")
    per = ids.groupBy("part").agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    from pyspark.sql import Window as W

    before = per.select("part", "first", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = ids.join(before, "part").select("old", (F.col("before") + F.col("mono") - F.col("first")).alias("community"))
    return assigned.join(number, "old").select("node", "community")


def modularity(edges: DataFrame, communities: DataFrame) -> float:
    c = communities.select("node", "community")
    e = edges.where("src <> dst").join(c.toDF("src", "cs"), "src").join(c.toDF("dst", "cd"), "dst")
    w = F.col("weight").cast("double")
    total = e.agg(F.sum(w)).head()[0] or 0.0
    if not total:
        return 0.0
    inside = e.where("cs = cd").agg(F.coalesce(F.sum(w), F.lit(0.0))).head()[0]
    degree = e.select(F.col("cs").alias("c"), w.alias("w")).union(e.select("cd", w)).groupBy("c").agg(F.sum("w").alias("d"))
    return inside / total - degree.agg(F.sum(F.pow(F.col("d") / (2 * total), 2))).head()[0]


def community_digest(communities: DataFrame) -> DataFrame:
    """One row: communities, the ten largest sizes, how many have one member."""
    sizes = communities.groupBy("community").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n")).limit(10).agg(F.sort_array(F.collect_list("n"), asc=False).alias("sizes"))
    return sizes.agg(F.count("*").alias("communities"), F.count_if(F.col("n") == 1).alias("singletons")).crossJoin(F.broadcast(top))  # one row each


def community_graph(communities: DataFrame, entities: DataFrame, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of communities: one entity each, member_of edges (weight 0), and for summaries (community, title,
    summary) of two members or more an entity and a summarizes edge. A blank summary goes; a blank title is the number."""
    cid = F.concat(F.lit("community:"), F.col("community").cast("string"))
    members = communities.join(entities.select(F.col("id").alias("node")), "node", "left_semi")
    ents = members.select("community").distinct().select(cid.alias("id"), F.lit("community").alias("type"), F.concat(F.lit("Community "), F.col("community").cast("string")).alias("label"), F.lit("").alias("description"))
    rels = members.select(F.col("node").alias("src"), cid.alias("dst"), F.lit("member_of").alias("type"), F.lit(0.0).alias("weight"), F.lit("derived").alias("provenance"))
    if summaries is not None:
        big = members.groupBy("community").agg(F.count("*").alias("n")).where("n >= 2")
        s = summaries.join(big, "community").where(X.strip(F.coalesce(F.col("summary"), F.lit(""))) != "")
        title = F.when(X.strip(F.coalesce(F.col("title"), F.lit(""))) != "", X.strip(F.col("title"))).otherwise(F.concat(F.lit("Community "), F.col("community").cast("string")))
        sid = X.entity_id(F.lit("community_summary"), title)
        ents = ents.unionByName(s.select(sid.alias("id"), F.lit("community_summary").alias("type"), title.alias("label"), X.strip(F.col("summary")).alias("description")))
        rels = rels.unionByName(s.select(sid.alias("src"), cid.alias("dst"), F.lit("summarizes").alias("type"), F.lit(None).cast("double").alias("weight"), F.lit("llm").alias("provenance")))
    return ents, rels


def greatest(best: tuple | None, ids: np.ndarray, dots: np.ndarray, k: int) -> tuple:
    """query (its place), id, dot: the k greatest for each query of those before (best) and of a strip (dots: a row for each id, a column
    for each query), the smallest ids among equals; NaN is greatest, as Spark orders it."""
    key = np.where(np.isnan(dots), np.inf, dots)
    least = np.partition(key, len(key) - k, axis=0)[len(key) - k] if len(key) > k else np.full(dots.shape[1], -np.inf)
    row, q = np.nonzero(key >= least)
    own = (q, ids[row], dots[row, q])
    q, i, d = own if best is None else (np.concatenate([x, y]) for x, y in zip(best, own, strict=True))
    o = np.lexsort((pd.factorize(i, sort=True)[0], -np.where(np.isnan(d), np.inf, d), ~np.isnan(d), q))
    q, i, d = q[o], i[o], d[o]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], i[rank < k], d[rank < k]


def nearest(items: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, id, rank, dot: the k items of greatest dot product with each query (a stated, counted set, broadcast in blocks)."""
    from pyspark.sql import Window as W

    total, found = queries.count(), None
    spark = items.sparkSession
    rows = queries.select("query", F.col("embedding").cast("array<double>").alias("embedding"))
    step = 10_000
    numbered_ = staged(rows.withColumn("__n", F.monotonically_increasing_id()), "queries") if total > step else rows
    for part in [numbered_] if total <= step else [numbered_.where(F.pmod(F.xxhash64("__n"), F.lit(-(-total // step))) == i) for i in range(-(-total // step))]:
        q = part.toPandas()
        shared = spark.sparkContext.broadcast((q["query"].to_numpy(), np.array(q["embedding"].tolist(), float)))
        kind = queries.schema["query"].dataType.simpleString()
        ikind = items.schema["id"].dataType.simpleString()

        def look(frames, shared=shared):
            names, grid = shared.value
            best = None
            for f in frames:
                for at in range(0, len(f) if len(names) else 0, max(1, CELLS // len(names))):
                    part = f.iloc[at : at + max(1, CELLS // len(names))]
                    best = greatest(best, part["id"].to_numpy(), np.array(part["embedding"].tolist(), float) @ grid.T, k)
            if best is not None:
                for at in range(0, len(best[0]), 100_000):
                    q, ids, dots = (x[at : at + 100_000] for x in best)
                    yield pd.DataFrame({"query": names[q], "id": ids, "dot": dots})

        one = items.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(look, f"query {kind}, id {ikind}, dot double")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("dot"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "id", "rank", "dot")
