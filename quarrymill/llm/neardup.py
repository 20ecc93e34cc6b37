"""Near-duplicate groups: min-max hashing, banding, exact confirmation, connected components.

A document's set is its distinct shingles of WORDS words (A-Z lower-cased); fewer words make one shingle of them all; no
words make an empty set, linked with nothing. Each of PERMUTATIONS random permutations gives two values of the signature,
its minimum and its maximum, so a signature of 64 values costs 32 evaluations; each agrees with probability J. Bands of
a few values make documents meet; whoever meets is confirmed on full sets.

Hot groups. Equal sets are first made one class, so a class costs one representative however many copies there are. A bucket
of a band is never listed: its members are held against one pivot, the member that meets most (copies meet their source more
often than each other), found by sums and maxima that combine before the shuffle. A pivot's members are
dealt over salted groups of SALT. Where that leaves a bucket in several components, its members are cut into chunks, each two
chunks meet in a task of their own, and what links are missing between components is found there; no pair leaves the task
unless it joins two components.

Defined cases: a null or empty text has no words; an empty table gives no rows; texts of any length are one set; other columns, whatever
their names, are neither read nor changed; null doc_ids form no links and are their own component (null); rows that repeat a
doc_id are judged by their own texts, and a doc_id on several texts is linked if any of them is; ties go to the smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, read_documents, staged, texts, width, word_list, words_hashed
from .components import components
from .spans import unsqueezed

WORDS = 5
PERMUTATIONS = 32
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(np.arange(101, PERMUTATIONS + 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Members of a pivot that one salted group holds; groups for which one row's text is copied in one task.
SALT, FAN = 256, 1024
#: Members of a bucket that are compared by signature with so many others in one task.
CHUNK = 1024


def lowered(text: str) -> list[str]:
    return word_list(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def shingles(text: str, cache: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    h = words_hashed(lowered(text), cache)
    if not len(h):
        return h
    k = min(WORDS, len(h))
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out + np.uint64(k))


def signature(s: np.ndarray) -> bytes:
    """Upper 32 bits of the minimum and maximum under each permutation; minima and maxima alternate."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(s), 8192):
        v = s[None, a : a + 8192] * _A[:, None] + _B[:, None]
        v ^= v >> np.uint64(33)
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return (np.stack([low, high], axis=1).reshape(-1) >> np.uint64(32)).astype("<u4").tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), h1 and h2 (its hash), sig (its signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache: dict[str, int] = {}
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, cache)
                raw = s.tobytes()
                n.append(len(s))
                h1.append(xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63))
                h2.append(xxhash.xxh3_64_intdigest(raw, 2) - (1 << 63))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, f.type) for x, f in zip((n, h1, h2, sig), list(_SIGNED)[1:], strict=True)]], schema=_SIGNED)

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def rows_of(threshold: float) -> int:
    """Values in a band: as many as leave a link at the threshold unmet with a probability below 1e-5."""
    for rows in (8, 6, 5, 4, 3, 2):
        if (1 - threshold**rows) ** (2 * PERMUTATIONS // rows) < 1e-5:
            return rows
    return 1


def bands(reps: DataFrame, rows: int) -> DataFrame:
    """doc, band and key: a row for each band of each signature."""
    each = [F.xxhash64(F.lit(i), F.substring("sig", 4 * rows * i + 1, 4 * rows)) for i in range(2 * PERMUTATIONS // rows)]
    return reps.select("doc", F.posexplode(F.array(*each)).alias("band", "key"))


def packed(docs: DataFrame) -> DataFrame:
    """key (doc_id) and packed: texts, compressed while they are dealt. They are always dealt, whatever joins them: what is
    wanted of them grows with the input."""
    schema = pa.schema([("key", pa.int64()), ("packed", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([z.compress(x.encode("utf-8", "surrogatepass")) for x in b.column("text").to_pylist()], pa.binary())], schema=schema)

    return docs.where("doc_id IS NOT NULL").mapInArrow(squeeze, "key long, packed binary")


def compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, common, either (sizes of intersection and union) of the full sets of each pair (a, b)."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    zero, last = F.lit(0).cast("long"), F.col("salts") - 1
    demand = salted.select(F.col("b").alias("key"), F.struct("a", "salt", F.lit(1).alias("role")).alias("for"))
    lead = many.where(F.col("salts") <= FAN).select(F.col("a").alias("key"), F.explode(F.sequence(zero, last)).alias("salt")).select("key", F.struct(F.col("key").alias("a"), "salt", F.lit(0).alias("role")).alias("for"))
    wanted = demand.unionByName(lead).groupBy("key").agg(F.collect_list("for").alias("for"))
    sent = packed(docs).join(wanted.hint("merge"), "key").select("key", "packed", F.explode("for").alias("for")).select("for.*", "key", "packed")
    hot = many.where(F.col("salts") > FAN)
    if not hot.isEmpty():  # a copy for each FAN groups, dealt, and then copied there for each group
        first = packed(docs).join(hot.select(F.col("a").alias("key"), "salts").hint("merge"), "key").withColumn("from", F.explode(F.sequence(zero, last, F.lit(FAN).cast("long"))))
        copies = first.repartition(width(docs.sparkSession), "key", "from").withColumn("salt", F.explode(F.sequence(F.col("from"), F.least(last, F.col("from") + FAN - 1))))
        sent = sent.unionByName(copies.select(F.col("key").alias("a"), "salt", F.lit(0).alias("role"), "key", "packed"))
    out = pa.schema([(c, pa.int64()) for c in ("a", "b", "common", "either")])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        now, own = None, []
        for b in batches:
            found = []
            for a, salt, role, key, text in zip(*[b.column(c).to_pylist() for c in ("a", "salt", "role", "key", "packed")], strict=True):
                s = shingles(unsqueezed(text).decode("utf-8", "surrogatepass"), cache)
                if now != (a, salt):
                    now, own = (a, salt), []
                if role == 0:
                    own.append(s)
                for x in own if role else ():
                    common = len(np.intersect1d(x, s, assume_unique=True))
                    found.append((a, key, common, len(x) + len(s) - common))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], schema=out)

    dealt = sent.repartition(width(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(hold, "a long, b long, common long, either long")


def unmet(docs: DataFrame, meets: DataFrame, labels: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between documents that share a bucket but no component yet: as many as join all that are linked.

    A bucket's members, with their texts, are cut into chunks of CHUNK; each two chunks meet in one task. There, pairs of unlike
    components whose signatures (at 4.5 standard deviations) and sizes allow a link are compared on full sets, the likeliest
    first; a pair that links found before have joined is passed over. A pair is looked at in the first band that it shares.
    """
    t, values = percent / 100, 2 * PERMUTATIONS
    least = t * values - 4.5 * (t * (1 - t) * values) ** 0.5
    rows = rows_of(t)
    own = meets.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / CHUNK).alias("chunks")).where("x < y")
    members = own.join(open_.select("key", "chunks"), "key")
    chunk = F.pmod(F.xxhash64("doc"), F.col("chunks"))
    tasks = members.select("key", "band", "doc", "component", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    wanted = tasks.groupBy("doc").agg(F.collect_list(F.struct("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "band", "component", "chunk")).alias("for"))
    wanted = wanted.join(reps.select("doc", "sig"), "doc")
    sent = packed(docs).join(wanted.withColumnRenamed("doc", "key").hint("merge"), "key").select(F.col("key").alias("doc"), "sig", "packed", F.explode("for").alias("for")).select("for.*", "doc", "sig", "packed")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links_of(group: list[tuple], cache: dict[str, int]) -> list[tuple[int, int]]:
        i, j, band = group[0][1:4]
        component, chunk, doc = (np.array([g[c] for g in group], np.int64) for c in (4, 5, 6))
        if len(np.unique(component)) < 2:
            return []
        sig = np.frombuffer(b"".join(g[7] for g in group), "<u4").reshape(len(group), values)
        keys = np.ascontiguousarray(sig[:, : values // rows * rows].reshape(len(group), -1, rows)[:, :band])
        left, right, alike = [], [], []
        for x in range(len(group)):
            if i != j and chunk[x] != i:
                continue
            y = np.arange(x + 1, len(group)) if i == j else np.flatnonzero(chunk == j)
            y = y[component[y] != component[x]]
            same = (sig[y] == sig[x]).sum(axis=1)
            y, same = y[same >= least], same[same >= least]
            if band and len(y):
                new = ~(keys[y] == keys[x]).all(axis=2).any(axis=1)
                y, same = y[new], same[new]
            left.append(np.full(len(y), x))
            right.append(y)
            alike.append(same)
        left, right, alike = np.concatenate(left), np.concatenate(right), np.concatenate(alike)
        sets: dict[int, np.ndarray] = {}

        def of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(unsqueezed(group[k][8]).decode("utf-8", "surrogatepass"), cache)
            return sets[k]

        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for k in np.argsort(-alike, kind="stable").tolist():
            x, y = int(left[k]), int(right[k])
            a, b = find(int(component[x])), find(int(component[y]))
            if a == b:
                continue
            s, u = of(x), of(y)
            if 100 * min(len(s), len(u)) < percent * max(len(s), len(u)):
                continue
            common = len(s) + len(u) - len(np.unique(np.concatenate([s, u])))
            if 100 * common >= percent * (len(s) + len(u) - common):
                root[max(a, b)] = min(a, b)
                found.append((int(doc[x]), int(doc[y])))
        return found

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, cache = None, [], {}

        def give() -> pa.RecordBatch:
            found = links_of(group, cache) if group else []
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 2)], schema=out)

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if r[:3] != now:
                    yield give()
                    now, group = r[:3], []
                group.append(r)
        yield give()

    dealt = sent.repartition(width(meets.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.select("key", "i", "j", "band", "component", "chunk", "doc", "sig", "packed").mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Sets with 100 * intersection >= percent * union are linked."""
    d = texts(docs)
    sets = staged(signed(d), "signed")
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = staged(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.min("sig").alias("sig")), "classes")
    reps = classes.select("doc", "sig")
    rows = bands(reps, rows_of(percent / 100))
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    meets = staged(rows.join(size, "key"), "meets")
    degree = meets.groupBy("doc").agg(F.sum("size").alias("degree"))
    top = meets.join(degree, "doc").groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("m"))).alias("top")).select("key", (-F.col("top.m")).alias("pivot"))
    first = staged(meets.join(top, "key").where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct(), "pairs")
    linked = F.expr(f"100 * common >= {percent} * either")
    held = staged(compared(d, first), "held").where(linked).select("a", "b")
    also = staged(unmet(d, meets, components(held).withColumnRenamed("node", "doc"), reps, percent), "more")
    labels = components(held.unionByName(also)).withColumnRenamed("node", "doc")
    of = classes.select("h1", "h2", "n", "doc").join(labels, "doc", "left").select("h1", "h2", "n", F.coalesce("component", "doc").alias("component"))
    named = full.select("doc_id", "h1", "h2", "n").join(of, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir), 85)


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document (the smallest doc_id) of each group; of several rows with that doc_id the one whose text is first in order of
    its characters stays, and of those with equal texts one. Null doc_ids stay."""
    kept = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).select(F.col("doc_id").alias("__id"))
    own = docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id").cast("long") == F.col("__id"))
    rest = [F.xxhash64(c) for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    first = F.row_number().over(W.partitionBy("__id").orderBy(F.col("text").asc_nulls_last(), *rest))
    return own.withColumn("__n", first).where("__n = 1").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
