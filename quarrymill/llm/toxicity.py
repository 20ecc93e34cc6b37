"""Toxicity of restored text: a noisy channel undoes leetspeak, spacing and repetition, then a lexicon scores the words.

Channel. A word may have had letters replaced by look-alikes (LEET), a letter repeated three times or more, or its letters set
apart by single spaces or marks. Every word with a letter and a look-alike, or with a letter three times running, is a lattice:
for each place the letters that it may have been, each at a cost; Viterbi finds the reading of greatest probability under a
character model (order 3, from charlm.py, of all texts) times the channel, in time linear in the word, whatever its length.
At a word's edges, marks that are also punctuation (EDGES) may be that, at a cost. Other words are read as they stand.
Readings are remembered by a worker, READINGS at most, each of at most LONGEST characters.

Score. For each word of the restored training texts (labels.toxic, rows whose crc32(doc_id) mod 3 is not 1), documents with it
are counted for each label (LABELS at most). The LEXICON words of greatest likelihood ratio whose log odds are at least STRONG in size are
kept, after PSEUDO documents of the prior's share; a text's log odds are the prior's plus those of its distinct words.

Defined cases: null and empty texts get the prior; without any label every score is 0.5 or less; a null doc_id is not held out;
documents without a label aren't learned from; several labels of one document count each; rows that repeat are
scored alike; of readings of equal cost the one found first stays; texts of any length are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import ORDER, SYMBOL, Kneser, _fold, collected, count_windows, lower
from .common import read_documents, small_batches, staged
from .langid import part

#: Look-alikes and what they may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h"}
SWAP, SAME, DROP, LOSE, JOIN, EDGE = 2.0, 0.05, 0.5, 7.0, 3.0, 1.0  # costs in nats
EDGES = "!(*#|+"
READINGS, LONGEST = 200_000, 200
LEXICON = 4096
STRONG = 2.0
FEWEST = 5
#: Labels learned from: all, up to this many; beyond, those of least hash of doc_id. So they can be broadcast (16 bytes each).
LABELS = 200_000
#: Documents of either label, in the share that they have, that every word is taken to have had besides.
PSEUDO = 4
_MARKS = "".join(map(re.escape, LEET))
_MARK = re.compile(rf"[{_MARKS}]")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1\1")
#: Three single letters or more, each two of them a single space or mark apart.
_APART = re.compile(rf"(?<![\w{_MARKS}])(?:[^\W_]|[@$!])(?:[ .\-_*·][^\W_]|[ .\-_*·][@$!]){{2,}}(?![\w{_MARKS}])")
_WORD = re.compile(r"[^\W\d_]+")
#: What stands at a word's edges and is no look-alike.
_EDGE = re.compile(rf"^[^\w{_MARKS}]+|[^\w{_MARKS}]+$")


class Reader:
    """The character model as sorted windows of one to three letters, and the decoder."""

    def __init__(self, model: Kneser | None):
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.floor = -SYMBOL * math.log(2)
        if model is not None:
            for k in (3, 2, 1):
                keys = model.p[k][0]
                self.keys.append(keys)
                self.logs.append(np.log(model.probability(k, keys)).astype(np.float32))
        self.near: dict[tuple[int, int, int], float] = {}
        self.known: dict[str, str] = {}

    def next(self, a: int, b: int, c: int) -> float:
        p = self.near.get((a, b, c))
        if p is None:
            if len(self.near) >= READINGS:
                self.near.clear()
            key, p = (a << 2 * SYMBOL) | (b << SYMBOL) | c, self.floor - 2.0
            for back, (keys, logs) in enumerate(zip(self.keys, self.logs, strict=True)):
                w = np.uint64(key & (1 << SYMBOL * (3 - back)) - 1)
                i = int(np.searchsorted(keys, w))
                if i < len(keys) and keys[i] == w:
                    p = float(logs[i]) - back
                    break
            self.near[a, b, c] = p
        return p

    def decode(self, places: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """Best reading of a lattice and its cost for each letter; "" at a place drops it."""
        fold = _fold()
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # cost, and letters linked backwards
        for options in [*places, [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, read) in best.items():
                for letter, price in options:
                    if letter == "":
                        state, c, link = (a, b), cost + price, read
                    else:
                        s = int(fold[ord(letter)])
                        state, c, link = (b, s), cost + price - self.next(a, b, s), (read, letter)
                    if state not in new or c < new[state][0]:
                        new[state] = (c, link)
            best = new
        cost, link = min(best.values(), key=lambda x: x[0])
        letters = []
        while link is not None:
            link, letter = link
            letters.append(letter)
        return "".join(reversed(letters)).strip(), cost / max(1, len(letters))

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        places: list[list[tuple[str, float]]] = []
        inner = word.strip(EDGES)
        first = len(word) - len(word.lstrip(EDGES)) if inner else 0
        last = first + len(inner) if inner else len(word)
        i = 0
        while i < len(word):
            c, j = word[i], i
            while j < len(word) and word[j] == c:
                j += 1
            options = [(c, SAME)] if c.isalpha() else []
            options += [(x, SWAP) for x in LEET.get(c, "")]
            if not c.isalpha():
                options.append(("", LOSE if first <= i < last else EDGE))
            places.append(options)
            if j - i == 2:
                places.append(options)
            elif j - i > 2:
                places.append([*options, ("", DROP)])
            i = j
        return places

    def remember(self, text: str, read: str) -> str:
        if len(text) <= LONGEST:
            if len(self.known) >= READINGS:
                self.known.clear()
            self.known[text] = read
        return read

    def word(self, word: str) -> str:
        """A word as it reads; it stays as it is if it can't have been disguised."""
        got = self.known.get(word)
        if got is None:
            core = _EDGE.sub("", word)
            odd = _RUN.search(core) or _MARK.search(core) and _LETTER.search(core)
            got = self.remember(word, self.decode(self.lattice(core))[0] if odd else word)
        return got

    def joined(self, m: re.Match) -> str:
        """Letters set apart, as one word if that reads better than single letters."""
        text = m.group()
        got = self.known.get(text)
        if got is None:
            letters = text[::2]
            read, cost = self.decode(self.lattice(letters))
            single = -sum(self.next(0, 0, int(_fold()[ord(c)])) + self.next(0, int(_fold()[ord(c)]), 0) for c in letters)
            got = self.remember(text, read if cost * max(1, len(read)) < single + JOIN else text)
        return got

    def restore(self, text: str) -> str:
        text = text.lower()
        text = _APART.sub(self.joined, text)
        run = _RUN.search(text)
        if run is None and _MARK.search(text) is None:
            return text
        return " ".join(w if run is None and w.isalpha() else self.word(w) for w in text.split())


def words(text: str) -> set[str]:
    return set(_WORD.findall(text))


def reader(docs: DataFrame) -> Reader:
    """A reader whose model has every window of three symbols of all texts. Only these, and the shorter ones that end them, come
    to the driver; they are counted by what stands before them, from all windows of ORDER symbols, where those are."""
    counts = staged(count_windows(docs.where("text IS NOT NULL").select(F.lit("all").alias("class"), "text")), "windows")
    for k in range(ORDER - 1, 2, -1):
        counts = lower(counts, k)
    own = collected(counts).get("all")
    return Reader(Kneser(*own, (int((own[1] == 1).sum()), int((own[1] == 2).sum())), order=3) if own else None)


def lexicon(labelled: DataFrame, shared) -> tuple[float, dict[str, float]]:
    """Prior log odds and the log odds of the words kept; labelled: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # one a worker, with what it remembers
        held: dict[str, list[int]] = {}

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["word", "clean", "toxic"])
            held.clear()
            return out

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                for w in words(own.restore(text or "")):
                    held.setdefault(w, [0, 0])[toxic] += 1
                held.setdefault("", [0, 0])[toxic] += 1  # the empty word stands for the document
                if len(held) > 500_000:
                    yield give()
        yield give()

    counts = staged(labelled.select("text", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic")).mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-counts")
    total = counts.where("word = ''").head()
    if total is None or not total["clean"] or not total["toxic"]:
        return -math.log(9), {}
    c, t = total["clean"], total["toxic"]
    share = t / (t + c)
    odds = F.log((F.col("toxic") + PSEUDO * share) / (F.col("clean") + PSEUDO * (1 - share))) - math.log(t / c)
    p = (F.col("toxic") + F.col("clean")) / (t + c)
    half = lambda x, n: F.when(x > 0, x * F.log(x / (n * p))).otherwise(F.lit(0.0))
    ratio = half(F.col("toxic"), t) + half(F.col("clean"), c)
    kept = counts.where("word <> ''").where(F.col("toxic") + F.col("clean") >= FEWEST).select("word", odds.alias("odds"), ratio.alias("ratio"))
    kept = kept.where((F.abs("odds") >= STRONG) & (F.col("ratio") >= 12)).orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()
    return math.log(t / c), {r["word"]: r["odds"] for r in kept}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, restored."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", part(F.col("doc_id"), 3).alias("part"))
    spark = d.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(reader(d))
    marked = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    marked = marked.where(part(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(LABELS)
    prior, odds = lexicon(d.where("part <> 1").join(F.broadcast(marked), "doc_id"), shared)
    scores = spark.sparkContext.broadcast((prior, odds))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (base, of) = shared.value, scores.value
        for b in batches:
            score = []
            for text in b.column("text").to_pylist():
                z = base + sum(of[w] for w in words(own.restore(text or "")) if w in of)
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x == 1 for x in b.column("part").to_pylist()]), pa.array(score, pa.float64()), pa.array([int(x >= 0.7) for x in score], pa.int32())], schema=schema
            )

    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
