"""Toxicity scores from an induced lexicon: random walks over a PPMI word graph.

Nodes of the graph are the whole words that a share of all documents holds,
labelled or not.  Seeds come from a bounded sample of labelled rows: words that
its toxic documents hold far more often than chance, and control words out of
the same documents that tell nothing.  An edge joins any
two nodes, weighted by the positive pointwise mutual information of
their co-occurrence at every distance within a window, over all documents
(``word_graph``).

Walks that restart at the toxic and at the clean seeds run over this graph
until they settle, which gives every word two visiting probabilities.  Their contrast is
the word's polarity, unless labelled documents refute it.  Beginnings that a whole family of polar words shares
(where many letters follow, and nearly all words are toxic) stand for family
members too rare to be nodes.  Documents are scored from the polarities of
their words by a logistic curve fitted on the labelled sample.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, largest, materialise, named, summed_arrays, texts
from .tokens import Remembered, in_worker
from .word_graph import coded, graph, kept_codes, walks
from .word_hashes import Hashes, Table

#: Labelled rows at most; toxic and clean seeds at most.
SAMPLE, SEEDS, CONTROLS = 40_000, 128, 256
#: Words on either side that co-occur; chance of a walk to restart; count at which a pair's evidence weighs half.
WINDOW, RESTART, DAMP = 20, 0.3, 8.0
#: A node's least share of all documents and least number of them (with a mean of 300 distinct words a document there are at
#: most 300 / SHARE nodes); rows of the graph that one task counts at most.
SHARE, LEAST, NODES_AT_ONCE = 2e-4, 10, 500_000
#: Polarity that counts; a stem's least and most letters, family members, letters that follow, share of toxic members.
CUT, STEM, FAMILY, FOLLOW, TOXIC_SHARE = 0.5, (4, 8), 6, 4, 0.9
_FLUSH, _PAIRS = 300_000, 4_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Words(Remembered):
    """What stands between white space, in lower case -> its words."""

    def make(self, piece: str) -> tuple[str, ...]:
        return (piece,) if piece.isalpha() else tuple(_WORD.findall(piece))


class Values(Remembered):
    """What stands between white space, in lower case -> the values of its words as 32-bit numbers."""

    def __init__(self, kind, value):
        super().__init__()
        self.kind, self.value = kind, value

    def make(self, piece: str) -> bytes:
        return np.array([self.value(w) for w in ((piece,) if piece.isalpha() else _WORD.findall(piece))], self.kind).tobytes()

    def of(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), self.kind)


class Codes:
    """Texts -> for each the numbers of its words among ``nodes``, -1 for others."""

    def __init__(self, nodes: list[str]):
        self.hashes = Hashes()
        self.table = Table(self.hashes.of_words(nodes), np.arange(len(nodes), dtype=np.int32), -1)

    def of_all(self, texts: list[str]) -> list[np.ndarray]:
        found = self.hashes.of(texts)
        return np.split(self.table.of(found.hashes), np.cumsum(found.counts)[:-1]) if texts else []


class Polarities:
    """Texts -> for each the polarities of its words, as ``Lexicon.of_word`` gives them."""

    def __init__(self, polarity: dict[str, float], stems: dict[str, float]):
        self.hashes = Hashes()
        self.words, self.stems = (Table(self.hashes.of_words(list(x)), np.array(list(x.values()), np.float32), none) for x, none in ((polarity, 0), (stems, np.nan)))
        self.any_stem = bool(stems)

    def of_all(self, texts: list[str]) -> list[np.ndarray]:
        found = self.hashes.of(texts)
        p = self.words.of(found.hashes)
        if self.any_stem:
            open_ = np.ones(len(p), bool)
            for at, beginning in self.hashes.prefixes(found, *STEM):
                of_stem = self.stems.of(beginning)
                hit = open_[at] & ~np.isnan(of_stem)
                p[at[hit]] = np.maximum(p[at[hit]], of_stem[hit])
                open_[at[hit]] = False
        return np.split(p, np.cumsum(found.counts)[:-1]) if texts else []

    def of(self, text: str) -> np.ndarray:
        return self.of_all([text])[0]


@dataclass
class Lexicon:
    """Polarity in [-1, 1] by word and by stem, and the curve from document features to a score."""

    polarity: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)

    def of_word(self, word: str) -> float:
        own = self.polarity.get(word, 0.0)
        if self.stems:
            for k in range(STEM[0], min(STEM[1], len(word) - 1) + 1):
                if word[:k] in self.stems:
                    return max(own, self.stems[word[:k]])
        return own

    def values(self) -> Polarities:
        return Polarities(self.polarity, self.stems)

    def features(self, p: np.ndarray) -> tuple[float, float, float]:
        found = p[p >= CUT]
        total = float(found.sum())
        return math.log1p(total), float(found.max()) if len(found) else 0.0, math.log1p(100.0 * total / max(1, len(p)))

    def score(self, p: np.ndarray) -> float:
        z = self.curve[0] + sum(c * v for c, v in zip(self.curve[1:], self.features(p)))
        return 1.0 / (1.0 + math.exp(-min(30.0, max(-30.0, z))))


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic): labels outside the held-out fifth, about ``sample`` of them at most, by hash of the id.

    A document labelled twice counts as toxic if either label says so; null
    ids and labels are passed over.
    """
    rows = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("int").alias("toxic")).dropna()
    once = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = materialise(once.where(~held_out("doc_id")))
    total = train.count()
    return train if total <= sample else train.where(F.pmod(F.xxhash64("doc_id"), F.lit(total)) < sample)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def tallies(labelled: DataFrame) -> DataFrame:
    """(word, df, toxic, clean): documents that hold the word, all and by label (null for most); word "" counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = in_worker("toxicity words", "", Hashes), np.zeros(1 << 20, np.uint64)
        names: dict[int, str] = {}
        held: tuple[list, list, list] = ([], [], [])  # words of all, toxic and clean documents, each once a document
        documents, waiting = [0, 0, 0], 0

        def rows() -> pa.RecordBatch:
            numbers, cols = None, []
            for k, x in enumerate(held):
                each, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *x]), return_counts=True)
                numbers = each if numbers is None else numbers
                cols.append(np.zeros(len(numbers) + 1, np.int64))
                cols[-1][np.searchsorted(numbers, each)], cols[-1][-1] = n, documents[k]
                documents[k] = 0
                x.clear()
            words = pa.array([*map(names.__getitem__, numbers.tolist()), ""], pa.string())
            names.clear()
            seen.fill(0)
            return pa.RecordBatch.from_arrays([words, *map(pa.array, cols)], ["word", "df", "toxic", "clean"])

        for b in batches:
            found = hashes.of(b.column(0).to_pylist())
            slot = found.hashes >> np.uint64(44)
            perhaps = np.flatnonzero(seen[slot] != found.hashes)
            number, first = np.unique(found.hashes[perhaps], return_index=True)
            seen[slot[perhaps]] = found.hashes[perhaps]
            new = np.array([k not in names for k in number.tolist()], bool)
            names.update(zip(number[new].tolist(), found.words(perhaps[first[new]])))
            ends = np.cumsum(found.counts)
            for low, high, label in zip((ends - found.counts).tolist(), ends.tolist(), b.column(1).to_pylist()):
                x = np.unique(found.hashes[low:high])
                waiting += len(x)
                for k in (0,) if label is None else (0, 1 if label else 2):
                    held[k].append(x)
                    documents[k] += 1
            if len(names) > _FLUSH or waiting > _PAIRS:
                yield rows()
                waiting = 0
        yield rows()

    each = labelled.select("text", "toxic").mapInArrow(run, "word string, df long, toxic long, clean long")
    return each.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("df", "toxic", "clean")])


def signed_g2(toxic, clean, n_toxic: float, n_clean: float):
    """Log-likelihood ratio of a term's rate in toxic against clean documents, negative if lower."""
    n = n_toxic + n_clean
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    both = toxic + clean
    e_t, e_c = both * (n_toxic / n), both * (n_clean / n)
    g = 2 * (part(toxic, e_t) + part(clean, e_c) + part(n_toxic - toxic, n_toxic - e_t) + part(n_clean - clean, n_clean - e_c))
    return F.when(toxic / n_toxic > clean / n_clean, g).otherwise(-g)


def telling_words(table: DataFrame, n_toxic: float, n_clean: float, most: int = SEEDS) -> tuple[dict[str, float], DataFrame]:
    """(toxic seeds with the number of toxic documents as weight, words that tell nothing), from the labelled counts of all words."""
    seen = table.where("word != '' AND toxic + clean > 0")
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    rate = (t + 0.5) / n_toxic / ((c + 0.5) / n_clean)
    scored = materialise(seen.select("word", "toxic", "clean", signed_g2(t, c, n_toxic, n_clean).alias("g"), rate.alias("rate")))
    by_chance = 2 * math.log(scored.count() + 1) + 2  # the largest of so many ratios, were no word telling
    telling = scored.where((F.col("toxic") >= 3) & (F.col("g") >= by_chance) & (F.col("rate") >= 4))
    strong = {r["word"]: float(r["toxic"]) for r in sorted(largest(telling, "g", most).collect(), key=lambda r: (-r["g"], r["word"]))}
    both = F.col("toxic") + F.col("clean")
    plain = scored.where((F.col("toxic") >= 1) & (both >= LEAST) & (both <= max([2 * x for x in strong.values()], default=0)) & (F.col("rate") < 1.5))
    return strong, plain.select("word")


def controls(labelled: DataFrame, strong: dict[str, float], plain: DataFrame, most: int = CONTROLS) -> list[str]:
    """Clean seeds: words that tell nothing, drawn from the toxic documents that hold toxic seeds.

    Every toxic seed in a document adds one to the chance of the document's
    other words together, so the draw follows the toxic seeds through their
    languages and subjects, and contrasts with them in nothing but toxicity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(), Counter()
        for b in batches:
            for t in b.column(0):
                held = set(chain.from_iterable(map(words.__getitem__, t.as_py().lower().split())))
                n = len(held & strong.keys())
                for w in held if n else ():
                    found[w] += n / len(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], ["word", "weight"])

    near = labelled.where("toxic = 1").select("text").mapInArrow(run, "word string, weight double").groupBy("word").agg(F.round(F.sum("weight"), 9).alias("weight"))
    # a draw without replacement in proportion to the weight, by the words' hashes
    drawn = near.join(plain, "word").withColumn("order", F.col("weight") / -F.log((F.crc32(F.col("word").cast("binary")) + 1) / F.lit(2.0**32 + 2)))
    return [r["word"] for r in sorted(largest(materialise(drawn), "order", most).collect(), key=lambda r: (-r["order"], r["word"]))]


def pair_counts(docs: DataFrame, seeds: list[str], nodes: list[str], window: int = WINDOW) -> DataFrame:
    """The pairs of few seeds only (the query takes all pairs, by ``word_graph``): (pair, n) over all documents; with ``size`` nodes and A seeds, which come first among the nodes, pair is

    seed * size + node: how often the node stands within the window of the seed;
    A * size + node: how often the node occurs; (A + 1) * size + seed: places
    within windows of the seed; (A + 2) * size: words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(nodes)
    first, size, name = len(seeds), len(nodes), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def codes() -> Values:
            known = {w: i for i, w in enumerate(shared.value)}
            return Values(np.int32, lambda w: known.get(w, -1))

        values = in_worker("toxicity nodes", name, codes)
        gap = np.full(window, -2, np.int32)
        uni, slots, words = np.zeros(size, np.int64), np.zeros(first, np.int64), 0
        held: list[np.ndarray] = [gap]
        keys, counts = [], []
        waiting, kept = 0, 0

        def add() -> None:
            nonlocal words, kept
            x = np.concatenate(held)
            held[1:] = []
            words += int((x != -2).sum())
            np.add(uni, np.bincount(x[x >= 0], minlength=size), out=uni)
            at = np.flatnonzero((x >= 0) & (x < first))
            own, near = x[at], []
            for d in (*range(-window, 0), *range(1, window + 1)):
                other = x[at + d]
                np.add(slots, np.bincount(own[other != -2], minlength=first), out=slots)
                ok = (other >= 0) & (other != own)
                near.append(own[ok].astype(np.int64) * size + other[ok])
            k, n = np.unique(np.concatenate(near), return_counts=True)
            keys.append(k)
            counts.append(n)
            kept += len(k)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
            return k, np.bincount(at, np.concatenate([*counts, np.zeros(0, np.int64)]), len(k)).astype(np.int64)

        for b in batches:
            for t in b.column(0):
                row = values.of(t.as_py())
                held += [row, gap]
                waiting += len(row)
                if waiting > 500_000:
                    add()
                    waiting = 0
                    if kept > _PAIRS:
                        k, n = merged()
                        keys[:], counts[:], kept = [k], [n], len(k)
                        if kept > _PAIRS // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pair", "n"])
                            keys[:], counts[:], kept = [], [], 0
        add()
        k, n = merged()
        some, seen = np.flatnonzero(uni), np.flatnonzero(slots)
        k = np.concatenate([k, first * size + some, (first + 1) * size + seen, [(first + 2) * size]])
        n = np.concatenate([n, uni[some], slots[seen], [words]])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


VECTORS = "word string, own int, seeds array<int>, ppmi array<float>"


def edges(docs: DataFrame, seeds: list[str], nodes: list[str], window: int = WINDOW) -> DataFrame:
    """(word, own, seeds, ppmi): each node with the seeds it has an edge to; ``own`` is its number among the seeds, or -1."""
    first, size = len(seeds), len(nodes)
    counted = materialise(pair_counts(docs, seeds, nodes, window))
    head = {r["pair"]: r["n"] for r in counted.where(F.col("pair") >= (first + 1) * size).collect()}  # a row for each seed, and one
    slots, total = np.array([head.get((first + 1) * size + a, 0) for a in range(first)], float), float(head[(first + 2) * size])
    shared = docs.sparkSession.sparkContext.broadcast(nodes)
    rows = counted.where(F.col("pair") < (first + 1) * size).select((F.col("pair") % size).cast("int").alias("node"), F.floor(F.col("pair") / size).cast("int").alias("seed"), "n")
    lists = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seed", "n"))).alias("held"))  # at most one for each seed, and one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for node, seed, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = np.array(n, float)
                a, n, f = np.array(seed[:-1], int), n[:-1], n[-1]
                ppmi = np.maximum(np.log(np.maximum(n, 1) * total / (slots[a] * f)), 0) * n / (n + DAMP)
                some = ppmi > 0
                for col, v in zip(out, (shared.value[node], node if node < first else -1, a[some].tolist(), ppmi[some].tolist())):
                    col.append(v)
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["word", "own", "seeds", "ppmi"])

    return materialise(lists.select("node", "held.seed", "held.n").mapInArrow(run, VECTORS))


def _dense(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(own, PPMI by row and seed) of a batch of ``edges``."""
    out = np.zeros((b.num_rows, first))
    lengths = np.array([len(x) for x in b.column(2)], int)
    out[np.repeat(np.arange(b.num_rows), lengths), b.column(2).flatten().to_numpy()] = b.column(3).flatten().to_numpy()
    return b.column(1).to_numpy(), out


def walk_on_seeds(out: np.ndarray, through: np.ndarray, between: np.ndarray, starts: list[np.ndarray], restart: float = RESTART) -> list[np.ndarray]:
    """For each start the restarting walk's visits of the seeds, divided by their total edge weight ``out``.

    ``through[a, b]`` sums w_a w_b / w over the other words w joined to both
    seeds, ``between[a, b]`` is the weight of the edge of the two seeds.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(out[:, None] > 0, ((1 - restart) * between + (1 - restart) ** 2 * through) / out[:, None], 0)
        found = [np.linalg.solve((np.eye(len(out)) - step).T, restart * s / max(s.sum(), 1e-12)) for s in starts]
        return [np.where(out > 0, x / out, 0) for x in found]


def walk_polarity(vectors: DataFrame, toxic: np.ndarray, clean: np.ndarray, restart: float = RESTART) -> DataFrame:
    """On a graph with edges of the seeds only, solved directly: (word, polarity) for every node, from the restarting walks at ``toxic`` and ``clean`` (weights by seed)."""
    first = len(toxic)
    numbered = vectors.withColumn("part", F.spark_partition_id())

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros((2 * first + 2, first)), None
        for b in batches:
            part = b.column(4)[0].as_py() if b.num_rows else part
            own, w = _dense(b, first)
            sums[-2] += w.sum(axis=0)
            sums[-1, 0] += len(own)
            seed = own >= 0
            sums[first + own[seed]] += w[seed]
            rest = w[~seed]
            total = rest.sum(axis=1, keepdims=True)
            sums[:first] += rest.T @ np.divide(rest, total, out=np.zeros_like(rest), where=total > 0)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    got = summed_arrays(numbered.mapInArrow(tally, "part long, sums binary")).reshape(2 * first + 2, first)
    out, n = got[-2], got[-1, 0]
    up, down = walk_on_seeds(out, got[:first], got[first : 2 * first].T, [toxic, clean], restart)
    little = (1 - restart) * 0.5 * (up + down) @ out / n  # an average word's visits: evidence below it counts for little

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, w = _dense(b, first)
            a, c = (1 - restart) * (w @ up), (1 - restart) * (w @ down)
            seed = own >= 0
            a[seed], c[seed] = (up * out)[own[seed]], (down * out)[own[seed]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((a - c) / (a + c + little))], ["word", "polarity"])

    return vectors.mapInArrow(run, "word string, polarity double")


def graph_polarity(docs: DataFrame, frequent: DataFrame, strong: dict[str, float], mild: list[str], window: int = WINDOW, restart: float = RESTART) -> DataFrame:
    """(word, polarity) for every word of ``frequent (word, df)``, from the walks at toxic and clean seeds over the graph of all of them."""
    nodes = [r["word"] for r in sorted(frequent.select("word", "df").collect(), key=lambda r: (-r["df"], r["word"]))]  # at most 300 / SHARE and the seeds
    shared = docs.sparkSession.sparkContext.broadcast(nodes)

    clean = set(mild)
    starts = np.array([[strong.get(w, 0.0) for w in nodes], [float(w in clean) for w in nodes]])
    with kept_codes(docs.sparkSession) as path:
        held, occurrences, places = coded(docs, lambda: Codes(shared.value), len(nodes), window, path)
        joined = graph(held, occurrences, places, window, NODES_AT_ONCE)
    up, down = walks(joined, places, DAMP, starts, restart)
    little = (1 - restart) / len(nodes)  # an average word's visits: evidence below it counts for little
    found = pd.DataFrame({"word": nodes, "polarity": (up - down) / (up + down + little)})
    return docs.sparkSession.createDataFrame(found, "word string, polarity double")


def verified(polarity: DataFrame, counts: DataFrame, n_toxic: float, n_clean: float) -> DataFrame:
    """``polarity`` with 0 for words that the walk calls toxic but at least three labelled documents show to tell nothing."""
    t, c = F.coalesce("toxic", F.lit(0)), F.coalesce("clean", F.lit(0))
    refuted = (t + c >= 3) & ((t + 0.5) / n_toxic < 1.5 * (c + 0.5) / n_clean)
    joined = polarity.join(broadcast_if_small(counts.select("word", "toxic", "clean")), "word", "left")
    return joined.select("word", F.when(refuted & (F.col("polarity") > 0), 0.0).otherwise(F.col("polarity")).alias("polarity"))


def stems(polarity: DataFrame) -> DataFrame:
    """(stem, polarity): shortest beginnings of a family of words nearly all of which are toxic, after which many letters follow."""
    n = F.length("word")
    each = polarity.where(n > STEM[0]).select("polarity", "word", F.explode(F.sequence(F.lit(STEM[0]), F.least(n - 1, F.lit(STEM[1])))).alias("k"))
    cut = each.select("polarity", F.expr("left(word, k)").alias("stem"), F.expr("substring(word, k + 1, 1)").alias("next"))
    family = cut.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("polarity") >= CUT).alias("toxic"), F.count_distinct("next").alias("follow"), F.avg("polarity").alias("polarity"))
    good = materialise(family.where((F.col("n") >= FAMILY) & (F.col("follow") >= FOLLOW) & (F.col("toxic") >= TOXIC_SHARE * F.col("n"))).select("stem", "polarity"))
    longer = good.select(F.col("stem").alias("long"), F.explode(F.sequence(F.lit(STEM[0]), F.length("stem"))).alias("k")).where(F.col("k") < F.length("long"))
    covered = longer.select("long", F.expr("left(long, k)").alias("stem")).join(good.select("stem"), "stem").select(F.col("long").alias("stem")).distinct()
    return good.join(covered, "stem", "left_anti")


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
    return tuple(float(v) for v in w)


def induce(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """The lexicon of a corpus; without toxic and clean training labels, or telling words, an empty one, which scores all near 0."""
    whole = texts(docs, id_col, text_col)
    sample = training_labels(labels)
    table = materialise(tallies(whole.join(F.broadcast(sample), "doc_id", "left")))
    head = table.where("word = ''").first()
    if not head or not head["toxic"] or not head["clean"]:
        return Lexicon()
    strong, plain = telling_words(table, float(head["toxic"]), float(head["clean"]))
    mild = controls(whole.join(F.broadcast(sample), "doc_id"), strong, plain) if strong else []
    if not mild:
        return Lexicon()
    seeds = [*strong, *mild]
    some = docs.sparkSession.createDataFrame([(w,) for w in seeds], "word string")
    enough = F.col("df") >= max(LEAST, SHARE * head["df"])
    marked = table.where("word != ''").join(F.broadcast(some.withColumn("seed", F.lit(True))), "word", "left").where(enough | F.col("seed"))
    frequent = materialise(marked)
    polarity = materialise(verified(graph_polarity(whole, frequent, strong, mild), frequent.where("seed IS NULL"), float(head["toxic"]), float(head["clean"])))
    lexicon = Lexicon({r["word"]: r["polarity"] for r in polarity.where(F.abs("polarity") >= CUT).collect()}, {r["stem"]: r["polarity"] for r in stems(polarity).collect()})
    held, name = whole.join(F.broadcast(sample), "doc_id").select("text", "toxic"), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rows = in_worker("toxicity features", name, lexicon.values), []
        for b in batches:
            rows += [(*lexicon.features(p), y) for p, y in zip(values.of_all(b.column(0).to_pylist()), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([np.array(rows, float).tobytes()], pa.binary())], ["rows"])

    rows = np.concatenate([np.frombuffer(r["rows"], float).reshape(-1, 4) for r in held.mapInArrow(run, "rows binary").collect()])  # the sample's features
    rows = rows[np.lexsort(rows.T)]  # so that the sums of the fit don't depend on the order
    return Lexicon(lexicon.polarity, lexicon.stems, fit_curve(rows[:, :3], rows[:, 3]))


def score_column(lexicon: Lexicon, text_col: str):
    """A column function's result: the score of a text, null as empty."""
    parts, name = (lexicon.polarity, lexicon.stems, lexicon.curve), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        held, values = in_worker("toxicity scores", name, lambda: (lambda x: (x, x.values()))(Lexicon(*parts)))
        return pd.Series([held.score(p) for p in values.of_all(text.tolist())], dtype=float)

    return score(F.coalesce(named(text_col).cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have a score too, that of no toxic word; texts of any
    length are read whole.  Rows that repeat are scored each, and labels of an
    id count for all its rows; a null id is not held out.  An empty table gives
    none; further columns are passed over.
    """
    lexicon = induce(docs, labels, id_col, text_col)
    whole = texts(docs, id_col, text_col)
    scored = whole.select("doc_id", held_out("doc_id").alias("held_out"), score_column(lexicon, "text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
