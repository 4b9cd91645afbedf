"""Document scores by masked pseudo-likelihood of a bidirectional window network.

Units are frequent words, pieces of three letters of all other words, and bytes
of pieces that are rare themselves, so that any text is a sequence of units and
every unit is predicted from the two on either side.  The softmax over units is
exact and hierarchical: units are the leaves of a Huffman tree over the
corpus counts, and each inner node has weights of its own, so context counts on
the way down to the very word.  Word counts cover every document and are
gathered by one shuffle that grows with the corpus.

Training is data-parallel in numpy and sees every document once, with one unit
in seven masked, by a hash of its neighbours, as masked language models are
trained; scoring masks every unit in turn.  Documents go to shards by a hash of
their text and are ordered there, so the weights don't depend on how the input
was split; in each round every shard starts from the same weights, and what the
shards reach is averaged by the units they saw.  A document's score is the sum
of the log-probabilities of all its units.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import largest, materialise, summed_arrays, texts
from .tokens import Remembered, in_worker

#: Whole words and pieces with a unit of their own; letters in a piece; width of the hidden layer.
WORDS, PIECES, PART, WIDTH = 40_000, 16_000, 3, 16
#: Rounds of training; positions in one step; step size; units in one shard.
ROUNDS, BATCH, RATE, SHARD = 2, 4096, 0.2, 16_000_000
#: Nodes near the root whose logits are made in one product; one unit in so many is masked in training.
TOP, MASKED = 63, 7
#: Places of the neighbours that predict a unit.
NEAR = (-2, -1, 1, 2)
_FLUSH, _LONG, _EDGE = 300_000, 64, max(NEAR)
#: Letters and marks of scripts written without spaces: Thai, Lao, Burmese, Khmer, Chinese, Japanese.
_UNSPACED = "฀-໿က-႟ក-៿⺀-⿟々-〇぀-ㄯㆠ-ㆿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+|[^\w\s{_UNSPACED}]+")


def tokens_of(text: str) -> list[str]:
    """Words, runs of punctuation, and single characters of scripts without spaces, in lower case.

    No token crosses white space, so what stands between may be cut into tokens on its own.
    """
    return _TOKEN.findall(text.lower())


def parts_of(word: str) -> list[str]:
    """Pieces of a word; the last one says that the word ends there."""
    cut = [word[i : i + PART] for i in range(0, len(word), PART)]
    return [*cut[:-1], cut[-1] + "\n"]


def unit_codes(words: dict[str, int], pieces: dict[str, int], first_byte: int, word: str) -> list[int]:
    """Codes of a word: its own, or those of its pieces, or of their bytes (256 more where a word ends)."""
    if word in words:
        return [words[word]]
    out: list[int] = []
    for p in parts_of(word):
        if p in pieces:
            out.append(pieces[p])
        else:
            raw = [first_byte + b for b in p.removesuffix("\n").encode("utf-8", "surrogatepass")]
            out += [*raw[:-1], raw[-1] + 256] if p[-1] == "\n" else raw
    return out


class Codes(Remembered):
    """What stands between white space -> codes of its units as little-endian unsigned 16-bit bytes."""

    def __init__(self, words: dict[str, int], pieces: dict[str, int], first_byte: int):
        super().__init__()
        self.known = (words, pieces, first_byte)

    def make(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return array("H", unit_codes(*self.known, piece)).tobytes()
        return array("H", [c for t in tokens_of(piece) for c in unit_codes(*self.known, t)]).tobytes()


def word_counts(whole: DataFrame) -> DataFrame:
    """(word, n) over all documents, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # pieces between white space
        words: Counter = Counter()

        def rows() -> pa.RecordBatch:
            for piece, n in seen.items():
                if piece.isascii() and piece.isalpha():
                    words[piece] += n
                else:
                    for t in tokens_of(piece):
                        words[t] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
            seen.clear()
            words.clear()
            return out

        for b in batches:
            for t in b.column(0):
                pieces = t.as_py().lower().split()
                if max(map(len, pieces), default=0) > _LONG:
                    words.update(chain.from_iterable(tokens_of(x) for x in pieces if len(x) > _LONG))
                    pieces = [x for x in pieces if len(x) <= _LONG]
                seen.update(pieces)
                if len(seen) + len(words) > _FLUSH:
                    yield rows()
        yield rows()

    return whole.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _parts(word: Column) -> Column:
    """``parts_of`` as a column."""
    last = F.ceil(F.length(word) / PART).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.substring(word, i * PART + 1, F.lit(PART)), F.when(i == last, "\n").otherwise("")))


def huffman(counts: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(inner nodes, depth by leaf, node and branch by depth and leaf) of the Huffman tree; nodes are numbered from the root."""
    heap: list[tuple[int, int, object]] = [(n, i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    for made in range(len(counts), 2 * len(counts) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a[2], b[2])))
    nodes, paths = 0, [[] for _ in counts]
    below: list[tuple[object, list[tuple[int, int]]]] = [(heap[0][2], [])]
    for tree, path in below:  # grows while it is walked
        if isinstance(tree, int):
            paths[tree] = path
            continue
        below += [(tree[0], [*path, (nodes, 1)]), (tree[1], [*path, (nodes, -1)])]
        nodes += 1
    depth = np.array([len(p) for p in paths], np.int16)
    node, branch = np.zeros((max(1, depth.max()), len(counts)), np.int32), np.zeros((max(1, depth.max()), len(counts)), np.float32)
    for i, path in enumerate(paths):
        for d, (k, c) in enumerate(path):
            node[d, i], branch[d, i] = k, c
    return max(1, nodes), depth, node, branch


def build_vocabulary(counts: DataFrame, words: int = WORDS, pieces: int = PIECES) -> tuple[dict[str, int], dict[str, int], int, list[int]]:
    """(word -> code, piece -> code, code of the first byte, count by code), from the counts of all words."""
    top = sorted(largest(counts, "n", words).collect(), key=lambda r: (-r["n"], r["word"]))
    known = counts.sparkSession.createDataFrame([(r["word"],) for r in top], "word string")
    rest = counts.join(F.broadcast(known), "word", "left_anti")
    parts = materialise(rest.select(F.explode(_parts(F.col("word"))).alias("part"), "n").groupBy("part").agg(F.sum("n").alias("n")))
    some = sorted(largest(parts, "n", pieces).collect(), key=lambda r: (-r["n"], r["part"]))
    left = (parts.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in some)
    n = [r["n"] for r in top] + [r["n"] for r in some] + [1 + left // 512] * 512
    return {r["word"]: i for i, r in enumerate(top)}, {r["part"]: len(top) + i for i, r in enumerate(some)}, len(top) + len(some), n


class Network:
    """Weights in one flat vector, with views of it: near (units and edge), scale, bias, out (nodes), prior (nodes)."""

    def __init__(self, counts: list[int], flat: np.ndarray | None = None, tree=None, seed: int = 7):
        self.units = len(counts)
        self.tree = self.nodes, self.depth, self.node, self.branch = tree or huffman(counts)
        self.top_levels = int((self.node.max(axis=1) < TOP).sum())
        shapes = {"near": (self.units + 1, WIDTH), "scale": (len(NEAR), WIDTH), "bias": (WIDTH,), "out": (self.nodes, WIDTH), "prior": (self.nodes,)}
        self.flat = np.zeros(sum(math.prod(s) for s in shapes.values()), np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, s in shapes.items():
            setattr(self, name, self.flat[at : at + math.prod(s)].reshape(s))
            at += math.prod(s)
        if flat is None:
            rng = np.random.default_rng(seed)
            self.near[:], self.scale[:], self.out[:] = rng.normal(0, 0.5, shapes["near"]), rng.normal(0.5, 0.1, shapes["scale"]), rng.normal(0, 0.05, shapes["out"])
            n = np.array(counts, float)
            left, right = (sum(np.bincount(k, np.where(s == way, n, 0), self.nodes) for k, s in zip(self.node, self.branch)) for way in (1, -1))
            self.prior[:] = np.log((left + 1) / (right + 1))  # so that it starts from the frequencies

    def start_over(self, flat: np.ndarray) -> None:
        self.flat[:] = flat
        self.squares = {k: np.full_like(getattr(self, k), 1e-9) for k in ("near", "scale", "bias", "out", "prior")}

    def hidden(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hidden layer at the places (counted from ``_EDGE``) of ``x``, from the units around them."""
        a = np.zeros((len(place), WIDTH), np.float32)
        for s, shift in zip(self.scale, NEAR):
            e = self.near[x[place + (_EDGE + shift)]]
            e *= s
            a += e
        a += self.bias
        return np.tanh(a, out=a)

    def deepest_first(self, place: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-self.depth[t], kind="stable")
        return place[order], t[order]

    def steps(self, h: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(targets that go on, node, branch, branch times logit) for each depth, of targets ordered by depth."""
        ones, deep = np.ones(WIDTH, np.float32), -self.depth[t]
        top = h @ self.out[:TOP].T  # the nodes near the root are on most paths
        top += self.prior[:TOP]
        flat, begin = top.ravel(), np.arange(len(t), dtype=np.int32) * top.shape[1]
        for d in range(-deep[0] if len(t) else 0):
            n = int(np.searchsorted(deep, -d, side="left"))
            node, branch = self.node[d][t[:n]], self.branch[d][t[:n]]
            if d < self.top_levels:
                z = flat[begin[:n] + node]
            else:
                w = self.out[node]
                w *= h[:n]
                z = w @ ones
                z += self.prior[node]
            z *= branch
            yield n, node, branch, np.maximum(z, -30, out=z)

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        """Of each unit of ``x`` but the first and last ``_EDGE``, given its neighbours; 0 for edge marks."""
        t = x[_EDGE : len(x) - _EDGE]
        place = np.flatnonzero(t != self.units)
        place, t = self.deepest_first(place, t[place])
        product = np.ones(len(t))
        for n, _, _, z in self.steps(self.hidden(x, place), t):
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            product[:n] *= z
        out = np.zeros(len(x) - 2 * _EDGE)
        out[place] = -np.log(product)
        return out

    def gradients(self, x: np.ndarray, place: np.ndarray) -> dict[str, tuple[object, np.ndarray]]:
        """weights -> (rows, gradient) of the mean loss over the units at ``place``, counted from ``_EDGE``."""
        place, t = self.deepest_first(place, x[place + _EDGE])
        h = self.hidden(x, place)
        back, size, at = np.zeros_like(h), int(self.depth[t].sum()), 0
        nodes, slope, toward = np.empty(size, np.int32), np.empty(size, np.float32), np.empty((size, WIDTH), np.float32)
        for n, node, branch, z in self.steps(h, t):
            g = -branch / (1 + np.exp(z))
            g *= np.float32(1 / len(t))
            nodes[at : at + n], slope[at : at + n] = node, g
            np.multiply(g[:, None], h[:n], out=toward[at : at + n])
            w = self.out[node]
            w *= g[:, None]
            back[:n] += w
            at += n
        back *= 1 - h * h
        near = [x[place + (_EDGE + shift)] for shift in NEAR]
        scale = np.array([(back * self.near[u]).sum(axis=0) for u in near])
        rows, sums = summed(nodes, toward, slope[:, None])
        units, toward_near = summed(np.concatenate(near), np.concatenate([s * back for s in self.scale]))
        return {"out": (rows, sums[0]), "prior": (rows, sums[1][:, 0]), "bias": (slice(None), back.sum(axis=0)), "scale": (slice(None), scale), "near": (units, toward_near[0])}

    def train_step(self, x: np.ndarray, place: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad on the units at ``place``."""
        for name, (rows, g) in self.gradients(x, place).items() if len(place) else ():
            squares = self.squares[name][rows] + g * g
            self.squares[name][rows] = squares
            getattr(self, name)[rows] -= rate * g / np.sqrt(squares)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys (below 2**16) and the sums of the rows of each."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], [np.add.reduceat(v[order], first, axis=0) for v in values]


def masked(x: np.ndarray, units: int, every: int = MASKED) -> np.ndarray:
    """Places, counted from ``_EDGE``, that training masks: about one in ``every``, by a hash of the units around."""
    t = x[_EDGE : len(x) - _EDGE]
    mixed = (x[:-4].astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (x[4:].astype(np.uint32) * np.uint32(0x85EBCA77)) ^ (np.arange(len(t), dtype=np.uint32) * np.uint32(0xC2B2AE3D))
    return np.flatnonzero(((mixed >> np.uint32(15)) % np.uint32(every) == 0) & (t != units))


def encoded(whole: DataFrame, vocabulary, shards: int, rounds: int) -> DataFrame:
    """(doc_id, codes, hash, shard, round): every document as little-endian 16-bit codes, in order within its shard."""

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = in_worker("units", name, lambda: Codes(*vocabulary.value[:3]))
        for b in batches:
            out = [b"".join(map(codes.__getitem__, t.as_py().lower().split())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "hash", "codes"])

    coded = whole.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, codes binary")
    shard, turn = F.pmod("hash", F.lit(shards)).cast("int"), F.pmod(F.shiftright("hash", 32), F.lit(rounds)).cast("int")
    return coded.withColumns({"shard": shard, "round": turn}).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "round", "hash", "doc_id")


def stretches(batches: Iterator[pa.RecordBatch], units: int, most: int = BATCH) -> Iterator[tuple[np.ndarray, list[tuple], object]]:
    """(codes with edge marks around each document, (doc_id, length) rows, key) of about ``most`` units or one document more.

    Columns are doc_id, codes and key; a stretch has documents of one key only.
    """
    edge = np.full(_EDGE, units, np.int32)
    held, rows, size, key = [edge], [], 0, None
    for b in batches:
        for i, c, k in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            if rows and (size > most or k != key):
                yield np.concatenate(held), rows, key
                held, rows, size = [edge], [], 0
            key, codes = k, np.frombuffer(c.as_buffer(), "<u2").astype(np.int32)
            held += [codes, edge]
            rows.append((i, len(codes)))
            size += len(codes) + 1  # empty documents count too, so that a stretch ends
    if rows:
        yield np.concatenate(held), rows, key


def distinct(batches: Iterator[pa.RecordBatch], ids: dict[int, list]) -> Iterator[pa.RecordBatch]:
    """``batches`` (doc_id, codes, key) with one row for neighbours of equal codes, numbered from 0 instead of doc_id; ``ids`` gets the doc_ids of each."""
    last, k = None, -1
    for b in batches:
        first = []
        for at, (i, c) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
            codes = c.as_buffer()
            if last is None or not codes.equals(last):
                last, k = codes, k + 1
                ids[k] = []
                first.append(at)
            ids[k].append(i)
        rows = pa.array(first, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1 - len(first), k + 1), pa.int64()), b.column(1).take(rows), b.column(2).take(rows)], ["doc_id", "codes", "key"])


def train_round(coded: DataFrame, model, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Average, weighted by units, of the weights that the shards reach from ``weights``; ``model`` is counts and tree, broadcast."""
    start = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, shard, seen = Network(model.value[0], start.value, model.value[1]), None, 0

        def reached() -> pa.RecordBatch:
            sums = np.append(net.flat.astype(float) * seen, float(seen))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

        for x, rows, key in stretches(batches, net.units, MASKED * BATCH):
            if key != shard:
                if seen:
                    yield reached()
                net.start_over(start.value)
                shard, seen = key, 0
            for k in range(0, len(x) - 2 * _EDGE, MASKED * BATCH):  # a long document takes several steps
                part = x[k : k + MASKED * BATCH + 2 * _EDGE]
                net.train_step(part, masked(part, net.units), rate)
            seen += sum(n for _, n in rows)
        if seen:
            yield reached()

    total = summed_arrays(coded.select("doc_id", "codes", "shard").mapInArrow(run, "part long, sums binary"))
    return weights if total is None else (total[:-1] / total[-1]).astype(np.float32)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_likelihood, mean_log_likelihood.

    ``n_tokens`` counts the units that are predicted.  A text without words,
    null included, has log-likelihood 0 and no mean; a text of any length is
    scored whole.  Rows that repeat have a row each, and one score; an empty table
    gives none, and further columns are passed over.
    """
    whole = texts(docs, id_col, text_col)
    counts = materialise(word_counts(whole))
    spark = docs.sparkSession
    built = build_vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(built)
    shards = max(1, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) / SHARD))
    coded = materialise(encoded(whole, vocabulary, shards, rounds))
    first = Network(built[3])
    model, weights = spark.sparkContext.broadcast((built[3], first.tree)), first.flat
    for r in range(rounds):
        weights = train_round(coded.where(F.col("round") == r), model, weights, RATE / (1 + r))
    final = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, ids = Network(model.value[0], final.value, model.value[1]), {}
        for x, rows, _ in stretches(distinct(batches, ids), net.units):  # a stretch ends when the next document has been seen, so its ids are all there
            parts = [net.log_probability(x[k : k + BATCH + 2 * _EDGE]) for k in range(0, len(x) - 2 * _EDGE, BATCH)]
            upto = np.concatenate([[0.0], np.cumsum(np.concatenate(parts))]) if parts else np.zeros(1)
            n = np.array([n for _, n in rows])
            begin = np.cumsum(n + _EDGE) - n - _EDGE
            copies = [ids.pop(k) for k, _ in rows]
            each = np.repeat(np.arange(len(rows)), [len(c) for c in copies])
            cols = [pa.array(list(chain.from_iterable(copies)), pa.int64()), pa.array(n[each], pa.int64()), pa.array((upto[begin + n] - upto[begin])[each])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "log_likelihood"])

    scored = coded.select("doc_id", "codes", F.lit(0).alias("key")).mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
