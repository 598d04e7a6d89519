"""Document scores by masked pseudo-likelihood.

A small network sees two words on each side of a place and predicts the word there;
the logarithms of the probabilities it gives to the words of a document, each from
its neighbours on both sides, are summed. The network is log-bilinear: one table of
vectors per neighbouring place, a sum, a tanh, and a softmax in two steps (class of
the word, word within its class), so probabilities are exact at little cost.

The vocabulary is counted over all documents: the commonest words have ids of their
own, all others share ids by a hash. Training is data-parallel: documents are dealt
into ``rounds`` by a hash of their text; in each round every task goes through its
documents of the round by mini-batches, starting from the same weights, and the
weights of the tasks are averaged, each by the number of places it learned from. Every
place of every document is learned from once (a ``stride`` above 1 would leave places
out), so training grows with the corpus. Every place of every document is scored.

Weights are averaged in parts, over groups of tasks first, so no task sees those of
all tasks; the driver holds one set of weights and the vocabulary.

Defined results: a null text is empty; a text without words has 0 tokens, sum 0 and
mean 0; repeated rows get equal scores; without any words in the corpus the initial
network is used; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, whole

CLASSES = 32
SIZE = CLASSES * CLASSES
#: Ids that all uncommon words share by a hash.
SHARED = 256
PAD = SIZE
WIDTH = 24
PLACES = (-2, -1, 1, 2)
ROUNDS, STRIDE, BATCH, RATE = 2, 1, 2048, 0.1
#: Numbers per part when weights are averaged, and groups of tasks that are averaged first.
PART, GROUPS = 8192, 64
#: Word ids kept per worker; a memory bound without influence on results.
MEMO = 500_000
WEIGHTS = "part int, lane int, n long, weights array<float>"

_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")


@dataclass
class Network:
    near: np.ndarray      # (places, SIZE + 1, WIDTH)
    of_class: np.ndarray  # (WIDTH + 1, CLASSES), the last row is the bias
    within: np.ndarray    # (CLASSES, WIDTH + 1, CLASSES)

    @classmethod
    def initial(cls) -> Network:
        rng = np.random.default_rng(8)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(draw(len(PLACES), SIZE + 1, WIDTH), draw(WIDTH + 1, CLASSES), draw(CLASSES, WIDTH + 1, CLASSES))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.of_class.ravel(), self.within.ravel()])

    @classmethod
    def from_flat(cls, x: np.ndarray) -> Network:
        a, b = len(PLACES) * (SIZE + 1) * WIDTH, (WIDTH + 1) * CLASSES
        x = x.astype(np.float32)
        return cls(x[:a].reshape(len(PLACES), SIZE + 1, WIDTH).copy(), x[a:a + b].reshape(WIDTH + 1, CLASSES).copy(), x[a + b:].reshape(CLASSES, WIDTH + 1, CLASSES).copy())


_ONES = np.ones(CLASSES, np.float32)


def _chosen(logits: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of the chosen column of each row, and what the softmax divides by; exponentials take the logits' place.

    Logits are cut where the exponential would leave the range of the type; sums of
    rows are products with ones, which is faster than reducing short rows.
    """
    np.clip(logits, -40, 40, out=logits)
    np.exp(logits, out=logits)
    total = logits @ _ONES
    return np.log(logits.ravel().take(_cells(k)) / total), total


def _cells(k: np.ndarray) -> np.ndarray:
    """Flat places of one column of each row."""
    return np.arange(0, len(k) * CLASSES, CLASSES) + k


def forward(net: Network, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Log-probability of the words at the places, hidden values, and what the gradient needs."""
    # Places of one class together: the logits within it are one product. Numbers of 16 bits are sorted by radix.
    order = np.argsort((ids[at] // CLASSES).astype(np.int16), kind="stable")
    ordered = at[order]
    total = net.near[0].take(ids[ordered + PLACES[0]], axis=0)
    for k in range(1, len(PLACES)):
        total += net.near[k].take(ids[ordered + PLACES[k]], axis=0)
    hidden = np.ones((len(at), WIDTH + 1), np.float32)
    np.tanh(total, out=hidden[:, :WIDTH])
    kind, word = np.divmod(ids[ordered].astype(np.int64), CLASSES)
    e = hidden @ net.of_class
    log_p, sums = _chosen(e, kind)
    starts = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    spans = [(c, a, b) for c, (a, b) in enumerate(zip(starts, starts[1:])) if b > a]
    inner = np.empty((len(at), CLASSES), np.float32)
    for c, a, b in spans:
        np.matmul(hidden[a:b], net.within[c], out=inner[a:b])
    log_p_inner, sums_inner = _chosen(inner, word)
    back = np.empty_like(log_p)
    back[order] = log_p + log_p_inner
    return back, hidden, [ordered, kind, word, e, sums, inner, sums_inner, spans]


_COLUMNS = np.arange(WIDTH)


def learn(net: Network, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One step down the gradient of the places' mean loss, in place."""
    _, hidden, (ordered, kind, word, d_class, sums, d_word, sums_word, spans) = forward(net, ids, at)
    step = np.float32(rate / np.sqrt(len(at)))
    for d, s, k in ((d_class, sums, kind), (d_word, sums_word, word)):
        d /= s[:, None]
        d.ravel()[_cells(k)] -= 1
    d_hidden = d_class @ net.of_class.T
    net.of_class -= step * (hidden.T @ d_class)
    for c, a, b in spans:
        d_hidden[a:b] += d_word[a:b] @ net.within[c].T
        net.within[c] -= step * (hidden[a:b].T @ d_word[a:b])
    d_total = (d_hidden[:, :WIDTH] * (1 - hidden[:, :WIDTH] ** 2)).ravel()
    for k, place in enumerate(PLACES):
        # Sums per word: every number of a row goes to its place in the word's row.
        cells = (ids[ordered + place].astype(np.int64)[:, None] * WIDTH + _COLUMNS).ravel()
        net.near[k] -= (step * np.bincount(cells, d_total, (SIZE + 1) * WIDTH)).reshape(SIZE + 1, WIDTH).astype(np.float32)


class _Memo(dict):
    """Ids of the words seen so far; others get theirs when they are asked for."""

    def __init__(self, own: dict[str, int]):
        self.own = own

    def __missing__(self, word: str) -> int:
        i = self.own.get(word)
        self[word] = i = SIZE - SHARED + zlib.crc32(word.encode()) % SHARED if i is None else i
        return i


class Numbers:
    """Word ids of texts: the vocabulary's, or a shared one by hash."""

    def __init__(self, vocabulary: list[str]):
        self.own = {w: i for i, w in enumerate(vocabulary)}
        self.memo = _Memo(self.own)

    def of(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with padding before, between and after, and the number of words of each."""
        # In ASCII the letters are a to z, which is a faster pattern.
        found = [(_ASCII_WORD if t.isascii() else _WORD).findall(t) for t in map(str.lower, texts)]
        if len(self.memo) > MEMO:
            self.memo.clear()
        sizes = np.array([len(w) for w in found], np.int64)
        n = int(sizes.sum())
        ids = np.full(n + 2 * (len(found) + 1), PAD, np.int32)
        places = np.arange(n) + 2 * np.repeat(np.arange(1, len(found) + 1), sizes)
        ids[places] = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(found)), np.int32, n)
        return ids, sizes


def _groups(texts: list[str], size: int = 1 << 19) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def vocabulary(texts: DataFrame) -> list[str]:
    """The commonest words of all documents, commonest first."""
    # The outer form: the plain one would filter by the words first, and so split every text twice.
    words = texts.select(F.explode_outer(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(SIZE - SHARED).collect()
    return [r["word"] for r in top]


def train(texts: DataFrame, words: list[str], rounds: int = ROUNDS, stride: int = STRIDE, rate: float = RATE) -> Network:
    """Weights after ``rounds`` passes, each over its share of the documents (columns mark, text)."""
    net = Network.initial()
    for turn in range(rounds):
        start = texts.sparkSession.sparkContext.broadcast((words, net.flat()))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            known, flat = start.value
            numbers, net, learned = Numbers(known), Network.from_flat(flat), 0
            for batch in batches:
                marks = batch.column(0).to_pylist()
                done = 0
                for group in _groups(batch.column(1).to_pylist()):
                    ids, sizes = numbers.of(group)
                    begins = 2 + np.r_[0, np.cumsum(sizes + 2)[:-1]]
                    at = np.concatenate([np.arange(b + m % stride, b + n, stride) for b, n, m in zip(begins, sizes, marks[done:done + len(group)], strict=True)])
                    done += len(group)
                    np.random.default_rng(len(at)).shuffle(at)
                    for first in range(0, len(at), BATCH):
                        learn(net, ids, at[first:first + BATCH], rate)
                    learned += len(at)
            flat = net.flat()
            parts = [flat[i:i + PART] for i in range(0, len(flat), PART)]
            lane = TaskContext.get().partitionId() % GROUPS
            if learned:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([lane] * len(parts), pa.int32()), pa.array([learned] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float32()))],
                    names=["part", "lane", "n", "weights"])

        def mean(table: pa.Table) -> pa.Table:
            n = np.array(table["n"].to_pylist(), float)
            weights = np.array(table["weights"].to_pylist())
            return pa.table({"part": table["part"][:1], "lane": pa.array([0], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()),
                             "weights": pa.array([(n @ weights / n.sum()).astype(np.float32)], pa.list_(pa.float32()))})

        of_turn = texts.where(F.pmod(F.shiftright("mark", 8), F.lit(rounds)) == turn).select(F.pmod("mark", F.lit(stride)).cast("int").alias("mark"), "text")
        of_groups = of_turn.mapInArrow(run, WEIGHTS).groupBy("part", "lane").applyInArrow(mean, WEIGHTS)
        averaged = of_groups.groupBy("part").applyInArrow(mean, WEIGHTS).orderBy("part").collect()
        if averaged:
            net = Network.from_flat(np.concatenate([np.array(r["weights"], np.float32) for r in averaged]))
    return net


def score(docs: DataFrame, words: list[str], net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) of every document."""
    model = docs.sparkSession.sparkContext.broadcast((words, net.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = model.value
        numbers, net = Numbers(known), Network.from_flat(flat)
        for batch in batches:
            sizes, sums = [], []
            for group in _groups(batch.column(1).to_pylist()):
                ids, count = numbers.of(group)
                begins = 2 + np.r_[0, np.cumsum(count + 2)[:-1]]
                places = np.repeat(begins - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                owner = np.repeat(np.arange(len(count)), count)
                total = np.zeros(len(count))
                for first in range(0, len(places), 8192):
                    log_p, _, _ = forward(net, ids, places[first:first + 8192])
                    total += np.bincount(owner[first:first + 8192], log_p, len(count))
                sizes.append(count)
                sums.append(total)
            n, s = np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(sums or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s), pa.array(s / np.maximum(n, 1))], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select(F.xxhash64(whole(F.col("text"))).alias("mark"), whole(F.col("text")).alias("text"))
    words = vocabulary(texts)
    return score(docs, words, train(texts, words))
