"""Toxicity scores: misspelling-tolerant lexicon matches, weighed by their context.

The lexicon is a trie of terms (whole words, and stems that any ending may follow).
Levenshtein automata of all terms run over the trie at once; the sets of (trie node,
errors) that a word can be in are made deterministic as words meet them, so a word
costs one table step per letter. A match has a term and its number of errors.

Terms and the weight of each (term, errors) come from labelled documents: how much
oftener it occurs in toxic ones than in others. Around every match a window of words
is looked at: inside quotation marks or beside a word of reporting the match counts
as quotation, among other matches as abuse. A logistic function of the abuse and
quotation sums gives the score.

What is fitted (lexicon and function) comes from at most about ``fit_rows`` labelled
rows, chosen by a hash of their id; every document is scored whole.

Defined results: a null or empty text has no matches and the score of such texts;
rows without label are scored like others; a labelled id without document, and a
null label, are not learned from; without toxic labels the built-in terms and
weights are used; repeated rows give equal rows; an empty table gives no rows.
Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, whole

FIT_ROWS = 12_000
THRESHOLD = 0.3
#: Candidate terms that reach the driver, and terms in the lexicon, at most.
CANDIDATES, TERMS = 20_000, 400
LEAST_LIFT, MOST_CLEAN = 8.0, 0.01
STEM_LENGTHS = range(4, 8)
WINDOW = 8
#: Words whose match is kept per worker; a memory bound without influence on results.
MEMO = 500_000

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[\"“”„«»‹›]|'(?=\w)|(?<=\w)'")
# Terms used where nothing can be learned; words that report what others say.
BUILT_IN = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown")
REPORTING = frozenset("said says saying wrote writes called calls quote quotes quoted term word slur insult dit écrit appelé mot sagte schrieb nannte wort dijo escribió llamó palabra".split())
_OPEN, _QUOTES = frozenset("“„«‹"), frozenset("\"“”„«»‹›")


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """Levenshtein automata of all terms, intersected with their trie. A term that ends in ``*`` is a stem."""

    terms: tuple[str, ...]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    # Node: (term number, errors allowed, stem), and the most errors that any term below allows.
    ends: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    room: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        for number, term in enumerate(self.terms):
            stem, letters = term.endswith("*"), term.rstrip("*")
            allowed = errors_allowed(letters)
            node = 0
            self.room[0] = max(self.room[0], allowed)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], allowed)
            if node not in self.ends or stem:
                self.ends[node] = (number, allowed, stem)
        self.letters = {c for below in self.children for c in below}
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0}, None)
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _state(self, nodes: Mapping[int, int], done: tuple[int, int] | None) -> int:
        """Number of the state with least errors per node; letters of a term may be missing."""
        least = dict(nodes)
        todo = list(least)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                errors = least[node] + 1
                if errors <= self.room[child] and errors < least.get(child, 99):
                    least[child] = errors
                    todo.append(child)
        for node, errors in least.items():
            number, allowed, stem = self.ends.get(node, (0, -1, False))
            if stem and errors <= allowed and (done is None or errors < done[0]):
                done = (errors, number)
        if done is not None:  # only a match with fewer errors could still matter
            least = {n: e for n, e in least.items() if e < done[0]}
        key = (tuple(sorted(least.items())), done)
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append((least, done))
            self.steps.append({})
            found = [done] if done else []
            found += [(e, self.ends[n][0]) for n, e in least.items() if n in self.ends and e <= self.ends[n][1]]
            self.accepts.append(min(found, default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        least, done = self.content[state]
        after: dict[int, int] = {}
        for node, errors in least.items():
            if errors + 1 <= self.room[node]:
                after[node] = min(after.get(node, 99), errors + 1)
            for letter, child in self.children[node].items():
                cost = errors + (letter != c)
                if cost <= self.room[child]:
                    after[child] = min(after.get(child, 99), cost)
        return self._state(after, done)

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term number) of the nearest term, or None."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > MEMO:
            self.memo.clear()
        state = self.start
        for c in word:
            c = c if c in self.letters else ""
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._step(state, c)
            state = after
            if not self.content[state][0]:
                break
        self.memo[word] = found = self.accepts[state]
        return found


@dataclass(frozen=True)
class Lexicon:
    terms: tuple[str, ...]
    #: Weight of (term number, errors); pairs that are not listed weigh nothing.
    weights: Mapping[tuple[int, int], float]


def found_in(text: str, automaton: Automaton) -> tuple[int, list[tuple[int, int, bool, int]]]:
    """Number of words, and (term, errors, quoted, other matches nearby) of every match."""
    low = text.lower()
    words = _WORD.findall(low)
    match = automaton.match
    if not any(match(w) for w in set(words)):
        return len(words), []
    tokens = _TOKEN.findall(low)
    quoted, inside, hits = [], False, []
    for i, t in enumerate(tokens):
        if t in _QUOTES:
            inside = t in _OPEN or not inside
        quoted.append(inside)
        m = match(t)
        if m:
            hits.append((i, m))
    # A mark that is never closed, or closed far away, quotes nothing.
    marks = [i for i, t in enumerate(tokens) if t in _QUOTES]
    out = []
    for k, (i, (errors, term)) in enumerate(hits):
        left = [m for m in marks if i - 4 * WINDOW <= m < i]
        right = [m for m in marks if i < m <= i + 4 * WINDOW]
        reported = any(t in REPORTING for t in tokens[max(0, i - WINDOW):i])
        near = sum(1 for j, _ in hits[max(0, k - WINDOW):k + WINDOW + 1] if j != i and abs(j - i) <= WINDOW)
        out.append((term, errors, bool(quoted[i] and left and right) or (reported and near == 0), near))
    return len(words), out


def features(n_words: int, hits: Iterable[tuple[int, int, bool, int]], weights: Mapping[tuple[int, int], float]) -> np.ndarray:
    """1, abuse, quotation, density, distinct terms: what the score is a function of."""
    abuse = quotation = 0.0
    terms = set()
    for term, errors, quoted, near in hits:
        weight = weights.get((term, errors), 0.0)
        if weight <= 0:
            continue
        if quoted:
            quotation += weight
        else:
            abuse += weight * (1 + 0.25 * min(near, 4))
            terms.add(term)
    return np.array([1.0, math.log1p(abuse), math.log1p(quotation), math.log1p(100 * abuse / max(20, n_words)), math.log1p(len(terms))])


#: Used where nothing can be fitted: a few plain matches are toxic, quoted ones hardly count.
DEFAULT = np.array([-5.0, 2.5, 0.5, 1.0, 1.0])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Regularised towards :data:`DEFAULT`, by Newton steps."""
    w = DEFAULT.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - DEFAULT)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    found = {w for w in words if 3 <= len(w) <= 30}
    for w in words:
        found.update(w[:k] + "*" for k in STEM_LENGTHS if k < len(w))
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(toxic, text) of about ``fit_rows`` labelled rows that are not held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = usable.count()
    share = min(1.0, fit_rows / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About fit_rows rows of two numbers: bounded by the parameter.
    return docs.select("doc_id", whole(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def learn_terms(sample: DataFrame) -> tuple[str, ...]:
    """Terms that toxic documents of the sample hold much oftener than others."""

    def counted(only: int, wanted: frozenset[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if toxic == only:
                        terms = _terms_of(text)
                        total.update(terms if wanted is None else terms & wanted)
                        total[""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        return sample.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    in_toxic = {r["term"]: r["n"] for r in counted(1, None).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    n_toxic = in_toxic.pop("", 0)
    in_toxic = {t: n for t, n in in_toxic.items() if n >= max(3, 0.01 * n_toxic)}
    in_clean = {r["term"]: r["n"] for r in counted(0, frozenset(in_toxic)).collect()}
    n_clean = in_clean.pop("", 0)
    chosen: list[str] = []
    for term in sorted(in_toxic, key=lambda t: (len(t), t)):
        toxic, clean = in_toxic[term] / n_toxic, (in_clean.get(term, 0) + 0.5) / (n_clean + 1)
        covered = any(term.startswith(c[:-1]) for c in chosen if c.endswith("*"))
        if not covered and toxic / clean >= LEAST_LIFT and clean <= MOST_CLEAN:
            chosen.append(term)
    # Stems that only a whole word has are that word.
    words = {c for c in chosen if not c.endswith("*")}
    chosen.sort(key=lambda t: (-in_toxic[t], t))
    return tuple(dict.fromkeys([*chosen[:TERMS], *(w for w in BUILT_IN if w not in words and not any(w.startswith(c[:-1]) for c in chosen if c.endswith("*")))]))


def matches(frame: DataFrame, terms: tuple[str, ...], keep: str, kind: str) -> DataFrame:
    """(keep, n_words, hits) of every row of (keep, text)."""
    shared = frame.sparkSession.sparkContext.broadcast(terms)  # at most TERMS and the built-in ones
    schema = f"{keep} {kind}, n_words int, hits array<struct<term:int,errors:int,quoted:boolean,near:int>>"
    hit = pa.list_(pa.struct([("term", pa.int32()), ("errors", pa.int32()), ("quoted", pa.bool_()), ("near", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            found = [found_in(t, automaton) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int32()),
                 pa.array([[dict(zip(("term", "errors", "quoted", "near"), h, strict=True)) for h in hits] for _, hits in found], hit)],
                names=[keep, "n_words", "hits"])

    return frame.select(keep, "text").mapInArrow(scan, schema)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    sample = fit_sample(docs, labels, fit_rows)
    terms = learn_terms(sample)
    rows = matches(sample, terms, "toxic", "int").collect()  # about fit_rows
    seen = (Counter(), Counter())
    total = Counter(r["toxic"] for r in rows)
    for r in rows:
        seen[r["toxic"]].update({(h["term"], h["errors"]) for h in r["hits"]})
    weights: dict[tuple[int, int], float] = {}
    for number, term in enumerate(terms):
        for errors in range(errors_allowed(term.rstrip("*")) + 1):
            key = (number, errors)
            if errors == 0 or seen[1][key] + seen[0][key] > 0:
                built_in = 2.0 if term in BUILT_IN and errors == 0 else 0.0
                odds = math.log((seen[1][key] + 0.5 + built_in) / (total[1] + 1) / ((seen[0][key] + 0.5) / (total[0] + 1))) if total[1] else 3.0
                weights[key] = max(0.0, odds) if not (errors and seen[0][key] > 0.002 * total[0]) else 0.0
            else:  # a misspelling that the sample does not hold: less sure than the term
                weights[key] = weights[(number, errors - 1)] * 0.7
    x = np.array([features(r["n_words"], [tuple(h) for h in r["hits"]], weights) for r in rows]).reshape(-1, len(DEFAULT))
    y = np.array([r["toxic"] for r in rows], float)
    return Lexicon(terms, weights), logistic(x, y) if total[1] and total[0] else DEFAULT


def score(docs: DataFrame, lexicon: Lexicon, function: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_matches, n_quoted) of every document."""
    model = docs.sparkSession.sparkContext.broadcast((lexicon, function))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, function = model.value
        automaton = Automaton(lexicon.terms)
        for batch in batches:
            found = [found_in(t, automaton) for t in batch.column(1).to_pylist()]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(n, hits, lexicon.weights) @ function))))) for n, hits in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([len(h) for _, h in found], pa.int64()), pa.array([sum(q for _, _, q, _ in h) for _, h in found], pa.int64())],
                names=["doc_id", "score", "n_matches", "n_quoted"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).mapInArrow(scan, "doc_id long, score double, n_matches long, n_quoted long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon, function = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon, function).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches", "n_quoted")
