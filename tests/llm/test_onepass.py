"""One-permutation near duplicates against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import onepass
from tests.llm.conftest import PROSE, odd_rows


def shingle_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\f\r" else c for c in text or "").split(" ") if w]
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def by_hand(rows):
    sets = [shingle_set(text) for _, text in rows]
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                lead[max(x, y)] = min(x, y)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        component = min(ids, default=None)
        out.append((doc, len(sets[i]), component, component is None or doc == component))
    return sorted(out, key=repr)


def found_by(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def copies(rng, base, n, edits):
    for _ in range(n):
        words = base.split(" ")
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
        yield " ".join(words)


def text_of(rng, words):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(words))


def test_components_by_hand(spark):
    rng = random.Random(12)
    texts = [text_of(rng, rng.choice((1, 2, 3, 4, 5, 9, 40, 200, 700))) for _ in range(60)]
    for words, edits in ((30, 2), (60, 3), (200, 9), (200, 14), (800, 30)):
        texts += copies(rng, text_of(rng, words), 30, edits)
    chain = text_of(rng, 300).split(" ")
    for _ in range(25):  # each alike to the one before, the ends not alike
        texts.append(" ".join(chain))
        for _ in range(7):
            chain[rng.randrange(300)] = f"new{rng.randrange(10 ** 6)}"
    shared = text_of(rng, 100)
    texts += [shared + " " + text_of(rng, 60) for _ in range(40)]  # a common passage is no link
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = found_by(onepass.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == by_hand(rows)
    assert 60 < sum(r[3] for r in found) < 200


def test_pairs_grow_with_the_group_not_its_square(spark):
    """A thousand near copies of one text: a few pairs each, and as many exact copies cost nothing."""
    rng = random.Random(3)
    base = text_of(rng, 150)
    rows = list(enumerate([*copies(rng, base, 1000, 4), *[base] * 1000]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, confirmed = [], onepass.confirmed
    try:
        onepass.confirmed = lambda pairs, *rest: (seen.append(pairs.count()), confirmed(pairs, *rest))[1]
        found = onepass.near_duplicates(docs)
        assert found.where("kept").count() == 1
    finally:
        onepass.confirmed = confirmed
    assert sum(seen) < 20 * 1000


def test_densified_bins_agree_as_often_as_sets():
    rng = np.random.default_rng(5)
    order = onepass.donors(onepass.BINS)
    for size in (3, 20, 300, 5000):
        agreed = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + rng.integers(0, 2, size, np.uint64))
            cut = max(1, len(x) // 5)
            a, b = x[cut:], np.sort(np.concatenate([x[:-cut]]))
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agreed.append((onepass.signature(a, order) == onepass.signature(b, order)).mean() - want)
        assert abs(np.mean(agreed)) < 0.06, size
    one = np.array([17 << 40], np.uint64)
    assert (onepass.signature(one, order) == one[0]).all()


def test_odd_rows(spark, odd, none):
    rows = [r[:2] for r in odd_rows()]
    assert found_by(onepass.near_duplicates(odd)) == by_hand(rows)
    assert onepass.near_duplicates(none).count() == 0


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c d", PROSE, "\x1c x", "\xa0", "É é"])
def test_shingles_by_hand(text):
    assert len(onepass.shingles(text or "")) == len(shingle_set(text))


def test_repeated_centres_and_members(spark):
    """Rows of one id and text many times over, in a star of near copies."""
    rng = random.Random(6)
    base = text_of(rng, 100)
    rows = [(1, base)] * 300 + [(2, t) for t in copies(rng, base, 20, 2)] + [(None, base)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_by(onepass.near_duplicates(docs)) == by_hand(rows)
    assert onepass.near_duplicates(docs).where(F.col("kept")).count() == 300
