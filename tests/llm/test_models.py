"""Toxicity, language identification and pseudo-likelihood."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import language, pseudo_likelihood, toxicity
from tests.llm.conftest import PROSE, odd_rows

FILLER = PROSE.lower().replace(".", "").replace(",", "").split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def nearest(word, terms):
    found = []
    for number, term in enumerate(terms):
        letters = term.rstrip("*")
        ways = [distance(word[:k], letters) for k in range(len(word) + 1)] if term.endswith("*") else [distance(word, letters)]
        if min(ways) <= toxicity.errors_allowed(letters):
            found.append((min(ways), number))
    return min(found, default=None)


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = ("idiot", "idle", "worthless", "scum", "chlla*", "lowein*", "disgusting", "aab", "vequ*")
    automaton = toxicity.Automaton(terms)
    words = {"", "idiot", "idoit", "1diot", "worthles", "worthlesss", "wrthles", "scam", "chllaxyz", "chlaxyz", "lla", "loweinung", "loweung"}
    for _ in range(3000):
        base = rng.choice(terms).rstrip("*") + rng.choice(("", "", "en", "xyz"))
        letters = list(base)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(0, len(letters) + 1)
            letters[at:at + rng.randrange(0, 2)] = rng.choice(("", "a", "e", "i", "q"))
        words.add("".join(letters))
    for word in words:
        got, wanted = automaton.match(word), nearest(word, terms)
        assert (got is None) == (wanted is None) and (got is None or got[0] == wanted[0]), (word, got, wanted)


def test_quotation_weighs_less_than_abuse():
    lexicon = toxicity.Lexicon(toxicity.BUILT_IN, {(i, 0): 3.0 for i in range(len(toxicity.BUILT_IN))})
    automaton = toxicity.Automaton(lexicon.terms)

    def score(text):
        return float(toxicity.features(*toxicity.found_in(text, automaton), lexicon.weights) @ toxicity.DEFAULT)

    abuse = score("you are an idiot and the whole street knows it well")
    assert abuse > score('they read the word “idiot” aloud and the whole street knows it well') > score("the whole street knows it well")
    assert score("you stupid idiot and you worthless scum") > abuse


def toxic_corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(FILLER) for _ in range(60)]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(("moron", "scum", "grunzel" + rng.choice(FILLER)))
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus(spark)
    lexicon, function = toxicity.fit(docs, labels)
    assert any(t.startswith("grun") for t in lexicon.terms)
    rows = toxicity.score(docs, lexicon, function).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 600
    for r in rows:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    right = [((r["score"] >= toxicity.THRESHOLD) == bool(truth[r["doc_id"]])) for r in rows if r["held"]]
    assert len(right) > 100 and np.mean(right) > 0.97
    misspelt = docs.sparkSession.createDataFrame([(1, "you are a mroon and scuum, a morron, you moronn"), (2, PROSE)], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.score(misspelt, lexicon, function).collect()}
    assert found[1] >= toxicity.THRESHOLD > found[2]


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = toxic_corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_toxicity_edges(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon, function = toxicity.fit(odd, no_labels)
    assert set(lexicon.terms) == set(toxicity.BUILT_IN)
    rows = toxicity.score(odd, lexicon, function).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, lexicon, function).count() == 0
    half = spark.createDataFrame([(1, None), (None, 1), (77, 1), (2, 1)], "doc_id long, toxic int")
    toxicity.fit(odd, half)


LANGUAGES = {
    "en": "the quick brown fox and the lazy dog were seen with others near the old stone bridge of this town",
    "de": "der schnelle braune fuchs und der faule hund wurden mit anderen nahe der alten brücke gesehen",
    "fr": "le renard brun rapide et le chien paresseux ont été vus avec les autres près du vieux pont",
}


def language_rows(n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        name = sorted(LANGUAGES)[i % 3]
        words = LANGUAGES[name].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(12)), name, f"{name}.example.{'com' if i % 2 else 'org'}"))
    return rows


def fused_by_hand(rows, languages, table):
    """The same evidence in plain Python, one document at a time."""
    n = len(languages)
    seen, guesses = [], []
    for _, text, declared, _ in rows:
        grams = language.trigrams(text or "")
        s = sum((table[:, g] for g in grams), np.zeros(n)) * (min(len(grams), language.TEXT_GRAMS) / max(1, len(grams)))
        known = declared in languages
        if known:
            s = s + np.log([language.TRUST if x == declared else (1 - language.TRUST) / (n - 1) for x in languages])
        seen.append(s)
        guesses.append(int(np.argmax(s)) if len(grams) or known else None)
    parts = [(h.rsplit(".", 1)[-1], ".".join(h.rsplit(".", 2)[-2:]), h) for _, _, _, h in rows]
    counted = [g for g in guesses if g is not None]
    overall = (np.bincount(counted, minlength=n) + 1) / (len(counted) + n)
    out = []
    for i, s in enumerate(seen):
        prior = overall
        for level in range(3):
            others = [guesses[j] for j in range(len(rows)) if j != i and guesses[j] is not None and parts[j][level] == parts[i][level]]
            counts = np.bincount(np.array(others, int), minlength=n)
            prior = (counts + language.SMOOTHING * prior) / (counts.sum() + language.SMOOTHING)
        total = s + np.log(prior)
        p = np.exp(total - total.max())
        out.append((languages[int(np.argmax(total))], p.max() / p.sum()))
    return out


def test_fusion_against_plain_python(spark):
    rows = language_rows()
    rows += [(900, "", "de", "fr.example.com"), (901, "xyzzy", "", "fr.example.com"), (902, "the", "fr", "en.example.org"), (903, None, "tlh", "q.example.net")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    prepared = language.prepared(docs, host=F.col("source"))
    languages, table = language.learn(prepared)
    wanted_languages = ["de", "en", "fr", "tlh"]
    assert languages == wanted_languages
    found = {r["id"]: r for r in language.fused(language.evidence(prepared, languages, table), languages).collect()}
    for (i, *_), (name, probability) in zip(rows, fused_by_hand(rows, languages, table), strict=True):
        assert found[i]["language"] == name and found[i]["probability"] == pytest.approx(probability, abs=1e-9)
    assert not found[900]["accepted"] and not found[903]["accepted"]
    assert np.mean([found[r[0]]["language"] == r[2] for r in rows[:240]]) > 0.99


def test_every_declared_language_is_known(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(5)
    words = [["".join(rng.choice(letters) for _ in range(7)) for _ in range(12)] for _ in range(80)]
    names = [a + b for a in letters[:8] for b in letters[:10]]
    rows = [(k * 10 + j, " ".join(rng.choice(words[k]) for _ in range(12)), names[k], "") for k in range(80) for j in range(6 if k < 64 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["id"]: r for r in language.identify(language.prepared(docs, host=F.col("source"))).collect()}
    assert all(found[i]["language"] == name and found[i]["accepted"] for i, _, name, _ in rows)


def test_text_overrules_a_wrong_declaration(spark):
    rows = language_rows() + [(999, LANGUAGES["fr"], "en", "fr.example.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["id"]: r["language"] for r in language.identify(language.prepared(docs, host=F.col("source"))).collect()}
    assert found[999] == "fr"


def test_language_edges(odd, none):
    rows = language.identify(language.prepared(odd, host=F.col("source"))).collect()
    assert len(rows) == len(odd_rows()) and sum(not r["accepted"] for r in rows) == 6
    assert language.identify(language.prepared(none, host=F.col("source"))).count() == 0


def score_by_hand(net, ids):
    """Word by word, with plain softmaxes."""
    total = 0.0
    padded = [pseudo_likelihood.PAD] * 2 + list(ids) + [pseudo_likelihood.PAD] * 2
    for t in range(2, len(padded) - 2):
        h = np.tanh(sum(net.near[k][padded[t + p]].astype(float) for k, p in enumerate(pseudo_likelihood.PLACES)))
        h = np.append(h, 1.0)
        kind, word = divmod(padded[t], pseudo_likelihood.CLASSES)
        for logits, chosen in ((h @ net.of_class, kind), (h @ net.within[kind], word)):
            total += logits[chosen] - np.log(np.exp(logits).sum())
    return total


def test_pseudo_likelihood_against_plain_python(spark, docs_of):
    texts = [PROSE, "one", "", None, PROSE + " " + PROSE, "unseen words here"]
    docs = docs_of(texts)
    words = sorted(set(FILLER))
    net = pseudo_likelihood.Network.initial()
    numbers = pseudo_likelihood.Numbers(words)
    for r in pseudo_likelihood.score(docs, words, net).collect():
        ids, sizes = numbers.of([texts[r["doc_id"]] or ""])
        assert r["n_tokens"] == sizes[0]
        assert r["log_likelihood"] == pytest.approx(score_by_hand(net, ids[2:-2]), rel=1e-4, abs=1e-6)


def test_gradient():
    net = pseudo_likelihood.Network.initial()
    rng = np.random.default_rng(0)
    ids = np.r_[[pseudo_likelihood.PAD] * 2, rng.integers(0, 50, 400), [pseudo_likelihood.PAD] * 2].astype(np.int32)
    at = np.arange(2, 402)
    before = pseudo_likelihood.forward(net, ids, at)[0].mean()
    for _ in range(60):
        pseudo_likelihood.learn(net, ids, at, 0.1)
    assert pseudo_likelihood.forward(net, ids, at)[0].mean() > before + 1.0


def test_all_classes_share_one_softmax_pass(monkeypatch):
    calls, chosen = [], pseudo_likelihood._chosen
    monkeypatch.setattr(pseudo_likelihood, "_chosen", lambda *given: calls.append(1) or chosen(*given))
    ids = np.r_[[pseudo_likelihood.PAD] * 2, np.arange(0, pseudo_likelihood.SIZE, 3), [pseudo_likelihood.PAD] * 2].astype(np.int32)
    pseudo_likelihood.learn(pseudo_likelihood.Network.initial(), ids, np.arange(2, len(ids) - 2), 0.1)
    # One for the classes, one for the words within all of them.
    assert len(calls) == 2


def test_step_against_plain_python():
    rng = np.random.default_rng(3)
    ids = np.r_[[pseudo_likelihood.PAD] * 2, rng.integers(0, 90, 70), [pseudo_likelihood.PAD] * 2].astype(np.int32)
    at = rng.permutation(np.arange(2, 72))
    net, plain = pseudo_likelihood.Network.initial(), pseudo_likelihood.Network.initial()
    pseudo_likelihood.learn(net, ids, at, 0.1)
    moved = [np.zeros(w.shape) for w in (plain.near, plain.of_class, plain.within)]
    for t in at:
        h = np.append(np.tanh(sum(plain.near[k][ids[t + p]].astype(float) for k, p in enumerate(pseudo_likelihood.PLACES))), 1.0)
        kind, word = divmod(int(ids[t]), pseudo_likelihood.CLASSES)
        back = np.zeros(len(h))
        for weights, change, chosen in ((plain.of_class, moved[1], kind), (plain.within[kind], moved[2][kind], word)):
            d = np.exp(h @ weights)
            d /= d.sum()
            d[chosen] -= 1
            change += np.outer(h, d)
            back += weights @ d
        for k, p in enumerate(pseudo_likelihood.PLACES):
            moved[0][k][ids[t + p]] += back[:-1] * (1 - h[:-1] ** 2)
    for now, before, change in zip((net.near, net.of_class, net.within), (plain.near, plain.of_class, plain.within), moved, strict=True):
        assert np.allclose(now, before - 0.1 / np.sqrt(len(at)) * change, atol=1e-6)


def test_training_prefers_the_corpus_to_its_shuffle(spark):
    rng = random.Random(6)
    patterns = ["red fox runs home", "blue bird sings loud", "old ship sails west", "tall tree grows slow"]
    texts = [" ".join(rng.choice(patterns) for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = docs.select(F.xxhash64("text").alias("mark"), "text")
    words = pseudo_likelihood.vocabulary(marked)
    assert len(words) == 16
    net = pseudo_likelihood.train(marked, words, stride=1, rate=0.3)
    held = "red fox runs home old ship sails west blue bird sings loud"
    mixed = "fox home red runs ship old west sails bird loud blue sings"
    rows = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudo_likelihood.score(spark.createDataFrame([(0, held), (1, mixed)], "doc_id long, text string"), words, net).collect()}
    assert rows[0] > rows[1] + 0.5 and rows[0] > -np.log(16)


def test_every_place_is_learned_from(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(FILLER) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    marked = spark.createDataFrame([(t,) for t in texts], "text string").select(F.xxhash64("text").alias("mark"), "text").coalesce(2)
    words = pseudo_likelihood.vocabulary(marked)
    assert np.array_equal(pseudo_likelihood.train(marked, words).flat(), pseudo_likelihood.train(marked, words, stride=1).flat())


def test_pseudo_likelihood_edges(odd, none):
    marked = odd.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    words = pseudo_likelihood.vocabulary(marked)
    rows = pseudo_likelihood.score(odd, words, pseudo_likelihood.train(marked, words)).collect()
    assert len(rows) == len(odd_rows()) and all(r["n_tokens"] or r["log_likelihood"] == 0 for r in rows)
    empty = none.select(F.lit(1).cast("long").alias("mark"), F.lit("").alias("text"))
    assert pseudo_likelihood.vocabulary(empty) == []
    assert pseudo_likelihood.score(none, [], pseudo_likelihood.train(empty, [])).count() == 0
