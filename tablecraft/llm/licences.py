"""Licence scan by a positional index of rare words, in DataFrame functions only.

A template is a sentence that licences are known by, with one mandatory key
phrase in it. Document frequencies of the template words are counted over all
documents. Each template's rarest words are its postings: (word, place relative
to the key phrase). A document's occurrences of posted words are looked up, each
proposes a start of the key phrase, and the start stands if every word of the key
phrase is there. How much of the template's rare-word weight agrees on that start
is the score of the find.

Every place of a key phrase holds the phrase's rarest word, so no place is missed.

Defined results: a null text is empty; an empty text has no words, no labels and
score 0; an empty table gives an empty result; equal rows give equal rows; of
equally rare words the alphabetically first is posted. Only the named columns of
the input are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import let, whole

#: What stands between words, after lower-casing A-Z: the complement of [^\x00-\x2F\x3A-\x60\x7B-\x7F].
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare words posted for a template, beside the rarest of its key phrase.
POSTED = 3


@dataclass(frozen=True)
class Template:
    label: str
    sentence: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.sentence.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key_words
        return next(i for i in range(len(words)) if words[i:i + len(key)] == key)


# Opening words of public licences, lower case, without punctuation.
TEMPLATES = (
    Template("mit", "released under the mit license", "under the mit license", base=True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", base=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(whole(text), UPPER, LOWER), BETWEEN), "")


def word_idf(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word over all documents.

    One row per template word reaches the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = docs.select(F.explode(F.concat(F.array_intersect(words_of(F.col(text)), known), F.array(F.lit("")))).alias("word")).groupBy("word").count().collect()
    seen = {r["word"]: r["count"] for r in rows}
    return {w: math.log((seen.get("", 0) + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}


def postings(template: Template, idf: Mapping[str, float]) -> list[tuple[str, int, float]]:
    """(word, place relative to the key phrase, weight); the first is the key phrase's rarest word."""
    start, key = template.key_at, range(len(template.key_words))
    places = [(w, i - start, idf[w]) for i, w in enumerate(template.words)]
    rare = sorted(places, key=lambda p: (-p[2], p[0], p[1]))
    anchor = next(p for p in rare if p[1] in key)
    return [anchor, *[p for p in rare if p != anchor][:POSTED]]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES,
         idf: Mapping[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, finds): every verified place of every template's key phrase.

    A find is (label, base, start, votes, score): the key phrase starts at word
    ``start``; ``votes`` posted words agree on it, with the share ``score`` of
    their weight.
    """
    idf = word_idf(docs, text, templates) if idf is None else idf
    posted = [postings(t, idf) for t in templates]
    probes = sorted({word for p in posted for word, _, _ in p})
    kind = "array<struct<label:string,base:boolean,start:int,votes:int,score:double>>"

    def finds(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(probes), F.struct(i.alias("at"), w.alias("word")))), lambda h: h.isNotNull())
        return let(hits, lambda hit: F.concat(*[starts(words, hit, t, p) for t, p in zip(templates, posted, strict=True)]))

    def starts(words: Column, hit: Column, template: Template, posting: list[tuple[str, int, float]]) -> Column:
        anchor, shift, _ = posting[0]
        key = template.key_words

        def stands(h: Column) -> Column:
            start = h["at"] - shift
            return (h["word"] == anchor) & (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, len(key)) == F.array(*[F.lit(w) for w in key]))

        def find(h: Column) -> Column:
            start = h["at"] - shift
            # Outside the text get() is null, and so is the comparison.
            agree = [F.coalesce((start + at >= 0) & (F.get(words, F.greatest(start + at, F.lit(0))) == word), F.lit(False)) for word, at, _ in posting]
            total = sum(w for _, _, w in posting)
            share = [F.when(a, F.lit(w / total if total else 1 / len(posting))).otherwise(0.0) for a, (_, _, w) in zip(agree, posting, strict=True)]
            return F.struct(
                F.lit(template.label).alias("label"), F.lit(template.base).alias("base"), start.alias("start"),
                sum((a.cast("int") for a in agree), F.lit(0)).alias("votes"), F.least(F.lit(1.0), sum(share, F.lit(0.0))).alias("score"))

        return F.transform(F.filter(hit, stands), find).cast(kind)

    scanned = let(words_of(F.col(text)), lambda words: F.struct(F.size(words).cast("long").alias("n_words"), finds(words).alias("finds")))
    return docs.select(F.col(doc_id).alias("doc_id"), scanned.alias("s")).select("doc_id", "s.n_words", "s.finds")


def digest(scanned: DataFrame) -> DataFrame:
    """One row per document: places of the base phrases and sorted labels."""
    base = F.filter("finds", lambda f: f["base"])
    start = F.transform(base, lambda f: f["start"].cast("long"))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("finds")).alias("labels"),
        F.coalesce(F.array_max(F.transform("finds", lambda f: f["score"])), F.lit(0.0)).alias("score"))
