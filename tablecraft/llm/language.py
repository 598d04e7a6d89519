"""Language identification by fusing evidence, as Bayes has it.

For every document the log-likelihoods of four kinds of evidence are added up for
every language and normalised:

* the text: character trigrams in hashed buckets, counted per declared language over
  all documents. Trigrams of a text are far from independent, so their mean counts
  as ``text_grams`` of them at most;
* the language that the markup declares, right with probability ``trust``;
* the suffix of the address: how documents of a language are spread over suffixes;
* the host: prior shares of languages, smoothed towards the host's domain, that one
  towards its suffix, and that one towards the whole corpus, each with the weight of
  ``smoothing`` documents. A document does not count in its own prior.

Suffixes and hosts are counted by grouped aggregation of what the text and the
declaration say. Every declared language is one, however many there are and however
rarely declared. Trigram counts per language (``BUCKETS`` numbers each) and how often
each is guessed reach the driver.

A document is accepted if its text has letters and the best language has at least
``least`` probability.

Defined results: a null or empty text, or one without letters, has no text evidence
and is not accepted; an empty or unknown declaration, suffix or host is no evidence;
ties go to the alphabetically first language; repeated rows give equal rows, each
counted; with no declared language at all the result has a null language. Extra
columns are kept out of the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import stored, whole

BUCKETS = 1 << 13
TEXT_GRAMS = 60
TRUST = 0.9
SMOOTHING = 20.0
LEAST = 0.5
EVIDENCE = "id long, mark long, declared string, suffix string, domain string, host string, letters int, text array<double>"

_OTHER = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the text's letter trigrams, words apart; no letters, none."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not clean:
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {clean} ".encode(), np.uint8).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def keys(doc_id: str = "doc_id", text: str = "text", declared: str | None = "lang", host: Column | None = None) -> list[Column]:
    """id, mark (hash of the text), declared, suffix, domain, host, with blanks for what is not known.

    Rows that agree in all of these get the same answer.
    """
    blank = F.lit("")
    place = F.lower(F.coalesce(host, blank)) if host is not None else blank
    parts = F.split(place, r"\.")
    dotted = F.size(parts) > 1
    return [
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(whole(F.col(text))).alias("mark"),
        (F.lower(F.split(F.trim(F.coalesce(F.col(declared).cast("string"), blank)), "[-_]")[0]) if declared else blank).alias("declared"),
        F.when(dotted, F.element_at(parts, -1)).otherwise(blank).alias("suffix"),
        F.when(dotted, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(blank).alias("domain"),
        place.alias("host")]


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", declared: str | None = "lang", host: Column | None = None) -> DataFrame:
    """The :func:`keys` of every row, and its text."""
    return docs.select(*keys(doc_id, text, declared, host), whole(F.col(text)).alias("text"))


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and, for each, the log-probability of every trigram bucket."""
    languages = sorted(r["declared"] for r in rows.where("declared <> ''").select("declared").distinct().collect())
    position = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name:
                    counts = np.bincount(trigrams(text), minlength=BUCKETS)
                    total[name] = total[name] + counts if name in total else counts
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["declared", "bucket", "n"])

    table = np.full((len(languages), BUCKETS), 0.5)
    counted = rows.select("declared", "text").mapInArrow(count, "declared string, bucket int, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # at most BUCKETS a language
        table[position[r["declared"]], r["bucket"]] += r["n"]
    return languages, np.log(table / table.sum(1, keepdims=True))


def evidence(rows: DataFrame, languages: list[str], table: np.ndarray, text_grams: int = TEXT_GRAMS) -> DataFrame:
    """The rows with the log-likelihood of the text for each language instead of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.T))  # BUCKETS numbers a language

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = shared.value
        for batch in batches:
            letters, likelihood = [], []
            for text in batch.column("text").to_pylist():
                grams = trigrams(text)
                letters.append(len(grams))
                total = np.bincount(grams, minlength=BUCKETS) @ columns if len(grams) else np.zeros(columns.shape[1])
                likelihood.append(total * (min(len(grams), text_grams) / max(1, len(grams))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "mark", "declared", "suffix", "domain", "host")), pa.array(letters, pa.int32()), pa.array(likelihood, pa.list_(pa.float64()))],
                names=["id", "mark", "declared", "suffix", "domain", "host", "letters", "text"])

    return rows.mapInArrow(weigh, EVIDENCE)


def _plus(*arrays: Column) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda x, y: x + y)
    return total


def _best(scores: Column) -> Column:
    """Position of the largest, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def fused(weighed: DataFrame, languages: list[str], trust: float = TRUST, smoothing: float = SMOOTHING, least: float = LEAST) -> DataFrame:
    """(id, mark, declared, host, language, probability, accepted). ``weighed`` is read several times: store it first."""
    n = len(languages)
    if not n:
        return weighed.select("id", "mark", "declared", "host", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), F.lit(False).alias("accepted"))
    names = F.array(*[F.lit(name) for name in languages])
    wrong = (1 - trust) / max(1, n - 1)
    known = F.array_contains(names, F.col("declared"))
    declared = F.transform(names, lambda name: F.when(known, F.when(name == F.col("declared"), F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(wrong if n > 1 else 1))))).otherwise(F.lit(0.0)))
    first = weighed.withColumn("seen", _plus(F.col("text"), declared)).withColumn("guess", F.when((F.col("letters") > 0) | known, _best(F.col("seen"))))

    # Counts of guessed languages, one row per language met; levels above are sums of those below.
    by_host = first.groupBy("suffix", "domain", "host", "guess").agg(F.count("*").alias("n"))
    up = lambda frame, *keys: frame.groupBy(*keys, "guess").agg(F.sum("n").alias("n"))
    by_domain = up(by_host, "suffix", "domain")
    by_suffix = up(by_domain, "suffix")

    def listed(frame: DataFrame, into: str, *keys: str) -> DataFrame:
        """The counts of each key as an array over the languages."""
        met = F.map_from_entries(F.collect_list(F.when(F.col("guess").isNotNull(), F.struct("guess", F.col("n").cast("double")))))
        full = lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))
        return frame.groupBy(*keys).agg(met.alias("met")).select(*keys, full(F.col("met")).alias(into))

    everywhere = np.zeros(n)
    for r in up(by_suffix).where("guess is not null").collect():
        everywhere[r["guess"]] = r["n"]
    overall = F.array(*[F.lit(float(x)) for x in (everywhere + 1) / (everywhere.sum() + n)])
    # Stored, so that the join below meets them as a table: broadcast if small, and else splittable at a hot host.
    levels = stored(
        listed(by_host, "of_host", "suffix", "domain", "host")
        .join(listed(by_domain, "of_domain", "suffix", "domain"), ["suffix", "domain"])
        .join(listed(by_suffix, "of_suffix", "suffix"), "suffix"), "hosts")

    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((F.col("guess") == i).cast("double"), F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        others = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda a, c: a + c)
        return F.zip_with(others, above, lambda c, p: (c + p * smoothing) / (total + smoothing))

    joined = first.join(levels, ["suffix", "domain", "host"])
    # A blank level is no evidence: its prior is the one above.
    joined = joined.withColumn("p_suffix", F.when(F.col("suffix") == "", overall).otherwise(smoothed(F.col("of_suffix"), overall)))
    joined = joined.withColumn("p_domain", F.when(F.col("domain") == "", F.col("p_suffix")).otherwise(smoothed(F.col("of_domain"), F.col("p_suffix"))))
    joined = joined.withColumn("p_host", F.when(F.col("host") == "", F.col("p_domain")).otherwise(smoothed(F.col("of_host"), F.col("p_domain"))))
    joined = joined.withColumn("total", _plus(F.col("seen"), F.transform("p_host", lambda p: F.log(p))))
    top = F.array_max("total")
    mass = F.aggregate(F.transform("total", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    return joined.select(
        "id", "mark", "declared", "host", F.get(names, _best(F.col("total"))).alias("language"), (1 / mass).alias("probability"),
        ((F.col("letters") > 0) & (1 / mass >= least)).alias("accepted"))


def identify(rows: DataFrame) -> DataFrame:
    """(id, mark, declared, host, language, probability, accepted) of the rows of :func:`prepared`."""
    languages, table = learn(rows)
    return fused(stored(evidence(rows, languages, table), "language"), languages)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare a language; their source is the host."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(prepared(docs, host=F.col("source"))).select(F.col("id").alias("doc_id"), "language", "probability", "accepted")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: text without markup, the language that the markup declares, host and suffix of the address."""
    html = whole(F.col("html"))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>", " ")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id", bare.alias("text"), F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1).alias("lang"),
        F.regexp_extract(whole(F.col("url")), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1).alias("host"))
    return identify(prepared(pages, doc_id="page_id", host=F.col("host"))).select(F.col("id").alias("page_id"), "language", "probability", "accepted")
