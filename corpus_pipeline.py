"""Corpus preparation in stages, each an operator of the ``llm`` package.

Decisions are joined to rows by a hash of the text and the id, null-safe, so null and
repeated ids do no harm. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import decontamination, jaccard, language, packing, secrets
from tablecraft.llm.common import documents, let, stored, whole
from tablecraft.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; ``lang`` becomes that language."""
    host = F.col("source")
    found = language.identify(language.prepared(docs, host=host)).where("accepted")
    answers = found.groupBy("id", "mark", "declared", "host").agg(F.first("language").alias("language"))
    rows = docs.select(F.struct(*COLUMNS).alias("row"), *language.keys(host=host)).drop("suffix", "domain")
    same = rows["id"].eqNullSafe(answers["id"]) & (rows["mark"] == answers["mark"]) & (rows["declared"] == answers["declared"]) & (rows["host"] == answers["host"])
    return rows.join(answers, same).select("row.doc_id", "row.text", F.col("language").alias("lang"), "row.source", "row.n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each class; texts without words all stay."""
    rows = docs.select(*COLUMNS)
    classed = jaccard.near_duplicates(rows).groupBy("group", "doc_id", "mark").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "times")).alias("first")
    winners = classed.where(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.doc_id", "first.mark", "first.times")
    wordless = classed.where(F.col("group").isNull()).select("doc_id", "mark", F.lit(1).cast("long").alias("times"))
    keep = stored(winners.unionByName(wordless), "kept").withColumnsRenamed({"doc_id": "kept_id", "mark": "kept_mark"})
    marked = rows.withColumn("mark", F.xxhash64(whole(F.col("text"))))
    joined = marked.join(keep, marked["doc_id"].eqNullSafe(keep["kept_id"]) & (marked["mark"] == keep["kept_mark"])).drop("kept_id", "kept_mark")
    once = joined.where("times = 1")
    repeated = joined.where("times > 1").dropDuplicates(["doc_id", "mark"])
    return once.unionByName(repeated).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    rows = docs.select(*COLUMNS).withColumn("text_mark", F.xxhash64(whole(F.col("text"))))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    held = decontamination.passages(rows, benchmark, keys=("text_mark",)).select("text_mark").distinct()
    return rows.join(held, "text_mark", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by a mark; all documents stay."""
    found = secrets.find(docs.select(*COLUMNS), into="spans")
    changed = F.size("spans") > 0
    new = let(secrets.redacted(F.col("text"), F.col("spans")), lambda text: F.struct(text.alias("text"), F.length(text).cast("long").alias("n_chars")))
    return found.withColumn("new", new).select("doc_id", "new.text", "lang", "source", F.when(changed, F.col("new.n_chars")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of the remaining documents goes."""
    return packing.packed(docs, public_path(packing.TOKENIZER)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language id", identify_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]
ORACLE_SQL = None  # language models and tokenizers are beyond SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    kept = documents(spark, sf_dir, *COLUMNS)
    for name, stage in STAGES:
        kept = stored(stage(spark, kept, sf_dir), name.replace(" ", "-"))
    return kept
