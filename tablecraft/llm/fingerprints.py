"""Document fingerprints that add up over paragraphs, in DataFrame functions only.

A paragraph (a non-empty line) is hashed into a wide vector; a document's
fingerprint is the sum of the vectors of its paragraphs, every coordinate modulo a
power of two. So the order of paragraphs does not matter, and a paragraph is
inserted or deleted by adding or subtracting its vector (:func:`added`). The
vector has three parts:

* ``exact``: 4 coordinates modulo 2**60, each from its own hash: equality;
* ``lines``: 128 coordinates modulo 2**8, one of them set by the paragraph's hash;
* ``parts``: the same for each sentence of the paragraph.

Two documents that differ in D lines (or sentences) leave a coordinate untouched
with probability exp(-D/128), so the share of equal coordinates gives D, and with
the counts a Jaccard likeness. Sentences are finer; where so many differ that few
coordinates are left equal, lines decide.

Defined results: a null text is empty; texts without paragraphs have the all-zero
fingerprint; two of those are alike (1). Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, let, stored, whole

EXACT, EXACT_BITS = 4, 60
OUTER, INNER = 16, 8
LANES = OUTER * INNER
#: Fewer equal lanes than this say nothing about how many units differ.
LEAST_EQUAL = 6


def _lanes(hashes: Column) -> Column:
    """Sums per lane modulo 256; a hash's lowest bits name the lane, the next its addend (1 to 255)."""

    def addends(chosen: Column) -> Column:
        return F.aggregate(chosen, F.lit(0), lambda total, h: (total + (F.shiftright(h, 7) % 255 + 255) % 255 + 1).cast("int") % 256).cast("smallint")

    def inner(group: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(INNER - 1)), lambda lane: addends(F.filter(group, lambda h: h.bitwiseAND(F.lit(INNER - 1).cast("long")) == lane)))

    outer = F.transform(
        F.sequence(F.lit(0), F.lit(OUTER - 1)),
        lambda lane: let(F.filter(hashes, lambda h: F.shiftright(h, 3).bitwiseAND(F.lit(OUTER - 1).cast("long")) == lane), inner))
    return F.flatten(outer)


def fingerprint(text: Column) -> Column:
    """struct(exact, lines, parts, n_lines, n_parts) of a text."""
    low = F.lit((1 << EXACT_BITS) - 1)

    def coordinate(paragraphs: Column, seed: int) -> Column:
        return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda total, p: (total + F.xxhash64(p, F.lit(seed)).bitwiseAND(low)).bitwiseAND(low))

    def of(paragraphs: Column) -> Column:
        exact = [coordinate(paragraphs, seed) for seed in range(EXACT)]
        sentences = F.filter(F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?])\s+"))), lambda s: s != "")
        return let(F.transform(sentences, lambda s: F.xxhash64(s, F.lit("part"))), lambda parts: F.struct(
            F.array(*exact).alias("exact"), _lanes(F.transform(paragraphs, lambda p: F.xxhash64(p, F.lit("line")))).alias("lines"),
            _lanes(parts).alias("parts"), F.size(paragraphs).alias("n_lines"), F.size(parts).alias("n_parts")))

    return let(F.filter(F.split(whole(text), "\n"), lambda p: p != ""), of)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the paragraphs of both, or of ``a`` without those of ``b`` (``sign=-1``)."""
    low = F.lit((1 << EXACT_BITS) - 1)
    exact = F.zip_with(a["exact"], b["exact"], lambda x, y: (x + y * sign).bitwiseAND(low))
    summed = lambda part: F.zip_with(a[part], b[part], lambda x, y: F.pmod(x + y * sign, F.lit(256)).cast("smallint"))
    return F.struct(exact.alias("exact"), summed("lines").alias("lines"), summed("parts").alias("parts"),
                    (a["n_lines"] + b["n_lines"] * sign).alias("n_lines"), (a["n_parts"] + b["n_parts"] * sign).alias("n_parts"))


def as_text(print_: Column) -> Column:
    wide = lambda part, digits: F.array_join(F.transform(print_[part], lambda x: F.lower(F.lpad(F.hex(x), digits, "0"))), "")
    return F.concat_ws("-", wide("exact", EXACT_BITS // 4), print_["n_lines"].cast("string"), wide("lines", 2), wide("parts", 2))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""

    def level(part: str, count: str) -> tuple[Column, Column]:
        equal = F.aggregate(F.zip_with(a[part], b[part], lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
        differ = -F.log(F.greatest(equal, F.lit(1)) / F.lit(float(LANES))) * LANES
        total = (a[count] + b[count]).cast("double")
        return equal, F.greatest(F.lit(0.0), (total - differ) / (total + differ))

    parts_equal, by_parts = level("parts", "n_parts")
    lines_equal, by_lines = level("lines", "n_lines")
    return (F.when(a["exact"] == b["exact"], 1.0).when(parts_equal >= LEAST_EQUAL, by_parts)
            .when(lines_equal >= LEAST_EQUAL, by_lines).otherwise(0.0))


def _following(keys: DataFrame) -> DataFrame:
    """Keys (id, mark, doc_id) with the next key by descending doc_id; the last is followed by the first.

    Keys are ordered by range partitions, so no task sees all of them; only the
    first key of each partition is looked at across partitions.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    placed = stored(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "key-order")
    inside = Window.partitionBy("range").orderBy(*order)
    key = F.struct("id", "mark")
    led = placed.withColumn("next", F.lead(key).over(inside))
    heads = placed.withColumn("place", F.row_number().over(inside)).where("place = 1").select("range", key.alias("head"))
    across = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("after"))
    return led.join(heads, "range").withColumn("next", F.coalesce("next", "after")).drop("range", "after")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last 1/``share`` code points replaced by the first as
    many (or all) of the next document by descending doc_id (null ids come last;
    after the last comes the first). Columns: doc_id, n_chars, print, edited_text,
    edited_print, next_print.

    Rows that repeat both id and text stand at one place of that order and share
    its next document; different texts of one id follow each other in a fixed
    order. Texts move once, by key; what moves on to the document before is the
    part of them that is needed there.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    keyed = body.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn(
        "mark", F.xxhash64(F.col("doc_id").isNull(), "text"))
    keys = keyed.groupBy("id", "mark").agg(F.max("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n"))
    asked = _following(keys).select(
        F.col("next.id").alias("id"), F.col("next.mark").alias("mark"), F.col("id").alias("for_id"), F.col("mark").alias("for_mark"),
        F.col("doc_id").alias("for_doc"), F.col("n").alias("for_n"))
    printed = keyed.select("id", "mark", "text", fingerprint(F.col("text")).alias("print"))
    heads = (
        printed.join(asked, ["id", "mark"])
        .select("for_id", "for_mark", "for_doc", "for_n", F.substring(F.col("text"), F.lit(1), F.floor(F.col("for_n") / share).cast("int")).alias("head"), F.col("print").alias("next_print"))
        # Copies of the next document offer the same head again.
        .groupBy("for_id", "for_mark").agg(F.first("for_doc").alias("doc_id"), F.first("for_n").alias("n_chars"), F.first("head").alias("head"), F.first("next_print").alias("next_print"))
        .withColumnsRenamed({"for_id": "id", "for_mark": "mark"}))
    whole_rows = printed.join(heads, ["id", "mark"])
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int"))
    return whole_rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "print", F.concat(kept, F.col("head")).alias("edited_text"), "next_print").select(
        "doc_id", "n_chars", "print", "edited_text", fingerprint(F.col("edited_text")).alias("edited_print"), "next_print")


def op6(spark, sf_dir: str) -> DataFrame:
    found = edited(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
