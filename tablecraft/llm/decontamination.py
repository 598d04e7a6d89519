"""Benchmark passages in documents by spaced seeds, in DataFrame functions only.

A mask selects some of the words after a place and ignores the others, so a seed
survives a substituted word at an ignored place. Masks are made of word pairs: pair
hashes are computed once per document and combined for every mask. Benchmark seeds
are looked up by the seeds of every place of every document; each hit lines up a
document with an item, and the item's words are compared with the document's words
at the same relative places. A document holds a passage of the item if the best
scoring run (1 for an equal word, ``-MISS`` for another) has at least
``least_words`` equal words and at least
``least_share`` of its words are equal.

The benchmark is the query set: it is broadcast in blocks of at most
``block_words`` words, however large it is, and every block goes over all documents.

Words are runs of letters and digits in lower case. Defined results: a null text
is empty; items and documents of fewer than ``least_words`` words cannot hold a
passage; repeated rows of one id count once per item; rows with a null id share the
null id; empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, let, whole

#: Places of the word pairs that each mask selects. At least 12 equal words, four fifths of a passage, hold one of them, wherever the others are.
MASKS = ((0, 3, 6), (0, 2, 5), (0, 5, 7), (0, 2, 9), (0, 5, 9))
LEAST_WORDS = 12
LEAST_SHARE = 0.8
MISS = 2
#: Benchmark words broadcast together: five seeds a word of about 60 bytes each, with the words of its item.
BLOCK_WORDS = 100_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: Column) -> Column:
    """For each mask in turn, a hash for every place.

    Near the end of a text seeds are cut short; they match nothing by accident that
    the comparison of words would let pass.
    """
    size = F.greatest(F.size(words), F.lit(1))

    def masked(pairs: Column, number: int, places: tuple[int, ...]) -> Column:
        _, second, third = places
        two = F.zip_with(pairs, F.slice(pairs, F.lit(second + 1), size), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(pairs, F.lit(third + 1), size), lambda a, b: F.xxhash64(F.lit(number), a, b))

    pairs = F.zip_with(words, F.slice(words, F.lit(2), size), lambda a, b: F.xxhash64(a, b))
    return let(pairs, lambda p: F.concat(*[masked(p, number, places) for number, places in enumerate(MASKS)]))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_key, item_at, item_size) for the places of every item at which a mask fits."""
    spans = F.array(*[F.lit(max(places) + 2) for places in MASKS])
    n = F.col("item_size")
    placed = items.select("item_key", F.size("item_words").alias("item_size"), F.posexplode(_seeds(F.col("item_words"))).alias("p", "seed"))
    at = placed.withColumn("item_at", F.pmod("p", n)).withColumn("mask", (F.col("p") / n).cast("int"))
    return at.where(F.col("item_at") + F.get(spans, F.col("mask")) <= n).select("seed", "item_key", "item_at", "item_size")


def _best_run(equal: Column) -> Column:
    """struct(words, length, end) of the best scoring run in an array of booleans."""
    zero = F.struct(*[F.lit(0).alias(n) for n in ("score", "words", "length", "best", "best_words", "best_length", "best_end", "i")])

    def step(s: Column, same: Column) -> Column:
        gain = F.when(same, F.lit(1)).otherwise(F.lit(-MISS))
        on = s["score"] + gain > 0
        score = F.when(on, s["score"] + gain).otherwise(F.lit(0))
        words = F.when(on, s["words"] + same.cast("int")).otherwise(F.lit(0))
        length = F.when(on, s["length"] + 1).otherwise(F.lit(0))
        better = score > s["best"]
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(
            score.alias("score"), words.alias("words"), length.alias("length"), pick(score, s["best"]).alias("best"), pick(words, s["best_words"]).alias("best_words"),
            pick(length, s["best_length"]).alias("best_length"), pick(s["i"] + 1, s["best_end"]).alias("best_end"), (s["i"] + 1).alias("i"))

    return F.aggregate(equal, zero, step, lambda s: F.struct(s["best_words"].alias("words"), s["best_length"].alias("length"), s["best_end"].alias("end")))


def passages(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text",
             least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(*keys, item_id, equal_words, passage_words, first_word): the best passage of an item in a document."""
    items = benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item_words")).where(F.size("item_words") >= least_words).distinct()
    items = items.withColumn("item_key", F.xxhash64(F.col("item_id").isNull(), "item_id", "item_words"))
    total = items.agg(F.coalesce(F.sum(F.size("item_words")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))
    body = docs.select(*keys, whole(F.col(text)).alias("text")).withColumn("mark", F.xxhash64("text"))
    seeded = let(word_hashes(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), F.when(F.size(w) >= least_words, _seeds(w)).alias("seeds")))
    # The outer form: the plain one would filter by the seeds first, and so compute them twice. Null seeds meet nothing.
    places = body.select("mark", seeded.alias("s")).select("mark", "s.n", F.posexplode_outer("s.seeds").alias("p", "seed"))
    found = None
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod("item_key", F.lit(blocks)) == block)
        best = _held(body, keys, places, chosen, least_words, least_share)
        found = best if found is None else found.unionByName(best)
    return found.select(*keys, "item_id", "best.equal_words", "best.passage_words", "best.first_word")


def _held(body: DataFrame, keys: tuple[str, ...], places: DataFrame, items: DataFrame, least_words: int, least_share: float) -> DataFrame:
    """Hits of one block of items, then the comparison of words; texts that are equal are looked up once."""
    hits = places.join(F.broadcast(benchmark_seeds(items)), "seed").select(
        "mark", "item_key", "item_size", (F.pmod(F.col("p"), F.col("n")) - F.col("item_at")).alias("start")).distinct()
    lined = hits.groupBy("mark").agg(F.collect_list(F.struct("item_key", "item_size", "start")).alias("hits"))

    def parts(words: Column, lines: Column) -> Column:
        return F.transform(lines, lambda h: F.struct(
            h["item_key"].alias("item_key"), h["start"].alias("start"),
            F.slice(words, F.greatest(h["start"], F.lit(0)) + 1, F.greatest(F.lit(0), h["item_size"] + F.least(h["start"], F.lit(0)))).alias("part")))

    lined_up = body.join(lined, "mark").select(*keys, F.explode(let(word_hashes(F.col("text")), lambda w: parts(w, F.col("hits")))).alias("h"))
    both = lined_up.select(*keys, "h.item_key", "h.start", "h.part").join(F.broadcast(items), "item_key")
    against = F.slice("item_words", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("part"))
    run = _best_run(F.zip_with("part", against, lambda a, b: F.coalesce(a == b, F.lit(False))))
    compared = both.select(*keys, "item_id", F.greatest("start", F.lit(0)).alias("begin"), run.alias("run"))
    enough = (F.col("run.words") >= least_words) & (F.col("run.words") >= F.col("run.length") * least_share)
    return compared.where(enough).groupBy(*keys, "item_id").agg(
        F.max(F.struct(F.col("run.words").alias("equal_words"), F.col("run.length").alias("passage_words"),
                       (F.col("begin") + F.col("run.end") - F.col("run.length")).alias("first_word"))).alias("best"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
