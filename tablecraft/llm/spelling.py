"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

A word of length L gives two disjoint chunks, its first and its last L // 2
letters. One edit leaves one of them whole, so a word within one edit, of the same
length or one longer, has that chunk among its positional grams, moved by no more
than the difference of lengths. Chunks of every word meet positional grams of every
word of length L or L + 1; pairs are verified by edit distance after a test of
their letter sets. Everything is a projection, a grouping with partial sums, or a join on
(length, chunk, gram), which AQE splits where a chunk is very common.

Words are maximal runs of Latin letters of the tables Basic Latin and Latin-1, in
lower case for A-Z only, of at least ``LETTERS`` code points and ``TIMES``
occurrences. Defined results: null and empty texts have no words; a null id counts
as an empty one where runs are damaged; repeated rows count as often as they occur;
of near words that are equally common the smallest in code-point order is taken; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, let, stored, whole

LETTERS = 6
TIMES = 5
#: A form is at least so many times as common as its variant.
RATIO = 5
#: Every so many-th occurrence (by checksum) loses a letter.
DAMAGED = 199


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.translate(run, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.lower(run) == run, run).otherwise(plain)


def damaged(doc_id: Column, word: Column, every: int = DAMAGED) -> Column:
    """The word, less one letter where ``every`` divides the checksum of id and word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))

    def cut(at: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))

    return let(h, lambda x: F.when(x % every == 0, cut((x % F.length(word)).cast("int"))).otherwise(word))


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, times: int = TIMES, every: int = DAMAGED) -> DataFrame:
    """(word, n) of the words that occur often enough, after the damage of :func:`damaged`."""
    runs = F.regexp_extract_all(whole(F.col(text)), F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    words = docs.select(F.col(doc_id).alias("at"), F.explode(runs).alias("run")).select("at", lowered(F.col("run")).alias("word"))
    kept = words.select(damaged(F.col("at"), F.col("word"), every).alias("word")).where(F.length("word") >= letters)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def letter_set(word: Column) -> Column:
    """64 bits, one for each letter (modulo 64) of the word; one edit changes at most two."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def _key(length: Column, chunk: int, gram: Column) -> Column:
    return F.xxhash64(length, F.lit(chunk), gram)


def chunks(words: DataFrame) -> DataFrame:
    """Two rows a word: its disjoint chunks, by (length, chunk number, letters)."""
    size = F.col("length")
    half = F.floor(size / 2).cast("int")
    keys = F.array(_key(size, 0, F.substring("word", F.lit(1), half)), _key(size, 1, F.substring("word", size - half + 1, half)))
    return words.select("word", "n", "length", "letters", F.explode(keys).alias("key"))


def grams(words: DataFrame) -> DataFrame:
    """The positional grams that chunks of words as long or one shorter can meet within their shift.

    A gram is as long as the chunk and stands at the chunk's place or, in a word that
    is longer by one, at most one further on.
    """

    def at(size: Column, longer: int) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [_key(size, chunk, F.substring("word", place + 1 + shift, half))
                for chunk, place in ((0, F.lit(0)), (1, size - half)) for shift in range(longer + 1)]

    size = F.col("length")
    keys = F.array(*at(size, 0), *at(size - 1, 1))
    return words.select("word", "n", "length", "letters", F.explode(F.array_distinct(keys)).alias("key"))


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart once, from stored (word, n)."""
    sized = words.select("word", "n", F.length("word").alias("length"), letter_set(F.col("word")).alias("letters"))
    a, b = chunks(sized).alias("a"), grams(sized).alias("b")
    longer = F.col("b.length") - F.col("a.length")
    alike = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2
    once = (longer == 1) | ((longer == 0) & (F.col("a.word") < F.col("b.word")))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & once & alike)
    verified = met.where(F.levenshtein("a.word", "b.word", 1) == 1)
    return verified.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where forms lead from each word, from (word, form); pointers are doubled until none moves.

    Counts grow fivefold at each step, so a chain is short and the rounds are its logarithm.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = now.join(after, now["root"] == after["at"], "left")
        if moved.where("further is not null").isEmpty():
            return now
        now = stored(moved.select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO, every: int = DAMAGED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module."""
    words = stored(counted(docs, doc_id, text, letters, times, every), "words")
    pairs = stored(near(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    around = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    takes = -F.col("best.less") >= ratio * F.col("n")
    found = stored(around.select("word", "n_near", F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")), "forms")
    lead = roots(found.where("form is not null").select("word", "form"))
    return words.join(found, "word", "left").join(lead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


#: The same rows from all words less one letter: two words of one length are near if they agree without the
#: letter at one place, two of lengths that differ by one if the longer agrees with the shorter without one letter.
OP13_SQL = r"""
WITH RECURSIVE remainders AS (
  SELECT list(r ORDER BY b) AS list FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS r
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents)),
spelt AS (
  SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM runs GROUP BY doc_id, run),
summed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda crc, byte: xor(crc >> 8, list[(xor(crc, byte) & 255) + 1])), 4294967295) AS h
  FROM spelt, remainders),
kept AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
around AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word, n),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN around USING (word)),
walk AS (
  SELECT word, word AS reached, form AS further FROM forms
  UNION ALL SELECT walk.word, walk.further, forms.form FROM walk JOIN forms ON forms.word = walk.further)
SELECT word, form, reached AS root, n, n_near, form_n FROM walk JOIN forms USING (word) WHERE further IS NULL
"""
