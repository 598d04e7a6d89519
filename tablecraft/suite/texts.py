"""Agent messages built from the conversations table, and redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.functions.redact import MAX_BYTES, redact
from tablecraft.operators import conversations as conv
from tablecraft.suite.registry import query, table

# Turns per chunk when a conversation is folded.
CHUNK_TURNS = 4096


def messages(spark, sf_dir):
    """Answers are assistant turns, thoughts system turns, SQL comes of user turns."""
    text = F.col("text")
    sql = F.concat(F.lit("SELECT note FROM Shop.Topic_"), F.col("conv_id").cast("string"), F.lit(" WHERE turn = "), F.col("turn").cast("string"))
    body = (
        F.when(
            F.col("role") == "assistant",
            F.to_json(F.struct(F.struct(F.struct(F.array(text).alias("parts"), F.lit("FINAL_RESPONSE").alias("textType")).alias("text")).alias("systemMessage"))),
        )
        .when(
            F.col("role") == "system",
            F.to_json(F.struct(F.struct(F.struct(F.array(text, F.lit("noted")).alias("parts"), F.lit("THOUGHT").alias("textType")).alias("text")).alias("systemMessage"))),
        )
        .when(
            F.col("turn") == 0,
            F.to_json(F.struct(F.struct(F.struct(F.struct(sql.alias("sql")).alias("query")).alias("data")).alias("systemMessage"))),
        )
        .when(
            F.col("turn") == 4,
            F.to_json(F.struct(F.struct(F.concat(F.lit("late at "), F.col("turn").cast("string")).alias("message")).alias("error"))),
        )
        .otherwise(F.to_json(F.struct(F.struct(F.struct(sql.alias("generatedSql")).alias("data")).alias("systemMessage"))))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("message"))


MESSAGES = """
m AS (SELECT conv_id, turn,
    CASE WHEN role = 'assistant' THEN text END AS answer,
    CASE WHEN role = 'system' THEN text || '#noted' END AS thoughts,
    CASE WHEN role = 'user' AND turn <> 4 THEN 'SELECT note FROM Shop.Topic_' || conv_id || ' WHERE turn = ' || turn END AS sql_text,
    CASE WHEN role = 'user' AND turn = 4 THEN 'late at ' || turn END AS error,
    CASE role WHEN 'assistant' THEN 'FINAL_RESPONSE' WHEN 'system' THEN 'THOUGHT' ELSE '' END AS text_type
  FROM conversations)
"""
FOLDED = f"""
{MESSAGES}, f AS (SELECT conv_id,
    coalesce(string_agg(answer, ' ' ORDER BY turn), '') AS answer,
    coalesce(string_agg(thoughts, '#' ORDER BY turn), '') AS thoughts,
    coalesce(string_agg(sql_text, chr(10) ORDER BY turn), '') AS sql_text,
    coalesce(arg_max(error, turn) FILTER (WHERE error IS NOT NULL), '-') AS error
  FROM m GROUP BY conv_id)
"""


@query(
    "msg_extract",
    f"""WITH {MESSAGES} SELECT conv_id, turn, text_type, coalesce(answer, '') AS answer,
    coalesce(thoughts, '') AS thoughts, coalesce(sql_text, '') AS sql_text, coalesce(error, '-') AS error FROM m""",
)
def msg_extract(spark, sf_dir):
    typed = conv.parse_messages(messages(spark, sf_dir), "message", ["conv_id", "turn"])
    return typed.select(
        "conv_id", "turn", "text_type",
        F.array_join("answer_parts", " ").alias("answer"),
        F.array_join("thoughts", "#").alias("thoughts"),
        F.array_join("sqls", "\n").alias("sql_text"),
        F.coalesce("error", F.lit("-")).alias("error"),
    )


def folded(spark, sf_dir):
    typed = conv.parse_messages(messages(spark, sf_dir), "message", ["conv_id", "turn"])
    chunk = F.floor(F.col("turn") / CHUNK_TURNS)
    return conv.fold_conversations(typed, ["conv_id"], ["turn"], chunk=chunk)


@query("conv_fold", f"WITH {FOLDED} SELECT * FROM f")
def conv_fold(spark, sf_dir):
    return folded(spark, sf_dir).select(
        "conv_id", "answer", F.array_join("thoughts", "#").alias("thoughts"), "sql_text",
        F.coalesce("error", F.lit("-")).alias("error"),
    )


@query(
    "references_table",
    f"""WITH {FOLDED} SELECT conv_id,
    contains(lower(sql_text), 'topic_1') AS topic_one, contains(lower(sql_text), 'topic_' || conv_id) AS own_topic,
    false AS nothing FROM f""",
)
def references_table(spark, sf_dir):
    own = F.concat(F.lit("project.shop.TOPIC_"), F.col("conv_id").cast("string"))
    return folded(spark, sf_dir).select(
        "conv_id",
        conv.references_table("sql_text", "shop.topic_1").alias("topic_one"),
        conv.references_table("sql_text", own).alias("own_topic"),
        conv.references_table("sql_text", "shop.").alias("nothing"),
    )


def golden(spark, sf_dir):
    """One question per conversation; what it expects depends on its opening turn."""
    opening = table(spark, sf_dir, "conversations").where("turn = 0")
    number = F.col("conv_id").cast("string")
    return opening.select(
        "conv_id",
        F.col("text").alias("question"),
        F.array(F.concat(F.lit("shop.topic_"), number), F.when(F.length("text") > 100, F.lit("shop.topic_1")).otherwise(F.lit("topic"))).alias("must_reference_tables"),
        F.when(F.col("role") == "user", F.lit("turn = [02468]")).alias("expect_sql_matches"),
        F.when(F.length("text") <= 150, F.lit("en")).alias("expect_answer_contains"),
        (F.length("text") > 50).alias("must_not_error"),
    )


SCORED = f"""
{FOLDED}, g AS (SELECT conv_id, length(text) AS n, role FROM conversations WHERE turn = 0),
b AS (SELECT conv_id,
    CASE WHEN NOT contains(lower(sql_text), 'topic_' || conv_id) THEN 'shop.topic_' || conv_id END AS miss1,
    CASE WHEN n > 100 AND NOT contains(lower(sql_text), 'topic_1') THEN 'shop.topic_1'
         WHEN n <= 100 AND NOT contains(lower(sql_text), 'topic') THEN 'topic' END AS miss2,
    CASE WHEN role = 'user' AND NOT regexp_matches(sql_text, 'turn = [02468]') THEN 'SQL does not match turn = [02468]' END AS no_match,
    CASE WHEN n <= 150 AND NOT contains(answer, 'en') THEN 'answer does not contain en' END AS no_word,
    CASE WHEN n > 50 AND error <> '-' THEN 'error: ' || error END AS failed
  FROM g JOIN f USING (conv_id)),
s AS (SELECT conv_id, concat_ws('; ',
    CASE WHEN miss1 IS NOT NULL OR miss2 IS NOT NULL THEN 'SQL does not reference ' || concat_ws(', ', miss1, miss2) END,
    no_match, no_word, failed) AS failure_reason FROM b)
"""


@query("golden_score", f"WITH {SCORED} SELECT conv_id, failure_reason = '' AS passed, failure_reason FROM s")
def golden_score(spark, sf_dir):
    scores = conv.score(golden(spark, sf_dir), folded(spark, sf_dir), on="conv_id")
    return scores.select("conv_id", "passed", "failure_reason")


@query(
    "golden_summary",
    f"""WITH {SCORED}, t AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE failure_reason = '') AS passed FROM s)
    SELECT total, passed, total = passed AS all_passed, passed || '/' || total || ' golden queries passed' AS summary FROM t""",
)
def golden_summary(spark, sf_dir):
    return conv.summary(conv.score(golden(spark, sf_dir), folded(spark, sf_dir), on="conv_id"))


MARKED_TEXT = r"""
text || CASE lang WHEN 'en' THEN ' {"token":"ya29.A0-b_c"} Authorization: Bearer' || chr(9) || 'x.y/z= end'
             WHEN 'de' THEN ' ghp_0123456789 bearer "quoted" AIzaSy'
             ELSE ' 1//0gRefresh,eyJhbGciOi.J9' END
     || CASE WHEN n_chars > 3000 THEN chr(10) || '-----BEGIN PRIVATE KEY-----' ELSE '' END
"""
MARKERS = r"(?:ya29\.|AIza|gho_|ghp_|ghs_|ghu_|eyJ|1//)[A-Za-z0-9\-_./+=]*"
BEARER = r"([Bb]earer)([ \t\n\f\r]*)(?:[A-Za-z0-9\-_./+=]+|[^ \t\n\f\r])"


@query(
    "redact_text",
    f"""
    WITH d AS (SELECT doc_id, {MARKED_TEXT} AS t FROM documents),
    r AS (SELECT doc_id, contains(t, '-----BEGIN') AS pem,
        regexp_replace(t, '{BEARER}|{MARKERS}', '\\1\\2' || chr(65535), 'g') AS x FROM d),
    w AS (SELECT doc_id, pem, replace(x, chr(65535), '[redacted]') AS whole,
        replace(regexp_replace(x, '(?:' || chr(65535) || '|[Bb]earer)+$', ''), chr(65535), '[redacted]') AS plain FROM r)
    SELECT doc_id,
        CASE WHEN pem THEN '[redacted: message contained private key material]' ELSE whole END AS whole,
        CASE WHEN pem THEN '[redacted: message contained private key material]'
             WHEN strlen(plain) >= 512 THEN
               left(whole, list_max(list_filter(range(0, 513), lambda n: strlen(left(whole, n)) <= 512))) || '…'
             ELSE whole END AS cut
    FROM w
    """,
)
def redact_text(spark, sf_dir):
    """Whole texts, with and without the cut that error messages get."""
    marked = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            "text",
            F.when(F.col("lang") == "en", F.lit(' {"token":"ya29.A0-b_c"} Authorization: Bearer\tx.y/z= end'))
            .when(F.col("lang") == "de", F.lit(' ghp_0123456789 bearer "quoted" AIzaSy'))
            .otherwise(F.lit(" 1//0gRefresh,eyJhbGciOi.J9")),
            F.when(F.col("n_chars") > 3000, F.lit("\n-----BEGIN PRIVATE KEY-----")).otherwise(F.lit("")),
        ).alias("t"),
    )
    return marked.select("doc_id", redact("t", max_bytes=None).alias("whole"), redact("t", MAX_BYTES).alias("cut"))
