"""Agent message streams: load, fold into one row per conversation, score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablecraft.operators.ordered import fold_in_order

# The message fields that are read, and the text types.
FINAL_RESPONSE = "FINAL_RESPONSE"
THOUGHT = "THOUGHT"
MESSAGE_DDL = (
    "error struct<message: variant>,"
    " systemMessage struct<"
    "text: struct<parts: array<variant>, textType: variant>,"
    " data: struct<generatedSql: variant, query: struct<sql: variant>>>,"
    " generatedSql variant,"
    " text struct<parts: array<variant>>"
)
GOLDEN_DDL = (
    "question string, must_reference_tables array<string>, expect_sql_matches string,"
    " expect_answer_contains string, must_not_error boolean"
)
# A code point that no text holds: joins answer parts until all are together.
_JOINT = "\uffff"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(value: Column) -> Column:
    """The string in a variant; NULL for numbers, objects and so on."""
    return F.when(F.schema_of_variant(value) == "STRING", F.variant_get(value, "$", "string"))


def _texts(values: Column) -> Column:
    plain = F.filter(F.transform(values, _text), lambda v: v.isNotNull())
    return F.coalesce(plain, F.array().cast("array<string>"))


def typed_messages(message: Column) -> list[Column]:
    """The columns that a parsed message contributes."""
    system, top = message["systemMessage"], message
    sqls = F.array(
        _text(system["data"]["generatedSql"]), _text(system["data"]["query"]["sql"]), _text(top["generatedSql"])
    )
    text_type = F.coalesce(_text(system["text"]["textType"]), F.lit(""))
    inner = _texts(system["text"]["parts"])
    none = F.array().cast("array<string>")
    is_answer = text_type.isin("", FINAL_RESPONSE)
    return [
        _text(top["error"]["message"]).alias("error"),
        F.filter(sqls, lambda s: s.isNotNull() & (s != "")).alias("sqls"),
        text_type.alias("text_type"),
        F.when(is_answer, F.concat(inner, _texts(top["text"]["parts"]))).otherwise(none).alias("answer_parts"),
        F.when(text_type == THOUGHT, inner).otherwise(none).alias("thoughts"),
    ]


def parse_messages(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """One JSON message per row to typed columns. Broken JSON gives empty ones."""
    parsed = df.select(*keep, F.from_json(F.col(column), MESSAGE_DDL).alias("m"))
    return parsed.select(*keep, *typed_messages(F.col("m")))


def parse_message_arrays(df: DataFrame, column: str, keep: Sequence[str], position: str = "turn") -> DataFrame:
    """One JSON array of messages per row to one typed row per message."""
    schema = T.ArrayType(T.StructType.fromDDL(MESSAGE_DDL))
    listed = df.select(*keep, F.from_json(F.col(column), schema).alias("ms"))
    exploded = listed.select(*keep, F.posexplode("ms").alias(position, "m"))
    return exploded.select(*keep, position, *typed_messages(F.col("m")))


def read_messages(spark: SparkSession, path: str, arrays: bool = False, keys: str = "") -> DataFrame:
    """Message files to typed rows.

    JSON lines are split over tasks; with ``arrays`` each file is one JSON
    array. ``keys`` declares further top-level fields that name the
    conversation and the order (DDL); without them a file is a conversation
    (``conversation``) and the order is the position in it (``block``, ``turn``).
    """
    reader = spark.read.schema(f"{MESSAGE_DDL}, {keys}" if keys else MESSAGE_DDL).option("multiLine", arrays)
    raw = reader.json(path)
    fields = [f.name for f in T.StructType.fromDDL(MESSAGE_DDL).fields]
    message = F.struct(*fields)
    if keys:
        named = [F.col(f.name) for f in T.StructType.fromDDL(keys).fields]
    else:
        named = [
            F.col("_metadata.file_path").alias("conversation"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("turn"),
        ]
    return raw.select(*named, message.alias("m")).select(
        *[n.name for n in raw.select(*named).schema.fields], *typed_messages(F.col("m"))
    )


def fold_conversations(
    messages: DataFrame, keys: Sequence[str], order_by: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """One row per conversation, in message order.

    ``answer``: answer parts joined by a space; ``thoughts``: list of thoughts;
    ``sql_text``: generated SQL joined by newlines; ``error``: the last one.
    A very long conversation is folded in chunks by many tasks first.
    """
    parts = F.col("answer_parts")
    place = F.struct(*[F.col(c) for c in order_by])
    folded = fold_in_order(
        messages,
        keys,
        order_by,
        {
            "answer": (F.when(F.size(parts) > 0, F.array_join(parts, _JOINT)), _JOINT),
            "sql_text": (F.when(F.size("sqls") > 0, F.array_join("sqls", "\n")), "\n"),
            "thoughts": (F.when(F.size("thoughts") > 0, F.col("thoughts")), None),
        },
        chunk=chunk,
        extra={
            "error": (
                F.max_by("error", F.when(F.col("error").isNotNull(), place)),
                F.max_by("error", F.when(F.col("error").isNotNull(), F.col("__chunk"))),
            )
        },
    )
    # No joint goes before the first text, so empty leading parts leave no trace.
    answer = F.replace(F.ltrim("answer", F.lit(_JOINT)), F.lit(_JOINT), F.lit(" "))
    return folded.select(
        *keys,
        F.coalesce(answer, F.lit("")).alias("answer"),
        F.coalesce("thoughts", F.array().cast("array<string>")).alias("thoughts"),
        F.coalesce("sql_text", F.lit("")).alias("sql_text"),
        "error",
    )


# -- scoring -------------------------------------------------------------------------
def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def references_table(sql: Column | str, table: Column | str) -> Column:
    """Whether SQL text mentions a table, by its last name part, any case."""
    text = F.col(sql) if isinstance(sql, str) else sql
    name = F.lit(table) if isinstance(table, str) else table
    needle = F.substring_index(name, ".", -1)
    return F.coalesce((needle != "") & F.contains(_ascii_lower(text), _ascii_lower(needle)), F.lit(False))


class RegressionError(RuntimeError):
    """Golden questions that failed."""


def score(golden: DataFrame, folded: DataFrame, on: str = "question") -> DataFrame:
    """One row per golden question: ``passed`` and the ``failure_reason``.

    The questions join the folded conversations on ``on``. A question asked in
    several conversations passes if all of them pass; its row then shows the
    conversation that failed, or else any (the smallest answer and SQL). A question
    nobody answered fails, and so does one whose pattern is invalid. Equal rows of
    ``golden`` are one question each.

    Conversations are on the left of an inner join, so a hot question can be split
    and the golden side broadcast; verdicts are reduced per question by partial
    aggregation.
    """
    wanted = golden.groupBy(*golden.columns).agg(F.count("*").alias("__times"))
    # Equal questions with different checks are different questions.
    wanted = wanted.withColumn("__golden", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in golden.columns])), 256))
    wanted = wanted.withColumn("__good", F.coalesce(_is_pattern("expect_sql_matches"), F.lit(True)))
    text = F.lit(None).cast("string")
    answered = folded.alias("f").join(wanted.alias("g"), on).select("g.*", "f.sql_text", "f.answer", "f.error", F.lit(True).alias("__answered"))
    nobody = wanted.join(folded.select(on), on, "left_anti").select(
        *[F.col(f"`{c}`") for c in wanted.columns], text.alias("sql_text"), text.alias("answer"), text.alias("error"), F.lit(False).alias("__answered"))
    verdict = F.struct((F.col("reason") == "").alias("passed"), "answer", "sql", "reason")
    per_question = _checked(answered.unionByName(nobody)).groupBy("__golden").agg(F.min(verdict).alias("v"))
    joined = wanted.join(per_question, "__golden")
    each = joined.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return each.select(F.col(on), "v.passed", F.col("v.sql").alias("generated_sql"), "v.answer", F.col("v.reason").alias("failure_reason"))


def _checked(joined: DataFrame) -> DataFrame:
    """Golden id, answer, SQL and reason ('' if all checks pass) per question and conversation."""
    sql = F.coalesce("sql_text", F.lit(""))
    answer = F.coalesce("answer", F.lit(""))
    pattern = F.when(F.col("__good"), F.col("expect_sql_matches"))
    missing = F.filter("must_reference_tables", lambda t: ~references_table(sql, t))
    checks = [
        (~F.col("__answered"), F.lit("no answer")),
        (F.size(missing) > 0, F.concat(F.lit("SQL does not reference "), F.array_join(missing, ", "))),
        (~F.col("__good"), F.concat(F.lit("invalid pattern "), F.col("expect_sql_matches"))),
        (~F.rlike(sql, pattern), F.concat(F.lit("SQL does not match "), F.col("expect_sql_matches"))),
        (~F.contains(answer, F.col("expect_answer_contains")), F.concat(F.lit("answer does not contain "), F.col("expect_answer_contains"))),
        (F.col("must_not_error") & F.col("error").isNotNull(), F.concat(F.lit("error: "), F.col("error"))),
    ]
    reason = F.concat_ws("; ", *[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in checks])
    return joined.select("__golden", answer.alias("answer"), sql.alias("sql"), reason.alias("reason"))


def gate(scores: DataFrame, fail_on_regression: bool = True, shown: int = 20) -> str:
    """The summary text; raises if a question failed, naming ``shown`` of them."""
    row = summary(scores).first()
    if fail_on_regression and not row["all_passed"]:
        bad = failures(scores).orderBy(scores.columns[0]).limit(shown).collect()
        raise RegressionError("\n".join([row["summary"], *(f"{r[0]}: {r['failure_reason']}" for r in bad)]))
    return row["summary"]


def summary(scores: DataFrame) -> DataFrame:
    """Passed and total, one row; an empty set passes."""
    return scores.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    ).select(
        "total",
        "passed",
        (F.col("total") == F.col("passed")).alias("all_passed"),
        F.concat(F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" golden queries passed")).alias("summary"),
    )


def failures(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("passed"))


def _is_pattern(pattern: Column | str) -> Column:
    """Whether the engine that runs patterns accepts this one; null stays null."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.when(p.isNotNull(), F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull())


def golden_problems(golden: DataFrame) -> DataFrame:
    """Golden questions that are empty, assert nothing or hold a bad pattern."""
    asserts = (
        (F.coalesce(F.size("must_reference_tables"), F.lit(0)) > 0)
        | F.col("expect_sql_matches").isNotNull()
        | F.col("expect_answer_contains").isNotNull()
        | F.coalesce("must_not_error", F.lit(False))
    )
    problem = (
        F.when(F.trim("question") == "", "no question")
        .when(~asserts, "asserts nothing")
        .when(~F.coalesce(_is_pattern("expect_sql_matches"), F.lit(True)), "invalid pattern")
    )
    return golden.withColumn("problem", problem).where(F.col("problem").isNotNull())
