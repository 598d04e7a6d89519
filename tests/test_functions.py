import datetime as dt
import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.functions import builtins as fn
from tablecraft.functions.jobs import JobError, run_script, run_sql
from tablecraft.functions.redact import KEY_MATERIAL_TEXT, MAX_BYTES, redact
from tablecraft.functions.routines import (
    Argument, RoutineError, create_function, create_procedure, create_python_function, create_table_function,
)
from tests.conftest import as_rows


def test_datediff_counts_whole_units(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS a, timestamp_ntz'2024-01-03 11:00:00' AS b")
    got = row.select(fn.datediff("a", "b", "day"), fn.datediff("b", "a", "'DAY'"), fn.datediff("a", "b", '"hour"')).first()
    assert tuple(got) == (1, -1, 47)
    with pytest.raises(ValueError, match="unknown date part"):
        fn.datediff("a", "b", "fortnight")


def test_dateadd_nests(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-01-31 00:00:00' AS a")
    got = row.select(fn.dateadd("month", 1, "a"), fn.dateadd("hour", -1, fn.dateadd("day", 1, "a"))).first()
    assert tuple(got) == (dt.datetime(2024, 2, 29), dt.datetime(2024, 1, 31, 23))


def test_surrogate_key(spark):
    df = spark.sql("SELECT 'ab' AS x, 'c' AS y, CAST(NULL AS STRING) AS z, 7 AS n, true AS t")

    def key(*cols, **options):
        return df.select(fn.surrogate_key(*cols, **options)).first()[0]

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    assert key("x", "y") == md5("abc")
    assert key("x") == md5("ab")
    assert key("x", "z", "n", "t") == md5("ab_dbt_utils_surrogate_key_null_7true")
    assert key("x", "y", sep="-") == md5("ab-c")
    with pytest.raises(ValueError, match="at least one column"):
        fn.surrogate_key()


def test_listagg_forms_agree(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, "x", "y"])) for i in range(200)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    wanted = {}
    for k, _, v in sorted(rows, key=lambda r: r[1]):
        wanted.setdefault(k, [])
        if v is not None:
            wanted[k].append(v)
    wanted = sorted((k, ",".join(v) if v else None) for k, v in wanted.items())
    assert as_rows(df.groupBy("k").agg(fn.listagg("v", ",", "o").alias("s"))) == wanted
    assert as_rows(fn.listagg_by(df, ["k"], "v", ",", ["o"])) == wanted
    assert as_rows(fn.listagg_by(df, ["k"], "v", ",", ["o"], chunk=F.floor(F.col("o") / 7))) == wanted
    loose = {k: sorted((s or "").split(",")) for k, s in as_rows(fn.listagg_by(df, ["k"], "v", ","))}
    assert loose == {k: sorted((s or "").split(",")) for k, s in wanted}
    assert df.groupBy().agg(fn.listagg("v", "'\\")).first()[0].count("'\\") == sum(v is not None for _, _, v in rows) - 1


def test_macros(spark):
    @fn.macro
    def inner(x):
        return x * 2

    @fn.macro
    def outer(x, y):
        return inner(x) + inner(y)

    @fn.macro
    def loop(x):
        return loop(x)

    assert spark.range(1, 2).select(outer("id", F.lit(5))).first()[0] == 12
    with pytest.raises(fn.MacroError, match="takes 2 arguments, got 1"):
        outer("id")
    with pytest.raises(fn.MacroError, match="calls itself: loop -> loop"):
        loop("id")
    assert spark.range(199, 200).select(fn.cents_to_dollars("id").cast("string")).first()[0] == "1.99"


def test_run_clock_is_stable(spark):
    run = dt.datetime(2024, 1, 1)
    assert spark.range(1).select(fn.now(run)).first()[0] == run
    assert spark.range(1).select(fn.now()).first()[0] > run


def test_jobs(spark):
    assert run_sql(spark, "SELECT :x + 1 AS y", {"x": 2}).first()["y"] == 3
    with pytest.raises(JobError, match="invalid"):
        run_sql(spark, "SELECT nothing FROM nowhere")
    with pytest.raises(JobError, match="empty"):
        run_sql(spark, "  ")
    assert run_script(spark, ["DECLARE x INT DEFAULT 4;", "SET x = x * 2", "SELECT x AS y"]).first()["y"] == 8
    with pytest.raises(JobError):
        run_script(spark, ["SELEKT 1"])


def test_scalar_and_table_functions(spark):
    create_function(spark, "t_add", [Argument("a", "INT64"), Argument("b", "INTEGER")], "a + b", "INT64", description="it's a sum")
    assert spark.sql("SELECT t_add(1, 2)").first()[0] == 3
    create_function(spark, "t_any", [Argument("a", "STRING")], "upper(a)")
    assert spark.sql("SELECT t_any('x')").first()[0] == "X"
    create_table_function(spark, "t_upto", [Argument("n", "INT64")], "SELECT id FROM range(10) WHERE id < n", [Argument("id", "INT64")])
    assert spark.sql("SELECT count(*) FROM t_upto(4)").first()[0] == 4
    create_function(spark, "t_kept", [Argument("a", "INT64")], "a * 2", "INT64", temporary=False)
    assert spark.sql("SELECT t_kept(4)").first()[0] == 8
    spark.sql("DROP FUNCTION t_kept")
    with pytest.raises(RoutineError, match="name and a body"):
        create_function(spark, "t_bad", [], " ")
    with pytest.raises(RoutineError, match="unknown mode"):
        create_function(spark, "t_bad", [Argument("a", "INT64", mode="BOTH")], "a")


def test_python_function_with_library(spark, tmp_path):
    library = tmp_path / "tc_helper.py"
    library.write_text("def triple(x):\n    return x * 3\n")

    def use(x: pd.Series) -> pd.Series:
        from tc_helper import triple

        return triple(x)

    made = create_python_function(spark, "t_triple", use, "INT64", "NOT_DETERMINISTIC", [str(library)])
    assert not made.deterministic
    assert spark.range(3).selectExpr("t_triple(id) AS x").agg(F.sum("x")).first()[0] == 9
    with pytest.raises(RoutineError, match="determinism"):
        create_python_function(spark, "t", use, "INT64", "MAYBE")


def test_procedure(spark):
    spark.range(10).createOrReplaceTempView("tc_numbers")
    made = create_procedure(
        "p",
        [Argument("least", "INT64"), Argument("total", "INT64", "OUT"), Argument("seen", "INT64", "INOUT")],
        ["SET VAR total = (SELECT SUM(id) FROM tc_numbers WHERE id >= least)", "SET VAR seen = seen + 1",
         lambda session, values: session.table("tc_numbers").where(F.col("id") >= values["least"])],
    )
    assert made.call(spark, least=8, seen=4).count() == 2
    assert made.out == {"total": 17, "seen": 5}
    with pytest.raises(RoutineError, match="missing seen"):
        made.call(spark, least=1)
    with pytest.raises(RoutineError, match="unknown more"):
        made.call(spark, least=1, seen=1, more=1)


# -- redaction -------------------------------------------------------------------------
def by_hand(text, limit=512):
    """Redaction one character at a time."""
    if "-----BEGIN" in text:
        return KEY_MATERIAL_TEXT
    markers = ["ya29.", "AIza", "gho_", "ghp_", "ghs_", "ghu_", "eyJ", "1//"]
    token = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_./+=")
    out, i, after_bearer = "", 0, False
    while i < len(text):
        starts = any(text.startswith(m, i) for m in markers)
        if starts or (after_bearer and text[i] not in " \t\n\f\r"):
            j = i
            while j < len(text) and text[j] in token:
                j += 1
            out, i, after_bearer = out + "[redacted]", max(j, i + 1), False
        elif text[i:i + 6] in ("Bearer", "bearer"):
            out, i, after_bearer = out + text[i:i + 6], i + 6, True
        else:
            out, i = out + text[i], i + 1
            if len(out.encode()) >= limit:
                return out.encode()[:limit].decode(errors="ignore") + "…"
    return out


PIECES = ["Bearer", "bearer", " ", "\t", "\n", "\x0b", "ya29.", "AIza", "gho_", "ghp_", "ghs_x", "ghu_", "eyJ", "1//", "abc", "é", "€", "𝄞",
          '"', ",", "{", "x" * 60, "word word ", "Bear", "[redacted]", "-", "1/", "ey"]


def test_redaction_against_character_by_character(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["x" * 511, "x" * 512, "x" * 510 + "é", "x" * 509 + "𝄞" * 3, "x" * 505 + " eyJabc", "x" * 511 + "Bearer", "", "a-----BEGIN RSA",
              "x" * 511 + "eyJ z", "Authorization: Bearer\tabc.def rest", '{"token":"ya29.AbC-d"}', "end 1//"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r for r in df.select("i", redact("t", MAX_BYTES).alias("cut"), redact("t").alias("whole")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["cut"] == by_hand(t), repr(t)
        assert got[i]["whole"] == by_hand(t, limit=10**9), repr(t)


def test_redaction_keeps_null(spark):
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(redact("t")).first()[0] is None
