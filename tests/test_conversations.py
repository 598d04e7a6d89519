import json
import random

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import conversations as conv
from tests.conftest import as_rows


def random_message(rng):
    parts = rng.choice([["a", "b"], [], ["", "c"], [" d ", 5, None, "e"], "text", [""]])
    kind = rng.choice(["THOUGHT", "FINAL_RESPONSE", "", "FOLLOWUP_QUESTIONS", 7, None])
    shapes = [
        {"systemMessage": {"text": {"parts": parts, "textType": kind}}},
        {"systemMessage": {"text": {"parts": parts}}},
        {"text": {"parts": parts}},
        {"systemMessage": {"data": {"generatedSql": rng.choice(["SELECT 1", "", 3])}}, "generatedSql": "SELECT 2"},
        {"systemMessage": {"data": {"query": {"sql": "SELECT x\nFROM t", "datasources": [{"tableId": "t"}]}}}},
        {"error": {"message": rng.choice(["first", "second", 9])}},
        {"error": "flat"},
        {"systemMessage": {"data": {"result": {"data": [{"n": 1.5}]}}}, "timestamp": "2026-01-01T00:00:00Z"},
    ]
    return rng.choice(shapes)


TALK = [
    {"systemMessage": {"text": {"parts": ["plan", "then act"], "textType": "THOUGHT"}}},
    {"systemMessage": {"data": {"query": {"sql": "SELECT x\nFROM t"}}}},
    {"systemMessage": {"text": {"parts": ["The total", 5, None, "is 12."], "textType": "FINAL_RESPONSE"}}},
    {"systemMessage": {"data": {"generatedSql": "SELECT 1"}}, "generatedSql": "SELECT 2"},
    {"error": {"message": "first"}},
    {"systemMessage": {"text": {"parts": ["skipped"], "textType": "FOLLOWUP_QUESTIONS"}}},
    {"text": {"parts": ["Anything else?"]}},
    {"error": {"message": "second"}},
    {"error": "flat"},
    {"systemMessage": {"data": {"generatedSql": ""}}},
]
FOLDED = ("The total is 12. Anything else?", ["plan", "then act"], "SELECT x\nFROM t\nSELECT 1\nSELECT 2", "second")


def test_a_talk_is_folded_into_one_row(spark, tmp_path):
    lines = [(1, t, json.dumps(m)) for t, m in enumerate(TALK)] + [(2, 0, json.dumps(TALK[4])), (3, 0, json.dumps(TALK[5]))]
    typed = conv.parse_messages(spark.createDataFrame(lines, "c int, t int, j string"), "j", ["c", "t"])
    got = {r["c"]: tuple(r)[1:] for r in conv.fold_conversations(typed, ["c"], ["t"]).select("c", "answer", "thoughts", "sql_text", "error").collect()}
    assert got == {1: FOLDED, 2: ("", [], "", "first"), 3: ("", [], "", None)}

    # The same talk as a file that holds an array, and as lines with keys.
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays" / "1.json").write_text(json.dumps(TALK, indent=1))
    files = conv.read_messages(spark, str(tmp_path / "arrays"), arrays=True)
    assert as_rows(conv.fold_conversations(files, ["conversation"], ["block", "turn"]), "answer", "error") == [(FOLDED[0], FOLDED[3])]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({**m, "c": 1, "t": t}) for t, m in enumerate(TALK)))
    keyed = conv.read_messages(spark, str(tmp_path / "lines.json"), keys="c int, t int")
    assert as_rows(conv.fold_conversations(keyed, ["c"], ["t"]), "sql_text") == [(FOLDED[2],)]


def test_chunks_order_and_splits_change_nothing(spark):
    rng = random.Random(5)
    talks = {c: [random_message(rng) for _ in range(rng.randrange(1, 25))] for c in range(25)}
    rows = [(c, t, json.dumps(m)) for c, ms in talks.items() for t, m in enumerate(ms)]

    def folded(data, chunk=None):
        typed = conv.parse_messages(spark.createDataFrame(data, "c int, t int, j string").repartition(4), "j", ["c", "t"])
        found = conv.fold_conversations(typed, ["c"], ["t"], chunk=chunk).collect()
        return {r["c"]: (r["answer"], tuple(r["thoughts"]), r["sql_text"], r["error"]) for r in found}

    whole = folded(rows)
    assert len(whole) == 25
    shuffled = list(rows)
    rng.shuffle(shuffled)
    assert folded(shuffled) == whole
    assert folded(rows, F.floor(F.col("t") / 4)) == whole
    # A talk cut in two: texts follow each other, the later error counts.
    halves = folded([(2 * c + (t > 6), t, j) for c, t, j in rows])
    for c, (answer, thoughts, sql, error) in whole.items():
        a, b = (halves.get(2 * c + k, ("", (), "", None)) for k in (0, 1))
        assert thoughts == a[1] + b[1] and error == (b[3] if b[3] is not None else a[3])
        assert sql == "\n".join(x for x in (a[2], b[2]) if x)
    arrays = spark.createDataFrame([(c, json.dumps(ms)) for c, ms in talks.items()], "c int, j string")
    as_arrays = conv.fold_conversations(conv.parse_message_arrays(arrays, "j", ["c"]), ["c"], ["turn"]).collect()
    assert {r["c"]: r["answer"] for r in as_arrays} == {c: v[0] for c, v in whole.items()}


def test_broken_messages_are_empty(spark):
    df = spark.createDataFrame([(1, "{not json"), (2, None)], "c int, j string")
    folded = conv.fold_conversations(conv.parse_messages(df, "j", ["c"]).withColumn("t", F.lit(0)), ["c"], ["t"])
    assert as_rows(folded) == [(1, "", [], "", None), (2, "", [], "", None)]


def test_references_table(spark):
    df = spark.createDataFrame(
        [("SELECT * FROM `p.d.Mart_Revenue`", "p.d.mart_revenue", True), ("SELECT 1", "x.one", False), ("SELECT 1", "d.", False),
         ("", "t", False), (None, "t", False), ("from ÉT", "ét", False)],
        "s string, t string, w boolean",
    )
    assert all(r[0] == r[1] for r in df.select(conv.references_table("s", F.col("t")), "w").collect())


def test_scores_and_summary(spark):
    golden = spark.createDataFrame(
        [("q1", ["d.rev"], "SUM\\(", "west", True), ("q2", ["d.rev", "d.none"], "^X", "zzz", True), ("q3", [], None, None, True),
         ("q4", [], None, "a", False), ("q5", None, None, "a", None)],
        conv.GOLDEN_DDL,
    )
    folded = spark.createDataFrame(
        [("q1", "the west", "SELECT SUM(x) FROM REV", None), ("q2", "", "SELECT 1 FROM rev", "boom"), ("q3", "", "", None), ("q5", "a", "", "e")],
        "question string, answer string, sql_text string, error string",
    )
    scores = conv.score(golden, folded)
    assert as_rows(scores, "question", "passed", "failure_reason") == [
        ("q1", True, ""),
        ("q2", False, "SQL does not reference d.none; SQL does not match ^X; answer does not contain zzz; error: boom"),
        ("q3", True, ""),
        ("q4", False, "no answer; answer does not contain a"),
        ("q5", True, ""),
    ]
    assert as_rows(conv.summary(scores)) == [(5, 3, False, "3/5 golden queries passed")]
    assert as_rows(conv.summary(scores.where("false"))) == [(0, 0, True, "0/0 golden queries passed")]
    assert conv.failures(scores).count() == 2


def test_repeated_questions_get_a_row_each(spark):
    golden = spark.createDataFrame([("q", [], None, "yes", False), ("q", [], None, "yes", False), ("q", [], None, "no", False), ("z", [], "(?P<x>a)", None, False)], conv.GOLDEN_DDL)
    talks = [("q", f"yes {n}", "", None) for n in range(500)] + [("z", "", "aaa", None)]
    scores = conv.score(golden, spark.createDataFrame(talks, "question string, answer string, sql_text string, error string"))
    assert as_rows(scores, "question", "passed", "failure_reason") == [
        ("q", False, "answer does not contain no"), ("q", True, ""), ("q", True, ""), ("z", False, "invalid pattern (?P<x>a)"),
    ]
    with pytest.raises(conv.RegressionError, match="2/4 golden queries passed"):
        conv.gate(scores)
    assert conv.gate(scores, fail_on_regression=False) == conv.gate(scores.where("passed")).replace("2/2", "2/4")


def test_golden_problems(spark):
    golden = spark.createDataFrame(
        [(" ", ["t"], None, None, True), ("a", [], None, None, False), ("b", None, "(", None, False), ("c", None, "x+", None, None)],
        conv.GOLDEN_DDL,
    )
    assert as_rows(conv.golden_problems(golden), "question", "problem") == [
        (" ", "no question"), ("a", "asserts nothing"), ("b", "invalid pattern"),
    ]
