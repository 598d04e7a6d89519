"""Conversations folded by a stream, against the batch fold."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import conversations as conv
from tablecraft.streaming.folding import PROVIDER, fold_messages, stream_fold
from tablecraft.streaming.microbatch import read_new_files
from tests.conftest import as_rows

SCHEMA = "conv string, turn long, message string"


def message(kind, text):
    return json.dumps({
        "answer": {"systemMessage": {"text": {"parts": [text, "", text + "!"], "textType": "FINAL_RESPONSE"}}},
        "plain": {"text": {"parts": [text]}},
        "empty": {"systemMessage": {"text": {"parts": [""]}}},
        "thought": {"systemMessage": {"text": {"parts": [text], "textType": "THOUGHT"}}},
        "sql": {"systemMessage": {"data": {"generatedSql": f"SELECT '{text}'", "query": {"sql": "SELECT 2"}}}},
        "error": {"error": {"message": text}},
        "broken": "x",
    }[kind]) if kind != "broken" else "{"


def talk(rng, conversations=12):
    kinds = ("answer", "plain", "empty", "thought", "sql", "error", "broken")
    return [(f"c{c}", t, message(rng.choice(kinds), f"text \"{c}\" \\ é {t}\n")) for c in range(conversations) for t in range(rng.randrange(1, 12))]


def batch(spark, rows):
    typed = conv.parse_messages(spark.createDataFrame(rows, SCHEMA), "message", ["conv", "turn"])
    return as_rows(conv.fold_conversations(typed, ["conv"], ["turn"]))


class Feed:
    """A folder of arriving messages and the stream that folds them."""

    def __init__(self, spark, warehouse, path, quiet=None):
        self.spark, self.warehouse, self.path, self.quiet = spark, warehouse, str(path), quiet

    def send(self, rows, files=1):
        for k in range(files):
            self.spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = read_new_files(self.spark, f"{self.path}/in", SCHEMA, max_files=1)
        typed = conv.parse_messages(stream, "message", ["conv", "turn"])
        stream_fold(typed, self.warehouse, "folded", f"{self.path}/checkpoint", ["conv"], "turn", quiet=self.quiet).awaitTermination()
        return as_rows(self.warehouse.read("folded"))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_batch_fold(spark, warehouse, tmp_path, seed):
    rng = random.Random(seed)
    rows = talk(rng)
    sent = rows + rng.sample(rows, len(rows) // 3)  # some come twice
    rng.shuffle(sent)
    feed = Feed(spark, warehouse, tmp_path)
    cuts = sorted(rng.sample(range(1, len(sent)), 2))
    for low, high in zip([0, *cuts], [*cuts, len(sent)]):
        feed.send(sent[low:high], files=2 if low == 0 else 1)
        found = feed.run()  # a restart for each
        assert found == batch(spark, sorted(set(sent[:high])))
    assert found == batch(spark, rows)
    assert spark.conf.get(PROVIDER[0], None) != PROVIDER[1]


def test_contents_of_one_place_do_not_depend_on_the_order(spark, warehouse, tmp_path):
    low, high = ("a", 1, message("plain", "A")), ("a", 1, message("plain", "B"))
    first, second = Feed(spark, warehouse, tmp_path / "x"), None
    first.send([low])
    first.run()
    first.send([high])
    one = first.run()
    warehouse.drop("folded")
    second = Feed(spark, warehouse, tmp_path / "y")
    second.send([high])
    second.run()
    second.send([low])
    assert second.run() == one == batch(spark, [high])


def test_quiet_conversations_are_closed_and_late_messages_kept(spark, warehouse, tmp_path):
    path = str(tmp_path / "in")

    def send(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def until(done):
        deadline = time.time() + 90
        while not done():
            assert query.isActive and time.time() < deadline, query.exception()
            time.sleep(0.5)

    def stored(name):
        return as_rows(warehouse.read(name)) if warehouse.exists(name) else []

    send(("a", 1, message("plain", "one")))
    typed = conv.parse_messages(read_new_files(spark, path, SCHEMA), "message", ["conv", "turn"])
    more = {"keys": ["conv"], "order_by": "turn", "quiet": dt.timedelta(seconds=1)}
    with pytest.raises(ValueError, match="does not end by itself"):
        stream_fold(typed, warehouse, "folded", str(tmp_path / "no"), trigger={"availableNow": True}, **more)
    query = stream_fold(typed, warehouse, "folded", str(tmp_path / "checkpoint"), trigger={"processingTime": "500 milliseconds"}, **more)
    try:
        until(lambda: len(stored("folded")) == 1)
        time.sleep(6)  # the timer of a is due and was called
        send(("a", 2, message("plain", "two")), (None, 3, message("plain", "nobody's")), ("b", 1, message("plain", "other")), ("b", None, message("plain", "nowhere")))
        until(lambda: len(stored("folded")) == 2 and len(stored("folded_late")) == 3)
    finally:
        query.stop()
    assert [(r[0], r[1]) for r in stored("folded")] == [("a", "one"), ("b", "other")]
    assert {r[:2] for r in stored("folded_late")} == {("a", 2), (None, 3), ("b", None)}


def test_fold_of_nothing():
    assert fold_messages([]) == ("", [], "", None)
    assert fold_messages(['[[null],[],["",""],[]]', '[["e"],["s"],["x"],["t"]]', '[[null],["r"],["","y"],[]]']) == ("x  y", ["t"], "s\nr", "e")
