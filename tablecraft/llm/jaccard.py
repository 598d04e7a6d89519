"""Near-duplicate documents: LSH banding over MinHash signatures, verified exactly.

A document is the set of its five-word shingles. Documents of equal sets form a
node and are treated once, whatever their number. Each node has ``trees``
signatures of one depth, each hashed into one key, its path. The depth is fixed by
the parameters, whatever the data: the most labels, ``labels`` at most, with which two
sets of the threshold's likeness share a path in some tree with probability ``recall``
(:func:`depth_for`). Nodes that share a path are linked
to the smallest of them, so a path costs as many rows as it has nodes, and the
connected clusters hold every candidate pair.

Inside a cluster all pairs are verified exactly, from the texts, by products of
incidence matrices in blocks of documents: pairs are counted, not written. What
leaves a block is, for every node, how many documents it is linked to and the
smallest node it hangs together with.

Result: one row per document with its class (smallest id of all documents connected
by links), the number of other documents it is linked to (Jaccard likeness at least
``threshold``; equal sets included) and of documents with the same set.

Words are runs of letters, digits and underscores in lower case. Defined results:
texts of fewer than five words are one shingle of all their words; texts without
words (null and empty ones among them) have no links and are their own class;
repeated rows are linked to each other; rows with null ids take part, and a class
without any id has a null id; an empty table gives no rows. Extra columns are not
read. Sets are told apart by 128-bit sums and nodes by 64 bits of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, stored, whole
from tablecraft.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES, LABELS = 20, 6
RECALL = 0.9999
#: Nodes of a cluster that are compared in one block.
BLOCK = 512
#: Word hashes kept per worker; a memory bound without influence on results.
MEMO = 500_000
SIGNATURES = "doc_id long, mark long, node long, check long, size int, paths array<long>"

_WORD = re.compile(r"\w+")
_memo: dict[str, int] = {}


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(found):
        if w not in _memo:
            _memo[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_memo.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i], 0xBF58476D1CE4E5B9)
    return np.unique(x)


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> int:
    """Longest prefix at which a pair of the threshold's likeness meets in some trie with the wanted probability."""
    for depth in range(labels, 0, -1):
        if 1 - (1 - threshold ** depth) ** trees >= recall:
            return depth
    raise ValueError("the recall cannot be reached with so few trees")


def paths(x: np.ndarray, trees: int, labels: int, depth: int) -> np.ndarray:
    """The prefix of each trie, as one hash."""
    numbers = np.random.default_rng(20_011).integers(0, 1 << 63, (2, trees, labels), np.uint64)[:, :, :depth].reshape(2, -1)
    least = np.full(numbers.shape[1], np.iinfo(np.uint64).max)
    for at in range(0, len(x), 2048):
        part = x[at:at + 2048]
        least = np.minimum(least, ((part[:, None] + numbers[1]) * (numbers[0] | np.uint64(1))).min(0) if len(part) else least)
    key = np.full(trees, 7, np.uint64)
    for label in least.reshape(trees, depth).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + label, 0x94D049BB133111EB)
    return key


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, trees: int = TREES, labels: int = LABELS, depth: int | None = None) -> DataFrame:
    """(doc_id, mark, node, check, size, paths) of every document."""
    depth = depth_for(trees=trees, labels=labels) if depth is None else depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check, size, keys = [], [], [], []
            for t in batch.column(2).to_pylist():
                x = shingles(t or "", words)
                node.append(int(_mixed(x, 0xD6E8FEB86659FD93).sum(dtype=np.uint64).view(np.int64)))
                check.append(int(_mixed(x, 0xA0761D6478BD642F).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(x))
                keys.append(paths(x, trees, labels, depth).view(np.int64) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "node", "check", "size", "paths"])

    body = whole(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text")).mapInArrow(sign, SIGNATURES)


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets are alike, as a boolean matrix; the diagonal is false."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros((n, n), np.float32)
    rows = np.repeat(np.arange(n), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one set alone is common to no pair
    rows, column = rows[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    step = max(1024, (1 << 22) // n)
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, (first, first + step))
        incidence = np.zeros((n, step), np.float32)
        incidence[rows[a:b], column[a:b] - first] = 1
        common += incidence @ incidence.T
    union = sizes[:, None] + sizes[None, :] - common
    alike = common >= threshold * union - 1e-6
    np.fill_diagonal(alike, False)
    return alike


def _leads(alike: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node each node hangs together with."""
    lead = nodes.copy()
    while True:
        best = np.where(alike, lead[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(lead, best)
        if (new == lead).all():
            return lead
        lead = new


def verified(candidates: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(node, n_links, lead) per block, from rows (cluster, i, j, part, node, copies, text)."""

    def compare(rows: list[tuple]) -> tuple[list, list, list]:
        found = {r[4]: r for r in rows}  # a node may come twice if a row of the table is repeated
        nodes = np.array(sorted(found), np.int64)
        part = np.array([found[x][3] for x in nodes.tolist()])
        copies = np.array([found[x][5] for x in nodes.tolist()], np.int64)
        alike = links([shingles(found[x][6], words) for x in nodes.tolist()], threshold) if len(nodes) > 1 else np.zeros((1, 1), bool)
        if rows[0][1] != rows[0][2]:
            alike &= part[:, None] != part[None, :]
        return nodes.tolist(), (alike @ copies).tolist(), _leads(alike, nodes).tolist()

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["node", "n_links", "lead"])
            for column in out:
                column.clear()
            return batch

        def close() -> None:
            for column, values in zip(out, compare(held), strict=True):
                column.extend(values)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    close()
                held.append(row)
            if len(out[0]) > 10_000:
                yield flush()
        if held:
            close()
        yield flush()

    dealt = candidates.select("cluster", "i", "j", "part", "node", "copies", "text").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.mapInArrow(groups, "node long, n_links long, lead long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, words: int = WORDS,
                    trees: int = TREES, labels: int = LABELS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, mark, group, class_id, n_links, n_copies); see the module.

    ``mark`` is a hash of the text. ``group`` tells classes apart where ids are null
    or repeated; it is null for texts without words.
    """
    depth = depth_for(threshold, trees, labels, recall)
    signed = stored(signatures(docs, doc_id, text, words, trees, labels, depth), "signatures")
    nodes = stored(
        signed.where("size > 0").groupBy("node", "check", "size").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.count("*").alias("copies"), F.first("paths").alias("paths"))
        .select("node", "first.doc_id", "first.mark", "copies", "paths"), "nodes")
    steps = nodes.select("node", F.posexplode("paths").alias("tree", "path"))
    meeting = steps.groupBy("tree", "path").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("tree", "path", "lead")
    clusters = stored(components(steps.join(meeting, ["tree", "path"]).where("node <> lead").select("node", "lead").distinct()), "clusters")

    parts = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = (
        clusters.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .join(nodes.select("node", "doc_id", "mark", "copies"), "node")
        .select("node", F.col("component").alias("cluster"), "part", "parts", "copies", F.col("doc_id").alias("at_doc"), "mark"))
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).withColumn("mark", F.xxhash64("text"))
    with_text = body.join(placed, (body["mark"] == placed["mark"]) & body["doc_id"].eqNullSafe(placed["at_doc"])).select("node", "cluster", "part", "parts", "copies", "text")
    paired = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cluster", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "copies", "text")
    checked = stored(verified(paired, threshold, words), "links")

    classes = components(checked.where("node <> lead").select("node", "lead"))
    linked = checked.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = nodes.select("node", "doc_id", "copies").join(classes, "node", "left").join(linked, "node", "left").select(
        "node", "doc_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = known.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_node = known.join(named, "component").select("node", F.col("component").alias("group"), "class_id", "copies", "n_links")
    with_words = signed.where("size > 0").select("doc_id", "mark", "node").join(of_node, "node").select(
        "doc_id", "mark", "group", "class_id", (F.col("n_links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    without = signed.where("size = 0").select("doc_id", "mark", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return with_words.unionByName(without)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


#: The same rows by counting common shingles of all pairs that share one.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y, c = nx.size AND c = ny.size AS same FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 5 * c >= 4 * (nx.size + ny.size - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY doc_id),
counted AS (SELECT x AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_same FROM links GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_same, 0) + 1 AS n_copies
FROM classes LEFT JOIN counted USING (doc_id)
"""
