"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

A document is the set of its four-word shingles; equal sets form a node and are
treated once, whatever their number. One hash of each shingle deals the set into
``BINS`` bins, of which each keeps its minimum. A bin that stays empty takes the
minimum of the first filled bin in an order drawn for that bin (optimal
densification), so two signatures agree in a bin as often as the sets are alike.
Bands of ``ROWS`` bins are the buckets.

Within a bucket nobody is paired with everybody: one node is the centre of a star and is compared
with the other members. The centre is the node that most others share buckets with, in a group of
copies the one they derive from, so a group of n copies costs about n pairs. A pair passes if
its signatures agree in ``ESTIMATE`` of the bins; then the full sets are compared, from the texts.

Linked nodes get one label. A bucket whose members have one label is done. In the others, which
hold copies too different from the centre, two members may still be alike. First the
shingles that only one of these nodes has are counted: nobody shares them, which
rules out nodes that each differ too much, exactly (:func:`bounded`). What is left is compared whole,
members of one label with those of others, in blocks (:func:`rest`). So every pair that shares a bucket
has been compared, ruled out, or hangs together otherwise: stars lose no link between components.

Two sets of likeness 0.8 share no bucket with probability (1 - 0.8 ** 6) ** 42, 3e-6, and
fall below ``ESTIMATE`` with probability 1e-6.

Words are runs of anything but ASCII white space, A-Z in lower case. Defined results:
texts of fewer than four words are one shingle of all their words; texts without
words (null and empty ones among them) have no shingles, are linked with nothing and are kept;
repeated rows are one component; rows with null ids take part and are never kept if their
component has an id; a component without any id has a null id, and all its rows are kept;
an empty table gives no rows. Extra columns are not read. Sets are told apart by
128-bit sums and nodes by 64 bits of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import documents, stored, whole
from tablecraft.llm.components import components
from tablecraft.llm.jaccard import _leads as leads
from tablecraft.llm.jaccard import links as similar

WORDS = 4
PERCENT = 80
BINS = 256
BANDS, ROWS = 42, 6
ESTIMATE = 0.68
#: Members of a star that are compared in one task, so that a large star is dealt over many.
STAR = 256
#: Nodes in a part of what stars leave open.
BLOCK = 256
#: So many nodes are sent to all tasks to fetch their texts; more are joined by a shuffle.
FEW = 50_000
#: Word hashes kept per worker; a memory bound without influence on results.
MEMO = 100_000
#: Texts that are held as Python strings at a time.
TOGETHER = 256
SIGNATURES = "doc_id long, mark long, node long, check long, size long, bins binary, bands array<long>"

_memo: dict[bytes, int] = {}


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
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
        x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i], 0xD6E8FEB86659FD93)
    return np.unique(x)


def donors(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a minimum."""
    rng = np.random.default_rng(12_011)
    return np.array([rng.permutation(bins) for _ in range(bins)])


def signature(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The minimum of each bin of a sorted, non-empty set of hashes; empty bins densified."""
    bins = len(order)
    of = (x >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # the upper bits deal, in ascending order
    at = np.searchsorted(of, np.arange(bins, dtype=np.uint64))
    filled = of[np.minimum(at, len(x) - 1)] == np.arange(bins, dtype=np.uint64)
    empty = np.flatnonzero(~filled)
    if len(empty):
        asked = order[empty]
        at[empty] = at[asked[np.arange(len(empty)), filled[asked].argmax(1)]]
    return x[at]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS, bins: int = BINS) -> DataFrame:
    """(doc_id, mark, node, check, size, bins, bands) of every document; ``mark`` is a hash of the text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = donors(bins)
        for batch in batches:
            node, check, size, short, keys = [], [], [], [], []
            for t in (t for at in range(0, batch.num_rows, TOGETHER) for t in batch.column(2).slice(at, TOGETHER).to_pylist()):
                x = shingles(t or "", words)
                node.append(int(_mixed(x, 0xBF58476D1CE4E5B9).sum(dtype=np.uint64).view(np.int64)))
                check.append(int(_mixed(x, 0xA0761D6478BD642F).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(x))
                if not len(x):
                    short.append(None)
                    keys.append(None)
                    continue
                minima = signature(x, order)
                short.append((_mixed(minima, 0x94D049BB133111EB) & np.uint64(255)).astype(np.uint8).tobytes())
                key = np.arange(bands, dtype=np.uint64)
                for part in minima[:bands * rows].reshape(bands, rows).T:
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + part, 0x94D049BB133111EB)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(short, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "node", "check", "size", "bins", "bands"])

    body = whole(F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text")).mapInArrow(sign, SIGNATURES)


def likely(pairs: DataFrame, nodes: DataFrame, estimate: float = ESTIMATE) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share ``estimate`` of the bins."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = (left == right).mean(1) >= estimate
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("bins").alias("of_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("bins").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(agree, "a long, b long")


def texts_of(named: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Stored (node, text) of the nodes of a stored table."""
    known = stored(named.join(nodes.select("node", "doc_id", "mark"), "node"), "needed")
    needed = known.select("node", F.col("doc_id").alias("at_doc"), "mark")
    if known.count() <= FEW:
        needed = F.broadcast(needed)
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(F.col(text)).alias("text")).withColumn("mark", F.xxhash64("text"))
    texts = stored(body.join(needed, (body["mark"] == needed["mark"]) & body["doc_id"].eqNullSafe(needed["at_doc"])).select("node", "text"), "texts")
    if texts.count() > known.count():  # rows of the table are repeated
        texts = stored(texts.dropDuplicates(["node"]), "texts")
    return texts


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are alike; each ``a`` is the centre of a star.

    Pairs and nodes are stored tables. A text is fetched once per node and sent once per pair
    that its node is a member in, and once per ``STAR`` members of a star that it is the centre of.
    """
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts")), "stars")
    texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, nodes, doc_id, text)
    member = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("node"), F.lit(1).alias("kind"))
    centre = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("kind"))
    dealt = member.unionByName(centre).join(texts, "node").select("a", "part", "kind", "node", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            parts = (batch.slice(at, TOGETHER).columns for at in range(0, batch.num_rows, TOGETHER))
            for star, part, kind, node, body in (row for columns in parts for row in zip(*(c.to_pylist() for c in columns), strict=True)):
                if kind == 0:
                    of, x = (star, part), shingles(body, words)
                    continue
                assert (star, part) == of
                y = shingles(body, words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    a.append(star)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(compare, "a long, b long")


def tokens_of(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingle): the sets of nodes, row by row."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                node = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])

    return texts.select("node", "text").mapInArrow(split, "node long, shingle long")


def bounded(members: DataFrame, tokens: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The members that some other member of their bucket may be alike to, with their ``common``.

    Shingles that no other node still in question has are common to no pair, so a pair has at most
    the rest of either set in common, and is alike only if (100 + percent) times that is at least
    percent times both sizes together. ``slack`` of a node is its share of that bound; of two alike nodes the slacks add
    up to 0 at least. So copies that each differ from their source by too much are told apart by their own
    edits, without being paired.
    """
    there = stored(members.select("node").distinct(), "open-nodes")
    lone = tokens.join(there, "node").groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    own = stored(lone.groupBy("node").agg(F.count("*").alias("own")), "own")
    common = F.col("size") - F.coalesce("own", F.lit(0))
    known = members.drop("common").join(own, "node", "left").select("bucket", "node", "size", "shared", "label", common.alias("common"))
    slack = (100 + percent) * F.col("common") - 2 * percent * F.col("size")
    known = stored(known.withColumn("slack", slack), "members")
    best = stored(known.groupBy("bucket").agg(F.max("slack").alias("best")), "best")
    return stored(known.join(best, "bucket").where("slack + best >= 0").drop("slack", "best"), "members")


def _left(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, size, shared, common, label) of the buckets whose members do not all hang together."""
    at = F.coalesce("component", "node")
    named = stored(members.join(labels, "node", "left").select("bucket", "node", "size", "shared", "common", at.alias("label")), "members")
    open_ = stored(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "open")
    return stored(named.join(open_, "bucket"), "members")


def rest(members: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between nodes of different labels that share an open bucket, compared exactly in blocks.

    Clusters of open buckets are cut into parts of about ``BLOCK`` nodes; a label that fills parts
    alone has its own. Two parts make a block, unless both belong to one label. A block is one product of
    incidence matrices and leaves, for each node, the smallest node that it hangs together with; pairs are not written.
    """
    hub = stored(members.groupBy("bucket").agg(F.min("node").alias("hub")), "hubs")
    clusters = stored(components(members.join(hub, "bucket").where("node <> hub").select("node", "hub").distinct()), "clusters")
    placed = stored(clusters.join(members.select("node", "label").distinct(), "node").select("node", F.col("component").alias("cluster"), "label"), "placed")
    counted = stored(placed.groupBy("cluster", "label").agg(F.count("*").alias("n")), "label-sizes")
    pool = F.when(F.col("n") >= BLOCK, F.col("label"))  # null: labels too small for parts of their own
    pools = counted.groupBy("cluster", pool.alias("pool")).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    part = F.xxhash64("cluster", "pool", F.col("pool").isNull(), "i")
    parts = stored(pools.select("cluster", "pool", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i")).select("cluster", "pool", part.alias("part")), "parts")
    a, b = (parts.select("cluster", F.col("pool").alias(f"{x}_pool"), F.col("part").alias(x)) for x in "ab")
    mixed = ~F.coalesce(F.col("a_pool") == F.col("b_pool"), F.lit(False))
    blocks = stored(a.join(b, "cluster").where((F.col("a") <= F.col("b")) & mixed).select("a", "b"), "blocks")
    sizes = stored(counted.join(pools.withColumnRenamed("pool", "of"), "cluster").where(pool.eqNullSafe(F.col("of"))).select("cluster", "label", pool.alias("pool"), "parts"), "pools")
    put = placed.join(sizes, ["cluster", "label"]).withColumn("i", F.pmod(F.xxhash64("node"), "parts").cast("int")).select("node", "label", part.alias("part"))
    put = stored(put, "put")
    texts = texts_of(placed.select("node"), docs, nodes, doc_id, text)
    left = put.join(blocks, put["part"] == blocks["a"]).select("a", "b", "node", "label")
    right = put.join(blocks.where("a <> b"), put["part"] == F.col("b")).select("a", "b", "node", "label")
    dealt = left.unionByName(right).join(texts, "node").select("a", "b", "node", "label", "text").repartition("a", "b").sortWithinPartitions("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        block, out = None, ([], [])

        def close() -> None:
            if len(held) > 1:
                names = np.array(sorted(held), np.int64)
                labels = np.array([held[x][0] for x in names.tolist()])
                alike = similar([held[x][1] for x in names.tolist()], percent / 100) & (labels[:, None] != labels[None, :])
                lead = leads(alike, names)
                out[0].extend(names[lead != names].tolist())
                out[1].extend(lead[lead != names].tolist())
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                for x, y, node, label, body in zip(*(c.to_pylist() for c in batch.slice(at, TOGETHER).columns), strict=True):
                    if (x, y) != block:
                        close()
                        block = (x, y)
                    held[node] = (label, shingles(body, words))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
            out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT, estimate: float = ESTIMATE) -> DataFrame:
    """(node, component) of all nodes that are linked with another: stars, then what they leave open."""
    steps = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = stored(steps.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1"), "buckets")
    met = stored(steps.join(shared, "bucket"), "met")
    weight = stored(met.groupBy("node").agg(F.sum("times").alias("shared")), "weights")
    members = stored(met.select("bucket", "node", "size", F.col("size").alias("common")).join(weight, "node"), "members")

    best = F.min(F.struct((-F.col("shared")).alias("less"), "node", "size")).alias("c")
    centres = stored(members.groupBy("bucket").agg(best).select("bucket", F.col("c.node").alias("a"), F.col("c.size").alias("a_size")), "centres")
    near_size = 100 * F.least("size", "a_size") >= percent * F.greatest("size", "a_size")
    star = members.join(centres, "bucket").where(near_size & (F.col("node") != F.col("a"))).select("a", F.col("node").alias("b"))
    # Pairs may share several buckets, and be centre and member in turn: each is compared once.
    once = star.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("a").alias("a"))
    star = stored(once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b")), "pairs")
    near = stored(likely(star, nodes, estimate), "likely")
    found = stored(confirmed(near, docs, nodes, doc_id, text, words, percent), "links")
    labels = stored(components(found), "labels")

    members = members.join(centres.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")  # centres have met all others
    members = _left(members, labels)
    if members.isEmpty():
        return labels
    tokens = stored(tokens_of(texts_of(members.select("node").distinct(), docs, nodes, doc_id, text), words), "tokens")
    members = bounded(members, tokens, percent)
    more = stored(rest(members, docs, nodes, doc_id, text, words, percent), "links")
    return labels if more.isEmpty() else stored(components(found.unionByName(more)), "labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, bins: int = BINS, estimate: float = ESTIMATE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; see the module."""
    signed = stored(signatures(docs, doc_id, text, words, bands, rows, bins), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    nodes = stored(
        signed.where("size > 0").groupBy("node", "check", "size").agg(first, F.first("bins").alias("bins"), F.first("bands").alias("bands"))
        .select("node", "size", "first.doc_id", "first.mark", "bins", "bands"), "nodes")
    labels = links(docs, nodes, doc_id, text, words, percent, estimate)
    known = nodes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    named = stored(known.groupBy("component").agg(F.min("doc_id").alias("component_id")), "named")
    of_node = stored(known.join(named, "component").select("node", "component_id"), "components")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    with_words = signed.where("size > 0").select("doc_id", "size", "node").join(of_node, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id", kept)
    without = signed.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return with_words.unionByName(without)


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: The same rows by counting common shingles of all pairs that share one.
OP12_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS size FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.size + ny.size - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other),
classes AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM classes LEFT JOIN n USING (doc_id)
"""
