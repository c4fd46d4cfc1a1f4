"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct word shingles. The sketch keeps, for each of
128 buckets, the leading-zero count and ten mantissa bits of the smallest
hash in it (an empty bucket takes the smallest of a hash family of its own, so
each register agrees with a probability equal to the Jaccard similarity). Bands of four
compressed registers find candidates: 32 bands miss a pair at 0.8 with a
probability below 1e-7. Candidates are then settled exactly on full sets:

1. equal sets collapse to one vertex;
2. vertices that share a band key form candidate clusters (connected
   components over stars, never all pairs);
3. the best-connected member of a cluster is its hub, and every member is
   compared with the hub: two members linked to it need no pair of their own;
4. only members not linked to their hub look for partners. What two members
   share inside the hub is at most the smaller of their intersections with
   it; the rest must be shingles outside the hub that both have. So a pair
   is possible if the first part suffices (partners by band key), or if the
   two meet at one of the rarest outside shingles (prefix and positional
   filters). The collision-corrected sketch estimate, seven deviations below the
   threshold, comes next, then the full sets;
5. links give the components.

Defined results: vertices are document ids, so rows sharing an id share its
component; a null id gets a null component and isn't kept; null and empty
texts have no shingles and are linked with nothing (kept); repeated rows
each get a row; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climatrix.llm import text as T
from climatrix.llm.tables import fresh, stored

BUCKETS, BITS, MANTISSA = 128, 7, 10
ROWS = 4
MARGIN = 0.25
#: Most rows of a table that is sent to every executor.
BROADCAST_ROWS = 200_000
#: Members of a cluster that one task compares with the hub.
SHARE = 256


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the places where each text's begin (one more than texts)."""
    w = T.tokenize(column, lower=True)
    start, h = w.windows(k)
    doc = w.doc[start] if len(start) else start
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.append(h, w.spans(w.first[short], w.first[short + 1]))
        doc = np.append(doc, short)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(count) + 1))


_OWN = T.mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def registers(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 registers, one row of ``BUCKETS`` per text (zeros for an empty set)."""
    n = len(first) - 1
    low = np.full(n * BUCKETS, np.iinfo(np.uint64).max, dtype=np.uint64)
    doc = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(low, doc * BUCKETS + (h >> np.uint64(64 - BITS)).astype(np.int64), h << np.uint64(BITS))
    low = low.reshape(n, BUCKETS)
    for d in np.flatnonzero((low == np.iinfo(np.uint64).max).any(axis=1) & (np.diff(first) > 0)):
        empty = np.flatnonzero(low[d] == np.iinfo(np.uint64).max)
        own = h[first[d] : first[d + 1]]
        low[d, empty] = T.mix(own[:, None] ^ _OWN[empty][None, :]).min(axis=0)
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(64) - np.minimum(exponent, np.uint64(64))
    mantissa = (low << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    out = (np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA)) | mantissa
    out[np.diff(first) == 0] = 0
    return out.astype(np.uint16)


def band_keys(registers_: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` registers."""
    bands = np.ascontiguousarray(registers_).view(np.uint64)
    return T.mix(bands ^ _OWN[: bands.shape[1]][None, :]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows, corrected for registers that agree by chance."""
    same = (a == b).mean(axis=1)
    chance = 0.1699 * 2.0**-MANTISSA * 4 * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2.0
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), a and b (two sums that identify the set), sketch, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = T.texts(batch.column("text"))
            for i, j in T.slices(col):
                h, first = shingle_sets(col[i:j], k)
                reg = registers(h, first)
                total = np.zeros((2, len(h) + 1), dtype=np.uint64)
                np.cumsum(h, out=total[0, 1:])
                np.cumsum(T.mix(h), out=total[1, 1:])
                ab = (total[:, first[1:]] - total[:, first[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(np.diff(first)), pa.array(ab[0]), pa.array(ab[1]), pa.array([x.tobytes() for x in reg], pa.binary())],
                    ["doc_id", "n", "a", "b", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(T.releasing(run), "doc_id long, n long, a long, b long, sketch binary")


def banded(sets: DataFrame) -> DataFrame:
    """key, node for every band of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                reg = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS)
                keys = band_keys(reg)
                node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return sets.select("node", "sketch").mapInArrow(T.releasing(run), "key long, node long")


def _fit(stored_table: DataFrame) -> DataFrame:
    """A stored table of plain columns, marked for broadcast if its counted rows allow it."""
    return F.broadcast(stored_table) if stored_table.count() <= BROADCAST_ROWS else stored_table


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges`` (src, dst).

    Smallest-label propagation with label jumping; each round is written to
    the shared folder, so a lost executor never replays earlier rounds. Labels are
    broadcast only if their counted rows allow it, else joined by shuffle.
    """
    both = edges.unionByName(edges.selectExpr("dst AS src", "src AS dst")).where("src <> dst")
    both = stored(both.distinct(), "edges")
    label = stored(both.groupBy("src").agg(F.min("dst").alias("m")).selectExpr("src AS node", "least(src, m) AS root"), "labels")
    n = label.count()
    small = F.broadcast if n <= BROADCAST_ROWS else (lambda df: df)
    files = max(2, n // 10_000) if n <= BROADCAST_ROWS else None  # few rows, few files
    while True:
        near = both.join(small(label.withColumnRenamed("node", "dst")), "dst").groupBy("src").agg(F.min("root").alias("m"))
        step = near.join(small(label), F.col("src") == F.col("node")).selectExpr("node", "root AS old", "least(root, m) AS to")
        jump = step.join(small(label.selectExpr("node AS to", "root AS over")), "to", "left").selectExpr("node", "old", "least(to, coalesce(over, to)) AS root")
        label = stored(jump.coalesce(files) if files else jump, "labels")
        if label.where("old <> root").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The columns of ``wanted`` (node, n, cluster, share) with the full set of each (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = T.texts(batch.column("text"))
            for i, j in T.slices(col):
                h, first = shingle_sets(col[i:j], k)
                signed = pa.array(h.view(np.int64))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("node", "n", "cluster", "share")] + [pa.ListArray.from_arrays(first.astype(np.int32), signed)],
                    ["node", "n", "cluster", "share", "items"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node")
    made = rows.select("node", "n", "cluster", "share", "text").mapInArrow(T.releasing(run), "node long, n long, cluster long, share long, items array<long>")
    return made.where("n = size(items)")


def _likely(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y, nx, ny, sx, sy) whose estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sx, sy = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, BUCKETS) for c in ("sx", "sy"))
                nx, ny = (b.column(c).to_numpy(zero_copy_only=False) for c in ("nx", "ny"))
                yield b.select(["x", "y"]).filter(pa.array(estimate(sx, sy, nx, ny) >= least))

    return pairs.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(T.releasing(run), "x long, y long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Links need ``100 * |A & B| >= percent * |A | B|`` on full sets of k-word
    shingles.
    """
    rows = stored(sketched(docs, k), "sketches")
    sets = stored(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")), "sets"
    )
    keys = stored(_shared_keys(banded(sets)), "keys")
    clusters = stored(_clusters(keys), "clusters")
    links = stored(_links(docs, sets, keys, clusters, k, percent), "links")
    return _labelled(rows, sets, links)


def _shared_keys(keys: DataFrame) -> DataFrame:
    """key, node, hub, size of every band key that two vertices or more have; hub is the smallest of them."""
    groups = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"))
    return keys.join(groups.where("hub < last"), "key").select("key", "node", "hub", "size")


def _clusters(keys: DataFrame) -> DataFrame:
    """node, root: components of vertices that share band keys.

    Each vertex first goes over to the smallest hub of its keys, which leaves few
    edges, whatever the size of the groups.
    """
    to = stored(keys.groupBy("node").agg(F.min("hub").alias("to")), "hubs")
    half = keys.select("node", "hub").join(to, "node").select("hub", "to").distinct()
    edges = half.join(to.selectExpr("node AS hub", "to AS over"), "hub").select(F.col("to").alias("src"), F.col("over").alias("dst"))
    root = components(edges).withColumnRenamed("node", "to")
    root = _fit(root)
    return to.join(root, "to", "left").selectExpr("node", "coalesce(root, to) AS root")


def _links(docs: DataFrame, sets: DataFrame, keys: DataFrame, clusters: DataFrame, k: int, percent: int) -> DataFrame:
    """src, dst: verified links whose closure has all links within the clusters."""
    t = percent / (100.0 + percent)  # J >= p is |A & B| >= t (|A| + |B|)
    # Members of a large cluster meet their hub in shares of about SHARE; the hub's set is repeated for each.
    sizes = stored(clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares")).where("shares > 1"), "large-clusters")
    wanted = sets.select("node", "n").join(_fit(clusters.withColumnRenamed("root", "cluster")), "node").join(_fit(sizes), "cluster", "left")
    share = F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1).cast("long")))
    wanted = stored(wanted.select("node", "n", "cluster", share.alias("share")), "cluster-sets")
    full = stored(_sets_of(docs, _fit(wanted), k), "full-sets")
    degree = keys.groupBy("node").agg(F.sum("size").alias("degree"))
    central = degree.join(_fit(clusters), "node").groupBy(F.col("root").alias("cluster")).agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    hubs = full.join(central, (full.cluster == central.cluster) & (full.node == central.hub)).select(
        full.cluster, F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("items").alias("hub_items")
    ).dropDuplicates(["cluster"])
    least = wanted.groupBy("cluster").agg(F.min("n").alias("least"))
    hubs = hubs.join(least, "cluster").join(_fit(sizes), "cluster", "left")  # a row a cluster
    hubs = hubs.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(1).cast("long")) - 1)))
    against = full.join(hubs, ["cluster", "share"]).select(
        "cluster", "node", "n", "hub", "hub_n", "least",
        F.size(F.array_intersect("items", "hub_items")).alias("shared"),
        F.array_except("items", "hub_items").alias("own"),
    )
    against = stored(against.withColumn("linked", F.expr(f"100 * shared >= {percent} * (n + hub_n - shared)")), "against-hub")
    star = against.where("linked").selectExpr("hub AS src", "node AS dst")
    # Shingles outside the hub that another member has too, rarest first; the rest can't be in any intersection.
    item = against.select("cluster", "node", "n", F.explode("own").alias("item"))
    common = item.groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    more = item.join(common, ["cluster", "item"]).groupBy("cluster", "node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("more"))
    member = against.select("cluster", "node", "n", "shared", "linked", "least").join(more, ["cluster", "node", "n"], "left")
    member = stored(
        member.withColumn("more", F.coalesce("more", F.expr("cast(array() AS array<struct<c:bigint,item:bigint>>)")))
        .withColumn("need", F.expr(f"cast(ceil({t} * (n + greatest(least, ceil({percent} * n / 100.0))) - 1e-6) AS long)"))
        .where("shared + size(more) >= need"),
        "members",
    )
    # |A & B| <= min(shared) + common items outside the hub. Either the first part reaches the threshold ...
    ends = ["node", "n", "shared"]
    x = member.where("NOT linked").select(*(F.col(c).alias(f"x_{c}") for c in ends), "cluster", "need", "more")
    y = member.select(*(F.col(c).alias(f"y_{c}") for c in ends), "cluster", "linked", "more")
    once = (F.col("x_node") != F.col("y_node")) & (F.col("linked") | (F.col("x_node") < F.col("y_node")))
    need = F.ceil(t * (F.col("x_n") + F.col("y_n")) - 1e-6) - F.least("x_shared", "y_shared")
    key = keys.select("key", "node")
    fits = F.broadcast if member.count() <= BROADCAST_ROWS else (lambda df: df)  # without the items: a few numbers a member
    x_key = key.join(fits(x.drop("cluster", "more", "need")), F.col("node") == F.col("x_node")).drop("node").withColumnRenamed("key", "x_key")
    y_key = key.join(fits(y.drop("cluster", "more")), F.col("node") == F.col("y_node")).drop("node")
    near = x_key.join(y_key, (F.col("x_key") == F.col("key")) & once & (need <= 0))
    # ... or enough of the second part is needed, and one of the x's rarest items must be among them.
    x_item = x.select(
        *(f"x_{c}" for c in ends), F.col("cluster").alias("x_cluster"), F.size("more").alias("x_size"),
        F.posexplode(F.expr("slice(more, 1, cast(size(more) - greatest(need - x_shared, 1) + 1 AS int))")).alias("x_at", "x_item"),
    )
    y_item = y.select(*(f"y_{c}" for c in ends), "cluster", "linked", F.size("more").alias("y_size"), F.posexplode("more").alias("y_at", "y_item"))
    reach = F.least("x_at", "y_at") + F.least(F.col("x_size") - F.col("x_at"), F.col("y_size") - F.col("y_at"))
    same = (F.col("x_cluster") == F.col("cluster")) & (F.col("x_item.item") == F.col("y_item.item"))
    apart = x_item.join(y_item, same & once & (need >= 1) & (reach >= need))
    found = near.select("x_node", "x_n", "y_node", "y_n").unionByName(apart.select("x_node", "x_n", "y_node", "y_n")).distinct()
    pairs = _fit(stored(found.toDF("x", "nx", "y", "ny"), "pairs"))
    sketch = sets.select("node", "n", "sketch")
    pairs = sketch.selectExpr("node AS x", "n AS nx", "sketch AS sx").join(pairs, ["x", "nx"]).join(sketch.selectExpr("node AS y", "n AS ny", "sketch AS sy"), ["y", "ny"])
    likely = _fit(stored(_likely(pairs, percent / 100.0 - MARGIN), "likely-pairs"))
    both = full.selectExpr("node AS x", "n AS nx", "items AS ix").join(likely, "x").join(full.selectExpr("node AS y", "n AS ny", "items AS iy"), "y")
    both = both.select("x", "y", "nx", "ny", F.size(F.array_intersect("ix", "iy")).alias("shared"))
    found = both.where(f"100 * shared >= {percent} * (nx + ny - shared)").selectExpr("x AS src", "y AS dst")
    return star.unionByName(found).where("src <> dst").distinct()


def _labelled(rows: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """Components of ids: those of equal sets, of links, and of rows sharing an id."""
    root = components(links)
    copies = rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "a", "b", "n")
    root = _fit(root)
    of_set = sets.select("a", "b", "n", "node").join(root, "node", "left").selectExpr("a", "b", "n", "coalesce(root, node) AS root")
    by_id = copies.join(of_set, ["a", "b", "n"]).select("doc_id", "root")
    ids = by_id.groupBy("doc_id").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    ids = stored(ids, "ids")
    twice = ids.where("root < other").selectExpr("root AS src", "other AS dst")
    if not twice.isEmpty():  # an id whose rows differ joins the components of all its texts
        more = by_id.join(ids.where("root < other").select("doc_id", F.col("root").alias("src")), "doc_id").selectExpr("src", "root AS dst")
        ids = ids.join(components(more).withColumnRenamed("root", "top"), F.col("root") == F.col("node"), "left").selectExpr("doc_id", "coalesce(top, root) AS root")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(ids.select("doc_id", "root"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The row of the smallest id of each component, all columns unchanged.

    Of rows that repeat a kept id all stay; rows with a null id stay too.
    """
    name = fresh(docs, "gone_id")
    gone = near_duplicates(docs, k, percent).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
