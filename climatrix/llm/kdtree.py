"""Sharding by a k-d tree over document metadata.

Units are groups of equal texts; their coordinates are the smallest id of the group, the size of
its text, and the metadata ``n_chars``, ``lang`` and ``source`` where the table has them (the group's
smallest). Sizes and lengths count by their logarithm; a language or source has no order, so its
place is a hash of its value: equal values stand together. A node that owes k shards is split along its widest
dimension at the weighted median (by bytes, at k // 2 of k), until every
leaf owes one shard, about ``total / shards`` bytes. Equal coordinates are told
apart by the unit's hash, so a median always falls between two units.

Medians are found for all nodes of a level at once: one aggregation gives the
bytes of 512 bins of every open node, and the bin holding the median is cut
into bins again, until what is left in it doesn't matter. The driver sees
bins only (nodes x 512), never rows. A group heavier than a shard can't be near equal
in one piece: only those are dealt into pieces of a quarter of a
shard by the hash of the id (there are fewer such groups than shards, so they are broadcast).

Defined results: a null text weighs nothing but the 16 bytes of its row and is
equal to other nulls and empty texts; a null id counts as id 0 in the tree;
repeated rows are weighed and placed one by one; null, missing or unreadable metadata lie at one
place, and a dimension without extent is never split; fewer units than shards leave
shards empty; an empty table gives an empty result; long texts are only measured and hashed; other columns
play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climatrix.llm.tables import numbered, stored

ROW_BYTES = 16
BINS = 512
#: A median may be off by this share of its node's bytes.
SLACK = 1e-4
DIMENSIONS = ("id", "size", "n_chars", "lang", "source")


@dataclass
class Node:
    """A part of the tree: a leaf if ``dim`` is None."""

    shards: int
    weight: int = 0
    dim: str | None = None
    value: float = 0.0  # left: coordinate below value, or equal to it with a tie at most ``tie``
    tie: float = 0.0
    left: Node | None = None
    right: Node | None = None
    first: int = 0  # its first shard


def _leaves(node: Node) -> list[Node]:
    return [node] if node.dim is None else _leaves(node.left) + _leaves(node.right)


def _number(root: Node) -> None:
    at = 0
    for leaf in _leaves(root):
        leaf.first = at
        at += leaf.shards


def _place(node: Node) -> Column:
    """First shard of the leaf that a unit belongs to."""
    if node.dim is None:
        return F.lit(node.first)
    left = (F.col(node.dim) < node.value) | ((F.col(node.dim) == node.value) & (F.col("tie") <= node.tie))
    return F.when(left, _place(node.left)).otherwise(_place(node.right))


def _medians(units: DataFrame, root: Node, targets: dict[int, tuple[str, float, float, float]]) -> dict[int, tuple[float, float, int]]:
    """For each open leaf (by first shard): value, tie and bytes at or below the split next to its target.

    targets: dimension, bytes wanted left, smallest and largest coordinate.
    """
    spark = units.sparkSession
    open_ = {k: {"dim": d, "on": "value", "want": want, "lo": lo, "hi": hi, "below": 0, "value": None} for k, (d, want, lo, hi) in targets.items()}
    found: dict[int, tuple[float, float, int]] = {}
    placed = units.withColumn("leaf", _place(root))
    while open_:
        rows = [(k, s["dim"], s["on"], float(s["lo"]), float(s["hi"]), float(s["value"]) if s["value"] is not None else 0.0) for k, s in open_.items()]
        state = F.broadcast(spark.createDataFrame(rows, "leaf int, dim string, `on` string, lo double, hi double, fixed double"))  # a row per shard at most
        chosen = F.expr(" ".join(["CASE dim", *(f"WHEN '{d}' THEN `{d}`" for d in DIMENSIONS), "END"]))
        seen = placed.join(state, "leaf").withColumn("coordinate", chosen)
        seen = seen.withColumn("x", F.expr("CASE WHEN `on` = 'value' THEN coordinate WHEN coordinate = fixed THEN tie END")).where("x BETWEEN lo AND hi")
        bin_ = F.expr(f"CAST(least({BINS - 1}, floor((x - lo) / greatest(hi - lo, 1e-300) * {BINS})) AS INT)")
        sums = seen.groupBy("leaf", bin_.alias("bin")).agg(F.sum("weight").alias("w"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for k in list(open_):
            s = open_[k]
            bins = sorted((r["bin"], r["w"], r["a"], r["b"]) for r in sums if r["leaf"] == k)
            below, hit, last = s["below"], None, s.get("last")
            for _, w, a, b in bins:
                if below + w > s["want"]:
                    hit = (w, a, b)
                    break
                below, last = below + w, b
            s["below"], s["last"] = below, last
            if hit is None or hit[0] <= SLACK * targets[k][1] or hit[1] == hit[2]:
                single = hit is not None and hit[1] == hit[2] and hit[0] > SLACK * targets[k][1]
                if single and s["on"] == "value":  # many units with one value: go on by the hash
                    s |= {"on": "tie", "value": hit[1], "lo": -(2.0**53), "hi": 2.0**53, "before": (last, below), "last": None}
                    continue
                take = hit is not None and (below == 0 or (below + hit[0] - s["want"]) < (s["want"] - below))
                if take:
                    below, last = below + hit[0], hit[2]
                if s["on"] == "value":
                    found[k] = (float(last), float("inf"), below)
                elif last is None and s["before"][0] is not None:
                    found[k] = (float(s["before"][0]), float("inf"), s["before"][1])
                else:
                    found[k] = (float(s["value"]), float(last if last is not None else -(2.0**60)), below)
                del open_[k]
            else:
                s["lo"], s["hi"] = hit[1], hit[2]
    return found


def build(units: DataFrame, shards: int) -> Node:
    """Tree over units (id, size, tie: doubles; weight: long)."""
    root = Node(shards)
    _number(root)
    whole: dict[str, float] = {}
    while True:
        todo = {leaf.first: leaf for leaf in _leaves(root) if leaf.shards > 1 and leaf.weight >= 0}
        if not todo:
            return root
        stats = units.withColumn("leaf", _place(root)).groupBy("leaf").agg(
            F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"), *(f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max)))
        ).collect()
        by_leaf = {r["leaf"]: r for r in stats}
        targets = {}
        for first, leaf in todo.items():
            r = by_leaf.get(first)
            if r is None or r["n"] < 2:
                leaf.weight = -1  # can't be split
                continue
            whole = whole or {d: max(r[f"hi_{d}"] - r[f"lo_{d}"], 1e-9) for d in DIMENSIONS}
            wide = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d])
            leaf.weight = int(r["w"])
            targets[first] = (wide, r["w"] * (leaf.shards // 2) / leaf.shards, r[f"lo_{wide}"], r[f"hi_{wide}"])
        for first, (value, tie, below) in _medians(units, root, targets).items():
            leaf = todo[first]
            left = min(max(round(leaf.shards * below / leaf.weight), 1), leaf.shards - 1)
            leaf.dim, leaf.value, leaf.tie = targets[first][0], value, tie
            leaf.left, leaf.right = Node(left), Node(leaf.shards - left)
        _number(root)


def metadata(docs: DataFrame) -> list[Column]:
    """Coordinates ``n_chars``, ``lang`` and ``source`` of each row; 0 where the table has no such column."""
    n = F.col("n_chars").cast("string").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    out = [F.when(n.between(1.0, 2.0**62), F.log2(n)).otherwise(0.0).alias("n_chars")]
    for c in ("lang", "source"):
        place = F.shiftright(F.xxhash64(F.col(c).cast("string")), 16).cast("double") if c in docs.columns else F.lit(0.0)
        out.append(place.alias(c))
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("long")
    digests = (F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.lit(1)).alias("same"))
    rows = stored(docs.select("doc_id", size.alias("size"), *digests, *metadata(docs)), "shard-rows")
    groups = rows.groupBy("same").agg(F.sum("size").alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    heavy = groups.where(F.col("weight") * shards > total).select("same", F.ceil(F.col("weight") * (4 * shards) / max(total, 1)).alias("pieces"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id")), F.col("pieces"))).otherwise(0)
    dealt = rows.join(F.broadcast(heavy), "same", "left").withColumn("piece", piece).drop("pieces")  # fewer rows than shards
    dealt = stored(dealt.withColumn("unit", F.when(F.col("piece") == 0, F.col("same")).otherwise(F.xxhash64("same", "piece"))).drop("same", "piece"), "shard-units")
    units = dealt.groupBy("unit").agg(
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("id"), F.log2(F.max("size").cast("double")).alias("size"), F.sum("size").alias("weight"),
        *[F.min(c).alias(c) for c in DIMENSIONS[2:]],
    )
    units = stored(units.withColumn("tie", F.shiftright("unit", 11).cast("double")), "units")
    tree = build(units, shards)
    placed = dealt.join(units.select("unit", _place(tree).alias("shard")), "unit")
    return numbered(stored(placed, "placed"), "shard", ["doc_id"], ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "shard", "slot")
