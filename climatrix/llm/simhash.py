"""Document fingerprints: SimHash and the search within a Hamming radius, in DataFrame operations only.

A term is a pair of neighbouring words (the last word stands alone), lower-cased, with its
frequency in the text as its weight. Each of the 128 bits of a term's hash votes, with that
weight, for a one or a zero; a fingerprint's bit is one where ones outweigh zeros. Two counters share
a long, so 64 sums hold all votes. Words are partly summed in the task that reads them; what is
shuffled is one row of sums a document and task.

``within_radius`` finds fingerprints at most ``RADIUS`` = 6 bits apart. The fingerprint falls into eight
blocks of 16 bits; six changed bits leave two blocks whole, so there are 28 permuted tables, each
keyed by two blocks, and every such pair meets in one of them at least. Candidates are then compared
bit by bit. Tables hold each distinct fingerprint once, whatever the number of its documents, and a
key's entries are dealt over ``SALT`` tasks.

Defined results: a null text counts as empty; a text without words has the fingerprint 0 and no term
voted in it. Rows equal in id and text are one document, returned as often as it stands in the
table. Documents that share an id follow each other by the SHA-256 of their texts; a null id comes
last and is never a query of the search. Other columns play no part. An empty table gives
an empty result. A text of any length is read whole; its words must fit a task's memory.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climatrix.llm.tables import stored

BITS = 128
BLOCKS = 8
RADIUS = 6
#: Tasks that one key of a block table is dealt over.
SALT = 8
#: Ids ordered by one task.
PER_BUCKET = 100_000

_LANES = 0x0000000100000001


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), "")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``fp_high``, ``fp_low``: 128 bits for each value of ``keys``, whose rows hold one and the same text."""
    words = texts.select(*keys, _words(text).alias("words"))
    following = F.slice("words", 2, F.greatest(F.size("words"), F.lit(1)))
    pairs = words.withColumn("following", following).select(*keys, F.explode_outer(F.arrays_zip("words", "following")).alias("term"))
    hashed = pairs.select(
        *keys,
        F.when(F.col("term").isNotNull(), F.xxhash64("term.words", "term.following")).alias("h0"),
        F.when(F.col("term").isNotNull(), F.xxhash64("term.words", "term.following", F.lit(1))).alias("h1"),
    )
    votes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_LANES).cast("long"))).alias(f"{h}_{i}") for h in ("h0", "h1") for i in range(32)]
    counted = hashed.groupBy(*keys).agg(F.count("h0").alias("weight"), *votes)

    def _bit(ones: Column, at: Column) -> Column:
        return F.when(2 * ones > F.col("weight"), F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).otherwise(F.lit(0).cast("long"))

    def bits(h: str) -> Column:
        ones = F.array(*(F.coalesce(F.col(f"{h}_{i}"), F.lit(0).cast("long")) for i in range(32)))
        place = F.transform(ones, lambda x, i: _bit(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), i).bitwiseOR(_bit(F.shiftrightunsigned(x, 32), i + 32)))
        return F.aggregate(place, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return counted.select(*keys, bits("h0").alias("fp_high"), bits("h1").alias("fp_low"))


def as_text(high: str, low: str) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (high, low))))


def distance(high: Column, low: Column, high2: Column, low2: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(high.bitwiseXOR(high2)) + F.bit_count(low.bitwiseXOR(low2))


def likeness(high: Column, low: Column, high2: Column, low2: Column) -> Column:
    """Share of equal bits of two fingerprints."""
    return 1 - distance(high, low, high2, low2) / F.lit(float(BITS))


def _blocks(high: str, low: str) -> list[Column]:
    return [F.shiftrightunsigned(c, s).bitwiseAND(F.lit(0xFFFF).cast("long")) for c in (high, low) for s in (48, 32, 16, 0)]


def block_tables(prints: DataFrame) -> DataFrame:
    """``prints`` with ``entry`` = table number * 2**32 + its two leading blocks; 28 rows for each fingerprint."""
    blocks = _blocks("fp_high", "fp_low")
    entries = [F.lit(t << 32).cast("long") + F.shiftleft(blocks[i], 16) + blocks[j] for t, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]
    return prints.withColumn("entry", F.explode(F.array(*entries)))


def within_radius(queries: DataFrame, prints: DataFrame) -> DataFrame:
    """fp_high, fp_low (of ``queries``) and near_high, near_low: all of ``prints`` at most ``RADIUS`` bits away.

    Both sides hold distinct fingerprints (fp_high, fp_low); every pair is returned once.
    """
    salt = F.pmod(F.xxhash64("fp_high", "fp_low"), F.lit(SALT))
    index = block_tables(prints.select("fp_high", "fp_low")).select("entry", salt.alias("salt"), F.col("fp_high").alias("near_high"), F.col("fp_low").alias("near_low"))
    asked = block_tables(queries.select("fp_high", "fp_low")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    met = asked.join(index, ["entry", "salt"])
    near = distance(F.col("fp_high"), F.col("fp_low"), F.col("near_high"), F.col("near_low"))
    return met.where(near <= RADIUS).select("fp_high", "fp_low", "near_high", "near_low").distinct()


def _key() -> Column:
    """SHA-256 of id and text: one value for each document."""
    name = F.when(F.col("doc_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("i"), F.col("doc_id").cast("string")))
    return F.unhex(F.sha2(F.concat(name, F.lit(":"), F.sha2(F.col("text").cast("binary"), 256)).cast("binary"), 256))


def succession(docs: DataFrame) -> DataFrame:
    """key, doc_id, n_chars, copies and next_key of each document: the next one by descending id; after the last comes the first.

    Ids are dealt into ranges, each ordered by a task of its own; the first row of every range (one a
    range) closes the range before it.
    """
    own = docs.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    own = stored(own, "fingerprint-ids")
    ranges = own.count() // PER_BUCKET + 1
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    dealt = stored(own.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    inside = Window.partitionBy("range").orderBy(*order)
    rows = dealt.withColumn("next_key", F.lead("key").over(inside)).withColumn("place", F.row_number().over(inside))
    first = rows.where("place = 1").select("range", F.col("key").alias("head"))
    across = Window.orderBy("range")  # one row a range
    first = first.select(
        "range", F.coalesce(F.lead("head").over(across), F.first("head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follows")
    )
    return rows.join(F.broadcast(first), "range").select("key", "doc_id", "n_chars", "copies", F.coalesce("next_key", "follows").alias("next_key"))


def document_fingerprints(docs: DataFrame, query_every: int = 50) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how near they and the next document's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and n_near: for
    ids divisible by ``query_every``, the number of other documents within the Hamming radius, else null.
    The edited text is the text with its last half (rounded down) replaced by the start of the next document.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", _key())
    follow = stored(succession(plain.select("key", "doc_id", "text")), "fingerprint-succession")
    prints = stored(fingerprints(plain, ["key"]), "fingerprints")

    # Each text meets, by its own key, the key of the document before it and how much that one takes.
    whole = plain.groupBy("key").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    takes = follow.select(F.col("next_key").alias("key"), F.col("key").alias("before"), half.alias("take"))
    heads = whole.join(takes, "key").select(F.col("before").alias("key"), F.expr("substring(text, 1, take)").alias("head"))
    kept = follow.select("key", (F.col("n_chars").cast("int") - half).alias("keep"))
    edited = whole.join(kept, "key").join(heads, "key").select("key", F.expr("concat(substring(text, 1, keep), head)").alias("edited"))
    edited = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    changed = fingerprints(edited, ["key", "edited_sha256"], "edited").withColumnsRenamed({"fp_high": "e_high", "fp_low": "e_low"})

    joined = follow.join(prints, "key").join(changed, "key").join(prints.select(F.col("key").alias("next_key"), F.col("fp_high").alias("n_high"), F.col("fp_low").alias("n_low")), "next_key")
    c = F.col
    rows = joined.select(
        "key", "doc_id", "n_chars", "copies", "edited_sha256", "fp_high", "fp_low", as_text("fp_high", "fp_low").alias("fingerprint"), as_text("e_high", "e_low").alias("edited_fingerprint"),
        likeness(c("fp_high"), c("fp_low"), c("e_high"), c("e_low")).alias("near_edited"), likeness(c("fp_high"), c("fp_low"), c("n_high"), c("n_low")).alias("near_next"),
    )
    rows = stored(rows, "fingerprint-rows")

    is_query = F.coalesce(F.col("doc_id").cast("long") % query_every == 0, F.lit(False))
    held = stored(rows.groupBy("fp_high", "fp_low").agg(F.sum("copies").alias("documents"), F.max(is_query).alias("asked")), "fingerprint-classes")
    pairs = within_radius(held.where("asked"), held)
    sizes = held.select(F.col("fp_high").alias("near_high"), F.col("fp_low").alias("near_low"), "documents")
    near = pairs.join(sizes, ["near_high", "near_low"]).groupBy("fp_high", "fp_low").agg(F.sum("documents").alias("n"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT))).join(near, ["fp_high", "fp_low", "salt"], "left")
    out = out.withColumn("n_near", F.when(is_query, F.col("n") - 1))
    # As many rows as the document has; two levels keep the arrays short.
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000)))
    out = out.withColumn("block", thousands).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000).cast("long"), F.col("copies") - 1000 * F.col("block")))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near")
