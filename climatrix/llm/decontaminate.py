"""Benchmark decontamination with a distributed positional inverted index.

DataFrame operations only. Postings (term, row, place) of every corpus
token that the benchmark uses are stored once in the shared folder; they give the terms'
frequencies as well. Each 13-word window of an item is looked up by its two
rarest terms: their lists, shifted by the terms' offsets in the item, are
intersected, which leaves (row, item, shift) candidates. Comparing the words
along a shift then gives the exact phrase matches; with ``slop`` the same
intersection gives proximity matches.

Only the benchmark's vocabulary and look-up terms are ever broadcast, after their rows are
counted (``BROADCAST_ROWS``); larger ones are joined by shuffle. A common term
spreads over many rows of postings and is only counted, with map-side sums.

Defined results: null texts have no words; a row without words isn't
contaminated; rows that are equal in id and text give equal results, and
rows that share an id but not the text are judged each on its own; items without words or id
never match; items repeated under one id count once; columns other than doc_id and text
(item_id and text) play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climatrix.llm.tables import fresh, stored

WINDOW = 13
#: Most rows of a benchmark-side table that are sent to every executor.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Lower-cased (A-Z only) words of a text column; null has none."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``row``: a key shared only by rows equal in both."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (its words joined by a space), item_words."""
    made = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("item_words"))
    return made.where("size(item_words) > 0").select("item_id", F.array_join("item_words", " ").alias("item"), "item_words").distinct()


def build_index(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stored postings term, row, place of the corpus tokens that any item uses."""
    terms = stored(items.select(F.explode("item_words").alias("term")).distinct(), "terms")
    tokens = keyed(docs).select("row", F.posexplode(words("text")).alias("place", "term"))
    return stored(tokens.join(_small(terms), "term").select("term", "row", "place"), "postings")


def rarest_pairs(items: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, t1, o1, t2, o2: terms and offsets of the two rarest terms of each window that can occur at all."""
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    text = items.select("item", "item_words").distinct()
    place = text.select("item", F.size("item_words").alias("n"), F.posexplode("item_words").alias("o", "term")).join(frequency, "term", "left")
    by_item = place.groupBy("item", "n").agg(F.sort_array(F.collect_list(F.struct("o", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("p"))
    one = by_item.select(
        "item",
        F.explode(F.expr(f"transform(sequence(0, n - least(n, {window})), i -> array_sort(transform(slice(p, i + 1, least(n, {window})), x -> struct(x.df, x.o, x.term))))")).alias("w"),
    )
    first, second = F.col("w")[0], F.expr("w[least(1, size(w) - 1)]")
    return one.where(first["df"] > 0).select(
        "item", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2")
    ).distinct()


def intersect(postings: DataFrame, pairs: DataFrame, slop: int = 0) -> DataFrame:
    """row, item, shift (place of the item's first word) where both terms of a pair stand, at most ``slop`` words out of place."""
    pairs = stored(pairs, "pairs")
    one = postings.join(_small(pairs), F.col("term") == F.col("t1")).select("row", "item", "o1", "o2", (F.col("place") - F.col("o1")).alias("shift"))
    two = postings.join(_small(pairs), F.col("term") == F.col("t2")).select("row", "item", "o1", "o2", (F.col("place") - F.col("o2")).alias("shift"))
    if slop == 0:
        return one.join(two.distinct(), ["row", "item", "o1", "o2", "shift"], "left_semi").select("row", "item", "shift").distinct()
    # Only shifts in the same or the next stretch of slop + 1 words meet: a word repeated all over a text gives no pairs of all its places.
    stretch = F.floor(F.col("shift") / (slop + 1)).cast("long")
    near = two.select("row", "item", "o1", "o2", F.col("shift").alias("other"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    both = one.withColumn("stretch", stretch).join(near, ["row", "item", "o1", "o2", "stretch"])
    return both.where(F.abs(F.col("shift") - F.col("other")) <= slop).select("row", "item", "shift").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, candidates: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, runs: the word ranges [s, e) of the row covered by windows of the item along one shift."""
    wanted = _small(candidates.select("row").distinct())  # first only the texts with a candidate
    texts = keyed(docs).select("row", "text").join(wanted, "row", "left_semi").dropDuplicates(["row"]).join(candidates, "row")
    pairs = texts.select("row", "item", "shift", words("text").alias("ws"), F.split("item", " ").alias("iw"))
    sized = pairs.withColumn("n", F.least(F.lit(window), F.size("iw")))
    starts = sized.withColumn(
        "starts",
        F.expr("filter(sequence(0, size(iw) - n), i -> shift + i >= 0 AND slice(ws, greatest(shift + i, 0) + 1, n) = slice(iw, i + 1, n))"),
    )
    runs = F.expr(
        "aggregate(starts, cast(array() AS array<struct<s:int,e:int>>), (acc, i) -> "
        "if(size(acc) > 0 AND acc[greatest(size(acc) - 1, 0)].e >= shift + i, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', acc[greatest(size(acc) - 1, 0)].s, 'e', shift + i + n))), "
        "concat(acc, array(named_struct('s', shift + i, 'e', shift + i + n)))))"
    )
    return starts.where("size(starts) > 0").select("row", "item", runs.alias("runs"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id where the two rarest terms of a window of the item stand within ``slop`` words of their places."""
    items = stored(items_of(benchmark), "items")
    postings = build_index(docs, items)
    near = intersect(postings, rarest_pairs(items, postings, window), slop).select("row", "item").distinct()
    return near.join(items, "item").join(keyed(docs).select("row", "doc_id").distinct(), "row").select("doc_id", "item_id").distinct()


#: Length of the union of the sorted ranges r: each adds what lies beyond the furthest end before it.
UNION = (
    "aggregate(r, named_struct('n', 0L, 'e', 0), (acc, x) -> named_struct("
    "'n', acc.n + greatest(0, x.e - greatest(x.s, acc.e)), 'e', greatest(acc.e, x.e)), acc -> acc.n)"
)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored exact matches (row, item, runs) and the items (item_id, item, item_words)."""
    items = stored(items_of(benchmark), "items")
    postings = build_index(docs, items)
    candidates = stored(intersect(postings, rarest_pairs(items, postings, window)), "candidates")
    return stored(phrase_matches(docs, items, candidates, window), "matches"), items


def hit_words(found: DataFrame) -> DataFrame:
    """row, n_hit: words of each row inside any matched window."""
    spans = found.select("row", F.explode("runs").alias("x")).select("row", "x.s", "x.e").distinct()
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("r"))
    return by_row.select("row", F.expr(UNION).alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated for every row of ``docs``."""
    found, items = matches(docs, benchmark, window)
    ids = found.select("row", "item").distinct().join(items.select("item", "item_id"), "item").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = keyed(docs).select("doc_id", "row", F.size(words("text")).cast("long").alias("n_words"))
    out = rows.join(ids.join(hit_words(found), "row"), "row", "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return out.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids",
        F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns unchanged."""
    found, _ = matches(docs, benchmark, window)
    hits = stored(hit_words(found), "hits")
    name = fresh(docs, "gone_row")
    marked = keyed(docs).join(_small(hits), "row").where(F.expr("20 * n_hit") >= F.size(words("text"))).select(F.col("row").alias(name)).distinct()
    return docs.join(_small(stored(marked, "contaminated")), F.xxhash64(docs["doc_id"], docs["text"]) == F.col(name), "left_anti")
