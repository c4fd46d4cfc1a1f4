"""Sampling (M1-M3).

A row's place in the draw is the MD5 of (key, seed), so a sample is the same
whatever the partitioning, and SQL can repeat it. Rows whose keys are equal
(or null) are told apart by an MD5 of their whole content; identical rows
are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 15  # 60 bits of the hash decide a Bernoulli draw
PREFIX_SPACE = 16**PREFIX_HEX
STEP_HEX = 4  # digits by which a boundary is narrowed: at most 65,536 counts a pass


def sample_fraction(
    df: DataFrame, fraction: float, seed: int = 42, key: str | None = None
) -> DataFrame:
    """M1: Bernoulli sample of about ``fraction`` of the rows.

    With ``key`` (a unique column) the draw is hash-based: a row is kept
    when the first 60 bits of MD5(key, seed) fall below ``fraction``. The
    sample is then the same whatever the partitioning or cluster layout, and
    reproducible in SQL. Without a key Spark's partition-seeded sampler is
    used.
    """
    if fraction >= 1.0:
        return df
    if key is None:
        return df.sample(withReplacement=False, fraction=float(fraction), seed=int(seed))
    bound = format(max(0, int(round(float(fraction) * PREFIX_SPACE))), f"0{PREFIX_HEX}x")
    return df.filter(F.substring(sample_hash(key, seed), 1, PREFIX_HEX) < F.lit(bound))


def sample_hash(key: str, seed: int) -> Column:
    """Hex MD5 of ``key || ':' || seed`` (a null key counts as empty text); DuckDB computes the same string."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{int(seed)}")))


def _content_hash(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """M2: exactly min(n, N) rows without replacement, repeatable by seed.

    The rows kept are the first n in the order of (MD5(key, seed), MD5 of the
    row). Rows are counted per four hex digits (at most 65,536 counts reach the driver),
    which locates the n-th row's prefix; only that prefix is counted again, four digits
    deeper, until it ends exactly at the n-th row - about log(N) / log(65,536) passes. The
    sample is then one distributed filter: no task ever holds or sorts it,
    and n, N and the uniqueness of the key make no difference to the method.
    """
    n = int(n)
    columns = df.columns
    if n <= 0:
        return df.limit(0)
    ranked = df.withColumn("_h", sample_hash(key, seed))
    prefix, need = "", n
    deep = False
    while True:
        width = min(len(prefix) + STEP_HEX, 64)
        if width > 32 and not deep:  # equal key hashes: go on by content, on those rows only
            deep = True
            head = prefix
            bucket = ranked.filter(F.col("_h") == F.lit(head)).withColumn("_h", F.concat("_h", _content_hash(columns)))
        rows = bucket if deep else ranked
        here = rows.filter(F.substring("_h", 1, len(prefix)) == F.lit(prefix)) if prefix else rows
        counts = sorted((r[0], r[1]) for r in here.groupBy(F.substring("_h", 1, width)).count().collect())
        if not prefix and sum(c for _, c in counts) <= n:
            return df
        for prefix, c in counts:
            if need <= c:
                break
            need -= c
        if need == c or width == 64:
            break
    whole = need == c  # the prefix is taken whole, else it is one row repeated c times
    if not deep:
        return ranked.filter(F.substring("_h", 1, len(prefix)) <= F.lit(prefix)).drop("_h")
    taken = bucket.filter(F.substring("_h", 1, len(prefix)) <= F.lit(prefix) if whole else F.col("_h") < F.lit(prefix))
    out = ranked.filter(F.col("_h") < F.lit(head)).drop("_h").unionByName(taken.drop("_h"))
    if whole:
        return out
    last = bucket.filter(F.col("_h") == F.lit(prefix)).drop("_h").limit(1)
    repeated = last.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(need)))).drop("_i")
    return out.unionByName(repeated)


def cap_rows(df: DataFrame, cap: int, key: str, seed: int = 42) -> DataFrame:
    """M3: all rows when there are at most ``cap``, else an exact ``cap`` sample."""
    return sample_n(df, cap, key, seed)
