"""Deterministic stratified splits, membership digests and samples."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.ranking import ordered_index
from tidewatch.session import stored
from tidewatch.spec import EXTERNAL_SPLIT, KEY, SPLIT_FRACTIONS


def draw_key(seed: int, key: str = KEY) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))


def make_splits(stays: DataFrame, seed: int = 2019, fractions: Mapping[str, float] = SPLIT_FRACTIONS) -> DataFrame:
    """``stay_id, split``.

    ``stays``: stay_id, hospital, ever_positive.  Stays of hospital A are shuffled by
    hash inside each ever_positive stratum and cut at floor(cumulative * n + 0.5);
    all other stays form the external test.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    known = F.col("hospital").isNotNull() & F.col("ever_positive").isNotNull()
    refuse = F.raise_error(F.lit("a stay without hospital or label has no split"))
    stays = stays.select(F.when(known, F.col(KEY)).otherwise(refuse).alias(KEY), "hospital", "ever_positive")
    stays = stored(stays, "stays")  # read three times
    home = stays.filter(F.col("hospital") == "A").select(KEY, "ever_positive")
    key = draw_key(seed)
    shuffled = ordered_index(home, ["ever_positive"], [F.md5(key), F.col(KEY)], "position")
    sizes = home.groupBy("ever_positive").agg(F.count(F.lit(1)).alias("size"))  # two rows
    placed = shuffled.join(F.broadcast(sizes), "ever_positive")
    names, cuts = list(fractions), list(accumulate(fractions.values()))
    split = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cuts[:-1]))):
        split = F.when(F.col("position") < F.floor(F.lit(cut) * F.col("size") + 0.5), name).otherwise(split)
    away = stays.filter(F.col("hospital") != "A").select(KEY, F.lit(EXTERNAL_SPLIT).alias("split"))
    return placed.select(KEY, split.alias("split")).unionByName(away)


def split_digest(splits: DataFrame) -> DataFrame:
    """Per split: size and a digest of its members.

    The digest hashes the sum of the members' 60-bit hashes, so it does not depend
    on order and needs no list of members in one place.
    """
    member = F.conv(F.substring(F.md5(F.col(KEY).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = splits.groupBy("split").agg(F.count(F.lit(1)).alias("stays"), F.sum(member).cast("string").alias("total"))
    return sums.select(
        "split", "stays", F.sha2(F.concat_ws("|", "split", F.col("stays").cast("string"), "total"), 256).alias("digest")
    )


def verify_splits(splits: DataFrame, recorded: DataFrame) -> None:
    """Raise unless every split matches its recorded digest (a handful of rows)."""
    now = split_digest(splits)
    off = now.join(recorded.withColumnRenamed("digest", "want"), "split", "full_outer").filter(
        ~F.col("digest").eqNullSafe(F.col("want"))
    )
    names = sorted(r["split"] for r in off.select("split").collect())
    if names:
        raise ValueError(f"splits do not match their recorded digest: {names}")


def split_overlap(splits: DataFrame) -> DataFrame:
    """Stays that sit in more than one split."""
    return splits.groupBy(KEY).agg(F.count_distinct("split").alias("n_splits")).filter(F.col("n_splits") > 1)


def in_split(rows: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    return rows.join(splits.filter(F.col("split") == name), KEY, "left_semi")


def not_in_split(requested: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    return requested.select(KEY).distinct().join(splits.filter(F.col("split") == name), KEY, "left_anti")


def sample(rows: DataFrame, n: int, seed: int, key: str = KEY) -> DataFrame:
    """``n`` rows without replacement, in hash order (a top-k, not a full sort)."""
    draw = draw_key(seed, key)
    return rows.orderBy(F.md5(draw), F.col(key)).limit(n)


def enriched_sample(stays: DataFrame, n: int, fraction: float, seed: int) -> DataFrame:
    """``n`` stays of which round(n * fraction) are ever positive, as far as there are any."""
    stays = stored(stays, "stays")
    counts = stays.groupBy("ever_positive").count().collect()  # two rows
    have = {bool(r["ever_positive"]): r["count"] for r in counts}
    n = min(n, sum(have.values()))
    k = min(have.get(True, 0), round(n * fraction))
    return sample(stays.filter("ever_positive"), k, seed).unionByName(
        sample(stays.filter("NOT ever_positive"), n - k, seed)
    )
