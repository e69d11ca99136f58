"""Spreading work: hot join keys and inputs that come in too few pieces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SALTS = 16
_FEW = 4
_SALT = "_salt"


def spread_join(
    facts: DataFrame,
    keyed: DataFrame,
    on: Sequence[str],
    spread_by: str,
    *,
    salts: int | None = DEFAULT_SALTS,
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many rows per key to one row per key without giving a key to a single task.

    ``facts`` rows of one key go to ``salts`` partitions by a hash of ``spread_by``; the keyed side
    is repeated once per salt.  Whether that side is broadcast instead is left to Spark, which knows
    its size when it is shuffled.

    With ``salts=None`` the facts' keys are counted first, when this is called, and only keys with more
    than a partition's fair share of all rows are parted, each into as many pieces as it has shares.
    Where no key is hot this is a plain join.  Counting computes the key columns of ``facts`` once more,
    joins and windows behind them included; ``counted``, cheaper rows in which the keys come about as
    often, is counted in their place.  The counts settle how keys are parted, never what the join returns.
    Null keys match nothing; with ``how="left"`` they are counted and parted like any other.
    """
    if how not in ("inner", "left"):
        raise ValueError("a spread join keeps the many-row side: use inner or left")
    if salts is None:
        return _part_hot_keys(facts, keyed, list(on), spread_by, hot_keys(facts if counted is None else counted, on), how)
    if salts <= 1:
        return facts.join(keyed, list(on), how)
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    repeated = keyed.withColumn(_SALT, copies)
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def hot_keys(facts: DataFrame, on: Sequence[str]) -> DataFrame | None:
    """Keys with more than one of ``spark.sql.shuffle.partitions`` equal shares of all rows, and their ``_pieces``.

    None if there are none.  Whatever the data, there are fewer of them than partitions: that is what the
    driver takes.  Counts combine per task before their shuffle.
    """
    session = facts.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    counts = facts.groupBy(*on).agg(F.count("*").alias("_rows"))
    shares = F.col("_rows") * parts / counts.agg(F.sum("_rows")).scalar()
    hot = counts.select(*on, F.ceil(shares).cast("int").alias("_pieces")).where("_pieces > 1")
    found = hot.collect()
    return session.createDataFrame(found, hot.schema) if found else None


def _part_hot_keys(
    facts: DataFrame, keyed: DataFrame, on: list[str], spread_by: str, hot: DataFrame | None, how: str
) -> DataFrame:
    if hot is None:
        return facts.join(keyed, on, how)
    few = F.broadcast(hot.toDF(*(f"_hot_{c}" for c in on), "_pieces"))  # fewer rows than partitions

    def pieces(df: DataFrame) -> DataFrame:
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on))
        return df.join(few, same, "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1))).drop(*(f"_hot_{c}" for c in on))

    salted = pieces(facts).withColumn(_SALT, F.pmod(F.xxhash64(spread_by), "_pieces").cast("int")).drop("_pieces")
    repeated = pieces(keyed).withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for work that is heavy per row, where byte-sized splits would be too coarse.

    A few per core, so that a core with a costly row leaves its other partitions to its neighbours.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, _FEW * spark.sparkContext.defaultParallelism)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input of fewer pieces than a few per core, such as one small file, over all cores.

    Large inputs already have more pieces than that and are left where they are.
    """
    context = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= _FEW * context.defaultParallelism:
        return df
    return df.repartition(compute_partitions(df.sparkSession))
