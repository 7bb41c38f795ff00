"""A global position for every row of an order, without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.session import ensure_checkpoint_dir

_LOCAL_BITS = 33        # of ``monotonically_increasing_id``: the place within a partition


def global_position(df: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``df`` with ``name``: each row's 0-based place in ``order`` (rows that are equal in it come in any order).

    Rows are range-partitioned and sorted, which a checkpoint fixes; a row's
    place is its place in its partition plus the rows of the partitions before.
    One number a partition goes through the driver, whatever the number of rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    at = "_at"
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn(at, F.monotonically_increasing_id()).checkpoint(eager=True))
    part = F.shiftright(at, _LOCAL_BITS)
    sizes = {r["part"]: r["count"] for r in placed.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before or [0]]), part.cast("int") + 1)
    return placed.withColumn(name, offset + F.col(at).bitwiseAND((1 << _LOCAL_BITS) - 1)).drop(at)
