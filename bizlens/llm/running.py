"""Running sums over a whole table in a global order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import drop_saved, saved, small_table


def _cumulate(sums: dict[str, str]):
    def run(batches):
        part, carry = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, names = list(batch.columns), list(batch.schema.names)
            for name, value in sums.items():
                upto = np.cumsum(batch.column(value).to_numpy()) + carry[name]
                carry[name] = int(upto[-1])
                columns.append(pa.array(upto, pa.int64()))
            columns.append(pa.array(np.full(batch.num_rows, part, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *sums, "_part"])
    return run


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: whole-number column): its sum up to this row in ``order``.

    Rows are range-partitioned and sorted, each partition is summed as it
    streams by, and what lies before a partition is added: one number for
    each sum and partition goes through the driver. Rows that are equal in ``order``
    come in any order. The result is a saved table.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = ", ".join([fields, *(f"`{n}` long" for n in sums), "_part int"])
    table = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cumulate(sums), schema), name)
    ends = table.groupBy("_part").agg(*[F.max(n).alias(n) for n in sums]).orderBy("_part").collect()
    before = {n: np.cumsum([0, *(e[n] for e in ends)])[:-1] for n in sums}
    offsets = small_table(df.sparkSession, {"_part": pa.array([e["_part"] for e in ends], pa.int32())}
                          | {f"_{n}": pa.array(before[n], pa.int64()) for n in sums})
    out = table.join(F.broadcast(offsets), "_part")             # as many rows as there are partitions
    out = saved(out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]), name)
    drop_saved(table)
    return out
