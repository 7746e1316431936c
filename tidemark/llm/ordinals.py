"""Global ordinals of a sorted frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.store import stored


def numbered(rows: DataFrame, order: list[str], kind: str) -> tuple[DataFrame, int]:
    """``rows`` with their place ``g`` (from 0) in the order of the columns ``order``, and their number.

    A range shuffle, a count per partition (that is all the driver sees) and no window over all rows. Rows that are equal
    in ``order`` get any of their places. The result is a written table.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], names=[*batch.schema.names, "__part", "g"])
            at += n

    schema = StructType([*rows.schema, StructField("__part", LongType()), StructField("g", LongType())])
    held = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), kind)
    sizes = sorted((r["__part"], r["n"]) for r in held.groupBy("__part").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([0] + [n for _, n in sizes]).tolist()
    before = held.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(sizes, ends, strict=False)], "__part long, __before long")
    return held.join(F.broadcast(before), "__part").withColumn("g", F.col("g") + F.col("__before")).drop("__part", "__before"), ends[-1]
