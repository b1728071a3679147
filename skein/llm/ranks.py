"""Positions of rows in a total order, found by ranges: no task ever holds more than its range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def in_order(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` sorted into ranges by ``order``, checkpointed, with their place in the whole from 0 on as ``name`` long.

    ``rows`` must be a table or checkpointed, as it is read to find the ranges and again to deal them. Rows that are equal
    in ``order`` are put in order of their place in ``rows``, so that any number of them is spread over the ranges. The
    table of range sizes, one row for each range, is the only thing broadcast.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = (dealt.repartitionByRange(*order, F.col("_row").asc()).sortWithinPartitions(*order, F.col("_row").asc())
              .drop("_row").withColumn("_place", F.monotonically_increasing_id())).checkpoint()
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (ranged.withColumn("_part", part).join(F.broadcast(base), "_part")
            .withColumn(name, F.col("_base") + F.col("_place") - F.shiftleft("_part", 33))
            .drop("_part", "_base", "_place"))


def in_groups(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """As :func:`in_order`, but the place of a row among those of its ``group`` (a string column; null is a group).

    Groups of any size are spread over ranges. Of each range only the first group may have begun in an earlier one, so
    one number for each range carries the counts on.
    """
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_first(), *order, F.col("_row").asc()]
    ranged = (dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
              .withColumn("_part", F.spark_partition_id().cast("long")))
    schema = StructType([*ranged.schema.fields, StructField("_head", LongType()), StructField("_local", LongType())])

    def count(batches):
        # number of the group within the range, and place within its part of the range
        last, head, local = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(batch.schema.get_field_index(group)).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy(zero_copy_only=False)
            key = (codes.dictionary[int(code[0])].as_py(),)
            new = np.r_[key != last, code[1:] != code[:-1]]
            heads = head + np.cumsum(new)
            at = np.arange(len(code))
            since = np.maximum.accumulate(np.where(new, at, -1))
            places = np.where(since >= 0, at - since, at + local)
            last, head, local = (codes.dictionary[int(code[-1])].as_py(),), int(heads[-1]), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.int64()), pa.array(places, pa.int64())],
                                             [*batch.schema.names, "_head", "_local"])

    placed = ranged.mapInArrow(count, schema).checkpoint()
    ends = placed.groupBy("_part").agg(
        F.min_by(F.struct(F.col(group).alias("g")), "_head").alias("first"),
        F.max_by(F.struct(F.col(group).alias("g"), (F.col("_local") + 1).alias("n")),
                 F.struct("_head", "_local")).alias("last"),
        (F.max("_head") == 0).alias("single"))
    w = Window.orderBy("_part")
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.struct(F.lag("last.g").over(w).alias("g")))
                         & (F.row_number().over(w) > 1), F.lit(False))
    seen = ends.select("_part", "single", goes_on.alias("goes_on"), F.lag("last.n").over(w).alias("n"))
    # a range whose first group fills all of the range before, and began earlier still, adds to that one's number
    adds = F.col("goes_on") & F.lag(F.col("goes_on") & F.col("single"), 1, False).over(w)
    runs = seen.withColumn("_adds", adds).withColumn("_run", F.sum(F.when(F.col("_adds"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy("_run").orderBy("_part")
    carry = runs.select("_part", F.sum(F.when(F.col("goes_on"), F.col("n")).otherwise(0)).over(inside).alias("_carry"))
    return (placed.join(F.broadcast(carry), "_part")
            .withColumn(name, F.col("_local") + F.when(F.col("_head") == 0, F.col("_carry")).otherwise(F.lit(0)))
            .drop("_part", "_head", "_local", "_carry"))
