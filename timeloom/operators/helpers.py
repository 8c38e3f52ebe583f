"""Joins and folds that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session in the one that ``spark.checkpoint.dir`` names; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/timeloom/{spark.sparkContext.applicationId}"


#: Whether a writer looks for a schema in variants.
SHREDDED = "spark.sql.variant.inferShreddingSchema"
#: Fixed value: how many wide rows are in a row group, which a reader takes at once.
WIDE_ROWS = 8


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe against lost executors. What a session wrote stays.

    Readers hold a batch of up to 4096 rows, but none beyond a row group; ``wide`` rows (whole documents) get groups of few rows. Variants in
    wide rows are written as they are: to find a schema for them a writer first holds up to 4096 rows in memory.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # by count, for sizes are those of compressed pages; a group's rows are counted after each
    writer = df.write.options(**{"parquet.block.row.count.limit": WIDE_ROWS, "parquet.block.size.row.check.min": 1}) if wide else df.write
    spark, before = df.sparkSession, df.sparkSession.conf.get(SHREDDED)
    spark.conf.set(SHREDDED, "false" if wide else before)
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHREDDED, before)
    return spark.read.schema(df.schema).parquet(path)


def islands(df: DataFrame, by: list[str], order: list[str], new: Column, out: str = "island") -> DataFrame:
    """Number the runs of rows of each key: a run begins where ``new`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(new.cast("int")).over(w))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str], direction: str = "backward") -> DataFrame:
    """Left rows with the columns ``take`` of the last right row at or before ``left_on`` (``forward``: first at or after).

    Both sides go through one shuffle by key and one ordered pass; ties of the right side go to the largest (forward:
    smallest) values of ``take``. Unmatched rows get nulls.
    """
    back = direction == "backward"
    side, t, row, found = "_side", "_t", "_row", "_found"
    a = left.select(*by, F.col(left_on).alias(t), F.lit(1 if back else 0).alias(side), F.struct(*left.columns).alias(row))
    a = a.withColumn("_r", F.lit(None).cast(_struct_type(right, take)))
    b = right.select(*by, F.col(right_on).alias(t), F.lit(0 if back else 1).alias(side), F.struct(*take).alias("_r")).withColumn(row, F.lit(None).cast(_struct_type(left, left.columns)))
    both = a.unionByName(b)
    if back:
        w = Window.partitionBy(*by).orderBy(t, side, "_r").rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*by).orderBy(F.desc(t), F.desc(side), F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(found, F.last("_r", ignorenulls=True).over(w)).filter(F.col(row).isNotNull())
    return both.select(f"{row}.*", *[F.col(found)[c].alias(c) for c in take])


def _struct_type(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType


def interval_join(a: DataFrame, b: DataFrame, by: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of half-open ranges (``a_start, a_end`` and ``b_start, b_end``) of one key that overlap.

    Ranges are dealt into bins of ``width``, bins are joined, and a pair is kept in the bin where its overlap begins. Ranges of ``b`` outside all
    of their key's in ``a`` meet none: they go before they are dealt.
    ``semi`` and ``anti`` keep rows of ``a``, each as often as it stands there; nulls in other columns don't matter.
    """

    def bins(df: DataFrame, s: str, e: str, out: str) -> DataFrame:
        return df.filter(F.col(s) < F.col(e)).withColumn(out, F.explode(F.sequence(F.expr(f"{s} div {width}"), F.expr(f"({e} - 1) div {width}"))))

    # one row a key of ``a``
    reach = a.filter("a_start < a_end").groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.min("a_start").alias("_low"), F.max("a_end").alias("_high"))
    same = reduce(lambda x, y: x & y, [b[c] == reach[f"_k{i}"] for i, c in enumerate(by)])
    near = b.join(reach, same & (F.col("b_start") < F.col("_high")) & (F.col("_low") < F.col("b_end")), "left_semi")
    left, right = bins(a, "a_start", "a_end", "_bin"), bins(near, "b_start", "b_end", "_bin")
    met = left.join(right, [*by, "_bin"]).filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    met = met.filter(F.expr(f"greatest(a_start, b_start) div {width}") == F.col("_bin")).drop("_bin")
    if how == "inner":
        return met
    # whether a range is met depends on its key and ends alone
    names = [*by, "a_start", "a_end"]
    keys = met.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]).distinct()
    same = [a[c].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(names)]
    return a.join(keys, reduce(lambda x, y: x & y, same), "left_semi" if how == "semi" else "left_anti")


def swept(points: DataFrame, by: list[str], at: str, value: str, width: int) -> DataFrame:
    """Points of a key (one row each ``at``) with ``run``, the sum of ``value`` up to them, and ``next``, the point after (or null).

    Sums go by bins of ``width`` first, so a key is no single task's work: only one row a bin is summed in order.
    """
    points = points.withColumn("_bin", F.expr(f"{at} div {width}"))
    inside, across = Window.partitionBy(*by, "_bin").orderBy(at), Window.partitionBy(*by).orderBy("_bin")
    bins = points.groupBy(*by, "_bin").agg(F.sum(value).alias("_s"), F.min(at).alias("_first"))
    bins = bins.select(*by, "_bin", F.coalesce(F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(across).alias("_after"))
    rows = points.withColumns({"_run": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead(at).over(inside)}).join(bins, [*by, "_bin"])
    return rows.withColumns({"run": F.col("_run") + F.col("_before"), "next": F.coalesce("_next", "_after")}).drop("_bin", "_run", "_next", "_before", "_after")


def fold_per_key(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Rows of each key, in order, through ``fold(rows) -> rows`` (iterators of dicts).

    Rows are dealt by key and sorted, and a task reads them as a stream: a fold that keeps little state takes keys of any
    size, and many small keys cost no call each.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, out = to_arrow_schema(target), []
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, own in groupby(rows, key=itemgetter(*keys)):
            for made in fold(own):
                out.append(made)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)


def with_halo(chunks: DataFrame, by: list[str], order: str, samples: str, n: int) -> DataFrame:
    """Add ``halo``: the last ``n`` samples of the chunk before, empty for the first."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(samples).over(w)
    tail = F.when(F.size(before) >= n, F.slice(before, -n, n)).otherwise(before)
    return chunks.withColumn("halo", F.coalesce(tail, F.array().cast(chunks.schema[samples].dataType)))
