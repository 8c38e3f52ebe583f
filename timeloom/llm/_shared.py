"""Helpers that the document operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of every operator that counts plain words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a bit map of hashes, as a power of two: 8 MB, whatever the input.
BIT_MAP = 26


#: A byte that no UTF-8 text has stands for the end.
END = 0xFE
#: Bytes that are hashed at once.
PIECE = 1 << 21
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\v\f\r" else b for b in range(256))
_PLACES = np.random.default_rng(41).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: computed once, and safe against lost executors.

    What a session wrote stays until ``discard`` or ``clear``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/timeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    # the table replaces the shuffles that made it; without this they stay on disk until the driver collects its garbage
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._written = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later plan reads."""
    for df in tables:
        if path := df.__dict__.get("_written"):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that ``cut`` wrote in this session; call it when the results have been read."""
    _delete(spark, f"{shared_folder(spark)}/timeloom/{spark.sparkContext.applicationId}")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows evenly before long Python work, by key where keys are given, into as many parts as a shuffle has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def exclusive_prefix(df: DataFrame, group: list[str], order: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over smaller ``order`` in the group.

    ``order`` is a dense non-negative long, unique in its group. Sums go up and down a tree of ``fan`` children, so
    that no task sees more than ``fan`` times the partial sums below the top, however large a group is.
    """
    low = Window.partitionBy(*group, "_p1").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_p1", F.expr(f"{order} div {fan}"))
    sums = df.groupBy(*group, "_p1").agg(F.sum(value).alias("_s1")).withColumn("_p2", F.expr(f"_p1 div {fan}"))
    tops = sums.groupBy(*group, "_p2").agg(F.sum("_s1").alias("_s2"))
    top = Window.partitionBy(*group).orderBy("_p2").rowsBetween(Window.unboundedPreceding, -1)
    mid = Window.partitionBy(*group, "_p2").orderBy("_p1").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*group, "_p2", F.coalesce(F.sum("_s2").over(top), F.lit(0)).alias("_o2"))
    sums = sums.withColumn("_o1", F.coalesce(F.sum("_s1").over(mid), F.lit(0))).join(tops, [*group, "_p2"])
    sums = sums.select(*group, "_p1", (F.col("_o1") + F.col("_o2")).alias("_o"))
    df = df.withColumn("_o0", F.coalesce(F.sum(value).over(low), F.lit(0))).join(sums, [*group, "_p1"])
    return df.withColumn(out, F.col("_o0") + F.col("_o")).drop("_p1", "_o0", "_o")


def text_key() -> Column:
    """16 bytes that stand for a text; a null text has none."""
    return F.coalesce(F.unhex(F.md5("text")), F.lit(b"").cast("binary"))


def map_texts(docs: DataFrame, keep: list[str], make, schema: str) -> DataFrame:
    """``keep`` columns and those that ``make(texts)`` gives, computed in Arrow batches.

    ``make`` gets a pyarrow string array (nulls as they are) and returns arrays for the columns of ``schema``.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    full = StructType([docs.schema[c] for c in keep] + made.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(full)
        for batch in batches:
            # large texts go through in pieces of bounded size
            step = max(1, int(batch.num_rows * min(1.0, 16_000_000 / max(1, batch.column(len(keep)).nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                columns = [part.column(i) for i in range(len(keep))] + list(make(part.column(len(keep))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return docs.select(*keep, "text").mapInArrow(run, full)


def groups(column, most: int = 2_000_000):
    """Rows of a string column in runs of at most ``most`` bytes, or one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def bit_map(keys: DataFrame, column: str = "key", bits: int = BIT_MAP) -> np.ndarray:
    """A map of ``2 ** bits`` bits of the hashes in ``column``, gathered in pieces of at most 8 KB."""
    low = keys.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("low")).distinct()
    pieces = low.groupBy(F.shiftright("low", 16).alias("piece")).agg(F.collect_list(F.col("low").bitwiseAND(F.lit(65535)).cast("int")).alias("at"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            made = []
            for at in batch.column(1):
                piece = np.zeros(1 << 13, np.uint8)
                at = np.array(at.values, np.int64)
                np.bitwise_or.at(piece, at >> 3, (1 << (at & 7)).astype(np.uint8))
                made.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["piece", "bytes"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in pieces.mapInArrow(pack, "piece long, bytes binary").toLocalIterator():
        out[row.piece << 13 : (row.piece + 1) << 13] = np.frombuffer(row.bytes, np.uint8)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _P2
    x = (x ^ x >> np.uint64(29)) * _P3
    return x ^ x >> np.uint64(32)


def run_key(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(context, suffix)`` of two longs."""
    h = np.uint64(42)
    for x in (context, suffix):
        h = (h + _P5 + np.uint64(8)) ^ _turned(x * _P2, 31) * _P1
        h = _mixed(_turned(h, 27) * _P1 + _P4)
    return h


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lowered) of all texts in a row, each text's followed by one end, and which are ends."""
    joined, at, hashes, ends = b"".join(b"%b %c " % ((t or "").encode().translate(_TABLE), END) for t in texts), 0, [], []
    while at < len(joined):
        raw = np.frombuffer(joined, np.uint8, joined.index(b" ", min(at + PIECE, len(joined) - 1)) + 1 - at, at)
        at += len(raw)
        space = raw == 32
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        if not len(starts):
            continue
        first = np.concatenate([[0], starts])
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(np.concatenate([first, [len(raw)]])))
        word = (raw.astype(np.uint64) + np.uint64(1)) * (_PLACES[place & 1023] + (place >> 10).astype(np.uint64) * _P3)
        word[space] = 0
        hashes.append(_mixed(np.add.reduceat(word, starts)))
        ends.append(raw[starts] == END)
    return (np.concatenate(hashes), np.concatenate(ends)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, bool))


def bounded_sample(df: DataFrame, key: str, n: int, seed: int, by: str | None = None) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``key``: the same ones each time, from all parts of the table.

    With ``by`` (a label, few enough values for the driver, which learns them) each of its values gets an equal share of the
    ``n`` rows, however rare it is. Counts let each task drop what can't be among the chosen, so that little reaches the final
    choice.
    """
    h, wide = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)), 1 << 40
    if by is None:
        total = df.count()
        if total > 8 * n:
            df = df.filter(h < int(wide * 4 * n / total))
        return df.orderBy(h, key).limit(n)
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_of"))
    share = max(1, n // max(1, counts.count()))
    df = df.join(F.broadcast(counts), by).filter(h < F.greatest(F.lit(40.0), F.lit(4.0 * share)) * wide / F.col("_of"))
    turn = F.row_number().over(Window.partitionBy(by).orderBy(h, key))
    return df.withColumn("_turn", turn).filter(F.col("_turn") <= share).drop("_turn", "_of").limit(n)


def slice_of(text: str, most_chars: int, seed: int) -> Column:
    """A text of at most ``most_chars`` characters: the whole, or as much from a place that a hash chooses."""
    return F.substring(F.col(text), 1 + F.pmod(F.xxhash64(text, F.lit(seed)), F.greatest(F.lit(1), F.length(text) - most_chars + 1)).cast("int"), F.lit(most_chars))
