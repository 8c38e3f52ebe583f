"""Files of one text each: captions, chapters, cut lists and project documents, written and read back.

A file lies in a folder of its key (``track_id=7/format=srt``), so that names need no rule and readers get the key back as columns. A job's files
are committed together when all of them are written: a job that fails leaves none, and none is ever half a file.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.functions.scalars import chapter_time
from timeloom.operators.captions import srt_files, vtt_files


#: What Spark escapes in the names of partition folders, and the name for a key without a value.
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _folder(keys: dict[str, str | None]) -> str:
    escaped = lambda v: _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v)
    return os.path.join(*[f"{escaped(k)}={escaped(v) if v else _NO_VALUE}" for k, v in keys.items()])


def write_files(texts: DataFrame, path: str, by: list[str], text: str, mode: str = "errorifexists") -> None:
    """One file a row (``by`` is a key) with ``text`` as it is and a line break at its end, if it has none yet."""
    rows = texts.select(*by, F.regexp_replace(F.col(text), "\n$", "").alias("value"))
    spark = texts.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() == "file":
        return _write_mounted(rows, store.makeQualified(place).toUri().getPath(), by, mode.lower())
    # files become visible when the whole job is done, not task by task
    writer = rows.write.partitionBy(*by).mode(mode)
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "1").text(path)


def _write_mounted(rows: DataFrame, path: str, by: list[str], mode: str) -> None:
    """The same in a mounted folder: there Hadoop's writer starts a process for each folder and file that it makes, which takes most of the time.

    Tasks write to a folder beside ``path``; when all are done, one rename makes it ``path``. A file takes its name when it is whole,
    and a task that runs again writes the same ones.
    """
    if os.path.exists(path) and mode in ("error", "errorifexists"):
        raise FileExistsError(f"path {path} already exists")
    if os.path.exists(path) and mode == "ignore":
        return
    job = uuid.uuid4().hex
    staged = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}-{job}")

    def run(batches):
        import pyarrow as pa

        seen, n = {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                value = row.pop("value")
                folder = os.path.join(staged, _folder(row))
                os.makedirs(folder, exist_ok=True)
                number = next(seen.setdefault(folder, count()))
                whole = os.path.join(folder, f"part-{number:05d}-{job}.txt")
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(f"{value or ''}\n")
                os.replace(part, whole)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    # rows of one key lie in one task, which numbers its files
    dealt = rows.select(*[F.col(c).cast("string").alias(c) for c in by], "value").repartition(*by)
    try:
        os.makedirs(staged)
        dealt.mapInArrow(run, "n long").agg(F.sum("n")).first()
        with open(os.path.join(staged, "_SUCCESS"), "w"):
            pass
        if mode == "append" and os.path.exists(path):
            for folder, _, names in os.walk(staged):
                own = os.path.join(path, os.path.relpath(folder, staged))
                os.makedirs(own, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(folder, name), os.path.join(own, name))
            return
        if mode == "overwrite" and os.path.exists(path):
            shutil.rmtree(path)
        os.rename(staged, path)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


#: Types that keys get back from the names of folders, the first that fits all of a key's values, and how such values look.
_TYPES = (("int", r"^[+-]?\d+$"), ("bigint", r"^[+-]?\d+$"), ("decimal(38,0)", r"^[+-]?\d{1,38}$"), ("double", r"^.*[^dDfF]$"), ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("timestamp", r"^\d{4}-\d{1,2}-\d{1,2}[ T]"))


def read_files(spark: SparkSession, path: str, text: str, **only: str) -> DataFrame:
    """The files of ``write_files``: their keys and their whole texts; ``only`` names values of keys (as in their folders), and other folders aren't read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() == "file":
        return _read_mounted(spark, store.makeQualified(place).toUri().getPath(), text, only)
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", text)
    for name, value in only.items():
        files = files.filter(F.col(name) == value)
    return files


def _entries(folder: str, folders: bool):
    """Names in a folder as a stream, without hidden ones."""
    with os.scandir(folder) as found:
        for e in found:
            if not e.name.startswith((".", "_")) and e.is_dir() == folders:
                yield e.name


def _value(name: str) -> str | None:
    """The value of a key in the name of its folder."""
    value = re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name.split("=", 1)[1])
    return None if value == _NO_VALUE else value


def _read_mounted(spark: SparkSession, path: str, text: str, only: dict[str, str]) -> DataFrame:
    """The same from a mounted folder: tasks list folders, level by level, and read files, so the driver holds no list of them (Spark's reader keeps one entry a folder and a file there)."""
    names, at = [], path
    while (first := next((n for n in _entries(at, True) if "=" in n), None)) is not None:
        names.append(first.split("=", 1)[0])
        at = os.path.join(at, first)

    def level(wanted):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for own in batch.column(0).to_pylist():
                    made = []
                    for name in _entries(own, True):
                        if "=" in name and (wanted is None or _value(name) == wanted):
                            made.append(os.path.join(own, name))
                        if len(made) == 10_000:
                            yield pa.RecordBatch.from_pydict({"folder": made})
                            made = []
                    if made:
                        yield pa.RecordBatch.from_pydict({"folder": made})

        return run

    keys = [f"_k{i}" for i in range(len(names))]
    folders = spark.range(1).select(F.lit(path).alias("folder"))
    for name in names:
        folders = folders.mapInArrow(level(only.get(name)), "folder string").repartition("folder")

    def values(folder):
        return [_value(n) for n in os.path.relpath(folder, path).split(os.sep)] if names else []

    def run_keys(batches):
        import pyarrow as pa

        for batch in batches:
            made = [values(f) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in range(len(names))], names=keys)

    def run(batches):
        import pyarrow as pa

        made, size = [], 0
        full = pa.schema([(k, pa.string()) for k in [*keys, "value"]])
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name in _entries(folder, False):
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace", newline="") as f:
                        made.append([*values(folder), f.read()])
                    size += len(made[-1][-1])
                    if size > 1 << 22 or len(made) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], schema=full)
                        made, size = [], 0
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*made)], schema=full)

    kinds = {}
    if names:
        fits = lambda k, kind, look: F.bool_and(F.col(k).isNull() | (F.col(k).rlike(look) & F.col(k).try_cast(kind).isNotNull())) & (F.count(k) > 0)
        row = folders.mapInArrow(run_keys, ", ".join(f"{k} string" for k in keys)).agg(*[fits(k, kind, look).alias(f"{k} {kind}") for k in keys for kind, look in _TYPES]).first()
        kinds = {k: next((kind for kind, _ in _TYPES if row[f"{k} {kind}"]), "string") for k in keys}
    files = folders.mapInArrow(run, ", ".join(f"{k} string" for k in [*keys, "value"]))
    return files.select(F.col("value").alias(text), *[F.col(k).cast(kinds[k]).alias(n) for k, n in zip(keys, names)])


def write_captions(segments: DataFrame, path: str, formats: tuple[str, ...] = ("srt", "vtt"), mode: str = "errorifexists") -> None:
    """Each track (``track_id, seg_id, start_ms, dur_ms, text``) as one file in each format."""
    made = {"srt": lambda: srt_files(segments).withColumnRenamed("srt", "body"), "vtt": lambda: vtt_files(segments).withColumnRenamed("vtt", "body")}
    parts = [made[f]().select("track_id", F.lit(f).alias("format"), "body") for f in formats]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    write_files(both, path, ["track_id", "format"], "body", mode)


def chapters_json(chapters: DataFrame) -> DataFrame:
    """Chapters (``project_id, t_ms, label``) as one JSON list a project, in the order of time: ``project_id, json``, each with ``time`` in seconds and ``label``."""
    entry = F.struct(F.col("t_ms").alias("t"), F.struct((F.col("t_ms") / 1000).alias("time"), F.col("label").alias("label")).alias("e"))
    rows = chapters.groupBy("project_id").agg(F.sort_array(F.collect_list(entry)).alias("s"))
    return rows.select("project_id", F.to_json(F.transform("s", lambda x: x["e"]), {"pretty": "false"}).alias("json"))


def parsed_chapters(files: DataFrame) -> DataFrame:
    """Entries of ``chapters_json``: ``project_id, n`` (from 0), ``t_ms, label, stamp`` (HH:MM:SS)."""
    rows = files.select("project_id", F.posexplode(F.from_json("json", "array<struct<time: double, label: string>>")).alias("n", "e"))
    ms = F.round(F.col("e.time") * 1000).cast("long")
    return rows.select("project_id", "n", ms.alias("t_ms"), F.col("e.label").alias("label"), chapter_time(ms).alias("stamp"))
