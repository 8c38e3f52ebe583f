"""Mixing sources to target weights, with DataFrame operations only.

The words of a source form one stream, in a pseudorandom but fixed order of its documents, cut into blocks of
``block_words``. The output is a sequence of slots, grouped in shards. A source is due as many slots as bring its target at
its blocks' mean length. Each slot of a shard draws a source by these numbers, so the source counts of a shard are
multinomial. The few slots that a source drew beyond its due are handed to sources that drew too few, by number. The slots
of a source are numbered through all shards; number ``r`` takes the block at ``r mod n`` of a pseudorandom permutation of
the source's ``n`` blocks, a new permutation for each pass.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, ordered last; a
null or repeated doc_id is a row like any other; a source smaller than a block is one short block and still meets its
target to half a block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm._shared import WORD, cut, exclusive_prefix, spread

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 12


def targets(sized: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """One row for each source: ``skey, source_size, weight, target``; targets share the total size by weight.

    A target stops at ``most`` times its source's size and what it can't take is shared again by weight. With sources
    in the order of cap / weight, the first k of them are capped, and the level that the others share is the largest
    of the levels that result for k = 0, 1, 2 and so on. One row a source reaches the single sorting task.
    """
    src = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("skey").isNull(), "skey")) - 1
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    src = src.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "skey")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total, every = F.sum("source_size").over(Window.partitionBy()), Window.partitionBy()
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    src = src.withColumn("_level", level).withColumn("_level", F.max("_level").over(every))
    return src.select("skey", "source_size", "weight", F.least("_cap", F.col("weight") * F.col("_level")).alias("target"))


def _permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 chosen by ``key``: rounds of swap-or-not."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, partner), key, r) > 0, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def sources(sized: DataFrame, block_words: int, weights=WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """The targets with ``sid`` (a hash that stands for the source, null or not), ``n_blocks``, ``n_slots`` due and ``low``, the slots due to sources before."""
    src = targets(sized, weights, most).withColumn("sid", _sid(seed)).withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    due = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return src.withColumn("n_slots", due).withColumn("low", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))


def _sid(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("skey").isNull(), F.col("skey"))


def pieces(docs: DataFrame, sized: DataFrame, src: DataFrame, block_words: int, seed: int, texts: bool = False) -> DataFrame:
    """What each block consists of: ``doc_id, size, skey, sid, start, block, from_word, n_words, source_size, target`` (and ``piece``, the words).

    A piece is the words ``from_word`` up to ``from_word + n_words`` of a document, and lies in block ``block`` of its source
    (null for documents without words). ``start`` is the document's place in its source's stream.
    """
    buckets = max(1, sized.count() // 256)
    rows = _sized(docs, *(["text"] if texts else [])) if texts else sized
    rows = rows.withColumn("sid", _sid(seed)).withColumn("_r", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.pmod("_r", F.lit(buckets)))
    sums = sized.select(_sid(seed).alias("sid"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(buckets)).alias("bucket"), "size").groupBy("sid", "bucket").agg(F.sum("size").alias("_n"))
    sums = exclusive_prefix(sums, ["sid"], "bucket", "_n", "_off").drop("_n")
    inner = Window.partitionBy("sid", "bucket").orderBy("_r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["sid", "bucket"]).withColumn("start", F.col("_in") + F.col("_off"))

    def piece(block: Column) -> Column:
        first = F.greatest(block * block_words, F.col("start"))
        n = F.least((block + 1) * block_words, F.col("start") + F.col("size")) - first
        made = [block.alias("block"), (first - F.col("start")).alias("from_word"), n.alias("n_words")]
        if texts:
            made.append(F.array_join(F.slice("words", (first - F.col("start") + 1).cast("int"), n.cast("int")), " ").alias("piece"))
        return F.struct(*made)

    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))
    if texts:
        rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "size", "skey", "sid", "start", F.explode_outer(F.transform(spans, piece)).alias("_p"))
    rows = rows.select("doc_id", "size", "skey", "sid", "start", "_p.*")
    return rows.join(src.select("sid", "source_size", "target"), "sid")


def slots(src: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """What each output shard takes: ``shard, sid, r, block``; joined with the pieces by ``(sid, block)`` they make the output."""
    spark = src.sparkSession
    n_src, n_slots = src.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_slots"), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a slot's number falls to one source; both meet by the range of numbers that they lie in
    wide = max(1, n_slots // (4 * max(1, n_src)))
    ranges = src.filter("n_slots > 0").select("sid", "low", (F.col("low") + F.col("n_slots")).alias("high"))
    ranges = ranges.withColumn("_range", F.explode(F.sequence(F.expr(f"low div {wide}"), F.expr(f"(high - 1) div {wide}"))))
    drawn = spark.range(0, n_slots, 1, parts).select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n_slots))).alias("_u"))
    drawn = drawn.withColumn("_range", F.expr(f"_u div {wide}")).join(ranges, "_range").filter("low <= _u AND _u < high")
    drawn = cut(drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("_n")), "mix-draws")

    every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    gaps = src.join(drawn.groupBy("sid").agg(F.sum("_n").alias("_drawn")), "sid", "left").select("sid", "n_blocks", "n_slots", F.coalesce("_drawn", F.lit(0)).alias("_drawn"))
    before = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0))).over(every), F.lit(0))
    gaps = gaps.withColumn("_spare", before(F.col("_drawn") - F.col("n_slots"))).withColumn("_lack", before(F.col("n_slots") - F.col("_drawn")))
    gaps = cut(gaps, "mix-gaps")
    ranks = exclusive_prefix(drawn, ["sid"], "shard", "_n", "_first").join(gaps.select("sid", "n_blocks", "n_slots", "_spare"), "sid")
    ranks = spread(ranks, "sid", "shard").withColumn("_end", F.col("_first") + F.col("_n"))
    kept = ranks.filter("_first < n_slots").select("shard", "sid", "n_blocks", F.explode(F.expr("sequence(_first, least(_end, n_slots) - 1)")).alias("r"))
    moved = ranks.filter("_end > n_slots").select("shard", F.explode(F.expr("sequence(_spare + greatest(_first, n_slots) - n_slots, _spare + _end - 1 - n_slots)")).alias("_turn"))
    lacking = gaps.filter("_drawn < n_slots").select("sid", "n_blocks", "_drawn", "_lack", F.explode(F.expr("sequence(_lack, _lack + n_slots - _drawn - 1)")).alias("_turn"))
    moved = moved.join(lacking, "_turn").select("shard", "sid", "n_blocks", (F.col("_drawn") + F.col("_turn") - F.col("_lack")).alias("r"))
    block = _permuted(F.pmod("r", F.col("n_blocks")), F.col("n_blocks"), F.xxhash64(F.lit(seed), "sid", F.expr("r div n_blocks")))
    return kept.unionByName(moved).select("shard", "sid", "r", block.alias("block"))


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)


def mixture(docs: DataFrame, block_words: int = 32, shard_slots: int = 1024, weights=WEIGHTS, most: float = 3.0, seed: int = 7, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pieces of all blocks and the slots of all shards."""
    sized = cut(_sized(docs), "mix-sizes")
    src = cut(sources(sized, block_words, weights, most, seed), "mix-sources")
    return pieces(docs, sized, src, block_words, seed, texts), slots(src, shard_slots, seed)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: ``doc_id, size, source_size, target, taken``."""
    parts, taken_by = mixture(docs, **options)
    uses = taken_by.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    taken = F.coalesce(F.sum(F.col("n_words") * F.col("uses")), F.lit(0)).cast("long")
    empty = parts.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    # a start is unique in its source among documents with words, so repeated ids stay apart
    full = parts.filter("size > 0").join(uses, ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "size", "source_size", "target").agg(taken.alias("taken"))
    return full.select("doc_id", "size", "source_size", "target", "taken").unionByName(empty)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself, a row for each slot: ``shard, r`` (its number in its source), ``source, block, doc_ids, n_words, text``.

    A block has at most ``block_words`` words, so it is put together from as many pieces at most.
    """
    parts, taken_by = mixture(docs, texts=True, **options)
    inside = F.array_sort(F.collect_list(F.struct("start", "doc_id", "piece", "n_words")))
    made = parts.filter("size > 0").groupBy("sid", "block").agg(F.first("skey").alias("source"), inside.alias("_in"))
    text, n_words = F.array_join(F.transform("_in", lambda x: x["piece"]), " "), F.aggregate("_in", F.lit(0).cast("long"), lambda n, x: n + x["n_words"])
    made = made.select("sid", "block", "source", F.transform("_in", lambda x: x["doc_id"]).alias("doc_ids"), n_words.alias("n_words"), text.alias("text"))
    return taken_by.join(made, ["sid", "block"]).select("shard", "r", "source", "block", "doc_ids", "n_words", "text")
