"""Jaccard join of documents over word shingles, with candidates filtered under several global token orders.

Let a set have ``m`` tokens. It has at least ``0.8 m`` in common with any set that it is linked with, so of its first
``m - ceil(0.8 m) + need(m)`` tokens under a global order, its prefix, at least ``need`` of the smaller of the two sizes are in the other's
prefix too. Candidates must pass that under all of ``ORDERS`` orders, each a hash of its own. The filters are intersected set by set: a set
goes on to the next order only if enough of its prefix tokens are met in prefixes of other sets that are still there, so texts that only
quote a passage go, however many quote it. What is left is small; pairs of it share enough tokens of the last order, and are verified.

Tokens are hashes of shingles. In each order the tokens known to be frequent come last, rarest first; a bounded number of them goes to
every task, for any order that all tasks share gives right results. Documents of one set are one row, under a key of 16 bytes. Prefixes
are shuffled as packed arrays of tokens and halves of keys (sets that share a half share their tokens, which drops no candidate).

Components need no list of all links. In a few rounds each set is compared with one pivot, drawn anew in each round among the sets of
its tokens, and linked ones become one component: near copies of one text, however many, in work linear in their prefixes. Then
all pairs whose components still differ are compared: sets are parted into classes of some hundred tokens by bits of the tokens, and linked sets
are near in one class at least, where they share a prefix token and have sketches of few unlike bits. So only pairs that are near become rows,
and no pair is left out at any size.

Defined results: null texts and texts without words are empty sets, linked with nothing, also not with each other; texts of fewer
words than a shingle are one shingle of all; repeated rows and null ids give a row each, and a component of null ids has a null
id; an empty table gives an empty result; other columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeloom.llm._shared import _mixed, bit_map, cut, discard, groups, in_map, tokens
from timeloom.llm.simhash import components

#: Global token orders; the seeds of their hashes.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Frequent tokens that go to every task, and how often one must stand among ``CHUNK`` tokens to be looked at.
FREQUENT, CHUNK, OFTEN = 1 << 17, 1 << 20, 4
_WEIGHTS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Links need 100 * common >= PERCENT * all.
PERCENT = 80
#: Tokens of a class at least, and bits of its sketch.
CLASS, SKETCH = 64, 256


def token_sets(texts: list[str | None], size: int):
    """The distinct shingle hashes of each text, sorted."""
    hashes, ends = tokens(texts)
    # sums of words weighed by their places in the run, for runs of 1 to size words
    sums = [hashes * _WEIGHTS[0]]
    for k in range(1, size):
        sums.append(sums[-1][:-1] + hashes[k:] * _WEIGHTS[k])
    whole, start = _mixed(sums[-1]), 0
    for end in np.flatnonzero(ends).tolist():
        n = end - start
        yield np.unique(whole[start : end - size + 1]) if n >= size else _mixed(sums[n - 1][start : start + 1]) if n else whole[:0]
        start = end + 1


def set_key(made: np.ndarray) -> bytes:
    return hashlib.blake2b(made.tobytes(), digest_size=16).digest()


def need(m):
    """How many prefix tokens two linked sets share, of which the smaller has ``m`` tokens."""
    return 1 + m // 6


def least_common(m: int) -> int:
    """The smallest size of a set that one of ``m`` tokens is linked with, and of what they have in common."""
    return (PERCENT * m + 99) // 100


def prefix_size(m: int) -> int:
    return min(m, m - least_common(m) + need(m))


def _within(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def prefix(made: np.ndarray, seed: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first tokens of a set under one order, in that order."""
    late = np.zeros(len(made), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, made), len(frequent) - 1)
        late = np.where(frequent[at] == made, rank[at] + 1, 0)
    return made[np.lexsort((_mixed(made ^ np.uint64(seed)), late))[: prefix_size(len(made))]]


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, id_hash, m`` (distinct shingles), ``sid``, the key of the set, and ``s0``, its first half; null for empty sets.

    Rows with ``often`` are no documents but tokens that stand often among ``CHUNK`` tokens of distinct sets of a task, with counts.
    """
    import pyarrow as pa

    full = StructType([docs.schema["doc_id"], *StructType.fromDDL("id_hash long, m long, sid binary, s0 long, often array<struct<token: long, n: long>>").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target, held, seen, n = to_arrow_schema(full), [], set(), 0

        def often():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            own = counts >= OFTEN
            pairs = pa.StructArray.from_arrays([pa.array(values[own].view(np.int64)), pa.array(counts[own], pa.int64())], names=["token", "n"])
            row = [pa.nulls(1, f.type) for f in target][:-1] + [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs).cast(target.field(5).type)]
            return pa.RecordBatch.from_arrays(row, schema=target)

        for batch in batches:
            for at, texts in groups(batch.column(2)):
                made = list(token_sets(texts, size))
                keys = [set_key(s) if len(s) else None for s in made]
                part = batch.slice(at, len(texts))
                columns = [part.column(0), part.column(1), pa.array([len(s) for s in made], pa.int64()), pa.array(keys, pa.binary()), pa.array([None if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()), pa.nulls(len(made), target.field(5).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
                for own, key in zip(made, keys):
                    if key is not None and key not in seen:
                        seen.add(key)
                        held.append(own)
                        n += len(own)
                if n >= CHUNK:
                    yield often()
                    held, seen, n = [], set(), 0
        if held:
            yield often()

    return docs.select("doc_id", F.xxhash64("doc_id").alias("id_hash"), "text").mapInArrow(run, full)


def frequent_tokens(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest tokens by ``n`` (``token, n``), sorted, and their ranks from rare to frequent."""
    rows = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    order = np.argsort(token)
    return token[order], rank[order]


def texts_in(docs: DataFrame, ids: np.ndarray, size: int):
    """Rows and how a task reads sets from them: keys and tokens of the non-empty sets of documents whose hashed id is in the bit map."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def read(batch):
        import pyarrow as pa

        batch = batch.filter(pa.array(in_map(shared.value, batch.column(0).to_numpy())))
        for _, texts in groups(batch.column(1)):
            for made in token_sets(texts, size):
                if len(made):
                    yield set_key(made), made

    return docs.select(F.xxhash64("doc_id").alias("id_hash"), "text"), read


def met_tokens(docs: DataFrame, ids: np.ndarray, size: int, order: int, frequent) -> DataFrame:
    """``token, s0`` (half a set's key): the prefix tokens under one order that two sets or more have, of documents whose hashed id is in the bit map ``ids``."""
    import pyarrow as pa

    rows_of, read = texts_in(docs, ids, size)
    n_parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = np.dtype([("token", np.uint64), ("s0", np.uint64)])

    def run(batches):
        words, rank = shared.value
        held, n = [], 0

        def packed():
            rows = np.concatenate(held)
            # frequent tokens are met anyway and needn't meet here: they are dealt by set too
            key = np.where(_within(words, rows["token"]), rows["token"] ^ rows["s0"], rows["token"])
            part = (key * np.uint64(ORDERS[0]) >> np.uint64(33)) % np.uint64(n_parts)
            by = np.argsort(part, kind="stable")
            rows, cuts = rows[by], np.searchsorted(part[by], np.arange(n_parts + 1))
            some = [p for p in range(n_parts) if cuts[p + 1] > cuts[p]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "rows"])

        for batch in batches:
            for key, made in read(batch):
                first = prefix(made, ORDERS[order], words, rank)
                rows = np.empty(len(first), kind)
                rows["token"], rows["s0"] = first, np.frombuffer(key, np.uint64)[0]
                held.append(rows)
                n += len(rows)
                if n >= 1 << 19:
                    yield packed()
                    held, n = [], 0
        if held:
            yield packed()

    def met(batches):
        """Parts come one after another; one is held at a time."""
        words = shared.value[0]
        blobs = ((p, b) for batch in batches for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for _, own in groupby(blobs, key=itemgetter(0)):
            rows = np.concatenate([np.frombuffer(b, kind) for _, b in own])
            rows = rows[np.lexsort((rows["s0"], rows["token"]))]
            # documents of one set leave one row
            same = rows["token"][1:] == rows["token"][:-1]
            rows = rows[np.concatenate([[True], ~(same & (rows["s0"][1:] == rows["s0"][:-1]))])]
            same = rows["token"][1:] == rows["token"][:-1]
            rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | _within(words, rows["token"])]
            for at in range(0, len(rows), 1 << 16):
                own = rows[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[c]).view(np.int64)) for c in ("token", "s0")], names=["token", "s0"])

    made = rows_of.mapInArrow(run, "part int, rows binary")
    return made.repartition(n_parts // 4, "part").sortWithinPartitions("part").mapInArrow(met, "token long, s0 long")


def whole_sets(docs: DataFrame, size: int, sids: DataFrame, first: DataFrame) -> DataFrame:
    """``sid, tokens`` (sorted) of the sets ``sids``, one row each; ``first`` names a document (``sid, id_hash``) of each set."""
    import pyarrow as pa

    rows_of, read = texts_in(docs, bit_map(first.join(sids, "sid", "left_semi"), "id_hash"), size)

    def run(batches):
        for batch in batches:
            made, n = [], 0
            for key, own in read(batch):
                made.append((key, own.tobytes()))
                n += len(own)
                if n >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], names=["sid", "tokens"])
                    made, n = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*made)], names=["sid", "tokens"])

    return rows_of.mapInArrow(run, "sid binary, tokens binary").join(sids, "sid", "left_semi").dropDuplicates(["sid"])


def sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``a, b``) that are linked, by their whole sets."""
    import pyarrow as pa

    side = lambda df, s: df.select(F.col("sid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "sid"])
    near = cut(pairs, "jaccard-candidates")
    both = near.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "tokens_a", "tokens_b")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    made = cut(both.mapInArrow(verify, "a binary, b binary"), "jaccard-links")
    discard(near)
    return made


def survivors(docs: DataFrame, first: DataFrame, size: int, frequent) -> tuple[DataFrame, DataFrame]:
    """The sets that pass the filters of all orders, as in ``first``, and the tokens of the last order that they share: ``token, sid, m``."""
    alive = first
    enough = 1 + F.expr(f"({PERCENT} * m + 99) div 100 div 6")  # need(least_common(m)): a partner may be that small
    for k in range(len(ORDERS)):
        met = cut(met_tokens(docs, bit_map(alive, "id_hash"), size, k, frequent), f"jaccard-order{k}")
        counts = met.groupBy("s0").agg(F.count(F.lit(1)).alias("_n"))
        before, alive = alive, cut(alive.join(counts, "s0").filter(F.col("_n") >= enough).drop("_n"), f"jaccard-alive{k}")
        if k:
            discard(before)
        if k < len(ORDERS) - 1:
            discard(met)
    rows = cut(met.join(alive.select("s0", "sid", "m"), "s0").drop("s0"), "jaccard-met")
    discard(met)
    return alive, rows


def level_of(m: int) -> int:
    """How many bits of its tokens part a set of ``m`` tokens into classes of ``CLASS`` to twice as many."""
    return max(0, (m // CLASS).bit_length() - 1)


def class_rows(made: np.ndarray, level: int, frequent: np.ndarray, rank: np.ndarray):
    """Of each class of a set: its prefix tokens, and for each of them its place in the order, the class's size and its sketch."""
    part = (made >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(made), np.int64)
    sizes = np.bincount(part, minlength=1 << level)
    bit = (_mixed(made ^ np.uint64(ORDERS[1])) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = (np.bincount(part * SKETCH + bit, minlength=SKETCH << level) & 1).astype(np.uint8)
    sketch = np.packbits(odd).view(np.int64).reshape(-1, SKETCH // 64)
    late = np.zeros(len(made), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, made), len(frequent) - 1)
        late = np.where(frequent[at] == made, rank[at] + 1, 0)
    order = np.lexsort((_mixed(made ^ np.uint64(ORDERS[-1])), late, part))
    place = np.arange(len(made)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = place < (sizes - (PERCENT * sizes + 99) // 100 + 1)[part]  # part is sorted, as tokens are
    return made[order][own], place[own], sizes[part[own]], sketch[part[own]]


def class_prefixes(sets: DataFrame, frequent) -> DataFrame:
    """Rows of the classes of sets (``sid, tokens, root``): ``key`` (a prefix token and the level), ``sid, root, m``, whether the level is
    the set's own, the token's ``place``, the class's size ``n``, and ``s0`` to ``s3``, its sketch.

    Linked sets have ``9 * apart <= size + size``, where ``apart`` counts the tokens that one of them has. If that held in none of the classes into
    which bits of the tokens part both, it would not hold in sum, so it does in one that has tokens: there they share one of their prefix tokens
    and their sketches, parities of the tokens, differ in no more bits than that. A pair is compared at the level of its smaller set.
    """
    import pyarrow as pa

    shared = sets.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "sid", "root", "m", "own", "place", "n", *(f"s{i}" for i in range(SKETCH // 64))]

    def run(batches):
        words, rank = shared.value
        for batch in batches:
            for sid, blob, root in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                made = np.frombuffer(blob.as_buffer(), np.uint64)
                m = len(made)
                for level in sorted({level_of(m), level_of(least_common(m))}):
                    token, place, n, sketch = class_rows(made, level, words, rank)
                    key = _mixed(token ^ np.uint64((level + 1) * ORDERS[0] % (1 << 64))).view(np.int64)
                    k = len(key)
                    columns = [pa.array(key), pa.array([sid] * k, pa.binary()), pa.array(np.full(k, root, np.int64)), pa.array(np.full(k, m, np.int32)), pa.array(np.full(k, level == level_of(m))), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(np.ascontiguousarray(s)) for s in sketch.T)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return sets.select("sid", "tokens", "root").mapInArrow(run, f"key long, sid binary, root long, m int, own boolean, place int, n int, {', '.join(f's{i} long' for i in range(SKETCH // 64))}")


def class_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets of unlike ``root`` that may be linked, by rows of ``class_prefixes``: all that are linked are among them."""
    mixed = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("key")
    rows = rows.join(mixed, "key", "left_semi")
    a, b = (rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "key"]) for s in "ab")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SKETCH // 64)])
    # as many tokens may be apart; of the first that both have, all before it are
    fits = lambda apart: (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("n_a") + F.col("n_b"))
    near = F.expr("sid_a < sid_b AND root_a <> root_b AND (own_a OR own_b)") & sizes_fit("m_a", "m_b") & sizes_fit("n_a", "n_b") & fits(F.col("place_a") + F.col("place_b")) & fits(bits)
    return a.join(b, "key").filter(near).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct()


def classes(docs: DataFrame, size: int = 5, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """``doc_id, m, sid`` of all documents, and ``node, root`` of the sets in components of two or more."""
    every = cut(sets_of(docs, size), "jaccard-sets")
    made = every.filter("often IS NULL").drop("often")
    made._written = every._written
    frequent = frequent_tokens(every.select(F.explode("often").alias("x")).select("x.*"))
    # one document stands for its set; a bit map of the ids may let others through, which only adds work
    first = cut(made.filter("sid IS NOT NULL").groupBy("sid", "s0", "m").agg(F.min("id_hash").alias("id_hash")), "jaccard-first")
    alive, rows = survivors(docs, first, size, frequent)
    sets = cut(whole_sets(docs, size, alive.select("sid"), alive), "jaccard-tokens")
    links = found = None
    for turn in range(rounds):
        roots = rows if found is None else rows.join(found.withColumnRenamed("node", "sid"), "sid", "left")
        roots = roots.withColumn("root", F.coalesce("root", "sid") if found is not None else F.col("sid"))
        # each set with that of its tokens' pivots with which it shares most; pivots differ from round to round
        pivot = roots.groupBy("token").agg(F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "m", "root")).alias("p"))
        stars = roots.join(pivot, "token").filter(F.col("root") != F.col("p.root")).filter(sizes_fit("m", "p.m"))
        shared = stars.groupBy(F.col("sid").alias("b"), F.col("p.sid").alias("a")).agg(F.count(F.lit(1)).alias("n"))
        made_links = linked(shared.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), sets)
        if not made_links.take(1):
            break
        links = made_links if links is None else links.unionByName(made_links)
        found = cut(components(links), "jaccard-components")

    # pairs whose components differ, of sets that share a token with another component
    parts = rows.withColumn("root", F.col("sid")) if found is None else rows.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    mixed = parts.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("token")
    apart = parts.join(mixed, "token", "left_semi").select("sid", F.xxhash64("root").alias("root")).distinct()
    open_rows = cut(class_prefixes(sets.join(apart, "sid"), frequent), "jaccard-open")
    more = linked(class_pairs(open_rows), sets)
    final = cut(components(more if links is None else links.unionByName(more)), "jaccard-classes")
    discard(rows, open_rows, first, alive, sets)
    return made, final


def join_classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row for each document."""
    made, found = classes(docs, size)
    by_set = made.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least")).join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = by_set.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = by_set.join(named, "root").select("sid", "component_id")
    joined = made.filter("sid IS NOT NULL").join(by_set, "sid").select("doc_id", F.col("m").alias("n_shingles"), "component_id")
    return joined.unionByName(made.filter("sid IS NULL").select("doc_id", F.col("m").alias("n_shingles"), F.col("doc_id").alias("component_id")))
