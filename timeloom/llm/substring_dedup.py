"""Removal of long repeated substrings with per-shard suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere in the corpus. Sorting all
suffixes of the corpus would move every byte many times, so three steps come before the suffix arrays, none of which
loses a repeat:

* Exact copies of a text are one text with a count.
* Each window of ``length`` bytes has an anchor, the least hash among its ``GRAM``-byte strings, leftmost on a tie. Equal
  windows have equal anchors. Anchors that occur once in the corpus need no suffix array; they are counted first.
* Neighbouring windows with one anchor share a context (the bytes that they cover). Equal contexts are one row with
  a count.

Contexts that share an anchor meet in one shard, or in several where they are many. A shard sorts its suffixes by
Larsson-Sadakane refinement, Kasai's scan gives their common prefixes, and neighbours with ``length`` bytes in common are
repeats. The sorted windows of the shards of one anchor are then dealt out by range and merged by binary search.

A bit map of fixed size tells a task which anchors need no work; it only ever errs towards more work. Which copy of a
text is read is decided by an exact join.

Defined results: a null text counts as empty; texts under ``length`` bytes keep all bytes; repeated rows are copies of each
other; null ids give a row each; an empty table gives an empty result; other columns are ignored; texts of any length
are handled whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import bit_map, cut, in_map

GRAM = 32
#: Positions of one piece of a text; pieces overlap so that no window is lost.
PIECE = 1 << 19
#: Ways in which the contexts of an anchor are dealt before they are counted.
SALTS = 8
SEPARATOR = 0xFF  # in no UTF-8 text
_ODD = [np.uint64(x * 2 + 1) for x in np.random.default_rng(77).integers(1 << 61, 1 << 62, 6).tolist()]


# ---- windows and anchors


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first and last window start of each run of windows with one anchor."""
    found = []
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        n = len(raw) - GRAM + 1
        words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)).astype(np.uint64)
        code = _mixed(sum(words[8 * j : 8 * j + n] * _ODD[j] for j in range(GRAM // 8)))
        # the position breaks ties towards the left, and tells which string was least
        low = np.uint64((1 << 20) - 1)
        least = _sliding_min(code & ~low | np.arange(n, dtype=np.uint64), length - GRAM + 1) & low
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        found.append((code[least[first].astype(np.int64)], first + at, np.concatenate([first[1:], [len(least)]]) - 1 + at))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


# ---- suffix arrays


def suffix_ranks(raw: np.ndarray, n: int) -> np.ndarray:
    """Ranks of all suffixes of ``raw``, whose bytes from ``n`` on are separators and sort last, the longest run first.

    Larsson-Sadakane refinement: a group of suffixes that agree on their first ``h`` bytes is sorted by the ranks of the
    suffixes ``h`` bytes further on, which doubles ``h``; a suffix alone in its group is never sorted again.
    """
    padded = np.concatenate([raw, np.full(8, SEPARATOR, np.uint8)])
    first = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.arange(len(raw))
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    active, h = order[~(starts & np.concatenate([starts[1:], [True]]))], 8
    while len(active):
        key = rank[active] * len(raw) + rank[np.minimum(active + h, len(raw) - 1)]
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        group = key // len(raw)
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        starts = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(active))
        base = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[active] = group + np.maximum.accumulate(np.where(starts, at, 0)) - base
        active, h = active[~(starts & np.concatenate([starts[1:], [True]]))], h * 2
    return rank


def common_prefixes(raw: np.ndarray, before: np.ndarray, heads: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one ``before`` it in order (-1: none), at most ``most``.

    Kasai's scan: from one position to the next the length falls by one at most. The texts that start at ``heads`` are
    scanned together, one position of each at a time.
    """
    out = np.zeros(len(before), np.int64)
    longest = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[longest], sizes[longest]
    h = np.zeros(len(heads), np.int64)
    for t in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -t, "left"))
        at = heads[:n] + t
        other = before[at]
        h = np.where(other >= 0, np.maximum(h[:n] - 1, 0), 0)
        going = np.flatnonzero((other >= 0) & (h < most))
        while len(going):
            same = raw[at[going] + h[going]] == raw[other[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < most]
        out[at] = h
    return out


def repeated(contexts: list[bytes], length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context the flags of its windows that also start elsewhere in the shard, and the order of all windows.

    The order has a row (context, window) for each distinct window, by its bytes.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    sep = bytes([SEPARATOR])
    raw = np.frombuffer(sep.join(contexts) + sep * (length + 8), np.uint8)
    heads, n, windows = np.cumsum(sizes + 1) - sizes - 1, int(sizes.sum()) + len(contexts) - 1, sizes - length + 1
    order = np.argsort(suffix_ranks(raw, n)[:n])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prefix = common_prefixes(raw, before, heads, sizes, length)
    # whole windows in order; what agrees with one on all its bytes is a whole window too
    window_of = np.full(n, -1, np.int64)
    owner = np.repeat(np.arange(len(contexts)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    window_of[heads[owner] + within] = np.arange(len(owner))
    order = order[window_of[order] >= 0]
    twin = prefix[order] >= length
    flags = np.zeros(len(owner), bool)
    flags[window_of[order]] = twin | np.concatenate([twin[1:], [False]])
    distinct = window_of[order[~twin]]
    return np.split(flags, np.cumsum(windows)[:-1]), np.stack([owner[distinct], within[distinct]], axis=1)


def _spans(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of true flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def spans_of(contexts: DataFrame, length: int, shard_bytes: int, crowd: int) -> DataFrame:
    """``anchor, digest, lo, hi``: runs of windows of a context that occur more than once.

    ``contexts``: ``anchor, digest, many`` (the whole context occurs more than once) and ``context``, no two alike.
    """
    import pyarrow as pa

    only = F.first(F.struct("digest", "many", (F.octet_length("context") - length).cast("int").alias("hi"))).alias("only")
    many = cut(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), only), "substrings-crowds")
    # the contexts of an anchor are dealt by digest too, so that a frequent anchor is no single task's work
    salted = many.filter("n > 1").select("anchor", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    sub = F.pmod(F.col("digest"), F.ceil(F.col("n") / F.lit(crowd)))
    dealt = contexts.withColumn("salt", F.pmod("digest", F.lit(SALTS)).cast("int")).join(salted, ["anchor", "salt"]).withColumn("sub", sub).select("anchor", "digest", "many", "context", "sub", (F.col("n") > crowd).alias("split"))
    n_parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n_parts, "anchor", "sub").sortWithinPartitions("anchor", "sub")
    schema = "anchor long, digest long, lo int, hi int, prefix long, window long"

    def run(batches):
        def shard(rows):
            flags, order = repeated([r[3] for r in rows], length)
            out = []
            for r, own in zip(rows, flags):
                out += [(r[0], r[1], a, b, None, None) for a, b in zip(*_spans(own | r[2]))]
            for c, w in order.tolist():
                if rows[c][5]:
                    window = rows[c][3][w : w + length]
                    # sign flipped, so that longs sort as the bytes do
                    prefix = int.from_bytes(window[:8], "big") - (1 << 63)
                    out.append((rows[c][0], rows[c][1], w, w, prefix, int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big", signed=True)))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "digest", "lo", "hi", "prefix", "window"]) if out else None

        rows, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if (r[0], r[4]) != last and size > shard_bytes:
                    if (made := shard(rows)) is not None:
                        yield made
                    rows, size = [], 0
                last = r[0], r[4]
                rows.append(r)
                size += len(r[3])
        if rows and (made := shard(rows)) is not None:
            yield made

    made = cut(dealt.mapInArrow(run, schema), "substrings-shards")

    def merge(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        # by prefix, then window: each shard's rows came in order, and each row looks for its like among all of them
        key = np.stack([table["prefix"].to_numpy(), table["window"].to_numpy()], axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        pair = np.empty(len(key), "i8,i8")
        pair["f0"], pair["f1"] = key[:, 0], key[:, 1]
        ordered = pair[order]
        number = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        found = np.searchsorted(number, number, "right") - np.searchsorted(number, number, "left") > 1
        yield from table.take(pa.array(np.sort(order[found]))).select(["anchor", "digest", "lo", "hi"]).to_batches()

    runs = made.filter("prefix is null").select("anchor", "digest", "lo", "hi")
    across = made.filter("prefix is not null").repartitionByRange(n_parts, "prefix", "window").mapInArrow(merge, "anchor long, digest long, lo int, hi int")
    # an anchor with one context needs no array: its windows occur as often as the context does
    alone = many.filter("n = 1 and only.many").select("anchor", "only.digest", F.lit(0).alias("lo"), "only.hi")
    return runs.unionByName(across).unionByName(alone)


# ---- the operator


def _key(text: str) -> Column:
    """16 bytes that stand for a text; no two texts of a corpus share them."""
    return F.unhex(F.md5(text))


def repeats(docs: DataFrame, length: int = 200, shard_bytes: int = 1 << 20, crowd: int = 2000) -> DataFrame:
    """``key, ranges``: by hash of the text, the byte ranges (``a``, ``b`` exclusive; they may overlap) to remove."""
    import pyarrow as pa

    spark = docs.sparkSession
    texts = docs.filter(F.octet_length("text") >= length).select(_key("text").alias("key"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("id"), "text")
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max(F.octet_length("text")).alias("size")).filter("n > 1")
    copies = cut(copies, "substrings-copies")

    def scan(batches, make, names):
        seen = set()
        for batch in batches:
            out = []
            for key, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key not in seen:  # copies within a task
                    seen.add(key)
                    out += make(key, id_, text.encode())
                    if len(seen) > 1_000_000:
                        seen.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if isinstance(c[0], np.ndarray) else pa.array([x for part in c for x in part]) for c in zip(*out)], names=names)

    def occurrence(key: bytes, first: np.ndarray) -> np.ndarray:
        return _mixed((first.astype(np.uint64) * _ODD[5]) ^ np.uint64(int.from_bytes(key[:8], "little"))).view(np.int64)

    def count(batches):
        def make(key, id_, data):
            code, first, _ = anchors(data, length)
            return [(code.view(np.int64), occurrence(key, first))]

        yield from scan(batches, make, ["anchor", "occurrence"])

    # an anchor's occurrences differ if the least and the largest do
    seen = texts.mapInArrow(count, "anchor long, occurrence long").groupBy("anchor").agg(F.min("occurrence").alias("a"), F.max("occurrence").alias("b"))
    common = cut(seen.filter("a <> b").select("anchor"), "substrings-anchors")
    anchor_map = spark.sparkContext.broadcast(bit_map(common, "anchor"))
    # of a text's copies, the one with the least id speaks for all
    # (a merge join at every size: a table of copies grows with the corpus)
    chosen = texts.join(copies.select("key", F.col("id").alias("least")).hint("merge"), "key", "left").filter("least is null or id = least")

    def cover(batches):
        from xxhash import xxh3_64_intdigest

        sent = set()

        def make(key, id_, data):
            code, first, last = anchors(data, length)
            own = np.flatnonzero(in_map(anchor_map.value, code))
            if not len(own):
                return []
            code, first, last = code[own].view(np.int64), first[own], last[own]
            digests, contexts = [], []
            for anchor, a, b in zip(code.tolist(), first.tolist(), last.tolist()):
                context = data[a : b + length]
                digest = xxh3_64_intdigest(context, anchor & 0x7FFFFFFF) >> 1
                new = (anchor, digest) not in sent
                if new:
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add((anchor, digest))
                digests.append(digest)
                contexts.append(context if new else None)
            return [(code, np.array(digests, np.int64), [key] * len(own), first, occurrence(key, first), contexts)]

        yield from scan(batches, make, ["anchor", "digest", "key", "first", "occurrence", "context"])

    schema = "anchor long, digest long, key binary, first long, occurrence long, context binary"
    places = cut(chosen.select("key", "id", "text").mapInArrow(cover, schema), "substrings-contexts")
    contexts = places.groupBy("anchor", "digest").agg((F.min("occurrence") != F.max("occurrence")).alias("many"), F.max("context").alias("context"))
    contexts = cut(contexts.join(common, "anchor", "left_semi"), "substrings-distinct")
    spans = spans_of(contexts, length, shard_bytes, crowd)
    met = places.select("anchor", "digest", "key", "first").join(spans, ["anchor", "digest"])
    ranges = met.groupBy("key").agg(F.collect_set(F.struct((F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + length).alias("b"))).alias("ranges"))
    whole = copies.select("key", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))).alias("ranges"))
    return ranges.join(copies, "key", "left_anti").unionByName(whole)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, ranges that touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row for each document."""
    import pyarrow as pa

    found = repeats(docs, length, **options)
    rows = docs.select("doc_id", _key("text").alias("key"), "text").join(found, "key", "left").select("doc_id", "ranges", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches):
        for batch in batches:
            made = []
            for ranges, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                runs = merged([(r["a"], r["b"]) for r in ranges or []])
                sha, at = hashlib.sha256(), 0
                for a, b in runs:
                    sha.update(data[at:a])
                    at = b
                sha.update(data[at:])
                made.append((len(data), sum(b - a for a, b in runs), len(runs), sha.hexdigest()))
            columns = list(zip(*made)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, schema)
