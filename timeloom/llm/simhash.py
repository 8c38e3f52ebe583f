"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, and connected components.

Fingerprints within ``distance`` bits agree on all but ``distance`` of ``distance + 3`` blocks, so they share at least
one choice of 3 blocks. Distinct fingerprints are joined on each choice of 3 blocks and verified by Hamming distance.
Where one such key holds more than ``large`` distinct fingerprints, its members are linked through the words within
one bit of each instead (two fingerprints within 2 bits share such a word), which is linear in the group and as exact.
Components of the links are found by alternating star contractions, written to the shared folder after each round.

``one_of_each`` drops near copies for a pipeline. A similarity of 0.8 puts 64-bit fingerprints some 12 bits apart, which no
choice of blocks finds in a large corpus, so there candidates are texts that share a sampled shingle of five words; the
Hamming distance thins them, and the share of words in common shingles, counted on the texts, decides. No group is cut: what
is left apart in a large one meets in its other shingles or is compared in blocks.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated rows and null ids
give a row each, and a component of null ids has a null id; an empty table gives an empty result; other columns are
ignored; texts of any length are hashed whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeloom.llm._shared import cut, discard, groups, map_texts, run_key, text_key, tokens

#: The seed of the shingle hash, and the white space that parts words.
SEED = 42
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\v\f\r" else b for b in range(256))


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half the hashes of its shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_TABLE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: str, shingle: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""

    def make(texts):
        return [[fingerprint(t or "", shingle) for t in texts.to_pylist()]]

    return map_texts(docs, list(keep), make, "fp long")


def blocks(distance: int) -> list[int]:
    """Masks of all choices of 3 blocks out of ``distance + 3``."""
    n = distance + 3
    bounds = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in combinations(masks, 3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame, distance: int = 2, large: int = 48) -> DataFrame:
    """Pairs ``a, b`` that connect exactly the distinct ``fp`` within ``distance`` bits.

    In small groups a pair is two fingerprints; in large ones (``distance`` 2 or less) it is a fingerprint and the least
    one that shares a word within one bit, hence within 2 bits of it.
    """
    masks = blocks(distance)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.part", "k.key")
    sizes = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = cut(keyed.join(sizes, ["part", "key"]), "simhash-blocks")
    few = met.filter(F.col("n") <= large) if distance <= 2 else met
    a, b = few.select("part", "key", F.col("fp").alias("a")), few.select("part", "key", F.col("fp").alias("b"))
    pairs = a.join(b, ["part", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    if distance > 2:
        return pairs.distinct()
    ones = [_signed(1 << i) for i in range(64)]
    many = met.filter(F.col("n") > large).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *map(F.lit, ones)] if distance == 2 else None
    if distance == 2:
        near = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("word"))
        least = near.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("word", "a")
        far = near.join(least, "word").filter("a < fp").select("a", F.col("fp").alias("b"))
    else:
        near = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in ones])).alias("word"))
        far = near.join(many.select(F.col("fp").alias("word")), "word").filter("fp < word").select(F.col("fp").alias("a"), F.col("word").alias("b"))
    return pairs.unionByName(far).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``); the root is the least node of the component.

    Large-star and small-star in turn: each node hands its larger neighbours, then its smaller ones and itself, to its
    least neighbour, until nothing changes. Each round is written, so a lost executor repeats one round at most. A hub
    is no single task's work: its least neighbour is a partial aggregate, joined back to its edges.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = cut(df.filter("a <> b").distinct(), "components")
        return df, tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first())

    edges, state = written(edges.select("a", "b"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        before, last = edges, state
        edges, state = written(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        discard(before)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")))


def classes(docs: DataFrame, distance: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id, class_id``: the least doc_id and a fingerprint that stand for the component."""
    made = cut(fingerprints(docs, "doc_id", shingle=shingle), "simhash")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, distance))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class_id", F.coalesce("root", "fp"))
    named = joined.groupBy("class_id").agg(F.min("least").alias("component_id"))
    by_fp = joined.select("fp", "class_id").join(named, "class_id")
    return made.join(by_fp, "fp").select("doc_id", "fp", "component_id", "class_id")


def components_of(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row for each document."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (of the whole sequence if it is shorter) from hashes of words."""
    made = hashes
    for _ in range(min(size, len(hashes)) - 1):
        made = run_key(made[:-1], made[1:])
    return made


def sampled(made: np.ndarray, least: int = 16) -> tuple[np.ndarray, int]:
    """Distinct shingles whose hash ends in as many zero bits as leave ``least`` to twice as many of the text's, and how many bits.

    Texts of another size class keep a part of the same ones, so that near copies meet in many shingles however long they are.
    """
    made = np.unique(made)
    bits = max(0, int(len(made) / least).bit_length() - 1)
    return made[made & np.uint64((1 << bits) - 1) == 0], bits


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, th`` (the text's key), ``fp`` (the fingerprint of its shingles), ``keys`` (its sampled shingles, sorted) and ``bits``, how sparse they are."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    full = StructType([docs.schema["doc_id"], *StructType.fromDDL("th binary, fp long, keys array<long>, bits int").fields])

    def run(batches):
        for batch in batches:
            for at, texts in groups(batch.column(2)):
                hashes, ends = tokens(texts)
                fps, keys, sparse, start = [], [], [], 0
                for end in np.flatnonzero(ends).tolist():
                    made, start = shingles(hashes[start:end], size), end + 1
                    votes = np.zeros(64, np.int64)
                    for k in range(0, len(made), 1 << 16):
                        votes += np.unpackbits(made[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    fps.append(int.from_bytes(np.packbits(votes * 2 > len(made)).tobytes(), "little", signed=True))
                    # texts without words meet under a key of their own
                    own, bits = sampled(made) if len(made) else (np.zeros(1, np.uint64), 0)
                    keys.append(own.view(np.int64))
                    sparse.append(bits)
                part = batch.slice(at, len(texts))
                cuts = np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(keys))), pa.array(sparse, pa.int32())], names=["doc_id", "th", "fp", "keys", "bits"])

    return docs.select("doc_id", text_key().alias("th"), "text").mapInArrow(run, full)


def bands(width: int) -> Column:
    """Keys of a text: hashes of ``width`` sampled shingles in a row, by hash, and of those of them that a text twice as long would have sampled.

    Near copies share most samples, so they share runs of them; texts that only quote the same passage do not.
    """
    if width == 1:
        return F.col("keys")
    runs = lambda a: F.when(F.size(a) > width, F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: F.xxhash64(F.slice(a, i + 1, F.lit(width))))).otherwise(F.array(F.xxhash64(a)))
    sparser = F.expr("filter(keys, k -> (k & shiftleft(1L, bits)) = 0)")
    return F.array_distinct(F.concat(runs(F.col("keys")), F.when(F.size(sparser) > 0, runs(sparser)).otherwise(F.array().cast("array<long>"))))


def laid_out(text: str | None, size: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the hashes of its shingles in order."""
    words = tokens([text])[0][:-1]
    return len(words), shingles(words, size)


def share(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], size: int) -> float:
    """The share of the words of two laid out texts that lie in shingles which both have; 1 if neither has a word."""
    total = 0
    for (n, own), (_, other) in ((a, b), (b, a)):
        edge = np.zeros(len(own) + size, np.int64)
        hit = np.isin(own, other)
        width = min(size, n)
        edge[: len(own)] += hit
        edge[width : width + len(own)] -= hit
        total += int((np.cumsum(edge) > 0).sum())
    return total / (a[0] + b[0]) if a[0] or b[0] else 1.0


def common_share(a: str | None, b: str | None, size: int) -> float:
    """The share of the words of both texts that lie in shingles which both have; 1 if neither has a word."""
    return share(laid_out(a, size), laid_out(b, size), size)


def placed_shingles(texts: DataFrame, size: int) -> DataFrame:
    """``th, words, key, at``: each distinct shingle of each text (``th, text``) with its places, and how many words the text has."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, made = laid_out(text, size)
                if not len(made):
                    continue
                order = np.argsort(made, kind="stable").astype(np.int32)
                made = made[order]
                first = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]]))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(made)).astype(np.int32)), pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.array([th] * len(first), pa.binary()), pa.array(np.full(len(first), words, np.int32)), pa.array(made[first].view(np.int64)), places], names=["th", "words", "key", "at"])

    return texts.mapInArrow(run, "th binary, words int, key long, at array<int>")


def crowd_pairs(docs: DataFrame, crowd: DataFrame, roots: DataFrame, size: int, similarity: float, distance: int, large: int) -> DataFrame:
    """Pairs ``a, b`` of texts with one sampled shingle (``key, th, fp``) that may be near copies, within ``distance`` bits, but those that ``roots`` connects.

    A pair that has a shingle of at most ``large`` texts meets in it, now that all shingles count. Any other pair shares frequent shingles alone, so
    it is near only if the words that those cover in either text reach ``similarity`` together: texts that only quote a passage go, all others are compared.
    """
    who = crowd.select("th", "fp").distinct().join(roots.withColumnRenamed("node", "th"), "th", "left").select("th", "fp", F.xxhash64(F.coalesce("root", "th")).alias("root"))
    texts = docs.select(text_key().alias("th"), "text").join(who.select("th"), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    placed = cut(placed_shingles(texts, size).join(who, "th"), "simhash-placed")
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 1 AND low <> high")
    met = cut(placed.join(sizes.select("key", "n"), "key"), "simhash-met")
    few = met.filter(F.col("n") <= large)
    a, b = (few.select("key", F.col("th").alias(x), F.col("fp").alias(f"f{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    rare = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near).select("a", "b").distinct()
    # words under frequent shingles: from each place to the next, but no more than a shingle has
    spots = met.filter(F.col("n") > large).select("th", "words", "fp", "root", F.explode("at").alias("p"))
    reach = F.least(F.lit(size), F.col("words"), F.coalesce(F.lead("p").over(Window.partitionBy("th").orderBy("p")) - F.col("p"), F.lit(size)))
    spare = spots.withColumn("_reach", reach).groupBy("th", "words", "root").agg(F.sum("_reach").alias("_under")).select("th", "root", (F.col("_under") - similarity * F.col("words")).alias("spare"))
    rows = crowd.select("key", "th", "fp").join(spare, "th")
    most = rows.groupBy("key").agg(F.max("spare").alias("_most"))
    rows = rows.join(most, "key").filter("spare + _most >= -1e-6").drop("_most")
    made = cut(rare.unionByName(blockwise(rows, distance)).distinct(), "simhash-rest")
    discard(placed, met)
    return made


def blockwise(rows: DataFrame, distance: int, block: int = 2048) -> DataFrame:
    """Pairs ``a, b`` of a group (``key, th, fp, root, spare``) within ``distance`` bits, of unlike ``root``, whose ``spare`` words are not below zero together.

    All pairs of a group are compared, so work is quadratic in it: members are dealt into blocks, each two blocks are a cell, and
    cells are spread over tasks, which hold one at a time. No row is a pair before it is compared.
    """
    import pyarrow as pa

    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low <> _high").select("key", "n")
    parts = F.expr(f"(n - 1) div {block} + 1")
    dealt = rows.join(sizes, "key").withColumns({"own": F.pmod(F.xxhash64("th"), parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "th", "fp", "root", F.col("spare").cast("double").alias("spare"))

    def pairs_of(side, other, same):
        names, fps, roots, spare = zip(*side)
        names_b, fps_b, roots_b, spare_b = (names, fps, roots, spare) if same else zip(*other)
        fps_b, roots_b, spare_b = np.array(fps_b, np.int64).view(np.uint64), np.array(roots_b), np.array(spare_b)
        for at in range(0, len(names), 256):
            own, root, left = np.array(fps[at : at + 256], np.int64).view(np.uint64), np.array(roots[at : at + 256]), np.array(spare[at : at + 256])
            hit = (np.bitwise_count(own[:, None] ^ fps_b[None]) <= distance) & (root[:, None] != roots_b[None]) & (left[:, None] + spare_b[None] >= -1e-6)
            x, y = np.nonzero(np.triu(hit, at + 1) if same else hit)
            made = [(names[at + p], names_b[q]) for p, q in zip(x.tolist(), y.tolist())]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array([min(m) for m in made], pa.binary()), pa.array([max(m) for m in made], pa.binary())], names=["a", "b"])

    def run(batches):
        each = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        for (_, i, j), own in groupby(each, key=lambda r: r[:3]):
            sides = {i: [], j: []}
            for r in own:
                sides[r[3]].append(r[4:])
            if sides[i] and sides[j]:
                yield from pairs_of(sides[i], sides[j], i == j)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary")


def verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: float, block: int = 256) -> DataFrame:
    """The pairs of keys of texts of which ``similarity`` of the words lie in common shingles.

    Keys are dealt into blocks, and a cell of two blocks gets each text that its pairs name once, so that a text in many pairs isn't sent with each.
    """
    import pyarrow as pa

    sides = pairs.select(F.col("a").alias("th")).unionByName(pairs.select(F.col("b").alias("th"))).distinct()
    texts = cut(docs.select(text_key().alias("th"), "text").join(sides, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text")), "simhash-texts")
    parts = F.lit(texts.count() // block + 1)
    none = F.lit(None)
    dealt = pairs.select(F.pmod(F.xxhash64("a"), parts).alias("i"), F.pmod(F.xxhash64("b"), parts).alias("j"), "a", "b")
    needed = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("th")).distinct().join(texts, "th")
    # a cell's texts come before its pairs
    rows = needed.select("i", "j", F.lit(0).alias("turn"), F.col("th").alias("a"), none.cast("binary").alias("b"), "text").unionByName(dealt.select("i", "j", F.lit(1).alias("turn"), "a", "b", none.cast("string").alias("text")))

    def run(batches):
        cell, known = None, {}
        for batch in batches:
            left, right = [], []
            for i, j, turn, a, b, text in zip(*[c.to_pylist() for c in batch.columns]):
                if (i, j) != cell:
                    cell, known = (i, j), {}
                if not turn:
                    known[a] = laid_out(text, size)
                elif share(known[a], known[b], size) >= similarity:
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    made = cut(rows.repartition("i", "j").sortWithinPartitions("i", "j", "turn").mapInArrow(run, "a binary, b binary"), "simhash-links")
    discard(texts)
    return made


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, distance: int = 24, large: int = 32) -> tuple[DataFrame, DataFrame]:
    """``made`` (``doc_id, th``) and links ``a, b`` between keys of texts that are near copies; they connect all such pairs within
    ``distance`` bits that share a sampled shingle.

    Two texts are near copies if ``similarity`` of their words lie in shingles of ``size`` words that both have. All pairs are
    compared in groups of up to ``large`` texts with one sampled shingle. In larger groups each text is compared with the least, in
    linear work, and the members go on to groups of 2, 4 and 8 sampled shingles in a row, so that a crowd that shares a passage falls apart
    into those who share most. What these links leave apart in a larger group is then compared (``crowd_pairs``): nothing is left out for a group's size.
    """
    made = cut(sketches(docs, size), "simhash-sketches")
    distinct = cut(made.groupBy("th").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "simhash-distinct")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    crowd, found, used = distinct, [], [distinct]
    for width in (1, 2, 4, 8):
        keyed = crowd.select("th", "fp", F.explode(bands(width)).alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("th", "fp")).alias("least")).filter("n > 1")
        met = cut(keyed.join(sizes, "key"), f"simhash-shingles{width}")
        used.append(met)
        few, many = met.filter(F.col("n") <= large), met.filter(F.col("n") > large)
        a, b = few.select("key", F.col("th").alias("a"), F.col("fp").alias("fa")), few.select("key", F.col("th").alias("b"), F.col("fp").alias("fb"))
        found.append(a.join(b, "key").filter("a < b").filter(close("fa", "fb")).select("a", "b"))
        found.append(many.select(F.col("least.th").alias("a"), F.col("th").alias("b"), F.col("least.fp").alias("fa"), F.col("fp").alias("fb")).filter("a <> b").filter(close("fa", "fb")).select("a", "b"))
        crowds = many if width == 1 else crowds
        if not many.take(1):
            break
        crowd = distinct.join(many.select("th").distinct(), "th", "left_semi")
    pairs = cut(reduce(DataFrame.unionByName, found).distinct(), "simhash-pairs")
    linked = verified(docs, pairs, size, similarity)
    if len(found) > 2:
        rest = crowd_pairs(docs, crowds, components(linked), size, similarity, distance, large)
        linked = linked.unionByName(verified(docs, rest, size, similarity))
        discard(rest)
    discard(*used, pairs)
    return made, linked


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document, with all its columns, of each group of near copies: that with the least doc_id (null last, then any one text).

    Defined results: null texts are copies of each other, and so are texts without words; repeated rows leave one; of null
    ids one row of a group without other ids stays; an empty table gives an empty one; extra columns may have any names.
    """
    made, linked = near_copies(docs, **options)
    roots = components(linked).withColumnRenamed("node", "th")
    # one row a text first, so that a large group is no single task's work
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("first")
    by_text = made.groupBy("th").agg(first).join(roots, "th", "left")
    stay = by_text.groupBy(F.coalesce("root", "th").alias("root")).agg(F.min("first").alias("first")).select(F.coalesce("first.doc_id", F.lit(-1)).alias("_id"), F.col("first.none").alias("_none"), F.col("first.th").alias("_th"))
    packed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("_id"), F.col("doc_id").isNull().alias("_none"), text_key().alias("_th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keys = ["_id", "_none", "_th"]
    # repeated rows share all keys; the join has already brought them together
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_th"))
    return packed.join(stay, keys).withColumn("_turn", turn).filter("_turn = 1").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
