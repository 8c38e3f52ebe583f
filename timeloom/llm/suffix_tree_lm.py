"""Language-model scores: a probabilistic suffix tree over words, beside add-one word counts.

A text's tokens are its words (A-Z lowered) and one end. The root of the tree is the add-one distribution of tokens; a
state is a context of one to ``depth`` tokens. Runs of tokens are counted level by level over all training texts; a run is
counted only if both runs of one token less in it were counted and occur twice or more, and its last token could still gain
enough: ``n * log(1 / p) >= least_gain`` of the run without its first token. A next token is kept in a context if it stands there
twice or more and its share diverges from what the shorter context gives it (``n * log(ratio) >= least_gain``), and a context
is a state if it keeps a token. A state's distribution is smoothed towards the shorter context's: what its kept tokens leave,
and ``strength`` more, goes to the shorter context. A token's probability is that of the longest state before it.

So the log probability of a text is a sum over its runs: each token adds its share at the root, each context that is a state
adds the log of what it leaves to the shorter one, and each kept run adds what it gains over that. The model is a table
of such addends by run, as large as the corpus makes it, and scoring is a join of runs with it. A bounded number of the most
frequent runs goes to every task, and a bit map of fixed size tells which runs have an addend; what is left is joined. Neither
bound changes a score.

Defined results: a null text counts as empty (one token, the end); repeated rows and null ids give a row each (a null
id is never held out nor learned from); an empty table gives an empty result; without training rows counts are 0 and
every token is as likely as an unknown one; other columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timeloom.llm._shared import bit_map, cut, discard, groups, in_map, run_key, tokens

#: Runs that a task holds before it hands them on.
HELD = 4_000_000
#: Parts in which runs are looked up, a power of two: a run belongs to that of its key's lowest bits.
PARTS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(hashes: np.ndarray, ends: np.ndarray, most: int):
    """For each length from 2 to ``most``: contexts, suffixes and keys of the runs from each token on, and which runs lie in one text."""
    keys, whole = hashes, None
    for _ in range(2, most + 1):
        context, suffix = keys[:-1], keys[1:]
        whole = ~ends[:-1] if whole is None else whole[:-1] & whole[1:]
        keys = run_key(context, suffix) if len(context) else context
        yield context, suffix, keys, whole


class Tally:
    """Counts of runs by key, with what else is known of them."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        keys, at, n = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append([keys, *(c[at] for c in columns), n])
        self.size += len(keys)

    def merge(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [[keys[first], *(c[order[first]] for c in columns[1:-1]), np.add.reduceat(columns[-1][order], first)]]
        self.size = len(first)

    def full(self) -> bool:
        """Whether it holds nearly ``HELD`` runs that differ."""
        if self.size > HELD:
            self.merge()
        return self.size > 0.7 * HELD

    def taken(self) -> list[np.ndarray]:
        """All but the keys."""
        self.merge()
        columns, self.parts, self.size = self.parts[0][1:], [], 0
        return columns


def counted(training: DataFrame, level: int, maps: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``context, suffix, n`` of the runs of ``level`` tokens that occur twice or more, at level 2 also of all single tokens (``context`` 0).

    ``maps``: bit maps of the runs that may be contexts and of those that may be suffixes. A task hands on its runs packed by part, so
    that a shuffle moves few rows; those of a part are summed where they meet.
    """
    import pyarrow as pa

    n_parts = 4 * int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = training.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        tally = Tally()

        def packed():
            context, suffix, n = tally.taken()
            part = (context * _ODD ^ suffix) * _ODD >> np.uint64(32)
            part = (part % np.uint64(n_parts)).astype(np.int32)
            # by context too, for its repeats compress well
            order = np.lexsort((suffix, context, part))
            context, suffix, n, part = context[order], suffix[order], n[order], part[order]
            cuts = np.searchsorted(part, np.arange(n_parts + 1))
            for at in range(0, n_parts, 16):
                own = [(p, slice(cuts[p], cuts[p + 1])) for p in range(at, min(at + 16, n_parts)) if cuts[p + 1] > cuts[p]]
                blobs = [context[w].tobytes() + suffix[w].tobytes() + n[w].astype(np.int64).tobytes() for _, w in own]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "runs"])

        for batch in batches:
            for _, texts in groups(batch.column(0)):
                hashes, ends = tokens(texts)
                if level == 2:
                    tally.add(hashes, np.zeros(len(hashes), np.uint64), hashes)
                *_, (context, suffix, keys, own) = runs(hashes, ends, level)
                if shared.value is not None:
                    own = np.flatnonzero(own)
                    own = own[in_map(shared.value[1], suffix[own])]
                    own = own[in_map(shared.value[0], context[own])]
                tally.add(keys[own], context[own], suffix[own])
                if tally.full():
                    yield from packed()
        if tally.size:
            yield from packed()

    def met(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(blob)
        for part in sorted(held):
            columns = [np.frombuffer(b, np.int64).reshape(3, -1) for b in held.pop(part)]
            context, suffix, n = np.concatenate(columns, axis=1)
            order = np.lexsort((suffix, context))
            context, suffix, n = context[order], suffix[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (suffix[1:] != suffix[:-1])]))
            context, suffix, n = context[first], suffix[first], np.add.reduceat(n, first)
            own = (context == 0) | (n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in (context, suffix, n)], names=["context", "suffix", "n"])

    made = training.select("text").mapInArrow(run, "part int, runs binary")
    return made.repartition(n_parts // 4, "part").mapInArrow(met, "context long, suffix long, n long")


def addends(level: DataFrame, of: DataFrame, shorter: DataFrame, strength: float, least_gain: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What a level adds to the model for its kept runs and for its states, each ``key, n, v``; its runs, ``key, n, p``, and its states, as tables.

    ``level``: ``context, suffix, n``; ``of``: ``key, n`` of the contexts; ``shorter``: ``key, p`` of the suffixes.
    """
    rows = level.join(of.select(F.col("key").alias("context"), F.col("n").alias("n_context")), "context")
    rows = rows.join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("p_short")), "suffix")
    keep = F.col("n") * F.log(F.col("n") / F.col("n_context") / F.col("p_short")) >= least_gain
    rows = cut(rows.select(F.xxhash64("context", "suffix").alias("key"), "context", "n", "p_short", keep.alias("kept"), F.when(keep, F.col("n_context")).alias("n_context")), "lm-level")
    left = F.first("n_context") - F.sum("n") + F.lit(strength)
    states = cut(rows.filter("kept").groupBy("context").agg(F.first("n_context").alias("n_state"), left.alias("left")), "lm-states")
    whole = F.col("n_state") + F.lit(strength)
    share = F.col("left") / whole * F.col("p_short")
    p = F.when(F.col("kept"), F.col("n") / whole + share).otherwise(F.coalesce(share, F.col("p_short")))
    made = cut(rows.join(states, "context", "left").select("key", "n", p.alias("p"), F.when(F.col("kept"), F.log10(p / share)).alias("v")), "lm-shares")
    fewer = states.select(F.col("context").alias("key"), F.col("n_state").alias("n"), F.log10(F.col("left") / whole).alias("v"))
    discard(rows)
    return made.filter("v IS NOT NULL").select("key", "n", "v"), fewer, made, states


def most_frequent(table: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Rows of the ``n`` that at most ``most`` rows reach, and that ``n``."""
    spectrum = table.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).toArrow().to_pandas().sort_values("n", ascending=False)
    fits = spectrum.n[spectrum.rows.cumsum() <= most]
    least = int(fits.min()) if len(fits) else 1 << 62
    return table.filter(F.col("n") >= least), least


def _held() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def _found(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in the sorted table, or its length where they aren't in it."""
    at = np.searchsorted(table, keys)
    return np.where(np.append(table, 0)[at] == keys, at, len(table)) if len(table) else np.zeros(len(keys), np.int64)


def model(docs: DataFrame, depth: int, strength: float, least_gain: float) -> tuple[DataFrame, DataFrame, int, int]:
    """``words`` (``key, n, v``) and ``grams`` (``key, n, v``) of the rows that aren't held out; how many tokens they have, and distinct ones."""
    training = docs.filter(~_held())
    first = cut(counted(training, 2), "lm-counts")
    words = first.filter("context = 0").select(F.col("suffix").alias("key"), "n")
    n_all, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    of, shorter = words, words.select("key", ((F.col("n") + 1) / F.lit(float(n_all + n_words + 1))).alias("p"))
    level, grams, used, tables = first.filter("context <> 0"), [], [first], []
    for k in range(2, depth + 2):
        gains, fewer, made, states = addends(level, of, shorter, strength, least_gain)
        tables += [made, states]
        if k == 2:  # the states of one token add to the tokens' own addends
            own = F.log10(F.col("n") + F.lit(1.0)) + F.coalesce("v", F.lit(0.0))
            words = cut(words.join(fewer.select("key", "v"), "key", "left").select("key", "n", own.alias("v")), "lm-words")
        grams += [gains] if k == 2 else [gains, fewer]
        discard(*used)
        if k <= depth:
            room = made.filter(F.col("n") * -F.log("p") >= least_gain)
            of, shorter = made.select("key", "n"), room.select("key", "p")
            level = cut(counted(training, k + 1, (bit_map(of), bit_map(room))), "lm-counts")
            level, used = level.join(shorter.select(F.col("key").alias("suffix")), "suffix", "left_semi").select("context", "suffix", "n"), [level]
    # a run may be kept in its context and be a state itself
    grams = cut(reduce(DataFrame.unionByName, grams).groupBy("key").agg(F.max("n").alias("n"), F.sum("v").alias("v")), "lm-runs")
    discard(*tables)
    return words, grams, n_all, n_words


def score(docs: DataFrame, depth: int = 2, strength: float = 1.0, least_gain: float = 20.0, head_words: int = 1 << 17, head_runs: int = 1 << 17) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    import pyarrow as pa

    spark = docs.sparkSession
    words, grams, n_all, n_words = model(docs, depth, strength, least_gain)
    (head, least_word), (often, least_run) = most_frequent(words, head_words), most_frequent(grams, head_runs)
    sent = [[t[c].to_numpy().copy() for c in ("key", "n", "v")] for t in (df.toArrow().sort_by("key") for df in (head, often))]
    shared = spark.sparkContext.broadcast((sent, bit_map(grams)))
    del sent
    full = StructType([docs.schema["doc_id"], *StructType.fromDDL("held_out boolean, row long, n_tokens long, head_known long, head_base double, head_score double").fields, *StructType.fromDDL(", ".join(f"tail_{p} array<long>" for p in range(PARTS))).fields])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        target, row = to_arrow_schema(full), TaskContext.get().partitionId() << 40
        ((word_keys, word_n, word_v), (gram_keys, _, gram_v)), known = shared.value
        base, word_v, gram_v = np.append(np.log10(word_n + 1.0), 0), np.append(word_v, 0), np.append(gram_v, 0)
        # words outside a head that holds all words are unknown; else the join knows
        whole = least_word == 1
        for batch in batches:
            for at, texts in groups(batch.column(2)):
                hashes, ends = tokens(texts)
                last = np.flatnonzero(ends)
                starts = np.concatenate([[0], last[:-1] + 1])
                place = _found(word_keys, hashes.view(np.int64))
                value = word_v[place]
                outside = np.flatnonzero(place == len(word_keys)) if not whole else np.zeros(0, np.int64)
                tail_at, tail = [outside], [hashes[outside].view(np.int64)]
                for _, _, keys, own in runs(hashes, ends, depth + 1):
                    own = np.flatnonzero(own)
                    own = own[in_map(known, keys[own])] if len(own) else own
                    found = _found(gram_keys, keys[own].view(np.int64))
                    value[own] += gram_v[found]
                    own = own[found == len(gram_keys)]
                    tail_at.append(own)
                    tail.append(keys[own].view(np.int64))
                tail_at, tail = np.concatenate(tail_at), np.concatenate(tail)
                order = np.argsort(tail_at, kind="stable")
                tail_at, tail = tail_at[order], tail[order]
                lists = []
                for p in range(PARTS):
                    own = tail & (PARTS - 1) == p
                    cuts = np.concatenate([np.searchsorted(tail_at[own], starts), [own.sum()]])
                    lists.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tail[own])))
                part = batch.slice(at, len(texts))
                made = [part.column(0), part.column(1), pa.array(row + np.arange(len(texts))), pa.array(last - starts + 1), pa.array(np.add.reduceat((place < len(word_keys)).astype(np.int64), starts)), pa.array(np.add.reduceat(base[place], starts)), pa.array(np.add.reduceat(value, starts)), *lists]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, target)], schema=target)

    scored = cut(docs.select("doc_id", F.coalesce(_held(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, full), "lm-scores")
    rest = words.filter(F.col("n") < least_word).unionByName(grams.filter(F.col("n") < least_run).withColumn("n", F.lit(None).cast("long")))
    # by parts of the keys, each written before the next, so that the shuffles of one part at a time are on disk
    sums = []
    for part in range(PARTS):
        met = scored.select("row", F.explode(f"tail_{part}").alias("key")).join(rest.filter(F.col("key").bitwiseAND(F.lit(PARTS - 1)) == part), "key")
        sums.append(cut(met.groupBy("row").agg(F.count("n").alias("tail_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("tail_base"), F.sum("v").alias("tail_score")), "lm-found"))
    found = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("tail_known", "tail_base", "tail_score")])
    made = scored.drop(*[f"tail_{p}" for p in range(PARTS)]).join(found, "row", "left")
    each = F.col("n_tokens") * F.lit(float(np.log10(n_all + n_words + 1)))
    base, total = F.col("head_base") + F.coalesce("tail_base", F.lit(0.0)) - each, F.col("head_score") + F.coalesce("tail_score", F.lit(0.0)) - each
    return made.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))
