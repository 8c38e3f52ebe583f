"""Benchmark decontamination by template windows.

Words become typed placeholders where they are numbers, names (capitalised inside a sentence) or units (after a number),
so that a question with other numbers and names keeps its template. Hashed windows of the benchmark's templates are
joined with those of the documents; along each alignment of a document with an item, a slot value of the item must
always meet the same value of the document, else the alignment is no re-parameterised copy and is dropped.

A document's windows first pass a bit map of the benchmark's window hashes. The map has a fixed number of bits, so it is
safe to hand to every task; however full it gets, it only lets more rows through to the exact join.

Defined results: null and empty texts match nothing; repeated rows of the same id and text are reported once and null
ids are reported as null; an item of fewer windows than ``min_windows`` needs as many as it has; one without a window (too
short, or dense in numbers and names) is searched for word by word as a whole, however short, in pieces of a window's
width that count as its windows; items with equal templates and slots are reported as the one with the least id, items
with other slots on their own; empty tables give an empty result; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import cut, groups, text_key

#: Units that may follow a number.
UNITS = frozenset("% ° $ € £ mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec min h hr hrs day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw kwh v a ma k c f mph kmh usd eur gbp euros dollars pounds percent meters metres kilometers kilograms grams liters litres hours minutes seconds miles feet inches".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|[%°€$]|[a-zA-Z]{1,3})?")
EDGES = re.compile(r"(?m)^[^\w\n]+|[^\w\n]+$")
GAP = re.compile(r"\s")
BITS = 22
#: Windows that are hashed at once.
SLICE = 1 << 20
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)


class Words:
    """Numbers of raw words, and what is known of each: ``hash``, ``kind``, ``ends`` (a sentence) and ``plain``; forgets all between groups of texts when large."""

    FULL = 400_000

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.number, self.plain = {}, []
        self.hash, self.kind, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool)

    def ids(self, words: list[str]) -> np.ndarray:
        if new := list(set(words).difference(self.number)):
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def learn(self, new: list[str]) -> None:
        from xxhash import xxh64_intdigest

        bare = EDGES.sub("", "\n".join(new))
        bare, plain = bare.split("\n"), bare.lower().split("\n")
        kind = np.array([_UNIT if p in UNITS else _NAME if b[:1].isupper() else _LITERAL for b, p in zip(bare, plain)], np.uint8)
        kind[[i for i, w in enumerate(new) if not w.isalpha() and NUMBER.fullmatch(w.strip("()[]{}\"'.,;:!?"))]] = _NUMBER
        ends = np.array([not w[-1].isalnum() and w.rstrip("\"')]")[-1:] in (".", "!", "?", ":") for w in new])
        hashes = np.array([xxh64_intdigest(p) | 1 if p else 0 for p in plain], np.uint64)
        self.number.update(zip(new, range(len(self.plain), len(self.plain) + len(new))))
        self.plain += plain
        self.hash, self.kind, self.ends = np.concatenate([self.hash, hashes]), np.concatenate([self.kind, kind]), np.concatenate([self.ends, ends])


#: Odd multipliers of a window's places, and the hashes of the placeholders.
def _constants(width: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240501).integers(0, 1 << 63, width + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return made[:width], made[width:]


def _keys(hashes: np.ndarray, width: int) -> np.ndarray:
    places, n = _constants(width)[0], max(0, len(hashes) - width + 1)
    keys, mixed = np.zeros(n, np.uint64), hashes ^ (hashes >> np.uint64(29))
    for j in range(width):
        keys += mixed[j : j + n] * places[j]
    return keys ^ keys >> np.uint64(31)


def literal_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Keys of all runs of ``size`` words as they are; no key of a template, nor of runs of another size."""
    return _keys(hashes, size) * np.uint64(2 * size + 1) ^ np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: str):
    """The text in pieces of about a million characters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + (1 << 20)
        gap = GAP.search(text, end) if end < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Read:
    """A group of texts as one stream of words that have a letter or digit: ``ids``, ``text_of`` each word, ``start`` of each text."""

    def __init__(self, texts: list[str | None], known: Words):
        if len(known.plain) > known.FULL:
            known.forget()
        ids, ends, words = [], [], []
        for text in texts:
            for part in lines_of(text or ""):
                words += part.split()
                if len(words) > SLICE:
                    ids.append(known.ids(words))
                    words = []
            ends.append(sum(map(len, ids)) + len(words))
        ids.append(known.ids(words))
        flat = np.concatenate(ids)
        text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff([0, *ends]))
        worded = known.hash[flat] != 0
        self.known, self.ids, self.text_of = known, flat[worded], text_of[worded]
        self.start = np.searchsorted(self.text_of, np.arange(len(texts)))
        kinds, first = known.kind[self.ids], np.zeros(len(self.ids), bool)
        first[self.start[self.start < len(first)]] = True
        after, previous = first.copy(), kinds.copy()
        after[1:] |= known.ends[self.ids[:-1]]
        previous[1:] = kinds[:-1]
        previous[first] = _LITERAL
        self.slot = np.where(kinds == _NUMBER, _NUMBER, np.where((kinds == _NAME) & ~after, _NAME, np.where((kinds == _UNIT) & (previous == _NUMBER), _UNIT, _LITERAL))).astype(np.uint8)

    def windows(self, width: int, literals: int, sizes: tuple[int, ...] = ()):
        """Keys and first words of windows with ``literals`` literal words, and of all runs of each of ``sizes`` words; and whether they are templates. In bounded pieces."""
        pads = _constants(width)[1]
        for least, template in [(width, True), *((k, False) for k in sizes)]:
            for at in range(0, len(self.ids) - least + 1, SLICE):
                part = slice(at, min(len(self.ids), at + SLICE + least - 1))
                hashes, owner = self.known.hash[self.ids[part]], self.text_of[part]
                whole = owner[: len(owner) - least + 1] == owner[least - 1 :]
                if template:
                    slot = self.slot[part]
                    run = np.concatenate([[0], np.cumsum(slot == 0)])
                    whole &= run[width:] - run[:-width] >= literals
                    hashes = np.where(slot > 0, pads[slot], hashes)
                    keys = _keys(hashes, width)
                else:
                    keys = literal_keys(hashes, least)
                own = np.flatnonzero(whole)
                yield keys[own], own + at, template

    def slots(self, at: int, width: int) -> list[str]:
        """The words of the window's slots."""
        return [self.known.plain[self.ids[j]] for j in range(at, at + width) if self.slot[j]]


def template_windows(df: DataFrame, keep: list[str], width: int, literals: int, bitmap: np.ndarray | None = None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """``keep`` columns, ``place``, ``key`` and ``slots`` of the windows of ``text``; with a bit map only those it holds; runs of ``sizes`` words have no slots.

    The texts of a batch are read together, so that array operations are few; each group of them is of bounded size.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    full = StructType([df.schema[c] for c in keep] + StructType.fromDDL("place long, key long, slots array<string>").fields)
    shared = df.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        known, target = Words(), to_arrow_schema(full)
        for batch in batches:
            for row, texts in groups(batch.column(len(keep))):
                read = Read(texts, known)
                for keys, at, template in read.windows(width, literals, sizes):
                    if shared is not None:
                        low = keys & np.uint64((1 << BITS) - 1)
                        own = np.flatnonzero(shared.value[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                        keys, at = keys[own], at[own]
                    if not len(keys):
                        continue
                    owner = read.text_of[at]
                    index = pa.array(owner.astype(np.int64) + row)
                    made = [batch.column(i).take(index) for i in range(len(keep))]
                    slots = [read.slots(i, width) if template else [] for i in at.tolist()]
                    made += [pa.array(at - read.start[owner]), pa.array(keys.view(np.int64)), pa.array(slots, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, target)], schema=target)

    return df.select(*keep, "text").mapInArrow(run, full)


def whole_items(benchmark: DataFrame, width: int) -> DataFrame:
    """``item_id, item_windows, place, key, size``: each item in literal pieces of ``width`` words, the last ending with the item; or in one shorter piece."""
    import pyarrow as pa

    def run(batches):
        known = Words()
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                read = Read([text], known)
                hashes = known.hash[read.ids]
                size = min(width, len(hashes))
                if size:
                    places = [*range(0, len(hashes) - size, size), len(hashes) - size]
                    keys = literal_keys(hashes, size).view(np.int64)
                    out += [(item, len(places), p, int(keys[p]), size) for p in places]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item_id", "item_windows", "place", "key", "size"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, item_windows long, place long, key long, size long")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, min_windows: int = 3) -> DataFrame:
    """Documents that hold ``min_windows`` (or all, if it has fewer) consistently matching windows of an item.

    ``doc_id, th`` (the text's key), ``item_id, n_windows, item_windows, share, same_values`` (no slot differs),
    ``first_word`` (place among the words that have a letter or digit).
    """
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = cut(template_windows(benchmark, ["item_id"], width, literals), "decontamination-windows")
    # equal templates with equal slots are one item: the rows of an item are few, so its template is a short list
    whole = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"), F.xxhash64(F.sort_array(F.collect_list(F.struct("place", "key", "slots")))).alias("template"))
    named = whole.groupBy("template", "item_windows").agg(F.min("item_id").alias("item_id"))
    short = whole_items(benchmark.join(whole, "item_id", "left_anti"), width)
    items = items.join(whole, "item_id").join(named.select("item_id"), "item_id", "left_semi").select("key", "item_id", "item_windows", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), F.lit(False).alias("literal"))
    items = items.unionByName(short.select("key", "item_id", "item_windows", F.col("place").alias("item_place"), F.array().cast("array<string>").alias("item_slots"), F.lit(True).alias("literal")))
    items = cut(items, "decontamination-items")
    sizes = tuple(sorted(r["size"] for r in short.select("size").distinct().collect()))  # at most width
    low = items.select(F.col("key").bitwiseAND(F.lit((1 << BITS) - 1)).alias("low")).distinct().toPandas()["low"].to_numpy(np.int64)
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, low >> 3, (1 << (low & 7)).astype(np.uint8))
    found = template_windows(docs.select("doc_id", text_key().alias("th"), "text"), ["doc_id", "th"], width, literals, bitmap, sizes)
    # repeated rows of one id and text must not count twice
    met = found.join(items, "key").dropDuplicates(["doc_id", "th", "item_id", "place", "item_place"])
    pair = F.flatten(F.collect_list(F.arrays_zip("item_slots", "slots")))
    along = met.groupBy("doc_id", "th", "item_id", "item_windows", "literal", (F.col("place") - F.col("item_place")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.array_distinct(pair).alias("pairs"))
    steady = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item_slots"])))
    # an item without windows must be there as a whole
    along = along.filter(steady & (~F.col("literal") | (F.col("n") == F.col("item_windows")))).withColumn("same", F.forall("pairs", lambda p: p["item_slots"].eqNullSafe(p["slots"])))
    made = along.groupBy("doc_id", "th", "item_id", "item_windows", "literal").agg(F.sum("n").alias("n_windows"), F.min("first").alias("first_word"), F.min("same").alias("same_values"))
    share = F.least(F.lit(1.0), F.col("n_windows") / F.col("item_windows"))
    made = made.filter(F.col("n_windows") >= F.least(F.lit(min_windows), F.col("item_windows")))
    return made.select("doc_id", "th", "item_id", "n_windows", "item_windows", share.alias("share"), "same_values", "first_word")


def pairs(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, share, same_values, first_word``: one row for each such pair."""
    return contaminated(docs, benchmark, **options).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    Defined results: null and empty texts stay; repeated rows and null ids stay or go by their text; an empty benchmark
    leaves all; an empty table gives an empty one; extra columns may have any names.
    """
    bad = contaminated(docs, benchmark, **options).select("th").distinct()
    packed = docs.select(text_key().alias("th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return packed.join(bad, "th", "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
