"""Quality classifier on supervised subword embeddings.

Each document is the average of the learned vectors of its features (hashed words and the hashed character 3- to 5-grams
of its words, and a marker word where a word repeats a near one), put through a softmax layer. Vectors and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample of the labelled rows. As the layer is linear in the average, a feature's vector and the layer
fold into one number for scoring, so that whole texts are scored by a few array operations.

Defined results: a null or empty text has no features and gets the softmax of the biases alone; repeated rows and null
ids give a row each (a null id is never held out nor learned from); an empty table gives an empty result; without any
labelled rows every score is 0.5; an id that ``labels`` marks in both ways is not learned from; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import bounded_sample, map_texts, slice_of

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
#: A word that equals the one so many words before adds a word of its own, whose bucket is that number.
REPEATS = (1, 2, 3)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint32(0x9E3779B1)


def features(raw: np.ndarray, bounds: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(places, buckets)`` for words and for each length of n-grams; a place is a byte's index in ``raw``.

    ``raw`` may hold many texts that begin and end with a space; ``bounds`` are their places.

    Words are runs without white space; their n-grams reach over the white space before and after, so that beginnings
    and ends count as such. Letters A-Z are lowered.
    """
    code = raw.astype(np.uint32)
    code += np.uint32(32) * ((raw >= 65) & (raw <= 90))
    space = _SPACE[raw]
    code[space] = 32
    out, n = [], len(raw)
    gap = np.concatenate([[0], np.cumsum(space[1:], dtype=np.int32)])  # white space strictly inside an n-gram would join two words
    rolling = code * np.uint32(0x85EBCA6B)
    for k in range(2, max(GRAMS) + 1):
        if n < k:
            break
        rolling = rolling[: n - k + 1] * np.uint32(0x01000193) + code[k - 1 :] * np.uint32(0xC2B2AE35)
        if k in GRAMS:
            at = np.flatnonzero(gap[k - 2 : n - 1] == gap[: n - k + 1])
            out.append((at, ((rolling[at] ^ (rolling[at] >> np.uint32(15))) * _MIX) >> np.uint32(14)))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if len(starts):
        ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        powers = np.full(64, 0x01000193, np.uint32).cumprod(dtype=np.uint32)
        place = np.arange(n, dtype=np.int64)
        place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
        word = code * powers[place & 63]
        word[space] = 0
        total = np.add.reduceat(word, starts).astype(np.uint32) + (ends - starts).astype(np.uint32)
        out.append((starts, ((total ^ (total >> np.uint32(13))) * _MIX) >> np.uint32(14)))
        owner = np.searchsorted(bounds, starts, "right") if bounds is not None else np.zeros(len(starts), np.int64)
        for back in REPEATS:
            at = starts[back:][(total[back:] == total[:-back]) & (owner[back:] == owner[:-back])]
            out.append((at, np.full(len(at), back, np.uint32)))
    return out


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)


class Model:
    """``table``: what one use of a feature adds to the difference of the two logits; ``bias``: that difference alone."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def margin(self, text: str | None, chunk: int = 1 << 20) -> float:
        """One text, in pieces of about ``chunk`` bytes; the same for any ``chunk``.

        A piece starts with the last ``max(REPEATS)`` words of the one before, whose own features are left out, and pieces
        part at white space, so that no word is cut.
        """
        total, count, raw, at, before = 0.0, 0, _bytes(text), 0, 0
        spaces = np.flatnonzero(_SPACE[raw])
        while at < len(raw) - 1:
            end = int(spaces[min(len(spaces) - 1, np.searchsorted(spaces, at + chunk))])
            for places, buckets in features(raw[before : end + 1]):
                # the space at the end is the next piece's first
                own = buckets[(places >= at - before) & (places < end - before)]
                total += float(self.table[own].sum(dtype=np.float64))
                count += len(own)
            words = np.flatnonzero(_SPACE[raw[at:end]] & ~_SPACE[raw[at + 1 : end + 1]])
            if len(words) >= max(REPEATS):
                before = at + int(words[-max(REPEATS)])
            at = end
        return self.bias + total / max(1, count)

    def margins(self, texts: list[str | None], chunk: int = 1 << 18) -> np.ndarray:
        """The margins of many texts, those that fit in a chunk scored together."""
        made, batch, size = np.empty(len(texts)), [], 0
        for i, text in enumerate([*texts, None]):
            n = len(text) if text else 0
            if i == len(texts) or size + n > chunk:
                self._together([texts[j] for j in batch], batch, made)
                batch, size = [], 0
            if i < len(texts):
                if n > chunk:
                    made[i] = self.margin(text)
                else:
                    batch.append(i)
                    size += n
        return made

    def _together(self, texts: list[str | None], index: list[int], made: np.ndarray) -> None:
        if not texts:
            return
        parts = [_bytes(t) for t in texts]
        raw = np.concatenate(parts)
        bounds = np.cumsum([0] + [len(p) for p in parts])
        total, count = np.zeros(len(parts)), np.zeros(len(parts))
        for places, buckets in features(raw, bounds):
            owner = np.searchsorted(places, bounds)
            sums = np.concatenate([[0.0], np.cumsum(self.table[buckets], dtype=np.float64)])
            total += sums[owner[1:]] - sums[owner[:-1]]
            count += np.diff(owner)
        made[index] = self.bias + total / np.maximum(1, count)


def train(texts: list[str | None], labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 5) -> Model:
    """Train vectors and softmax layer together; one document is one step."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    layer[:] = rng.normal(0, 0.3, layer.shape)
    docs = []
    for text in texts:
        found = features(_bytes(text))
        ids, n = np.unique(np.concatenate([b for _, b in found]) if found else np.zeros(0, np.uint32), return_counts=True)
        docs.append((ids.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)))
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))  # both labels count alike
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            now, step = rate * (1 - step / steps), step + 1
            hidden = part @ vectors[ids]
            logit = layer @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            error = (p * min(3.0, weight[labels[i]])).astype(np.float32)
            back = layer.T @ error
            layer -= now * np.outer(error, hidden)
            bias -= now * error
            # a feature's step is scaled up by the length of the average, as each word is shared by few documents
            vectors[ids] -= np.float32(now) * np.minimum(part * 200, 1)[:, None] * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def held(modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def sample(docs: DataFrame, labels: DataFrame, most_rows: int, most_chars: int) -> list[tuple[str | None, int]]:
    """At most ``most_rows`` labelled rows, chosen by a hash of the id, of each at most ``most_chars`` characters."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("_most")).filter("label = _most").drop("_most")
    known = bounded_sample(known.filter(~held(3, 1)), "doc_id", most_rows, 11)
    rows = docs.select("doc_id", slice_of("text", most_chars, 11).alias("text")).join(known, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "text")
    return [(r.text, r.label) for r in rows.limit(most_rows).collect()]


def score(docs: DataFrame, labels: DataFrame, most_rows: int = 2400, most_chars: int = 6000, **training) -> DataFrame:
    """``doc_id, held_out, score, predicted, margin``.

    Learned from at most ``most_rows`` labelled rows that aren't held out, of each at most ``most_chars`` characters:
    a bounded sample, at most 15 MB, that fits the driver.
    """
    rows = sample(docs, labels, most_rows, most_chars)
    model = train([t for t, _ in rows], np.array([y for _, y in rows], np.int64), **training)
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # 1 MB, whatever the input

    def make(texts):
        return [Model(*shared.value).margins(texts.to_pylist())]

    made = map_texts(docs, ["doc_id"], make, "margin double")
    p = 1 / (1 + F.exp(-F.col("margin")))
    return made.select("doc_id", F.coalesce(held(3, 1), F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "margin")
