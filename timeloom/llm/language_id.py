"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent passes, one from each end, label every byte position with language probabilities; a document's
probabilities are their mean over all of its positions. The network is trained in numpy by backpropagation through time
on windows of a bounded sample of labelled rows, of each language alike. Texts are read in windows of ``STEPS`` bytes, many at
a time.

Defined results: a null text and one without a letter get ``und`` with score 0; repeated rows and null ids give a row
each (a null id is never held out nor learned from); an empty table gives an empty result; without labelled rows every
language is ``und``; of equal probabilities the language first in code-point order is given; labelled rows shorter than a
window of the training are learned too; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm._shared import bounded_sample, map_texts, slice_of

STEPS = 96
HIDDEN = 12
COLUMNS = 4096


class Pass:
    """One direction: input terms by byte (256 x 3h: reset, update, candidate) and recurrent weights (3h x h)."""

    def __init__(self, inputs: np.ndarray, recurrent: np.ndarray):
        self.inputs, self.recurrent = inputs, recurrent

    def states(self, x: np.ndarray):
        """For training: per step (state before, reset, update, candidate, state after)."""
        h = self.recurrent.shape[1]
        state, out = np.zeros((h, x.shape[1]), np.float32), []
        for row in x:
            given = self.inputs[row].T
            gates = 0.5 + 0.5 * np.tanh(0.5 * (self.recurrent[: 2 * h] @ state + given[: 2 * h]))
            reset, update = gates[:h], gates[h:]
            candidate = np.tanh(self.recurrent[2 * h :] @ (reset * state) + given[2 * h :])
            after = state + update * (candidate - state)
            out.append((state, reset, update, candidate, after))
            state = after
        return out

    def gradients(self, x: np.ndarray, out: list, above: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``recurrent``, back through all steps; ``above`` is the loss's at each state."""
        h = self.recurrent.shape[1]
        later, dw, deltas = np.zeros_like(out[0][0]), np.zeros_like(self.recurrent), [None] * len(out)
        for t in range(len(out) - 1, -1, -1):
            state, reset, update, candidate, _ = out[t]
            d = above[t] + later
            d_candidate = d * update * (1 - candidate**2)
            d_mixed = self.recurrent[2 * h :].T @ d_candidate
            d_gates = np.concatenate([d_mixed * state * reset * (1 - reset), d * (candidate - state) * update * (1 - update)])
            dw[: 2 * h] += d_gates @ state.T
            dw[2 * h :] += d_candidate @ (reset * state).T
            later = d * (1 - update) + d_mixed * reset + self.recurrent[: 2 * h].T @ d_gates
            deltas[t] = np.concatenate([d_gates, d_candidate])
        flat, bytes_ = np.concatenate(deltas, axis=1), x.ravel()
        return np.stack([np.bincount(bytes_, row, 256) for row in flat], axis=1).astype(np.float32), dw


class Network:
    def __init__(self, langs: list[str], arrays: list[np.ndarray]):
        """``arrays``: inputs and recurrent weights forwards, the same backwards, output weights (langs x 2h) and bias."""
        self.langs, self.arrays = langs, arrays

    def _stepper(self, inputs: np.ndarray, recurrent: np.ndarray, columns: int):
        """A function that takes a row of bytes and moves the state on, with all scratch space reused."""
        h = recurrent.shape[1]
        # sigmoid(x) is (1 + tanh(x / 2)) / 2; its halves are folded into the weights
        inputs, gates_w, mixed_w = inputs.copy(), 0.5 * recurrent[: 2 * h], 0.5 * recurrent[2 * h :]
        inputs[:, : 2 * h] *= 0.5
        state, gates, mixed = np.zeros((h, columns), np.float32), np.empty((2 * h, columns), np.float32), np.empty((h, columns), np.float32)

        def step(row: np.ndarray) -> np.ndarray:
            given = inputs.take(row, axis=0).T
            np.matmul(gates_w, state, out=gates)
            np.add(gates, given[: 2 * h], out=gates)
            np.tanh(gates, out=gates)
            np.add(gates, 1, out=gates)
            np.multiply(gates[:h], state, out=gates[:h])
            np.matmul(mixed_w, gates[:h], out=mixed)
            np.add(mixed, given[2 * h :], out=mixed)
            np.tanh(mixed, out=mixed)
            np.subtract(mixed, state, out=mixed)
            np.multiply(mixed, gates[h:], out=mixed)
            np.multiply(mixed, 0.5, out=mixed)
            np.add(state, mixed, out=state)
            return state

        return step

    def sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of position probabilities (langs x columns) of windows ``x`` (steps x columns), of which the first ``lengths`` bytes count."""
        fi, fr, bi, br, out, bias = self.arrays
        h, half = fr.shape[1], []
        forwards, backwards = self._stepper(fi, fr, x.shape[1]), self._stepper(bi, br, x.shape[1])
        for row in x:
            half.append(out[:, :h] @ forwards(row) + bias[:, None])
        total = np.zeros((len(self.langs), x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            state = backwards(x[t])
            if lengths.min() <= t:
                state[:, lengths <= t] = 0  # the pass starts at the window's last byte
            logit = out[:, h:] @ state
            logit += half[t]
            logit -= logit.max(axis=0)
            np.exp(logit, out=logit)
            logit /= logit.sum(axis=0)
            logit *= t < lengths
            total += logit
        return total

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """Mean position probabilities (texts x langs); zeros for empty texts."""
        raw = [(t or "").encode() for t in texts]
        sizes = np.array([len(b) for b in raw], np.int64)
        counts = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(raw)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + within * STEPS
        lengths = np.minimum(STEPS, np.repeat(sizes, counts) - within * STEPS)
        flat = np.frombuffer(b"".join(raw) + bytes(STEPS), np.uint8)
        made = np.zeros((len(raw), len(self.langs)))
        for at in range(0, len(owner), COLUMNS):
            part = slice(at, at + COLUMNS)
            x = np.ascontiguousarray(flat[starts[part, None] + np.arange(STEPS)].T)
            got = self.sums(x, lengths[part])
            for k in range(len(self.langs)):
                made[:, k] += np.bincount(owner[part], got[k], len(raw))
        return made / np.maximum(1, sizes)[:, None]


def train(texts: list[str], langs: list[str], rounds: int = 260, columns: int = 256, steps: int = 48, rate: float = 0.02, seed: int = 3) -> Network:
    """Backpropagation through time over random windows; each language is drawn alike, whatever its share of the rows."""
    names = sorted(set(langs))
    rng, h, n = np.random.default_rng(seed), HIDDEN, len(names)
    arrays = []
    for _ in range(2):
        inputs = rng.normal(0, 0.3, (256, 3 * h))
        inputs[:, h : 2 * h] -= 0.5
        arrays += [inputs.astype(np.float32), rng.normal(0, 0.8 / np.sqrt(h), (3 * h, h)).astype(np.float32)]
    arrays += [rng.normal(0, 0.3, (n, 2 * h)).astype(np.float32), np.zeros((n, 1), np.float32)]
    # the texts of a language are one stream; a language of a few bytes is told over and over
    by = [np.frombuffer(b" ".join(t.encode() for t, name in zip(texts, langs) if name == x) + b" ", np.uint8) for x in names]
    by = [b if len(b) >= steps else np.resize(b, steps) for b in by]
    means, squares = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for k in range(1, rounds + 1):
        label = rng.integers(0, n, columns)
        x = np.stack([by[y][(s := rng.integers(0, len(by[y]) - steps + 1)) : s + steps] for y in label], axis=1)
        one, two = Pass(*arrays[:2]), Pass(*arrays[2:4])
        ahead, back = one.states(x), two.states(x[::-1])
        weights, truth = arrays[4], np.eye(n, dtype=np.float32)[label].T
        grads, above, behind = [np.zeros_like(weights), np.zeros((n, 1), np.float32)], [], [None] * steps
        for t in range(steps):
            both = np.concatenate([ahead[t][4], back[steps - 1 - t][4]])
            p = np.exp(weights @ both + arrays[5])
            p /= p.sum(axis=0)
            d = (p - truth) / (columns * steps)
            grads[0] += d @ both.T
            grads[1] += d.sum(axis=1, keepdims=True)
            down = weights.T @ d
            above.append(down[:h])
            behind[steps - 1 - t] = down[h:]
        grads = [*one.gradients(x, ahead, above), *two.gradients(x[::-1], back, behind), *grads]
        now = rate * min(1, k / 20) * (1 - k / (rounds + 1))
        for a, g, m, s in zip(arrays, grads, means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            a -= now * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Network(names, [np.ascontiguousarray(a) for a in (*arrays[:5], arrays[5][:, 0])])


def learned(docs: DataFrame, most_rows: int = 2000, most_chars: int = 6000, **training) -> Network | None:
    """A network trained on at most ``most_rows`` rows, equally many of each language, of each at most ``most_chars`` characters (12 MB at most, on the driver).

    Only rows with a language whose id's checksum isn't 0 modulo 5 are learned from. None if there are none.
    """
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    chosen = docs.filter((part != 0) & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", "text")
    ids = bounded_sample(chosen.select("doc_id", "lang"), "doc_id", most_rows, 23, "lang").select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang")).distinct()
    rows = chosen.join(F.broadcast(ids), (chosen["doc_id"] == F.col("_doc")) & (chosen["lang"] == F.col("_lang")), "left_semi")  # most_rows ids at most
    rows = rows.select(slice_of("text", most_chars, 23).alias("text"), "lang", F.xxhash64("doc_id", "text").alias("o"))
    rows = rows.orderBy("o", "text", "lang").limit(most_rows).collect()
    return train([r.text for r in rows], [r.lang for r in rows], **training) if rows else None


def identify(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """``doc_id`` (or the columns ``keep``), ``held_out, lang_pred, score``."""
    network = learned(docs, **options)
    shared = docs.sparkSession.sparkContext.broadcast((network.langs, network.arrays) if network else None)  # some KB

    def make(texts):
        texts = texts.to_pylist()
        if shared.value is None or not texts:
            return [["und"] * len(texts), [0.0] * len(texts)]
        made = Network(*shared.value)
        p = made.probabilities(texts)
        best = p.argmax(axis=1)
        return [[made.langs[i] for i in best], np.clip(p[np.arange(len(best)), best], 0, 1)]

    keep = keep or ["doc_id"]
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    marked = docs.select(*[c for c in keep if c != "text"], held.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"), "text")
    made = map_texts(marked, [*keep, "held_out", "_letters"], make, "lang_pred string, score double")
    und = ~F.col("_letters") | (F.col("lang_pred") == "und")
    return made.select(*keep, "held_out", F.when(und, "und").otherwise(F.col("lang_pred")).alias("lang_pred"), F.when(und, 0.0).otherwise(F.col("score")).alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.3, **options) -> DataFrame:
    """The documents, with all their columns, that have letters and a language with at least ``min_score``.

    Defined results: null, empty and letterless texts go; repeated rows and null ids stay or go by their text; without
    labelled rows nothing is known, so nothing stays; an empty table gives an empty one; extra columns may have any names.
    """
    packed = docs.select("doc_id", "lang", "text", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    made = identify(packed, ["_row"], **options)
    return made.filter((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
