"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads each run of letters in both directions, starting anew at every run, and gives each byte
the probabilities of the languages; a document's are the normalised geometric mean over its bytes.  As a run's
result does not depend on its surroundings, a task keeps the results of the runs it has met.

Training is plain numpy: backpropagation through time with Adam over the most frequent runs of a
bounded sample of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivemill.llm import tokens
from archivemill.llm.tokens import Texts

#: Bounds of the sample: languages (the most frequent), documents and runs of letters of each.
LANGUAGES = 200
SAMPLE_DOCS = 300
SAMPLE_RUNS = 4000
#: Units of each direction, and bytes after which a long run of letters starts anew.
HIDDEN = 16
LONGEST = 32
STEPS = 900
BATCH = 256
RATE = 0.02
#: Runs that a task keeps, and runs put through the network at once.
KEPT_RUNS = 400_000
AT_ONCE = 8192

UNKNOWN = "und"

#: Bytes of letters: ASCII letters and everything beyond ASCII.
LETTERS = tokens.table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One direction's unit: update, reset and candidate side by side in ``inputs`` (by byte), ``states`` and ``bias``."""

    def __init__(self, hidden: int, pick: np.random.Generator, kind=np.float32):
        self.hidden = hidden
        self.inputs = (pick.normal(size=(256, 3 * hidden)) * 0.5).astype(kind)
        self.states = (pick.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(kind)
        self.bias = np.zeros(3 * hidden, kind)

    def weights(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.bias]

    def run(self, data: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States at each place of runs of one length: (places, runs, hidden)."""
        n, h = self.hidden, np.zeros((len(data), self.hidden), self.states.dtype)
        table = self.inputs + self.bias
        out = np.empty((data.shape[1], len(data), n), self.states.dtype)
        for t in range(data.shape[1]):
            x, own = table[data[:, t]], h @ self.states
            gates = _sigmoid(x[:, : 2 * n] + own[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(x[:, 2 * n :] + r * own[:, 2 * n :])
            if trace is not None:
                trace.append((h, z, r, new, own[:, 2 * n :]))
            h = new + z * (h - new)
            out[t] = h
        return out

    def back(self, data: np.ndarray, trace: list, slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weights, given those of the states."""
        n, later = self.hidden, np.zeros_like(slope[0])
        states, xs = np.zeros_like(self.states), np.empty((len(trace), len(data), 3 * n), slope.dtype)
        for t in range(len(trace) - 1, -1, -1):
            h, z, r, new, own = trace[t]
            d = slope[t] + later
            dn = d * (1 - z) * (1 - new**2)
            dz = d * (h - new) * z * (1 - z)
            dr = dn * own * r * (1 - r)
            xs[t] = np.concatenate([dz, dr, dn], axis=1)
            gate = np.concatenate([dz, dr, dn * r], axis=1)
            states += h.T @ gate
            later = d * z + gate @ self.states.T
        flat = xs.reshape(-1, 3 * n)
        hot = np.zeros((len(flat), 256), flat.dtype)
        hot[np.arange(len(flat)), data.T.ravel()] = 1
        return [hot.T @ flat, states, flat.sum(axis=0)]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1, kind=np.float32):
        pick = np.random.default_rng(seed)
        self.languages = languages
        self.there, self.back = Direction(hidden, pick, kind), Direction(hidden, pick, kind)
        self.out = (pick.normal(size=(2 * hidden, len(languages))) / np.sqrt(2 * hidden)).astype(kind)
        self.prior = np.zeros(len(languages), kind)

    def weights(self) -> list[np.ndarray]:
        return [*self.there.weights(), *self.back.weights(), self.out, self.prior]

    def logs(self, data: np.ndarray, traces: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States of both directions, and log probabilities, of each place of runs of one length."""
        first, second = traces or (None, None)
        there, back = self.there.run(data, first), self.back.run(data[:, ::-1], second)[::-1]
        states = np.concatenate([there, back], axis=2)
        scores = states @ self.out + self.prior
        scores -= scores.max(axis=2, keepdims=True)
        return states, scores - np.log(np.exp(scores).sum(axis=2, keepdims=True))

    def slopes(self, data: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The loss, weighted cross-entropy over all places, and its gradients."""
        traces: tuple[list, list] = ([], [])
        states, logs = self.logs(data, traces)
        rows = np.arange(len(data))
        loss = -float((logs[:, rows, label] * weight).sum())
        d = np.exp(logs)
        d[:, rows, label] -= 1
        d *= weight[None, :, None]
        out = np.einsum("tbh,tbk->hk", states, d, optimize=True)
        into, n = d @ self.out.T, self.there.hidden
        there = self.there.back(data, traces[0], into[:, :, :n])
        back = self.back.back(data[:, ::-1], traces[1], into[::-1, :, n:])
        return loss, [*there, *back, out, d.sum(axis=(0, 1))]


def fit(runs: list[bytes], label: np.ndarray, weight: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1) -> Network:
    """A network for runs of letters, each of a language (by number) and with a weight."""
    network, pick = Network(languages, seed=seed), np.random.default_rng(seed)
    sizes = np.array([len(r) for r in runs])
    groups = []
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        data = np.frombuffer(b"".join(runs[i] for i in own), np.uint8).reshape(-1, size)
        groups.append((data, label[own], weight[own]))
    if not groups or len(languages) < 2:
        return network
    share = np.array([w.sum() * data.shape[1] for data, _, w in groups])
    mean = [np.zeros_like(w) for w in network.weights()]
    square = [np.zeros_like(w) for w in network.weights()]
    for step in range(1, steps + 1):
        data, own, weights = groups[pick.choice(len(groups), p=share / share.sum())]
        rows = pick.choice(len(data), BATCH, p=weights / weights.sum())
        _, slopes = network.slopes(data[rows], own[rows], np.full(BATCH, 1 / (BATCH * data.shape[1]), network.out.dtype))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, m, s, slope in zip(network.weights(), mean, square, slopes, strict=True):
            m += 0.1 * (slope - m)
            s += 0.01 * (slope**2 - s)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return network


def held_out(key: Column) -> Column:
    """Rows that no language is learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    most_docs: int = SAMPLE_DOCS, most_runs: int = SAMPLE_RUNS, most_languages: int = LANGUAGES,
) -> Network:
    """Fit the network to a bounded sample of the rows with a key, text and language, less those held out.

    The sample: of the ``most_languages`` most frequent languages the ``most_docs`` keys with the smallest
    hash each, and of their whole texts the ``most_runs`` most frequent runs of letters.  A run weighs the root of its count.
    """
    usable = docs.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    usable = usable.where(F.col("_key").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_key")))
    counts = usable.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(most_languages).collect()
    languages = sorted(r["_lang"] for r in counts)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key")
    chosen = (
        usable.where(F.col("_lang").isin(languages)).select("_lang", "_key").withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= most_docs).select("_lang", "_key").distinct()
    )
    sample = usable.join(F.broadcast(chosen), ["_lang", "_key"])  # languages x most_docs rows
    lower = F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = sample.select("_lang", F.explode(F.split(lower, r"[^a-z\x{80}-\x{10FFFF}]+")).alias("run")).where(F.col("run") != "")
    runs = runs.groupBy("_lang", F.substring("run", 1, LONGEST).alias("run")).count()
    first = Window.partitionBy("_lang").orderBy(F.col("count").desc(), "run")
    kept = runs.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most_runs).orderBy("_lang", "run").collect()
    data = [r["run"].encode()[:LONGEST] for r in kept]
    label = np.array([languages.index(r["_lang"]) for r in kept], np.int64)
    weight = np.sqrt(np.array([r["count"] for r in kept], np.float64))
    totals = np.bincount(label, weights=weight, minlength=len(languages))
    return fit(data, label, weight / totals[label] if len(kept) else weight, languages)


@dataclass
class Runs:
    """Runs of letters of some texts: their text, place and hash."""

    owner: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def runs_of(texts: Texts) -> tuple[Runs, np.ndarray]:
    """The runs, none over ``LONGEST`` bytes, and the lower-cased bytes."""
    data = _LOWER[texts.data]
    starts, ends = texts.spans(LETTERS)
    pieces = -(-(ends - starts) // LONGEST)
    which = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[which] + place * LONGEST
    end = np.minimum(begin + LONGEST, ends[which])
    return Runs(texts.owner(begin), begin, end, texts.hashes(begin, end, data)), data


class Reader:
    """Sums of log probabilities by run, worked out once for each distinct run a task meets."""

    def __init__(self, network: Network):
        self.network = network
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(self.network.languages)))

    def read(self, runs: Runs, data: np.ndarray) -> np.ndarray:
        """The sums of each run."""
        if len(self.hashes) > KEPT_RUNS:
            self.clear()
        distinct, first, which = np.unique(runs.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == distinct[at < len(self.hashes)]
        new = first[~known]
        if len(new):
            hashes = np.r_[self.hashes, distinct[~known]]
            sums = np.r_[self.sums, self._through(runs.starts[new], runs.ends[new], data)]
            order = np.argsort(hashes)
            self.hashes, self.sums = hashes[order], sums[order]
            at = np.searchsorted(self.hashes, distinct)
        return self.sums[at][which]

    def _through(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.network.languages)))
        sizes = ends - starts
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            for part in range(0, len(own), AT_ONCE):
                rows = own[part : part + AT_ONCE]
                out[rows] = self.network.logs(data[starts[rows][:, None] + np.arange(size)])[1].sum(axis=0)
        return out


def pooled(texts: Texts, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
    """For each text the probabilities of the languages, and the number of its bytes in runs of letters."""
    runs, data = runs_of(texts)
    sums = reader.read(runs, data)
    size = np.bincount(runs.owner, weights=runs.ends - runs.starts, minlength=len(texts))
    total = np.stack([np.bincount(runs.owner, weights=sums[:, k], minlength=len(texts)) for k in range(sums.shape[1])], axis=1)
    mean = np.exp(total / np.maximum(size, 1)[:, None])
    return mean / mean.sum(axis=1, keepdims=True), size


def languages(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's ``key``, held_out, lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was learnt.
    Whole texts count, however long; repeated rows score alike; a null key is not held out; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = Reader(network), np.array([*network.languages, UNKNOWN], object)
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for texts in tokens.slices(batch.column(2)):
                n = len(texts)
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if network.languages:
                    share, size = pooled(texts, reader)
                    told = letters[texts.first : texts.first + n] & (size > 0)
                    best[told], score[told] = share[told].argmax(axis=1), share[told].max(axis=1)
                keys = [batch.column(i).slice(texts.first, n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(names[best], pa.string()), pa.array(score)], names=[key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(key, held_out(docs[key]).alias("_held_out"), text, letter.alias("_letter"))
    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
