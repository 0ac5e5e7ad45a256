"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased, encoded as UTF-8 and cut into windows; two recurrent layers read each window, one from either
end, and a softmax labels every byte position with a language. A document's probabilities are the mean over all its
positions. The network is trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import settle

#: Documents learned from at most (least hashes of their ids), windows of each, bytes of a window, and units of a direction.
SAMPLE, WINDOWS, WIDTH, UNITS = 6_000, 6, 48, 12
STEPS, BATCH, RATE = 260, 256, 0.02
#: Windows read at a time when predicting.
BLOCK = 4096
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_layer(table: np.ndarray, u: np.ndarray, bias: np.ndarray, x: np.ndarray, keep: bool = False):  # noqa: ANN201
    """One gated recurrent layer over x (time, batch): hidden states, and what backpropagation needs if `keep`."""
    n = u.shape[0]
    h = np.zeros((x.shape[1], n), dtype=np.float32)
    states = np.empty((*x.shape, n), dtype=np.float32)
    saved = []
    for t in range(x.shape[0]):
        a = table[x[t]]
        b = h @ u
        gates = a[:, : 2 * n] + b[:, : 2 * n]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :n], gates[:, n:]
        inner = b[:, 2 * n :] + bias
        new = np.tanh(a[:, 2 * n :] + r * inner)
        if keep:
            saved.append((h, z, r, inner, new))
        h = new + z * (h - new)
        states[t] = h
    return states, saved


def back_layer(table: np.ndarray, u: np.ndarray, x: np.ndarray, saved: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of a layer's table, recurrent weights and bias, from gradients of its states."""
    n = u.shape[0]
    g_table, g_u, g_bias = np.zeros_like(table), np.zeros_like(u), np.zeros(n, dtype=np.float32)
    g_h = np.zeros((x.shape[1], n), dtype=np.float32)
    for t in range(x.shape[0] - 1, -1, -1):
        h, z, r, inner, new = saved[t]
        g_h = g_h + into[t]
        g_new = g_h * (1 - z) * (1 - new * new)
        g_z = g_h * (h - new) * z * (1 - z)
        g_inner = g_new * r
        g_r = g_new * inner * r * (1 - r)
        g_a = np.concatenate([g_z, g_r, g_new], axis=1)
        g_b = np.concatenate([g_z, g_r, g_inner], axis=1)
        np.add.at(g_table, x[t], g_a)
        g_u += h.T @ g_b
        g_bias += g_inner.sum(axis=0)
        g_h = g_h * z + g_b @ u.T
    return g_table, g_u, g_bias


@dataclass
class Network:
    """langs, and the weights of both layers and of the output; without languages every prediction is unknown."""

    langs: list[str]
    weights: list[np.ndarray]

    @staticmethod
    def new(langs: list[str], units: int = UNITS, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        layer = lambda: [make(256, 3 * units, by=0.3), make(units, 3 * units, by=units**-0.5), np.zeros(units, dtype=np.float32)]
        return Network(langs, [*layer(), *layer(), make(2 * units, len(langs), by=0.3), np.zeros(len(langs), dtype=np.float32)])

    def logits(self, x: np.ndarray, keep: bool = False):  # noqa: ANN201
        """Logits (time, batch, language) of byte windows x (time, batch)."""
        e1, u1, b1, e2, u2, b2, out, bias = self.weights
        forth, s1 = run_layer(e1, u1, b1, x, keep)
        back, s2 = run_layer(e2, u2, b2, x[::-1], keep)
        n = u1.shape[0]
        return forth @ out[:n] + back[::-1] @ out[n:] + bias, (forth, back, s1, s2)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and its gradients; weight (time, batch) is 0 at padding."""
        logits, (forth, back, s1, s2) = self.logits(x, keep=True)
        p = softmax(logits)
        total = weight.sum()
        at = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, at, y] + 1e-9) * weight).sum() / total)
        p[:, at, y] -= 1
        p *= (weight / total)[:, :, None]
        e1, u1, _, e2, u2, _, out, _ = self.weights
        n = u1.shape[0]
        flat = p.reshape(-1, p.shape[2])
        g_out = np.concatenate([forth.reshape(-1, n).T @ flat, back[::-1].reshape(-1, n).T @ flat])
        g1 = back_layer(e1, u1, x, s1, p @ out[:n].T)
        g2 = back_layer(e2, u2, x[::-1], s2, (p @ out[n:].T)[::-1])
        return loss, [*g1, *g2, g_out, flat.sum(axis=0)]

    def train(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 6) -> Network:
        """Adam over random batches in which languages are as frequent as each other; x is (window, time)."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m, v = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, steps + 1):
            picked = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups if len(g)])
            seen = (np.arange(x.shape[1])[:, None] < length[picked][None, :]).astype(np.float32)
            _, grads = self.gradients(x[picked].T, y[picked], seen)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in enumerate(grads):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.weights[k] = (self.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def documents(self, data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
        """Mean probabilities (document, language) over all byte positions of each document."""
        lengths = np.diff(offsets)
        counts = -(-lengths // width)
        owner = np.repeat(np.arange(len(lengths)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts, left = offsets[owner] + nth * width, np.minimum(width, lengths[owner] - nth * width)
        padded = np.append(data, np.zeros(width, dtype=np.uint8))
        sums = np.zeros((len(lengths), len(self.langs)))
        steps = np.arange(width)[:, None]
        for k in range(0, len(owner), BLOCK):
            part = slice(k, k + BLOCK)
            seen = steps < left[part][None, :]
            x = np.where(seen, padded[starts[part][None, :] + steps], 0)
            p = softmax(self.logits(x)[0])
            p *= seen[:, :, None]
            by_window = p.sum(axis=0)
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(owner[part], by_window[:, c], len(lengths))
        return sums / np.maximum(lengths, 1)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    return p


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Network:
    """Trains on documents with a language for which `learn` (a condition on doc_id) holds; at most `sample` of them.

    Only windows of bounded length reach the driver: WINDOWS of each document, from pseudorandom places of its whole
    text. Rows with a null id, text or language teach nothing. Without any, every prediction is unknown.
    """
    chosen = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    chosen = settle(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).groupBy("doc_id").agg(F.min("lang").alias("y")))
    place = lambda k: F.substring(F.col("low"), (1 + F.pmod(F.xxhash64("doc_id", k), F.greatest(F.lit(1), F.length("low") - WIDTH // 2))).cast("int"), F.lit(WIDTH))
    texts = docs.select("doc_id", F.lower("text").alias("low")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("low").alias("low"))
    rows = texts.select("doc_id", "y", F.transform(F.sequence(F.lit(1), F.lit(WINDOWS)), place).alias("w")).orderBy("doc_id").collect()
    langs = sorted({r.y for r in rows})
    windows = [(w.encode()[:WIDTH], r.y) for r in rows for w in r.w if any(c.isalpha() for c in w)]
    net = Network.new(langs)
    if not windows:
        return Network([], net.weights)
    x = np.zeros((len(windows), WIDTH), dtype=np.uint8)
    for k, (w, _) in enumerate(windows):
        x[k, : len(w)] = np.frombuffer(w, dtype=np.uint8)
    number = {lang: k for k, lang in enumerate(langs)}
    return net.train(x, np.array([len(w) for w, _ in windows]), np.array([number[y] for _, y in windows]))


def predictor(net: Network):  # noqa: ANN201
    """A function for mapInArrow from (doc_id, low, letters) to (doc_id, lang_pred, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("low").cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
            letters = batch.column("letters").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            known = letters & bool(net.langs)
            p = net.documents(data, offsets) if net.langs else np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            langs = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score (the language's pooled probability) of every whole text.

    A text that is null or has no letter is `und` with score 0. Equal rows are predicted alike; an empty table gives
    an empty result; lang, source and other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", F.lower("text").alias("low"), F.col("text").rlike(r"\p{L}").alias("letters"))
    return own.mapInArrow(predictor(net), f"doc_id {kind}, lang_pred string, score double")
