"""Operator 9: language identification by a byte convolutional network.

Bytes of a fixed-length window are embedded, filters of several widths pass over them, each filter's maximum over the
window is pooled, and a softmax gives the language. Training is numpy (Adam) on windows of a bounded sample of labelled
rows: about ``SAMPLE_DOCS`` documents of each language, up to ``SAMPLE_WINDOWS`` windows of each. For prediction the
embedding is folded into the filters, so a filter is a sum of table rows. Every window of a text is scored, and a
text's probabilities are the mean over its windows, weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0. Without any labelled row all texts are ``und``. Long
texts are scored whole. Of equal probabilities the language that sorts first is taken; languages are at most ``MAX_LANGS``, the
most frequent ones. Rows are predicted each by itself, and repeated rows of a sample count once. Labels are never an input of a
prediction; further columns are not read by :func:`predict` and kept by :func:`keep_known`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WIDTHS, FILTERS, EMBED, LENGTH = (2, 3, 4), 12, 8, 256
SAMPLE_DOCS, SAMPLE_WINDOWS, MAX_LANGS, EPOCHS = 240, 4, 1000, 6
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def held_out(key: str = "doc_id", of: int = 4, left: int = 2):
    """Rows that nothing is learned from: crc32 of the id as text leaves ``left``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == left, F.lit(False))


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["E"][0] = 0
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["V"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """``x``: windows of bytes [n, LENGTH]; ``y``: language numbers."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(self.langs))) / len(self.langs)).astype(np.float32)
        step = 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                g = self._gradients(x[at], y[at], weight)
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v2[k] += 0.001 * (d * d - v2[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-7)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n, g = self.p, len(x), {}
        e = p["E"][x]
        pooled, caches = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : LENGTH - w + 1 + k] for k in range(w)], axis=2)
            z = cols.reshape(-1, w * EMBED) @ p[f"W{w}"]
            z = z.reshape(n, -1, FILTERS)
            best = z.argmax(1)
            top = np.take_along_axis(z, best[:, None], 1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(top, 0))
            caches.append((w, cols, best, top > 0))
        h = np.concatenate(pooled, 1)
        logits = h @ p["V"] + p["c"]
        probs = np.exp(logits - logits.max(1, keepdims=True))
        probs /= probs.sum(1, keepdims=True)
        d = probs
        d[np.arange(n), y] -= 1
        d *= weight[y][:, None] / n
        g["V"], g["c"] = h.T @ d, d.sum(0)
        dh = d @ p["V"].T
        de = np.zeros_like(p["E"])
        for k, (w, cols, best, on) in enumerate(caches):
            dt = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            g[f"b{w}"] = dt.sum(0)
            at = cols[np.arange(n)[:, None], best]  # [n, FILTERS, w * EMBED]
            g[f"W{w}"] = np.einsum("nfi,nf->if", at, dt)
            back = (dt[:, :, None] * p[f"W{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(de, x[np.arange(n)[:, None], best + j], back[:, :, j])
        de[0] = 0
        g["E"] = de
        return g

    def tables(self) -> None:
        """Folds the embedding into the filters: table [byte, filter] for each tap."""
        self.taps = {w: [np.ascontiguousarray(self.p["E"] @ self.p[f"W{w}"][k * EMBED : (k + 1) * EMBED]) for k in range(w)] for w in WIDTHS}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows [n, LENGTH], 512 at a time."""
        out = np.empty((len(x), len(self.langs)), np.float32)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            pooled = []
            for w in WIDTHS:
                z = self.taps[w][0][part[:, : LENGTH - w + 1]]
                for k in range(1, w):
                    z += self.taps[w][k][part[:, k : LENGTH - w + 1 + k]]
                pooled.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
            logits = np.concatenate(pooled, 1) @ self.p["V"] + self.p["c"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[at : at + 512] = e / e.sum(1, keepdims=True)
        return out


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows [n, LENGTH] padded with 0, row of each, bytes in each)."""
    size = np.diff(offs)
    n = -(-size // LENGTH)
    row = np.repeat(np.arange(len(size)), n)
    start = offs[row] + LENGTH * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    held = np.minimum(LENGTH, offs[row + 1] - start)
    step = np.arange(LENGTH)
    at = np.minimum(start[:, None] + step, max(0, len(buf) - 1))
    return np.where(step < held[:, None], buf[at], 0).astype(np.uint8) if len(row) else np.zeros((0, LENGTH), np.uint8), row, held


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_to = np.concatenate([[0], np.cumsum(_ASCII_LETTER[buf])])[offs]
    out = np.diff(ascii_to) > 0
    for r in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[r] = any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode())
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network | None:
    """A network trained on the rows that aren't held out; None if no row has text and a language."""
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not counts:
        return None
    # a hash of id and text chooses each language's share and repeated rows count once, so what is collected is bounded by languages x documents x windows
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1 << 20, -(-(sample_docs << 20) // n)))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("k", "text"), F.lit(1 << 20)) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = shared.Texts(b.column(2))
            for at, to, buf, offs in t.slices():
                x, row, held = windows(buf, offs)
                own = np.bincount(row, minlength=to - at)
                place = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own)
                every = np.maximum(1, -(-own // SAMPLE_WINDOWS))[row]
                take = np.flatnonzero((place % every == 0) & ((held > 40) | (own[row] == 1)))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(at + row[take])), b.column(1).cast(pa.string()).take(pa.array(at + row[take])), pa.array([w.tobytes() for w in x[take]], pa.binary())], ["k", "lang", "w"])

    got = sorted((r.k if r.k is not None else -1, r.lang, bytes(r.w)) for r in chosen.mapInArrow(shared.released(cut), "k long, lang string, w binary").distinct().collect())
    if not got:
        return None
    langs = sorted({r[1] for r in got})
    net = Network(langs)
    x = np.frombuffer(b"".join(r[2] for r in got), np.uint8).reshape(-1, LENGTH)
    net.train(x, np.array([langs.index(r[1]) for r in got]))
    return net


def judge(net: Network | None, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of each row."""
    n = len(offs) - 1
    if net is None:
        return ["und"] * n, np.zeros(n)
    if not hasattr(net, "taps"):
        net.tables()
    x, row, held = windows(buf, offs)
    mass = np.zeros((n, len(net.langs)))
    np.add.at(mass, row, net.probabilities(x) * held[:, None])
    mass /= np.maximum(1, np.bincount(row, weights=held, minlength=n))[:, None]
    best = mass.argmax(1)
    known = has_letter(buf, offs)
    return [net.langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, np.clip(mass[np.arange(n), best], 0, 1), 0.0)


def predict(docs: DataFrame, net: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shared.row_ids(b.column(0))
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                names, score = judge(net, buf, offs)
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(names, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return shared.only(docs, key, text).mapInArrow(shared.released(run), f"{key} long, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known with at least that score. Without a network (no row has a language) the rows that hold a letter stay."""
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [np.zeros(0, bool)]
            for _, _, buf, offs in shared.Texts(b.column(at_text)).slices():
                names, score = judge(net, buf, offs)
                keep.append(has_letter(buf, offs) if net is None else (np.array(names) != "und") & (score >= least))
            yield b.filter(pa.array(np.concatenate(keep)))

    return shared.map_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    predicted = predict(docs, fit(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
