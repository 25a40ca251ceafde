"""Operator 4: toxicity from Levenshtein automata intersected with a lexicon trie, weighed in context windows.

A lexicon (words, and word beginnings marked as such) with log-odds weights is learned from a bounded sample of labelled
rows. Its trie is intersected with the automaton of all strings within one edit; the product is made deterministic as it
is met, so a word runs through one table, a character at a step, and misspelled terms are caught without trying any edits; an
accented letter is one edit like any other. A hit is weighed in
its window: other hits close by raise it, quotation marks around it count apart. A logistic regression over these figures,
fitted on the other half of the sample, gives the score.

The sample: about SAMPLE_DOCS rows of each label, of at most SAMPLE_BYTES of text, chosen by a hash of doc_id; of near copies one,
of rows that share a doc_id the smallest text. Terms of equal worth are ordered by their letters, so a fit repeats exactly.
All rows are scored over their whole text, each by itself, repeated rows alike. Null, empty and word-less texts get the score
of a text without hits. Without labelled rows of both kinds the score is 0. A doc_id with both labels counts as toxic. Labels,
language, source and id are no input of a score, and further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .language_id import held_out

SAMPLE_DOCS, SAMPLE_BYTES, THRESHOLD = 2500, 1 << 16, 0.3
LEAST_DOCS, LEAST_WEIGHT, MOST_TERMS, FUZZY_LENGTH = 5, 1.0, 4000, 5
STEMS = range(4, 9)
NEAR, QUOTED = 10, 3


class Automaton:
    """States are sets of (trie node, edits); made when met. ``table`` [state, class of the character] holds the next state, -1 unknown, 0 dead. Class 0 is of all characters that no term has."""

    def __init__(self, terms: dict[str, float]):
        """``terms``: weight of each word; a trailing * stands for any rest."""
        self.children: list[dict[int, int]] = [{}]
        self.word: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.length: list[int] = [0]
        letters = sorted({c for t in terms for c in t.removesuffix("*")})
        self.classes = len(letters) + 1
        self.class_of = np.zeros(0x110000, np.int16)
        self.class_of[[ord(c) for c in letters]] = np.arange(1, self.classes)
        number = {c: k for k, c in enumerate(letters, 1)}
        for term, weight in terms.items():
            stem, at = term.endswith("*"), 0
            for c in term.removesuffix("*"):
                nxt = self.children[at].get(number[c])
                if nxt is None:
                    nxt = self.children[at][number[c]] = len(self.children)
                    self.children.append({})
                    self.word.append(0.0)
                    self.stem.append(0.0)
                    self.length.append(self.length[at] + 1)
                at = nxt
            (self.stem if stem else self.word)[at] = weight
        self.states: list[tuple[frozenset, float]] = []
        self.number: dict[tuple[frozenset, float], int] = {}
        self.table = np.zeros((0, self.classes), np.int32)
        self.exact, self.fuzzy, self.begun = (np.zeros(0) for _ in range(3))
        self._state(frozenset(), 0.0)
        self.start = self._state(self._closed({(0, 0)}), 0.0)

    def _closed(self, places: set) -> frozenset:
        """With the places reached by leaving out a character of the term."""
        return frozenset(places | {(child, 1) for node, e in places if e == 0 for child in self.children[node].values()})

    def _state(self, places: frozenset, stem: float) -> int:
        """``stem``: the best weight of the beginnings passed."""
        got = self.number.get((places, stem))
        if got is not None:
            return got
        k = self.number[places, stem] = len(self.states)
        self.states.append((places, stem))
        if k >= len(self.table):
            more = max(256, len(self.table))
            self.table = np.concatenate([self.table, np.full((more, self.classes), -1, np.int32)])
            self.exact, self.fuzzy, self.begun = (np.concatenate([x, np.zeros(more)]) for x in (self.exact, self.fuzzy, self.begun))
        self.exact[k] = max([0.0, *(self.word[n] for n, e in places if e == 0)])
        self.fuzzy[k] = max([0.0, *(self.word[n] for n, e in places if e and self.length[n] >= FUZZY_LENGTH)])
        self.begun[k] = stem
        if not places:
            self.table[k] = k  # nothing but a passed beginning is left
        return k

    def _step(self, state: int, cls: int) -> int:
        places, stem = self.states[state]
        new = set()
        for node, e in places:
            child = self.children[node].get(cls)
            if child is not None:
                new.add((child, e))
            if e == 0:
                new.add((node, 1))
                new.update((c, 1) for c in self.children[node].values())
        new -= {(n, 1) for n, e in new if e == 0}
        stem = max([stem, *(self.stem[n] for n, e in new if e == 0)])
        return self._state(self._closed(new), stem)

    def run(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exact, misspelled, beginning) weights of words; 0 is no hit."""
        cps, before = shared.code_points(shared.lowered(buf))
        classes = self.class_of[cps].astype(np.int64)
        start, end = before[start], before[end]
        state = np.full(len(start), self.start, np.int64)
        live, at = np.flatnonzero(end > start), 0
        while len(live):
            cls = classes[start[live] + at]
            nxt = self.table[state[live], cls]
            new = nxt < 0
            if new.any():
                for key in np.unique(state[live[new]] * self.classes + cls[new]).tolist():
                    to = self._step(*divmod(key, self.classes))
                    self.table[key // self.classes, key % self.classes] = to
                nxt = self.table[state[live], cls]
            state[live] = nxt
            at += 1
            live = live[(start[live] + at < end[live]) & (nxt > 0)]
        state[end <= start] = 0
        exact = self.exact[state]
        return exact, np.where(exact > 0, 0, self.fuzzy[state]), self.begun[state]


def trimmed(buf: np.ndarray, offs: np.ndarray) -> tuple[shared.Words, np.ndarray, np.ndarray]:
    """Words without what is no letter or digit at their ends: (words, start, end)."""
    w = shared.Words(buf, offs, hashed=False)
    solid = np.flatnonzero(shared.ALNUM[buf])
    a, b = np.searchsorted(solid, w.starts), np.searchsorted(solid, w.ends)
    some = b > a
    start, end = w.starts.copy(), w.starts.copy()
    start[some], end[some] = solid[a[some]], solid[b[some] - 1] + 1
    return w, start, end


def quote_marks(buf: np.ndarray) -> np.ndarray:
    """How many quotation marks stand before each byte, and in all."""
    mark = buf == 0x22
    if len(buf) > 2:
        mark[:-1] |= (buf[:-1] == 0xC2) & ((buf[1:] == 0xAB) | (buf[1:] == 0xBB))
        mark[:-2] |= (buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & (buf[2:] >= 0x9C) & (buf[2:] <= 0x9E)
    return np.concatenate([[0], np.cumsum(mark)])


def features(machine: Automaton, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Figures of each row."""
    n_rows = len(offs) - 1
    out = np.zeros((n_rows, 11))
    w, start, end = trimmed(buf, offs)
    n = np.diff(w.first)
    exact, fuzzy, begun = machine.run(buf, start, end)
    weight = np.maximum(exact, np.maximum(0.5 * fuzzy, begun))
    hit = np.flatnonzero(weight > 0)
    if len(hit):
        row = w.row[hit]
        lo = np.maximum(hit - NEAR, w.first[row])
        hi = np.minimum(hit + NEAR + 1, w.first[row + 1])
        marks = quote_marks(buf)
        fro = w.starts[np.maximum(hit - QUOTED, w.first[row])]
        to = w.ends[np.minimum(hit + QUOTED, w.first[row + 1] - 1)]
        quoted = (marks[w.starts[hit] + 1] > marks[fro]) & (marks[to] > marks[np.maximum(w.ends[hit] - 1, 0)])
        own = np.where(quoted, 0, weight[hit])
        total = np.concatenate([[0], np.cumsum(np.bincount(hit, weights=own, minlength=len(w)))])
        near = total[hi] - total[lo]
        for k, x in ((0, exact), (1, fuzzy), (2, begun)):
            np.maximum.at(out[:, k], row, x[hit])
            out[:, 3 + k] = np.log1p(np.bincount(row, weights=x[hit] > 0, minlength=n_rows))
        np.maximum.at(out[:, 6], row, near)
        out[:, 6] = np.log1p(out[:, 6])
        out[:, 7] = np.log1p(1000 * np.bincount(row, minlength=n_rows) / np.maximum(1, n))
        out[:, 8] = np.log1p(np.bincount(row, weights=quoted, minlength=n_rows))
        out[:, 9] = np.log1p(np.bincount(row, weights=weight[hit], minlength=n_rows))
        out[:, 10] = out[:, 7] * out[:, 9]
    return out


class Model:
    def __init__(self, terms: dict[str, float], bias: float, coefficients: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.terms, self.bias, self.coefficients, self.mean, self.scale = terms, bias, coefficients, mean, scale
        self.machine: Automaton | None = None

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.machine is None:
            self.machine = Automaton(self.terms)
        x = (features(self.machine, buf, offs) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.coefficients, -40, 40)))


def _terms_of(text: bytes) -> tuple[set[str], int]:
    """(words and beginnings of a text, hash of its least run of five words, equal in most near copies)."""
    buf = np.frombuffer(text, np.uint8)
    _, start, end = trimmed(buf, np.array([0, len(buf)]))
    low = shared.lowered(buf).tobytes()
    words = [low[a:b].decode(errors="ignore") for a, b in zip(start.tolist(), end.tolist()) if b > a]
    found = set(words)
    least = min((zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))), default=0)
    return found | {x[:k] + "*" for x in found for k in STEMS if len(x) > k}, least


def learn(texts: list[bytes], toxic: np.ndarray) -> Model | None:
    """Lexicon from the even rows, regression from the odd ones."""
    seen, keep = set(), []
    for k, t in enumerate(texts):
        least = _terms_of(t)[1]
        if (least, bool(toxic[k])) not in seen:
            seen.add((least, bool(toxic[k])))
            keep.append(k)
    y = toxic[keep].astype(float)
    if not len(y) or not 0 < y.sum() < len(y):
        return None
    half = np.arange(len(y)) % 2 == 0
    if len(y) < 40:
        half[:] = True
    good, bad = half.sum() - y[half].sum(), y[half].sum()
    counts = (Counter(), Counter())
    for k in np.flatnonzero(half & (y == 1)):
        counts[1].update(_terms_of(texts[keep[k]])[0])
    common = {t for t, a in counts[1].items() if a >= min(LEAST_DOCS, max(1, bad / 4))}
    counts = (Counter(), Counter({t: counts[1][t] for t in common}))
    for k in np.flatnonzero(half & (y == 0)):  # only terms that may enter the lexicon are counted, so the rest takes no memory
        counts[0].update(_terms_of(texts[keep[k]])[0] & common)
    weight = {}
    for term, a in counts[1].items():
        if a:
            w = float(np.log((a + 0.5) / (bad + 1)) - np.log((counts[0][term] + 0.5) / (good + 1)))
            if w >= LEAST_WEIGHT:
                weight[term] = w
    best = sorted(weight, key=lambda t: (-weight[t] * np.sqrt(counts[1][t]), t))[:MOST_TERMS]
    machine = Automaton(terms := {t: round(weight[t], 3) for t in best})
    rest = np.flatnonzero(~half if (~half).any() and 0 < y[~half].sum() < (~half).sum() else half)
    parts = [texts[keep[k]] for k in rest]
    sample = shared.Texts(pa.array(parts, pa.large_binary()))
    x = np.concatenate([features(machine, buf, offs) for _, _, buf, offs in sample.slices()])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    beta = np.zeros(x.shape[1])
    ridge = np.eye(len(beta)) * 1.0
    ridge[0, 0] = 1e-3
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        beta += np.linalg.solve(h, x.T @ (y[rest] - p) - ridge @ beta)
    return Model(terms, float(beta[0]), beta[1:], mean, scale)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model | None:
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).where("k IS NOT NULL AND toxic IN (0, 1)").where(~held_out("k"))
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col("toxic") == value, F.lit(min(1 << 20, -(-(sample_docs << 20) // n)))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share).groupBy("k").agg(F.max("toxic").alias("toxic"))
    # about 2 * sample_docs ids, so they may be sent to all tasks; of rows that share an id one text is taken, so no more texts come back
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= SAMPLE_BYTES))
    got = sorted((r.k, r.t, r.toxic) for r in texts.join(F.broadcast(chosen), "k").groupBy("k", "toxic").agg(F.min("t").alias("t")).collect())
    model = learn([t.encode() for _, t, _ in got], np.array([x for _, _, x in got], int))
    if model is not None:  # the sample holds more of the rarer label than the table
        have = Counter(x for _, _, x in got)
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(max(1, have[1]) / max(1, have[0])))
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shared.row_ids(b.column(0))
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                s = model.score(buf, offs) if model is not None else np.zeros(to - at)
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return shared.only(docs, key, text).mapInArrow(run, f"{key} long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
