"""Operator 5: quality rules by suffix-array repetition.

Words of a document are symbols; a suffix array of the words and its longest-common-prefix array give, at each word, the
longest passage that starts there and stands elsewhere in the same text too. Their union is the repeated part (the union
of all maximal repeated substrings), and the largest common prefix is the longest repeat. A document goes if repeats of
at least ``min_repeat`` words cover more than ``max_covered`` of it, or one is longer than ``max_longest`` words.

Documents are taken in slices; a symbol is a word with its row, so suffixes of different rows never share a prefix.

Null, empty and white-space texts have no words: counts of 0, base_failed, not kept. Texts of any length are taken whole.
Each row stands alone: repeated rows and rows of one doc_id get equal figures, an empty table gives none. Further columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared
from .fm_index import suffix_array

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.30, 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "longest_repeat"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place the length of the longest passage from there that also starts at another place."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    order = suffix_array(symbols)
    a, b = order[:-1], order[1:]
    # common prefixes of neighbours by lifting: hashes of 1, 2, 4, ... symbols, as long as any two neighbours agree
    levels, k = [shared.mix(symbols.astype(np.uint64) + np.uint64(1))], 1
    while True:
        h = levels[-1]
        near = (np.maximum(a, b) + k <= n) & (h[a] == h[b])
        if not near.any() or 2 * k > n:
            break
        beyond = np.zeros(n, np.uint64)
        beyond[: n - k] = h[k:]
        doubled = shared.mix(h * np.uint64(0x9E3779B97F4A7C15) + beyond)
        levels.append(doubled)
        k *= 2
    common = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        k, h = 1 << level, levels[level]
        fit = np.flatnonzero(np.maximum(a, b) + common + k <= n)
        at = fit[h[a[fit] + common[fit]] == h[b[fit] + common[fit]]]
        common[at] += k
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def covered(longest: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which places lie in a repeat of at least ``least`` (all of it, or its first ``width``)."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + (longest[at] if width is None else width), 1)
    return np.cumsum(edge[:-1]) > 0


def duplicate_lines(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row the lines that hold a word and equal an earlier line of the row."""
    n_rows = len(offs) - 1
    solid = np.flatnonzero(shared.SPACED[buf])
    if not len(solid):
        return np.zeros(n_rows, np.int64)
    # lines that hold a word: a word byte whose next word byte before it lies in another line or row
    line = np.cumsum(buf == 10)[solid] + np.searchsorted(offs, solid, "right")
    head = solid[np.concatenate([[True], line[1:] != line[:-1]])]
    feeds = np.flatnonzero(buf == 10)
    row = np.searchsorted(offs, head, "right") - 1
    last = np.searchsorted(feeds, head)
    start = np.maximum(np.where(last > 0, feeds[np.maximum(last - 1, 0)] + 1, 0) if len(feeds) else 0, offs[row])
    end = np.minimum(np.where(last < len(feeds), feeds[np.minimum(last, len(feeds) - 1)], len(buf)) if len(feeds) else len(buf), offs[row + 1])
    h = shared.span_hash(buf, start, end - start)
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=n_rows)


def judge(buf: np.ndarray, offs: np.ndarray, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> list[np.ndarray]:
    """The columns of SCHEMA for the rows of a slice."""
    n_rows = len(offs) - 1
    w = shared.Words(buf, offs, lower=False)
    n_words = np.diff(w.first).astype(np.int64)
    points = np.concatenate([[0], np.cumsum(((buf & 0xC0) != 0x80) & shared.SPACED[buf])])[offs]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])[offs]
    _, ids = np.unique(shared.mix(w.hash ^ shared.mix(w.row.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    longest = longest_repeats(ids)
    repeat = shared.by_row(covered(longest, WINDOW, WINDOW), w.row, n_rows)
    cover = shared.by_row(covered(longest, min_repeat), w.row, n_rows)
    most = np.zeros(n_rows, np.int64)
    np.maximum.at(most, w.row, longest)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (cover <= max_covered * n_words) & (most <= max_longest)
    return [n_words, np.diff(points), np.diff(symbols), duplicate_lines(buf, offs), repeat, failed, kept, cover, most]


def rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key and the columns of SCHEMA) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = shared.row_ids(b.column(0))
            for at, to, buf, offs in shared.Texts(b.column(1)).slices():
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), *map(pa.array, judge(buf, offs, min_repeat, max_covered, max_longest))], [key, *NAMES])

    return shared.only(docs, key, text).mapInArrow(run, f"{key} long, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(shared.documents(spark, sf_dir)).drop("n_covered", "longest_repeat")


#: A word lies in a repeat of at least k words if a window of k words that stands twice holds it, and the longest repeat has more than k words if a window of k + 1 stands twice.
ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
places AS (
  SELECT r, n, i, md5(array_to_string(w[i : i + n - 1], ' ')) AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (VALUES (6), (8), (101)) AS v (n) WHERE len(w) >= n)),
twice AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY r, n, s) AS c FROM places) WHERE c > 1),
inside AS (SELECT r, n, count(DISTINCT j) AS c FROM (SELECT r, n, unnest(range(i, i + n)) AS j FROM twice) GROUP BY r, n),
base AS (
  SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce((SELECT c FROM inside WHERE inside.r = docs.r AND n = 8), 0) AS n_repeat_words,
    coalesce((SELECT c FROM inside WHERE inside.r = docs.r AND n = 6), 0) AS n_covered, EXISTS (SELECT 1 FROM inside WHERE inside.r = docs.r AND n = 101) AS long_repeat
  FROM docs LEFT JOIN lines USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_covered <= 0.3::DOUBLE * n_words AND NOT long_repeat AS kept
FROM base
"""
