"""Structure statistics of whole texts, one narrow pass over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordHashes, mix, text_slices

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 5
#: counts that :func:`counts_of` returns, in order
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_upper", "n_letters",
    "n_marks", "n_digits", "n_top_word", "n_marked_words", "longest_run",
)
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if chr(b) not in ".," and not chr(b).isalnum())
_DOUBLED = (b"!!", b"??", b"**", b"##", b"$$", b"%%", b"&&")


def windows(hashes: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - length + 1, np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - length + 1 + k]
    return mix(total)


def covered(marked: np.ndarray, length: int, size: int) -> int:
    """Positions out of ``size`` inside a window of ``length`` that starts at a marked place."""
    change = np.zeros(size + 1, np.int32)
    starts = np.flatnonzero(marked)
    change[starts] += 1
    np.subtract.at(change, starts + length, 1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts_of(text: str | None, words_known: WordHashes) -> list[int]:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    hashes = words_known.of(words)
    _, where, times = np.unique(windows(hashes), return_inverse=True, return_counts=True)
    repeated = covered(times[where] > 1, WINDOW, n) if len(where) and times.max() > 1 else 0
    lines = [line for line in data.split(b"\n") if line.strip()]
    top = longest = distinct = 0
    if n:
        _, per_word = np.unique(hashes, return_counts=True)
        distinct, top = len(per_word), int(per_word.max())
        change = np.flatnonzero(np.diff(hashes)) + 1
        longest = int(np.diff(np.concatenate(([0], change, [n]))).max())
    without = len(data) - len(data.translate(None, BLANKS))
    upper = len(data) - len(data.translate(None, _UPPER))
    return [
        n, len(text) - without, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, distinct,
        len(lines), upper, upper + len(data) - len(data.translate(None, _LOWER)), len(data) - len(data.translate(None, _MARKS)),
        len(data) - len(data.translate(None, _DIGITS)), top, sum(data.count(d) for d in _DOUBLED), longest,
    ]


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one long column per entry of ``COUNTS``); a null text counts as an empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in text_slices(batches, text):
            table = np.array([counts_of(t, known) for t in part.column(text).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            columns = [pa.array(table[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"{key} {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Scale-free features, one row per row of counts (columns as ``COUNTS``)."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T, strict=True))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    expected = np.minimum(1.0, c["n_distinct_words"] / np.power(words, 0.9))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        expected, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_marks"] / words, c["n_digits"] / chars, c["n_top_word"] / words,
        c["n_marked_words"] / words, np.log1p(np.minimum(c["longest_run"], 1000)), np.log1p(c["n_words"] / lines),
    ])
