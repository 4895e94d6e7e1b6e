"""Repetition coverage: characters of a text that lie in repeated word n-grams and lines, from rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, small_batches
from .textvec import Texts, hash_spans, mix, texts_of

_STEP = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Largest share of word characters that a kept text may have inside n-grams, or lines, that occur before."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    lines: float = 0.20
    min_words: int = 50
    window: int = 3
    #: Percent of the words that may lie in windows found twice or more.
    window_percent: int = 50


def _rank(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a twin (same text, same hash), and which of these are not the first of theirs."""
    key = mix(h + doc.astype(np.uint64) * _STEP)
    sort = np.sort(key)
    twice = np.unique(sort[1:][sort[1:] == sort[:-1]])
    again, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        again = twice[at] == key
        rows = np.flatnonzero(again)
        order = rows[np.argsort(at[rows], kind="stable")]
        later[order[1:]] = at[order[1:]] == at[order[:-1]]
    return again, later


def _covered(marks: np.ndarray, n: int) -> np.ndarray:
    """Words in a window of n words that starts at a marked one."""
    depth = np.zeros(len(marks) + n, dtype=np.int32)
    depth[:-n] += marks
    depth[n:] -= marks
    return np.cumsum(depth)[: len(marks)] > 0


def measure(t: Texts, rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts for each text of a slice."""
    out = {"n_words": t.words}
    point = np.zeros(len(t.raw) + 1, dtype=np.int64)
    np.cumsum((t.raw & 0xC0) != 0x80, out=point[1:])  # code points up to each byte
    chars = point[t.ends] - point[t.starts]
    out["word_chars"] = np.bincount(t.doc, weights=chars, minlength=t.n).astype(np.int64)
    out["n_symbols"] = t.per_text(None, np.flatnonzero(SYMBOLS[t.raw])).astype(np.int64)
    # Lines, cut at line feeds and at the ends of texts.
    feeds = np.flatnonzero(t.raw == 10)
    starts = np.sort(np.concatenate([t.offsets[:-1], feeds + 1]))
    stops = np.sort(np.concatenate([feeds, t.offsets[1:]]))
    words_before = np.searchsorted(t.starts, [starts, stops], side="left")
    solid = words_before[1] > words_before[0]
    starts, stops, first = starts[solid], stops[solid], words_before[0][solid]
    line_doc = t.doc[first] if len(first) else first
    _, later = _rank(line_doc, hash_spans(t.raw, starts, stops))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=t.n).astype(np.int64)
    in_line = np.concatenate([[0], np.cumsum(chars)])
    line_chars = in_line[words_before[1][solid]] - in_line[first]
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=line_chars[later], minlength=t.n).astype(np.int64)
    # n-grams: one rolling hash is extended from length to length.
    word, total = t.hashes(), len(t.doc)
    lengths = sorted({rules.window, *(n for n, _ in rules.ngrams)})
    roll, have = word.copy(), 1
    for n in lengths:
        while have < n and total > have:
            roll = mix(roll[: total - have] * _STEP + word[have:])
            have += 1
        marks_any, marks_later = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
        if have == n and total >= n:
            inside = np.flatnonzero(t.doc[: total - n + 1] == t.doc[n - 1 :])
            again, later = _rank(t.doc[inside], roll[inside])
            marks_any[inside], marks_later[inside] = again, later
        if n == rules.window:
            out["n_repeat_words"] = np.bincount(t.doc[_covered(marks_any, n)], minlength=t.n).astype(np.int64)
        if n in dict(rules.ngrams):
            hit = _covered(marks_later, n) if marks_later.any() else marks_later
            out[f"dup_{n}gram_chars"] = np.bincount(t.doc[hit], weights=chars[hit], minlength=t.n).astype(np.int64)
    return out


def repetition(df: DataFrame, text_col: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The input without its text, with the measures and the verdicts base_failed and kept.

    A text is kept if it does not fail the base rule (too few words, or too many in repeated windows) and no
    share of its word characters inside later copies of n-grams or lines is above its limit. Null and empty texts have
    0 everywhere and fail the base rule. Every row is measured by itself, so ties and repeated rows give equal
    rows; an empty table gives an empty table. Input columns named like a measure are replaced.
    """
    rules = rules or RepetitionRules()
    small_batches(df.sparkSession)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n, _ in rules.ngrams)]
    made = {x.lower() for x in (*counts, "base_failed", "kept")}
    keep = [c for c in df.columns if c != text_col and c.lower() not in made]
    src = df.select(*keep, F.col(text_col).alias(free_name(df, "_t")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{c} long" for c in counts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, t in texts_of(batch.column(len(keep))):
                got = measure(t, rules)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *(pa.array(got[c]) for c in counts)], names=[*keep, *counts])

    failed = (F.col("n_words") < rules.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.window_percent) * F.col("n_words"))
    over = F.col("dup_line_chars") > F.lit(rules.lines) * F.col("word_chars")
    for n, share in rules.ngrams:
        over = over | (F.col(f"dup_{n}gram_chars") > F.lit(share) * F.col("word_chars"))
    return src.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)
