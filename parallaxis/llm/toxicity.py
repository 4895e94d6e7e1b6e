"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, small_batches
from .textvec import PLAIN, Texts, mix, texts_of


@dataclass(frozen=True)
class FtrlRules:
    """sample_rows bounds the labelled rows that weights are learnt from; 2^bits bounds the weights."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 12.0
    l2: float = 1.0
    epochs: int = 6
    #: How much a toxic row counts against another; toxic ones are few.
    toxic_weight: float = 6.0
    sample_rows: int = 12_000


_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(t: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of words, of pairs of neighbours and of pairs with one word between; repeats included."""
    h = t.hashes()
    shift = np.uint64(64 - bits)
    docs, found = [t.doc], [h >> shift]
    for gap, salt in ((1, _NEXT), (2, _SKIP)):
        if len(h) > gap:
            inside = np.flatnonzero(t.doc[:-gap] == t.doc[gap:])
            docs.append(t.doc[inside])
            found.append(mix(h[inside] * salt + h[inside + gap]) >> shift)
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def by_text(t: Texts, bits: int) -> list[np.ndarray]:
    """Each text's set of features."""
    doc, f = features(t, bits)
    key = np.unique((doc << bits) | f)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key, np.arange(1, t.n) << bits))


def train(sets: list[np.ndarray], labels: np.ndarray, rules: FtrlRules) -> np.ndarray:
    """Weights by hashed feature, the last one the bias; a coordinate's rate falls with the gradients it has seen."""
    n = (1 << rules.bits) + 1
    z, s = np.zeros(n), np.zeros(n)
    sets = [np.append(f, n - 1) for f in sets]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        l1 = np.full(n, rules.l1)[at] if isinstance(at, slice) else np.where(at == n - 1, 0.0, rules.l1)
        w = -(z[at] - np.sign(z[at]) * l1) / ((rules.beta + np.sqrt(s[at])) / rules.alpha + rules.l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(rules.epochs):
        for f, y in zip(sets, labels, strict=True):
            w = weights(f)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= rules.toxic_weight if y else 1.0
            root = np.sqrt(s[f])
            s[f] += g * g
            z[f] += g - (np.sqrt(s[f]) - root) / rules.alpha * w
    out = weights(slice(None))
    out[-1] = weights(np.array([n - 1]))[0]
    return out


def fit(df: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rules: FtrlRules | None = None) -> np.ndarray:
    """Weights (index, value as two rows) other than 0, learnt in one task from at most about sample_rows labelled rows.

    trainable says, by the labels' id, which rows may be learnt from. Of these the rows with the smallest hashes of the id are
    taken. Null labels and ids are left out, of several labels of an id the largest counts, and of several texts. Without any label
    all weights are 0 and every score is a half.
    """
    rules = rules or FtrlRules()
    small_batches(df.sparkSession)
    own = labels.where(trainable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    n = own.count()
    cut = min(1.0, rules.sample_rows / max(n, 1))
    order = F.shiftrightunsigned(F.xxhash64("_id"), 1)
    some = own.where(order <= F.lit(min(int(cut * 2**63), 2**63 - 1)))  # bounded by sample_rows, so small enough to broadcast
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(some), "_id").groupBy("_id", "_y").agg(F.max("_t").alias("_t"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ys, sets = [], [], []
        for batch in batches:
            keys += batch.column(0).to_pylist()
            ys += batch.column(1).to_pylist()
            for _, _, t in texts_of(batch.column(2), PLAIN):
                sets += [f.astype(np.int32) for f in by_text(t, rules.bits)]
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        w = train([sets[i] for i in order], np.array(ys, dtype=float)[order], rules) if sets else np.zeros((1 << rules.bits) + 1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    model = rows.select(F.xxhash64("_id").alias("k"), "_y", "_t").repartition(1).mapInArrow(learn, "at long, w double").collect()  # the weights that L1 leaves
    return np.array([[r["at"], r["w"]] for r in sorted(model, key=lambda r: r["at"])], dtype=float).reshape(-1, 2).T


def score(df: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score", rules: FtrlRules | None = None, keep_text: bool = False) -> DataFrame:
    """The input with the chance that a text is toxic; the text itself stays only if asked for.

    Null and empty texts score by the bias alone. A row's score depends on its own text only, so repeated rows score alike. An
    input column named like the result is replaced.
    """
    rules = rules or FtrlRules()
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c.lower() != out.lower() and (keep_text or c != text_col)]
    src = df.select(*rest, F.col(text_col).alias(free_name(df, "_t")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{out}` double"])
    at, value = weights[0].astype(np.int64), weights[1].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((1 << rules.bits) + 1)
        w[at] = value
        live = w[:-1] != 0
        for batch in batches:
            for lo, hi, t in texts_of(batch.column(len(rest)), PLAIN):
                doc, f = features(t, rules.bits)
                hit = live[f]
                key = np.unique((doc[hit] << rules.bits) | f[hit])
                logit = w[-1] + np.bincount(key >> rules.bits, weights=w[key & ((1 << rules.bits) - 1)], minlength=t.n)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))))], names=[*rest, out])

    return src.mapInArrow(run, schema)
