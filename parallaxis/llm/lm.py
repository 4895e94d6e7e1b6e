"""Language-model scores by a weighted backoff automaton over word bigrams, block by block.

Smoothing: p(w) = (c(w) + a) / (N + a (V + 1)), one share of the mass for all unknown words. Every training word is a state. After state u
p(w | u) = (c(u, w) + k p(w)) / (c(u) + k) with k = pull * (c(u) + 1) ** power: a state has an arc for each seen successor and a failure
arc of weight k / (c(u) + k) to the root, and its probabilities add up to 1. The two constants come near to absolute
discounting, whose counts of successors would have to be gathered for each state.

Counts of words and pairs are exact and never leave the executors. Documents are dealt into blocks where they are read. A block
asks for the n-grams it holds: sorted hashes, cut into ranges and packed, with the counts of its own training rows. A range adds
up what all blocks ask and answers each with the totals that it can't know by itself; then a block's documents are run through the block's automaton.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, materialise, small_batches
from .textvec import LOWER, Texts, mix, texts_of


@dataclass(frozen=True)
class LmRules:
    """block_bytes of text make a block; a range has about range_grams different n-grams of all blocks together."""

    add: float = 0.1
    pull: float = 2.0
    power: float = 0.8
    block_bytes: int = 16 << 20
    range_grams: int = 1 << 20


END = np.uint64(xxhash.xxh64_intdigest(b"", 0))  # no word is empty
_PAIR = np.uint64(0xD1342543DE82EF95)
#: Bytes of a hash that are sent; the range stands for the bits above.
SENT = 6
#: Bits that name a range at most; with the bytes sent, these many bits tell n-grams apart.
RANGE_BITS = 16


def token_hashes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (LOWER texts) with the end token behind each text, end to end, and where each text ends."""
    ends = np.cumsum(t.words + 1)
    out = np.empty(int(ends[-1]) if t.n else 0, dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[ends - 1] = False
    out[place] = t.hashes()
    out[~place] = END
    return out, ends


def pair_hashes(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it, the end token before a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = END
    return mix(before * _PAIR + tokens)


def _index(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where wanted stands in ascending values, -1 if it does not."""
    if not len(values):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _tally(grams: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct n-grams, and how many of each stand where on is set."""
    own, back = np.unique(grams, return_inverse=True)
    return own, np.bincount(back, weights=on, minlength=len(own)).astype(np.int64)


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """The low bytes of hashes, and counts: one byte each, those of 255 and more as 8 bytes behind."""
    low = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :SENT]
    return low.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :SENT] = np.frombuffer(data, np.uint8, n * SENT).reshape(n, SENT)
    counts = np.frombuffer(data, np.uint8, n, n * SENT).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", -1, n * (SENT + 1))
    return wide.view(np.uint64).ravel(), counts


def _trim(grams: np.ndarray, bits: int) -> np.ndarray:
    """Hashes with as many bits as are sent: those that name the range, then the low ones."""
    top = grams >> np.uint64(64 - bits) if bits else np.zeros(len(grams), np.uint64)
    return (top << np.uint64(8 * SENT)) | (grams & np.uint64((1 << (8 * SENT)) - 1))


class Automaton:
    """States, arcs and failure arcs for the n-grams of one block."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, kinds: int, rules: LmRules) -> None:
        """words and pairs: ascending hashes with their counts in training. total: tokens there, kinds: distinct ones."""
        self.words, self.pairs, self.pair_counts = words, pairs, pair_counts
        floor = rules.add / (total + rules.add * (kinds + 1))
        self.p = np.append((counts + rules.add) / (total + rules.add * (kinds + 1)), floor)  # the last is that of unknown words
        self.counts = np.append(counts, 0).astype(float)
        pull = rules.pull * (self.counts + 1) ** rules.power
        pull[-1] = 0.0
        self.pull, self.mass = pull, np.maximum(self.counts + pull, 1e-300)

    def score(self, tokens: np.ndarray, pairs: np.ndarray, ends: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts whose tokens stand end to end, end being the hash of the end token: base score, known tokens, score.

        The state before a token is the token before it, where that is a training word, else the root; so the traversal of all
        texts from left to right is one look at every step: the arc if there is one, else the failure arc and the root's.
        """
        ids = _index(self.words, tokens)
        root = len(self.words)
        state = np.empty_like(ids)
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
        state[1:] = ids[:-1]
        state[starts] = _index(self.words, end)[0]
        state[state < 0] = root
        p = self.p[ids]
        at = _index(self.pairs, pairs)
        seen = np.where(at >= 0, self.pair_counts[at], 0) if len(self.pairs) else np.zeros(len(at))
        step = np.where(state == root, p, (seen + self.pull[state] * p) / self.mass[state])
        sums = lambda x: np.add.reduceat(x, starts) if len(ends) else np.zeros(0)
        return sums(np.log10(p)), sums((ids >= 0).astype(np.int64)), sums(np.log10(step))


def _dealt(src: DataFrame, rules: LmRules) -> DataFrame:
    """The rows with the block they belong to: as they are read, some megabytes at a time; a longer text is a block."""
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields), "block long", "bytes long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pc.binary_length(batch.column("_t")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = held + np.cumsum(size + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block + ends // rules.block_bytes), pa.array(size)], names=[*batch.schema.names, "block", "bytes"])
            held = int(ends[-1]) if len(ends) else held

    return src.mapInArrow(run, ", ".join(fields))


def lm_scores(df: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", rules: LmRules | None = None) -> DataFrame:
    """One row per input row: id, trains, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).

    trains says which rows the counts come from; rows where it is null do not count. Every row is scored: null and empty texts are
    the end token alone. Repeated rows count and score each. Without training rows all words are unknown and scores are those of
    uniform mass. An empty table gives an empty table; other columns are not looked at. Words are told apart by 64-bit hashes.
    """
    rules = rules or LmRules()
    small_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    try:
        src = df.select(F.col(id_col).alias("_id"), F.coalesce(trains, F.lit(False)).alias("_train"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
        stored = scratch.keep(_dealt(src, rules))
        size = stored.agg(F.sum("bytes")).first()[0] or 0
        # A word has six bytes or so; half of the pairs are new.
        bits = min(RANGE_BITS, max(0, (size // 12 // rules.range_grams).bit_length()))

        end = _trim(np.array([END], dtype=np.uint64), bits)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What each block holds: for words (kind 0) and pairs (kind 1) and each range the distinct n-grams with their counts in training rows."""
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def out(block: int) -> Iterator[pa.RecordBatch]:
                on = np.concatenate([h[2] for h in held])
                rows: list[tuple] = []
                for kind in (0, 1):
                    grams, n = _tally(np.concatenate([h[kind] for h in held]), on)
                    cut = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else [0, len(grams)]
                    rows += [(kind, k, block, cut[k + 1] - cut[k], _pack(grams[cut[k] : cut[k + 1]], n[cut[k] : cut[k + 1]])) for k in range(1 << bits) if cut[k] < cut[k + 1]]
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "range", "block", "n", "data"])

            last = None
            for batch in batches:
                block = batch.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else []
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if last is not None and block[lo] != last and held:
                        yield from out(last)
                    last = int(block[lo])
                    part = batch.slice(lo, hi - lo)
                    train = np.array(part.column("_train").to_pylist(), dtype=float)
                    for a, b, t in texts_of(part.column("_t"), LOWER):
                        tokens, ends = token_hashes(t)
                        held.append((tokens, pair_hashes(tokens, ends), np.repeat(train[a:b], t.words + 1)))
            if held:
                yield from out(last)

        asked = stored.select("block", "_train", "_t").mapInArrow(ask, "kind int, range int, block long, n long, data binary")

        def add_up(key: tuple, table: pa.Table) -> pa.Table:
            """Totals of one range: to each block those that differ from its own counts, and to all (block -1) how many words and tokens there are."""
            kind, blocks = key[0].as_py(), table.column("block").to_pylist()
            lists = [_unpack(d, n) for d, n in zip(table.column("data").to_pylist(), table.column("n").to_pylist(), strict=True)]
            grams, back = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
            own = np.concatenate([x[1] for x in lists])
            total = np.bincount(back, weights=own, minlength=len(grams)).astype(np.int64)
            out, at = [], 0
            for block, (values, counts) in zip(blocks, lists, strict=True):
                all_ = total[back[at : at + len(values)]]
                at += len(values)
                new = all_ != counts
                if new.any():
                    out.append((block, int(new.sum()), _pack(values[new], all_[new])))
            if kind == 0:
                out.append((-1, int((total > 0).sum()), int(total.sum()).to_bytes(8, "little")))
            cols = [pa.array([kind] * len(out), pa.int32()), pa.array([key[1].as_py()] * len(out), pa.int32()), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary())))]
            return pa.Table.from_arrays(cols, names=["kind", "range", "block", "n", "data"])

        answers = scratch.keep(asked.groupBy("kind", "range").applyInArrow(add_up, "kind int, range int, block long, n long, data binary"))
        sums = answers.where("block = -1").select("n", "data").collect()  # a row for each range
        kinds, total = sum(r["n"] for r in sums), sum(int.from_bytes(r["data"], "little") for r in sums)

        def run(key: tuple, docs: pa.Table, got: pa.Table) -> pa.Table:
            texts, train = docs.column("_t").combine_chunks(), np.array(docs.column("_train").to_pylist(), dtype=float)
            parts = []
            for a, b, t in texts_of(texts, LOWER):
                tokens, ends = token_hashes(t)
                parts.append((_trim(tokens, bits), _trim(pair_hashes(tokens, ends), bits), ends, np.repeat(train[a:b], t.words + 1)))
            told: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
            for kind, k, n, data in zip(*(got.column(c).to_pylist() for c in ("kind", "range", "n", "data")), strict=True):
                values, counts = _unpack(data, n)
                told[kind].append((values | (np.uint64(k) << np.uint64(8 * SENT)), counts))
            model = []
            for kind in (0, 1):
                grams, n = _tally(np.concatenate([p[kind] for p in parts]), np.concatenate([p[3] for p in parts]))
                for values, counts in told[kind]:
                    n[np.searchsorted(grams, values)] = counts
                model += [grams[n > 0], n[n > 0]]
            automaton = Automaton(*model, total, kinds, rules)
            cols = [np.concatenate(x) for x in zip(*((np.diff(ends, prepend=0), *automaton.score(tokens, pairs, ends, end)) for tokens, pairs, ends, _ in parts), strict=True)]
            return pa.table([docs.column("_id"), docs.column("_train"), pa.array(cols[0], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[3], pa.float64())], names=[id_col, "trains", "n_tokens", "n_known", "base_score", "score"])

        schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, trains boolean, n_tokens long, n_known long, base_score double, score double"
        scored = stored.select("block", "_id", "_train", "_t").groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, schema)
        return materialise(scored).withColumn("train_tokens", F.lit(total).cast("long"))
    finally:
        scratch.clear()
