"""Packing by concatenate and cut: token totals of partitions, prefix sums to global offsets, fixed windows."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import free_name, materialise, small_batches

#: Words, and pieces of words, that a Python worker remembers before it starts anew.
CACHE_WORDS = 600_000

#: Words that the quick encoder takes: printable ASCII and the letters of Latin-1. All others go through the tokenizer itself.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's split of a lower-cased word, for such words.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_END = b"\xff"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids by word; a word that is not there is encoded and kept."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = self.encode(word)
        return out


class WordEncoder:
    """Ids of whole texts by a word-level BPE file, equal to those of the tokenizers library.

    White space never lies inside a piece of this vocabulary, so a text's ids are those of its
    words in turn and a word is encoded once. Words of plain letters and marks are merged by rank with
    the file's own vocabulary; any other word is encoded by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = _Words(self.word)
        self.pieces = _Words(lambda piece: array("I", self.quick.encode_single_piece(piece + _END)).tobytes())
        self.quick = self._ranks()

    def _ranks(self):
        """The vocabulary as byte strings by rank, the end of a word written as one byte that UTF-8 does not have."""
        from tiktoken import _tiktoken

        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        spec = json.loads(self.tokenizer.to_str())["model"]
        if spec.get("end_of_word_suffix") != "</w>":
            return None
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {_END: len(vocab) + 2}
        for token, number in vocab.items():
            body = token.removesuffix("</w>")
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + (_END if body != token else b"")] = number
        return _tiktoken.CoreBPE(ranks, {}, r"\S+")

    def word(self, word: bytes) -> bytes:
        """Ids of one word as 32-bit integers."""
        pieces = self.pieces
        low = word.lower()
        core = low.rstrip(b".,;:!?|")
        if self.quick is not None and core.isalpha():  # ASCII letters, then marks
            return pieces[core] + pieces[low[len(core) :]] if core != low else pieces[core]
        if self.quick is not None and b"<|" not in word and _PLAIN.fullmatch(text := word.decode()):
            return b"".join([pieces[p.encode()] for p in _PIECES.findall(text.lower())])
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, 4 bytes each; null is empty."""
        return b"".join(map(self.cache.__getitem__, (text or "").encode().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize(df: DataFrame, path: str, text_col: str = "text", end_id: int = 1, ids: str = "ids") -> DataFrame:
    """The input without its text, with ids (binary, 32 bits little-endian, end_id last), n_ids,
    the partition, and the ids before the document in its partition."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col]
    src = df.select(*keep, F.col(text_col).alias(free_name(df, "_t")))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), f"`{ids}` binary", "_n long", "_part int", "_before long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            col = [enc.encode(t) + end for t in batch.column(len(keep)).to_pylist()]
            n = np.array([len(x) // 4 for x in col], dtype=np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(col, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(at)], names=[*keep, ids, "_n", "_part", "_before"])

    return src.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: the documents end to end, cut at every multiple of it.

    Per piece: the id, start (the document's tokens before it), length, ids (binary, 32 bits little-endian),
    doc_tokens, sequence_id, offset, last (whether the document ends here) and padding (what its sequence lacks, only the last one
    lacks any). Each document ends with end_id, so a null or empty text makes one piece of one token. Rows
    that repeat are packed each. No row in gives none out; other columns are not looked at.

    Pass one tokenises and writes ids with running totals per partition. Pass two adds up the
    partitions' totals, one row each, and cuts; documents are never shuffled.
    """
    tokens = materialise(tokenize(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), tokenizer or default_tokenizer(), "_text", end_id))
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("total"))
    # One row for each partition, so the frame over all of them is small.
    bases = totals.select(F.col("_part").alias("p"), (F.sum("total").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("total")).alias("base"), F.sum("total").over(W.partitionBy()).alias("all"))
    placed = tokens.join(F.broadcast(bases), tokens["_part"] == F.col("p")).select("_id", "ids", "_n", (F.col("base") + F.col("_before")).alias("at"), "all")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, last boolean, padding long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            whole = batch.column(4)[0].as_py() if batch.num_rows else 0
            first, stop = at // length, (at + n - 1) // length
            count = stop - first + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
            begin = np.maximum(seq * length, at[row])
            end = np.minimum((seq + 1) * length, at[row] + n[row])
            col = batch.column(1)
            view = [memoryview(col[i].as_buffer()) for i in range(len(n))]
            start = begin - at[row]
            pieces = [view[r][4 * s : 4 * e].tobytes() for r, s, e in zip(row.tolist(), start.tolist(), (end - at[row]).tolist(), strict=True)]
            padding = np.maximum((seq + 1) * length - whole, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(pieces, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(begin - seq * length), pa.array(end == at[row] + n[row]), pa.array(padding)],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "last", "padding"],
            )

    return placed.mapInArrow(cut, schema)
