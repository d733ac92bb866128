"""Packing by power-of-two decomposition.

A document's token ids, closed by one end id, are cut into pieces whose lengths are powers of
two: whole pieces of the largest length first, then the binary digits of the rest from high to
low. Every piece is a sequence of its own in the bucket of its length, so no sequence holds two
documents and none needs padding. A batch of training steps takes sequences from one bucket.

Null text counts as empty: its only token is the end id. Repeated rows and repeated ids are
packed row by row. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netlens.llm.common import map_batches

MAX_LENGTH = 2048
END_ID = 1
#: Text parts whose ids a Python worker remembers at once; beyond that it forgets them all.
CACHE_PARTS = 1_000_000

# Fixed value: how a byte-level BPE of this kind cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts whose words are the same under any table of Unicode: Latin letters, ASCII signs, space, newline.
PLAIN = re.compile("[ -~\nÀ-ÖØ-öø-ɏ]*")


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary writes for each byte: itself if it shows, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merge_ranks(path: str, tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """Bytes of every token by id, if merging by least id gives what the file's merges give.

    That is so if ids follow the order of the merges and every token, merged on its own, is one
    token again: then two neighbours that together spell a token stand for its own merge, as
    nothing outside them had a part in how they came about.
    """
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    letters, vocab = byte_letters(), model["vocab"]
    order = [vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)] for pair in model["merges"]]
    in_order = order == sorted(order) and len(vocab) == 256 + len(order) and all(vocab[c] < 256 for c in letters)
    if not in_order or any([t.id for t in tokenizer.model.tokenize(token)] != [i] for token, i in vocab.items()):
        return None
    return {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items()}


class PartEncoder:
    """Token ids of whole texts by parts that are remembered.

    The pre-tokenizer of a byte-level BPE always begins a new word at a space before a
    character that is no white space, so the parts between such spaces are encoded apart with
    equal results. Texts with other spaces go whole. A plain part or text is merged by ranks,
    which is several times faster than the tokenizer and gives its ids; any other, and
    one with the text of a special token, goes through the tokenizer.
    """

    #: Another space than the one before a word: before white space, or at the end.
    odd_space = re.compile(r" (?=\s|\Z)")

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        self.cache_parts = cache_parts
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = merge_ranks(path, self.tokenizer)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.known = _Memory(self._encode)

    def _encode(self, text: str) -> bytes:
        """The ids of a text that holds no special token's text, or goes to the tokenizer anyway."""
        if self.fast and PLAIN.fullmatch(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return self._slowly(text)

    def _slowly(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _text(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._slowly(text)
        if self.odd_space.search(text):
            return self._encode(text)
        first, *parts = text.split(" ")
        return self._encode(first) + b"".join(map(self.known.__getitem__, parts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.cache_parts:
            self.known.clear()
        return list(map(self._text, texts))


class _Memory(dict):
    """Ids of parts; a part that is asked for the first time is encoded behind a space."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.encode(f" {part}")
        return ids


@functools.cache
def encoder(path: str, cache_parts: int) -> PartEncoder:
    """The encoder of this Python worker; its memory serves one task after another.

    Spark runs a task on each core, so the tokenizer's own threads would only contend.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PartEncoder(path, cache_parts)


def piece_lengths(total: int, longest: int = MAX_LENGTH) -> list[int]:
    """Powers of two that sum to ``total``: the longest as often as it fits, then falling."""
    whole, rest = divmod(total, longest)
    bits = [1 << b for b in reversed(range(longest.bit_length())) if rest >> b & 1]
    return [longest] * whole + bits


def pack(docs: DataFrame, tokenizer_path: str, longest: int = MAX_LENGTH, keep_ids: bool = True, cache_parts: int = CACHE_PARTS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    ``cache_parts`` trades memory of the Python workers for speed. ``ids`` (array of int) comes with ``keep_ids``. ``sequence_id`` is unique, not dense: the
    number of the task and the piece in it. ``bucket`` equals ``length``; write with
    ``partitionBy("bucket")`` to lay out one folder for each length.
    """
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def start():
        encode = encoder(tokenizer_path, cache_parts)
        end = np.array([END_ID], dtype="<u4").tobytes()

        def step(batch: dict) -> dict:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode([t or "" for t in batch["text"]]), strict=True):
                ids = np.frombuffer(ids + end, dtype="<u4")
                at = 0
                for length in piece_lengths(len(ids), longest):
                    piece = ids[at : at + length]
                    rows.append((doc_id, at, length, zlib.crc32(piece.tobytes()), len(ids), piece if keep_ids else None))
                    at += length
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
            columns = dict(zip(names, zip(*rows, strict=True), strict=True))
            if not keep_ids:
                del columns["ids"]
            return columns

        return step

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    pieces = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ddl, start)
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length")}
    )
