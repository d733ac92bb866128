"""Fill-in-middle transformation with SWAR words.

The UTF-8 bytes of a whole Arrow batch are viewed as 64-bit words. Bytes that end a unit are
marked by arithmetic on eight bytes at once, ``bitwise_count`` counts the marks of each word,
a cumulative sum over words answers rank, and a search in it finds the word of the k-th mark; the
mark inside the word is found by clearing lower ones. A text is never walked unit by unit.

A unit is a line (``[^\\n]*\\n|[^\\n]+``) or a code point. The two cuts and the form of a document
depend on its id alone, so a run can be repeated.

Null text counts as empty: the form is ``plain`` and the output empty. A null id draws like an id
without digits. Repeated rows each give the same row. Other columns are not read; an empty table
gives no rows. A batch holds at most a few whole texts at a time, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netlens.llm.common import release

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7

LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
HIGH = np.uint64(0x8080808080808080)
NEWLINES = np.uint64(0x0A0A0A0A0A0A0A0A)
ONE = np.uint64(1)


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words; zero bytes fill up the last one, and one word follows."""
    padded = np.zeros((len(data) // 8 + 2) * 8, dtype=np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def newline_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a newline, and no other bit."""
    x = words ^ NEWLINES
    return ~(((x & LOW7) + LOW7) | x | LOW7)


def continuation_marks(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx."""
    return words & ~(words << ONE) & HIGH


def code_point_end_marks(words: np.ndarray, size: int) -> np.ndarray:
    """The high bit of every byte of ``size`` that the next code point (or the end) follows."""
    follows = continuation_marks(words)
    later = np.append(follows[1:], np.uint64(0))
    marks = ~((follows >> np.uint64(8)) | (later << np.uint64(56))) & HIGH
    whole, rest = divmod(size, 8)
    marks[whole:] &= (ONE << np.uint64(8 * rest)) - ONE if rest else np.uint64(0)
    marks[whole + 1 :] = 0
    return marks


class Marks:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks among the bytes before each position."""
        word = at >> 3
        below = (ONE << ((at & 7) * 8).astype(np.uint64)) - ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th mark, counted from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[word]
        value = self.marks[word]
        for _ in range(7):  # a word has eight bytes
            value = np.where(left > 0, value & (value - ONE), value)
            left = left - 1
        return (word << 3) + (np.bitwise_count((value & (~value + ONE)) - ONE) >> 3)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def cuts(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Marks]:
    """Units of each text, and the byte positions of its two cuts.

    ``offsets`` has the texts' bounds in ``data``, ``drawn`` the two numbers of each text. The
    last of the four results counts continuation bytes.
    """
    words = as_words(data)
    ends = Marks(newline_marks(words) if unit == "line" else code_point_end_marks(words, len(data)))
    start, end = offsets[:-1], offsets[1:]
    before = ends.rank(start)
    marked = ends.rank(end) - before
    # the rest behind the last newline is a unit too
    last = data[np.maximum(end - 1, 0)] if len(data) else np.zeros(len(end), np.uint8)
    open_end = (end > start) & (last != 10) if unit == "line" else np.zeros(len(end), dtype=bool)
    n = marked + open_end

    def position(count: np.ndarray) -> np.ndarray:
        inner = (count > 0) & (count <= marked)
        at = np.where(count > marked, end, start)
        at[inner] = ends.select((before + count - 1)[inner]) + 1
        return at

    pair = np.sort(drawn % (n + 1)[:, None], axis=1)
    return n, position(pair[:, 0]), position(pair[:, 1]), Marks(continuation_marks(words))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Marks must stay apart in any output: none inside another, no end of one that begins another."""
    for a in sentinels:
        for b in sentinels:
            overlap = any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b))))
            if not a or overlap or (a in b and a is not b):
                raise ValueError(f"sentinels {a!r} and {b!r} can be mistaken for each other")


def transform(
    docs: DataFrame,
    unit: str = "line",
    rate: int = 100,
    spm_rate: int = 50,
    seed: int = SEED,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` per cent of the documents are cut, of these ``spm_rate`` per cent suffix first. A
    text that is empty or holds a sentinel stays plain. The characters are null where plain.
    """
    if unit not in ("line", "code_point"):
        raise ValueError(f"unit {unit!r}")
    check_sentinels(sentinels)
    prefix_mark, suffix_mark, middle_mark = (s.encode() for s in sentinels)
    held = re.compile(b"|".join(re.escape(s.encode()) for s in sentinels))
    kind = T.StructType.fromDDL("doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    target = to_arrow_schema(kind)

    def one_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        ids = batch.column(0).to_pylist()
        drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64)
        n, first, second, inside = cuts(data, offsets, drawn[:, :2], unit)
        start, end = offsets[:-1], offsets[1:]
        skipped = inside.rank(np.stack([start, first, second]))
        prefix_chars = first - start - (skipped[1] - skipped[0])
        middle_chars = second - first - (skipped[2] - skipped[1])
        raw = data.tobytes()
        forms, outputs = [], []
        for i in range(len(ids)):
            a, b, c, d = start[i], first[i], second[i], end[i]
            if a == d or drawn[i, 2] % 100 >= rate or held.search(raw, a, d):
                forms.append("plain")
                outputs.append(raw[a:d])
            elif drawn[i, 3] % 100 < spm_rate:
                forms.append("spm")
                outputs.append(b"".join((suffix_mark, raw[c:d], prefix_mark, raw[a:b], middle_mark, raw[b:c])))
            else:
                forms.append("psm")
                outputs.append(b"".join((prefix_mark, raw[a:b], suffix_mark, raw[c:d], middle_mark, raw[b:c])))
        plain = np.array([f == "plain" for f in forms], dtype=bool)
        columns = [
            pa.array(ids, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(prefix_chars, pa.int64(), mask=plain),
            pa.array(middle_chars, pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield one_batch(batch)
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone."""
    between = "|".join(r"\Q" + s + r"\E" for s in sentinels)
    part = F.split(output, between, -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
