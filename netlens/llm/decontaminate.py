"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A pattern is
a window of ``width`` consecutive words of a benchmark item; a shorter item is one window. Each
document is scanned once; hits are word positions, and character offsets of the original text.

Every word of the benchmark has a code of two or more letters, as many as its words need, so a
window is a short string whatever its words are, and a word that the benchmark does not have is
one fixed code. The automaton runs over codes; a match that does not begin with a code's first
letter is none. It is built once in each Python worker from one broadcast. Both grow with the
benchmark (about 1.5 kB a window), never with the documents.

Null or empty text has no words and no hits. Repeated documents are scanned row by row, items
that repeat (same id or same text) count once each by id; items with a null id or no word are
left out. An empty benchmark gives no hits.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import map_batches

WIDTH = 10
#: Letters of a code; the last one stands for words that the benchmark does not have.
LETTERS = "".join(map(chr, range(33, 126)))
OTHER = "~"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The automaton of this Python worker by name, the last one only.
_BUILT: dict[str, Matcher] = {}


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text. Bytes are replaced one by one, so no multi-byte character breaks."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def patterns(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows: window (words with a space on either side), n (words), items (ids)."""

    def step(batch: dict) -> dict:
        rows = []
        for item_id, text in zip(batch["item_id"], batch["text"], strict=True):
            found = words(text)
            n = min(width, len(found))
            rows += [(item_id, f" {b' '.join(found[i : i + n]).decode('utf-8', 'surrogatepass')} ", n) for i in range(len(found) - n + 1) if n]
        return {k: [r[i] for r in rows] for i, k in enumerate(("item_id", "window", "n"))}

    known = items.select("item_id", "text").where("item_id is not null and text is not null")
    rows = map_batches(known.withColumn("item_id", F.col("item_id").cast("string")), "item_id string, window string, n int", lambda: step)
    return rows.groupBy("window").agg(F.first("n").alias("n"), F.collect_set("item_id").alias("items"))


@dataclass(frozen=True)
class Windows:
    """All windows of a benchmark in codes."""

    name: str  # of the automaton
    width: int  # letters of a code
    codes: dict[bytes, str]
    rows: list[tuple[str, int, list[str]]]  # window, n, items


class Matcher:
    """The automaton of all windows."""

    def __init__(self, windows: Windows):
        self.width, self.codes = windows.width, windows.codes
        self.other = OTHER * windows.width
        self.automaton = ahocorasick.Automaton()
        for window, n, items in windows.rows:
            self.automaton.add_word(window, (n, items))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, set[int], set[str]]:
        """Number of words, positions of hit words, ids of items."""
        found = words(text)
        hit: set[int] = set()
        items: set[str] = set()
        if len(self.automaton) and found:
            code, other = self.codes.get, self.other
            for end, (n, ids) in self.automaton.iter("".join([code(w, other) for w in found])):
                last, rest = divmod(end + 1, self.width)
                if not rest:
                    hit.update(range(last - n, last))
                    items.update(ids)
        return len(found), hit, items


def _matcher(sent: Broadcast) -> Matcher:
    name = sent.value.name
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Matcher(sent.value)
    return _BUILT[name]


RESULT = "n_words long, hit array<long>, items array<string>, spans array<struct<start:long,end:long>>"


def code_width(n: int) -> int:
    """Letters that codes of ``n`` words need, two at least."""
    width = 2
    while len(LETTERS) ** width < n:
        width += 1
    return width


def _code(i: int, width: int) -> str:
    out = []
    for _ in range(width):
        i, digit = divmod(i, len(LETTERS))
        out.append(LETTERS[digit])
    return "".join(out)


def windows_of(items: DataFrame, width: int = WIDTH) -> Broadcast:
    """The windows of the benchmark, broadcast."""
    rows = patterns(items, width).collect()
    split = [r["window"].encode("utf-8", "surrogatepass").split() for r in rows]
    every = sorted({w for found in split for w in found})
    letters = code_width(len(every))
    codes = {w: _code(i, letters) for i, w in enumerate(every)}
    coded = [("".join(codes[w] for w in found), r["n"], r["items"]) for found, r in zip(split, rows, strict=True)]
    return items.sparkSession.sparkContext.broadcast(Windows(uuid.uuid4().hex, letters, codes, coded))


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, hit (word positions), items (ids, sorted), spans
    (offsets of each hit word in the original text, end exclusive)."""
    sent = windows_of(items, width)

    def start():
        matcher = _matcher(sent)

        def step(batch: dict) -> dict:
            out: dict[str, list] = {"doc_id": batch["doc_id"]} | {k: [] for k in ("n_words", "hit", "items", "spans")}
            for text in batch["text"]:
                n, hit, ids = matcher.scan(text)
                order = sorted(hit)
                at = [m.span() for m in WORD.finditer(text)] if order else []
                spans = [{"start": at[i][0], "end": at[i][1]} for i in order]
                for k, v in (("n_words", n), ("hit", order), ("items", sorted(ids)), ("spans", spans)):
                    out[k].append(v)
            return out

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, {RESULT}", start)


def item_list(items: Column) -> Column:
    """Ids joined by commas, in their order as strings."""
    return F.array_join(items, ",")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no window of the benchmark."""
    sent = windows_of(items, width)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        matcher = _matcher(sent)
        return pd.Series([not matcher.scan(t)[2] for t in texts], dtype=bool)

    return docs.where(clean(F.col("text")))
