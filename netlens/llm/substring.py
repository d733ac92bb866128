"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is 13 consecutive words of one document. A word is removed if a window that covers it
also starts in a document with a smaller id. Every step is linear in the text:

1. *Candidates.* Every window has an anchor, the five-word run in it with the smallest hash; equal
   windows have equal anchors. A run of windows with the same anchor is a segment. Tasks count, for
   each anchor, the documents and the different segments; what comes of it are two bitmaps of
   fixed size: anchors of two or more documents, and anchors with very many different segments.
2. *Segments.* All segments of candidate anchors go out as hashes with their document. The windows
   of an anchor with very many segments (a common phrase in ever new surroundings) go out one by
   one under their own hash, so no key gathers those surroundings.
3. *Confirmed passages.* Where the same segment occurs in a smaller document, all its windows go.
   What is left are the first occurrences, of anchors with several segments. Their texts are dealt
   to shards by anchor, so equal windows meet; a shard confirms the windows of two or more
   documents, compiles them, as sequences of word numbers, into one automaton, and streams its
   texts through it, which finds every occurrence of them.
4. *Removal.* Marks are gathered by document and the texts rewritten.

The bitmaps only save work: a false hit gives a segment that no other document shares. Hashes of
segments are compared under their anchor's, 128 bits together.

Null and empty texts have no words. Rows that repeat an id are one document to each other: neither
is smaller. Rows without an id keep all words and are no source. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bitmap, map_batches
from netlens.llm.hashing import INVERSE, Words, batch_words, grams, mix, powers
from netlens.session import stored

WIDTH = 13
ANCHOR = 5
#: Bits of a bitmap, 16 MB; as many as there are ranges at least, times eight.
BITS = 1 << 27
#: Bits of the bitmap of documents with something to remove.
PICK_BITS = 1 << 23
#: Different segments from which on an anchor's windows go out one by one.
MANY_SEGMENTS = 5_000
#: Texts in one shard, about.
SHARD_TEXTS = 20_000
#: Ranges of hashes for each partition of the input.
RANGES_PER_PARTITION = 4
#: Bytes of text that are hashed at once.
CHUNK_BYTES = 4 << 20


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Segments:
    """The segments of a batch: text, first word (in the batch), windows, hashes of anchor and words."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    segment: np.ndarray


def _sums(hashes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that hashes the words from ``start`` to before ``end``."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes) * powers(len(hashes)), dtype=np.uint64)])
    back = powers(len(hashes) + 1, INVERSE)
    return lambda start, end: mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def segments_of(found: Words, width: int) -> Segments:
    """All segments, in the order of the texts."""
    h = grams(found.hashes, ANCHOR)
    span = width - ANCHOR + 1
    m = len(h) - span + 1
    none = np.zeros(0, dtype=np.int64)
    if m < 1:
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    least = h[:m].copy()
    for i in range(1, span):
        np.minimum(least, h[i : i + m], out=least)
    place = np.zeros(m, dtype=np.int64)
    for i in reversed(range(span)):
        place[h[i : i + m] == least] = i
    place += np.arange(m)
    text = found.of()
    inside = np.flatnonzero(text[:m] == text[width - 1 : width - 1 + m])
    if not len(inside):
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    at, own = place[inside], text[inside]
    new = np.r_[True, (at[1:] != at[:-1]) | (own[1:] != own[:-1]) | (np.diff(inside) != 1)]
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, len(inside)])
    start = inside[begin]
    return Segments(own[begin], start, n, least[start], _sums(found.hashes)(start, start + n + width - 1))


@dataclass(frozen=True)
class Slots:
    """Where a hash is in the bitmaps: a range by its upper half, a slot of the range by its lower half."""

    ranges: int
    bits: int  # of a range, as a power of two

    def part(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)).astype(np.int64)

    def within(self, low: np.ndarray) -> np.ndarray:
        return (low >> np.uint32(32 - self.bits)).astype(np.int64)

    def hits(self, bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
        place = (self.part(h) << self.bits) + self.within(h.astype(np.uint32))
        return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


@dataclass(frozen=True)
class Candidates:
    slots: Slots
    some: np.ndarray  # bitmap of the anchors of two or more documents
    many: np.ndarray  # and of those with very many different segments
    segments: int  # different ones of the anchors in ``some``, about


def _chunks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a column of about ``CHUNK_BYTES``, with the place of their first row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES)))
        yield at, texts.slice(at, end - at)
        at = end


def recurring(docs: DataFrame, width: int = WIDTH, many: int = MANY_SEGMENTS, most_bits: int = BITS) -> Candidates:
    """Count documents and different segments of each anchor. A task's counts go out by range of
    the hash; there are as many ranges for each partition of the input, so a range keeps its size."""
    rows = docs.where("doc_id is not null and text is not null").select("text")
    ranges = RANGES_PER_PARTITION * max(1, rows.rdd.getNumPartitions())
    slots = Slots(ranges, max(3, (most_bits // ranges).bit_length() - 1))
    out = pa.schema([("part", pa.int32()), ("anchors", pa.binary()), ("segments", pa.binary()), ("documents", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (anchor, 16 bits of the segment's hash), each once for a document
        pairs = []
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                s = segments_of(batch_words(texts), width)
                order = np.lexsort((s.segment, s.key, s.text))
                key, segment, text = s.key[order], s.segment[order], s.text[order]
                once = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])] if len(key) else np.zeros(0, bool)
                pairs.append((key, (segment >> np.uint64(48)).astype(np.uint16), once))
        if not pairs:
            return
        key, segment, once = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((segment, key))
        key, segment, once = key[order], segment[order], once[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (segment[1:] != segment[:-1])]) if len(key) else np.zeros(0, int)
        documents = np.minimum(np.add.reduceat(once.astype(np.int64), new), 2).astype(np.uint8) if len(key) else np.zeros(0, np.uint8)
        key, segment = key[new], segment[new]
        cuts = np.searchsorted(slots.part(key), np.arange(ranges + 1))
        used = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
        low = key.astype(np.uint32)
        yield pa.RecordBatch.from_pydict(
            {"part": used} | {k: [v[cuts[i] : cuts[i + 1]].tobytes() for i in used] for k, v in (("anchors", low), ("segments", segment), ("documents", documents))},
            schema=out,
        )

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in pdf["anchors"]])
        segment = np.concatenate([np.frombuffer(b, dtype=np.uint16) for b in pdf["segments"]])
        documents = np.concatenate([np.frombuffer(b, dtype=np.uint8) for b in pdf["documents"]]).astype(np.int64)
        order = np.lexsort((segment, low))
        low, segment, documents = low[order], segment[order], documents[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        different = np.add.reduceat(np.r_[True, (low[1:] != low[:-1]) | (segment[1:] != segment[:-1])].astype(np.int64), first)
        shared = np.add.reduceat(documents, first) >= 2
        place = slots.within(low[first])
        flags = []
        for chosen in (shared, shared & (different >= many)):
            bits = np.zeros(1 << slots.bits, dtype=np.uint8)
            bits[place[chosen]] = 1
            flags.append(np.packbits(bits).tobytes())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "some": [flags[0]], "many": [flags[1]], "n": [int(different[shared].sum())]})

    counts = rows.mapInArrow(count, "part int, anchors binary, segments binary, documents binary").groupBy("part")
    size = 1 << slots.bits >> 3
    some, very = np.zeros(ranges * size, dtype=np.uint8), np.zeros(ranges * size, dtype=np.uint8)
    total = 0
    for r in counts.applyInPandas(put, "part int, some binary, many binary, n long").toLocalIterator():
        some[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["some"], dtype=np.uint8)
        very[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["many"], dtype=np.uint8)
        total += r["n"]
    return Candidates(slots, some, very, total)


OCCURRENCES = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("segment", pa.int64())]
)


def occurrences(rows: DataFrame, candidates: Broadcast, width: int) -> DataFrame:
    """doc_id, text_hash, start (word), n (windows), key, segment: all segments of candidate anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = candidates.value
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for base, texts in _chunks(batch.column(2)):
                w = batch_words(texts)
                s = segments_of(w, width)
                keep = found.slots.hits(found.some, s.key)
                many = keep & found.slots.hits(found.many, s.key)
                one = np.flatnonzero(keep & ~many)
                parts = [(s.text[one], s.start[one], s.n[one], s.key[one], s.segment[one])]
                split = np.flatnonzero(many)
                if len(split):
                    n = s.n[split]
                    start = np.repeat(s.start[split] - np.cumsum(np.r_[0, n[:-1]]), n) + np.arange(n.sum())
                    own = grams(w.hashes, width)[start]
                    parts.append((np.repeat(s.text[split], n), start, np.ones(len(start), np.int64), own, _sums(w.hashes)(start, start + width)))
                text, start, n, key, segment = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [ids[base + text], hashes[base + text], start - w.first[text], n, key.view(np.int64), segment.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OCCURRENCES, strict=True)], schema=OCCURRENCES)

    return rows.where("doc_id is not null and text is not null").mapInArrow(
        run, "doc_id long, text_hash long, start int, n int, key long, segment long"
    )


def locate(texts: list[tuple[list[bytes], int]], width: int) -> list[list[int]]:
    """For each text (words, document id): the windows that a text of a smaller id holds as well."""
    numbers: dict[bytes, int] = {}
    coded = []
    seen: dict[tuple[int, ...], tuple[int, int]] = {}
    for own, doc_id in texts:
        code = tuple([numbers.setdefault(w, len(numbers) + 1) for w in own])
        coded.append(code)
        for i in range(len(code) - width + 1):
            window = code[i : i + width]
            low, high = seen.get(window, (doc_id, doc_id))
            seen[window] = (min(low, doc_id), max(high, doc_id))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, (low, high) in seen.items():
        if low < high:
            automaton.add_word(window, low)
    del seen
    if not len(automaton):
        return [[] for _ in texts]
    automaton.make_automaton()
    return [[end - width + 1 for end, low in automaton.iter(code) if low < doc_id] for code, (_, doc_id) in zip(coded, texts, strict=True)]


def _place(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(PICK_BITS)).cast("int")


def _repeats(every: DataFrame) -> DataFrame:
    """doc_id, text_hash, marks: the segments of a document that a smaller document holds (start, n),
    and the first occurrences (start, n, key) of segments whose anchor has several."""
    low = every.groupBy("key", "segment").agg(F.min("doc_id").alias("low"))
    several = low.groupBy("key").agg(F.count("segment").alias("segments"), F.min("low").alias("lowest"))
    several = several.where("segments > 1 and lowest is not null").select("key", F.lit(True).alias("several"))
    placed = every.join(low.join(several, "key", "left"), ["key", "segment"]).where("doc_id > low or several")
    mark = F.struct("start", "n", F.when(F.col("doc_id") == F.col("low"), F.col("key")).alias("key"))
    return placed.groupBy("doc_id", "text_hash").agg(F.collect_list(mark).alias("marks"))


def _first_texts(joined: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, start, key, words: the texts of first occurrences."""

    def step(batch: dict) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "text_hash", "start", "key", "words")}
        for doc_id, text_hash, text, marks in zip(*[batch[k] for k in ("doc_id", "text_hash", "text", "marks")], strict=True):
            first = [m for m in marks or () if m["key"] is not None]
            w = words(text) if first else []
            for m in first:
                values = (doc_id, text_hash, m["start"], m["key"], b" ".join(w[m["start"] : m["start"] + m["n"] + width - 1]))
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
        return out

    return map_batches(joined, "doc_id long, text_hash long, start int, key long, words binary", lambda: step)


def _confirmed(texts: DataFrame, width: int, shards: int) -> DataFrame:
    """doc_id, text_hash, windows: the windows that a shard's automaton finds in a smaller document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = locate([(w.split(), d) for w, d in zip(pdf["words"], pdf["doc_id"], strict=True)], width)
        rows = [(d, h, s + i) for d, h, s, own in zip(pdf["doc_id"], pdf["text_hash"], pdf["start"], hits, strict=True) for i in own]
        return pd.DataFrame(rows, columns=["doc_id", "text_hash", "start"])

    sharded = texts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard")
    found = sharded.applyInPandas(run, "doc_id long, text_hash long, start int")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("windows"))


RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _rewrite(doc_ids: list, texts: list, marks: list, windows: list, width: int) -> dict:
    out: dict[str, list] = {"doc_id": doc_ids, "n_words": [], "n_removed": [], "kept": []}
    for text, own, more in zip(texts, marks, windows, strict=True):
        w = kept = words(text)
        runs = [(m["start"], m["n"]) for m in own or () if m["key"] is None] + [(i, 1) for i in more or ()]
        if runs:
            gone = bytearray(len(w))
            for start, n in runs:
                gone[start : start + n + width - 1] = b"\1" * (n + width - 1)
            kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out["n_words"].append(len(w))
        out["n_removed"].append(len(w) - len(kept))
        out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, many: int = MANY_SEGMENTS, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = recurring(rows, width, many)
    sent = rows.sparkSession.sparkContext.broadcast(found)
    marks = stored(_repeats(occurrences(rows, sent, width)), "repeats")
    bits = rows.sparkSession.sparkContext.broadcast(bitmap(marks.select(_place("doc_id").alias("place")), PICK_BITS))

    def picked(batch: dict, wanted: bool) -> list[int]:
        own = bits.value
        return [i for i, p in enumerate(batch["place"]) if bool(own[p >> 3] >> (7 - (p & 7)) & 1) == wanted]

    def touched(batch: dict) -> dict:
        keep = picked(batch, True)
        return {k: [batch[k][i] for i in keep] for k in ("doc_id", "text_hash", "text")}

    def plain(batch: dict) -> dict:
        keep = picked(batch, False)
        none = [None] * len(keep)
        return _rewrite([batch["doc_id"][i] for i in keep], [batch["text"][i] for i in keep], none, none, width)

    def rewrite(batch: dict) -> dict:
        return _rewrite(batch["doc_id"], batch["text"], batch["marks"], batch["windows"], width)

    # only documents with a mark are shuffled; their exchange serves both joins
    key = ["doc_id", "text_hash"]
    placed = rows.withColumn("place", _place("doc_id"))
    joined = map_batches(placed, "doc_id long, text_hash long, text string", lambda: touched).join(marks, key, "left")
    windows = _confirmed(_first_texts(joined, width), width, max(1, math.ceil(found.segments / shard_texts)))
    return map_batches(joined.join(windows, key, "left"), RESULT, lambda: rewrite).union(map_batches(placed, RESULT, lambda: plain))
