"""Near-duplicates by MinHash with odd sketches.

A document's set holds its distinct five-word shingles (a shorter text is one shingle). Of 160
MinHash samples, 40 bands of four find candidates, which misses a pair of similarity 0.75 with a
chance of 3 in 10 million. All samples are also folded into an odd sketch, a bitmap in which each
sample flips one bit; the population count of two sketches' XOR estimates their similarity, and
candidates far below the threshold are dropped. What is left is confirmed on the full sets.

Equal sets meet first, by a 128-bit hash, and one document stands for them. Buckets of the first
band with several blocks of members then take one linear pass: each block is compared inside and
with one other block, so a large group of near copies is one component after it. Bands are taken
in three rounds, and components are found after each. A round only looks at buckets that still hold
members of different components. Members outside a bucket's largest component are compared with
each other there, in blocks of bounded size (in rows and in bytes of sets); those of the largest component stay at home, in blocks
of their component, and are visited by the outsiders that share a bucket with the block, once for
all bands. A comparison goes by the sketches, and by the full sets where these allow a link; one
link is handed on for each two components it joins. So no pairs are listed, a group of near copies
is settled by few comparisons for each member, and no link that joins components is lost.

Null and empty texts have no set and are linked with nothing. Rows that repeat an id are judged
each by its own text; a null id stays null and is its own component.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import bitmap, free_names, map_batches, release, settled, split_rows, stable
from netlens.llm.graph import components
from netlens.llm.hashing import batch_words, grams, mix

WIDTH = 5
BANDS = 40
ROWS = 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH_BITS = 512
#: Least estimated similarity of a candidate: seven standard deviations below 0.75.
LEAST_ESTIMATE = 0.5
#: Members of one bucket in one block, about, and bytes of their sets; two blocks at most meet in a task.
BLOCK = 500
BLOCK_BYTES = 64 << 20
#: Bands of each round, up to and without.
ROUNDS = ((0, 1), (1, 4), (4, BANDS))
#: Bits of the bitmap that picks the documents whose sets are needed.
PICK_BITS = 1 << 23

LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(_A)
#: Most bits in which the sketches of a candidate pair may differ.
MOST_DIFFERENT = int(SKETCH_BITS / 2 * (1 - np.exp(-2 * (2 * SAMPLES * (1 - LEAST_ESTIMATE)) / SKETCH_BITS)))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    found = batch_words(pa.array(texts, pa.string()), lower=True)
    out = []
    for a, b in pairwise(found.first.tolist()):
        out.append(np.unique(grams(found.hashes[a:b], min(WIDTH, b - a))) if b > a else found.hashes[:0])
    return out


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value under each of the hash functions."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        part = np.multiply.outer(_A, shingles[i : i + 1024])
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band is part of it."""
    parts = mix(least).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as 64-bit words."""
    place = mix(least + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(SKETCH_BITS)
    flips = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (null without shingles), bands, sketch of every row."""

    def start():
        def step(batch: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_shingles", "set_hash", "bands", "sketch")}
            for shingles in shingle_sets(batch["text"]):
                out["n_shingles"].append(len(shingles))
                if len(shingles):
                    least = samples(shingles)
                    out["set_hash"].append(xxhash.xxh3_128_hexdigest(shingles.tobytes()))
                    out["bands"].append(band_keys(least))
                    out["sketch"].append(odd_sketch(least))
                else:
                    for k in ("set_hash", "bands", "sketch"):
                        out[k].append(None)
            return {"doc_id": batch["doc_id"]} | out

        return step

    ddl = "doc_id long, n_shingles long, set_hash string, bands array<long>, sketch array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), ddl, start)


def _place(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PICK_BITS)).cast("int")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set: the full sets (sorted 64-bit hashes) of the documents that stand for the ids (id, set_hash)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(_place("id").alias("place")), PICK_BITS))

    def start():
        bits = sent.value

        def step(batch: dict) -> dict:
            picked = [i for i, p in enumerate(batch["place"]) if bits[p >> 3] >> (7 - (p & 7)) & 1]
            sets = shingle_sets([batch["text"][i] for i in picked])
            full = [(batch["doc_id"][i], s.tobytes()) for i, s in zip(picked, sets, strict=True) if len(s)]
            rows = [(d, xxhash.xxh3_128_hexdigest(s), s) for d, s in full]
            return {k: [r[i] for r in rows] for i, k in enumerate(("id", "set_hash", "set"))}

        return step

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("place", _place("doc_id"))
    found = map_batches(rows.where("doc_id is not null"), "id long, set_hash string, set binary", start)
    return found.join(ids, ["id", "set_hash"], "left_semi").dropDuplicates(["id"]).select("id", "set")


def join_block(
    ids: list[int], components: list[int], blocks: list[int], sketches: np.ndarray, sets: list[np.ndarray]
) -> list[tuple[int, int]]:
    """Links that join components of one block, or of two that meet: then only links across.

    Members of the largest component need no comparison of their own: every pair that matters has
    a member outside.
    """
    root = {c: c for c in components}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    if len(root) == 1:
        return []
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum([0, *sizes[:-1]])
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    marks = np.zeros(len(values), dtype=np.int32)
    block, label = np.array(blocks), np.array(components)
    across = len(set(blocks)) == 2
    largest = Counter(components).most_common(1)[0][0]
    links = []
    for y in range(len(ids)):
        if find(components[y]) == find(largest):
            continue
        bound = 100 * np.minimum(sizes, sizes[y]) >= 75 * np.maximum(sizes, sizes[y])
        may = bound & (np.bitwise_count(sketches ^ sketches[y]).sum(axis=1) <= MOST_DIFFERENT) & (label != label[y])
        if across:
            may &= block != blocks[y]
        if not may.any():
            continue
        own = local[starts[y] : starts[y] + sizes[y]]
        marks[own] = 1
        both = np.add.reduceat(marks[local], starts)
        marks[own] = 0
        for z in np.flatnonzero(may & (100 * both >= 75 * (sizes + sizes[y] - both))).tolist():
            p, q = find(components[y]), find(components[z])
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((ids[y], ids[z]))
    return links


def _weight(n_shingles: Column) -> Column:
    """What a member counts in its block: one, and more if its set is large."""
    return F.lit(1.0) + n_shingles * (8.0 * BLOCK / BLOCK_BYTES)


def _parts(n: str) -> Column:
    """Number of blocks that members of this weight take."""
    return F.ceil(F.col(n) / (1.0 + BLOCK)).cast("int")


def _block(parts: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _linear(buckets: DataFrame) -> DataFrame:
    """Meetings of buckets (key, id, w) with more than one block, as in ``_meetings``: each block by
    itself and with the bucket's first one, which grows with the members and no faster."""
    large = buckets.groupBy("key").agg(F.sum("w").alias("n")).withColumn("parts", _parts("n")).where("parts > 1").select("key", "parts")
    open_, tasks = settled(buckets.join(large, "key").withColumn("own", _block("parts")))
    first = open_.where("own = 0").withColumn("c", F.explode(F.sequence(F.lit(1), F.col("parts") - 1)))
    inside = open_.select("key", F.col("own").alias("b"), F.col("own").alias("c"), "own", "id")
    across = open_.where("own > 0").select("key", F.lit(0).alias("b"), F.col("own").alias("c"), "own", "id")
    across = across.union(first.select("key", F.lit(0).alias("b"), "c", "own", "id"))
    every = inside.union(across).coalesce(tasks)
    return every.select(F.lit(2).alias("kind"), F.col("key").alias("a"), "b", "c", "own", "id", F.col("id").alias("component"))


def _meetings(labelled: DataFrame) -> DataFrame:
    """Which members meet in a round: group (kind, a, b, c), own, id, component. ``labelled`` has
    key, id, w and component. Members of one group with the same ``own`` need no comparison where
    there are two values of it."""
    counts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    largest = largest.where("components > 1").select("key", F.col("top.component").alias("largest"))
    open_, tasks = settled(labelled.join(largest, "key"))
    outside, inside = open_.where("component <> largest"), open_.where("component = largest")

    # outsiders of a bucket among themselves
    among = outside.groupBy("key").agg(F.sum("w").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    among = outside.join(among.where("lo < hi").select("key", _parts("n").alias("parts")), "key").coalesce(tasks)
    among = among.withColumn("own", _block("parts")).withColumn("other", _every("parts"))
    blocks = [F.least("own", "other").alias("b"), F.greatest("own", "other").alias("c")]
    among = among.select(F.lit(0).alias("kind"), F.col("key").alias("a"), *blocks, "own", "id", "component")

    # blocks of largest components, and their visitors
    home = inside.select("id", "component", "w").distinct().coalesce(tasks)
    sizes = home.groupBy("component").agg(F.sum("w").alias("n")).select("component", _parts("n").alias("parts"))
    home = home.join(sizes, "component").withColumn("block", _block("parts")).select("id", "component", "block").coalesce(tasks)
    near = inside.select("key", "id").join(home.select("id", "block"), "id").select("key", "block").coalesce(tasks).distinct()
    visits = outside.join(near.coalesce(tasks), "key").select(F.col("largest").alias("a"), F.col("block").alias("b"), "id", "component", "w")
    visits, _ = settled(visits.coalesce(tasks).distinct())
    guests = visits.groupBy("a", "b").agg(F.sum("w").alias("n")).select("a", "b", _parts("n").alias("parts"))
    visits = visits.join(guests, ["a", "b"]).withColumn("c", _block("parts"))
    home = home.select("id", "component", F.col("component").alias("a"), F.col("block").alias("b")).join(guests, ["a", "b"]).withColumn("c", _every("parts"))
    group = [F.lit(1).alias("kind"), "a", "b", "c"]
    visits = visits.select(*group, F.lit(0).alias("own"), "id", "component")
    home = home.select(*group, F.lit(1).alias("own"), "id", "component")
    return among.union(visits.coalesce(tasks)).union(home.coalesce(tasks))


def _round_links(buckets: DataFrame, found: DataFrame | None, sets: DataFrame) -> DataFrame:
    """Links (u, v) between members of different components that share a bucket (key, id, w)."""
    if found is None:
        labelled = buckets.withColumn("component", F.col("id"))
    else:
        labelled = buckets.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return _links(_meetings(labelled), sets)


def _links(meetings: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that the meetings' blocks give."""
    group = ("kind", "a", "b", "c")
    names = ("id", "component", "own", "sketch", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def settle() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, components, blocks, sketches, sets = zip(*held, strict=True)
            full = [np.frombuffer(s, dtype=np.uint64) for s in sets]
            return join_block(list(ids), list(components), list(blocks), np.array(sketches, dtype=np.int64).view(np.uint64), full)

        def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"u": [u for u, _ in links], "v": [v for _, v in links]}, schema=LINKS)

        for batch in batches:
            links = []
            rows = batch.to_pydict()
            for own, row in zip(zip(*[rows[n] for n in group], strict=True), zip(*[rows[n] for n in names], strict=True), strict=True):
                if own != at:
                    links += settle()
                    at, held = own, []
                held.append(row)
            yield out(links)
        yield out(settle())
        held = []
        release()

    together = meetings.join(sets, "id").repartition(*group).sortWithinPartitions(*group, "id")
    return together.select(*group, *names).mapInArrow(run, "u long, v long")


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable, its own if
    alone), kept (doc_id = component_id)."""
    rows = stable(signatures(docs))
    stands, _ = settled(rows.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("id")))
    members = rows.join(stands.withColumnRenamed("set_hash", "h"), (F.col("doc_id") == F.col("id")) & (F.col("set_hash") == F.col("h")))
    members = members.select("id", "set_hash", "bands", "sketch", _weight(F.col("n_shingles")).alias("w"))
    members, _ = settled(members.dropDuplicates(["id"]), 20_000)

    keyed = members.select(F.posexplode("bands").alias("band", "key"), "id", "w")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets, _ = settled(keyed.join(shared, "key", "left_semi"))
    wanted = members.select("id", "set_hash").join(buckets.select("id").distinct(), "id", "left_semi")
    sets, _ = settled(_sets(docs, wanted).join(members.select("id", "sketch"), "id"), 10_000)

    links = stable(_links(_linear(buckets.where("band = 0").select("key", "id", "w")), sets))
    found = None if links.isEmpty() else settled(components(links))[0]
    for first, end in ROUNDS:
        own = buckets.where((F.col("band") >= first) & (F.col("band") < end)).select("key", "id", "w")
        links = _round_links(own, found, sets)
        if found is not None:
            links = links.union(found.select("node", "component"))
        found, _ = settled(components(links))

    labels = stands.join(found.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(labels, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but one document of each class.

    Of rows that repeat the kept id with equal text one stays; rows without an id all stay.
    """
    own_id, rows, kept = free_names(docs, "_id", "_rows", "_kept")
    found = classes(docs.select("doc_id", "text")).where("doc_id is not null").groupBy(F.col("doc_id").alias(own_id))
    found = stable(found.agg(F.count(F.lit(1)).alias(rows), F.bool_or("kept").alias(kept)))
    special = found.where((F.col(rows) > 1) | ~F.col(kept))
    place = _place(F.col("doc_id").cast("long"))
    maybe, plain = split_rows(docs, place, special.select(_place(F.col(own_id)).alias("place")), PICK_BITS)
    joined = maybe.join(found.where(F.col(kept)), F.col("doc_id").cast("long") == F.col(own_id))
    names = [f"`{c}`" for c in docs.columns]
    again = joined.where(F.col(rows) > 1).dropDuplicates(["doc_id", "text"])
    no_id = maybe.where("doc_id is null")
    return plain.select(*names).union(joined.where(F.col(rows) == 1).select(*names)).union(again.select(*names)).union(no_id.select(*names))
