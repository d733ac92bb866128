"""Divergence of sources by hash-consed segment trees over term ids.

Terms are counted by (lang, source). The kept terms of a language are dealt to blocks of ids by a
hash; inside a block they are numbered by falling count, so that rare terms stand side by side. A
task takes one block and builds a segment tree over its ids for each group: a leaf is a count,
an inner node the pair of its halves, and equal pairs are one node, whatever group or place they
come from. Two groups are compared by walking both trees at once from the root, level by level;
a pair of nodes that was met is not met again, so its leaves are priced once, and the sums go
back up along the same edges. A stretch without counts is one node, so sparse groups cost
little. Sums over blocks are added by Spark. All arithmetic is exact.

No task holds a language: a block has about ``block_terms`` terms, and the groups of a language
are dealt to tiles of about ``tile_groups``, each pair of tiles being a task of its own. Term counts
are added up inside each task first, so a group with a third of all rows is a few rows for each
term and task.

Null text, lang and source count as ''. A repeated row is a document of its own. Extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from netlens.llm.common import release, text_of
from netlens.session import stored

#: A term is kept in a language where so many of its documents have it.
LEAST_DOCS = 10
#: Ranks of the terms of a group that are returned.
TOP_TERMS = 10
SCALE = 1_000_000_000
BLOCK_TERMS = 4096
TILE_GROUPS = 64
#: Different terms that a task holds at once; then it hands over what it has counted.
HELD_TERMS = 300_000
#: Bytes of a text whose words are in memory at once.
SLICE_BYTES = 1 << 20

#: Bytes of terms (letters of ASCII in lower case, and all beyond ASCII); every other byte ends a term.
_LETTERS = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a slice of it at a time."""
    plain = text.translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial counts of each task: lang, source, term, count, docs."""
    kind = T.StructType.fromDDL("lang string, source string, term string, count long, docs long")
    target = to_arrow_schema(kind)

    def emit(counts: dict, in_docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            seen = in_docs[lang, source]
            terms = list(found)
            for at in range(0, len(terms), 20_000):
                part = terms[at : at + 20_000]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array(part, pa.binary()).cast(pa.string()),
                    pa.array([found[t] for t in part], pa.int64()),
                    pa.array([seen[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        in_docs: dict[tuple, Counter] = {}
        held = 0
        for batch in batches:
            groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            texts = batch.column(2).cast(pa.large_binary())
            for group, text in zip(groups, texts, strict=True):
                found = counts.setdefault(group, Counter())
                before = len(found)
                seen: set[bytes] = set()
                for words in term_slices(text.as_py()):
                    found.update(words)
                    seen.update(words)
                in_docs.setdefault(group, Counter()).update(seen)
                held += len(found) - before
                if held > HELD_TERMS:
                    yield from emit(counts, in_docs)
                    counts, in_docs, held = {}, {}, 0
        yield from emit(counts, in_docs)
        del counts, in_docs
        release()

    return docs.select(group_name("lang"), group_name("source"), text_of().alias("text")).mapInArrow(run, kind)


def group_name(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, count, and over the language lang_count; first marks one row of each term.

    One shuffle by (lang, term) serves the sums by group and by language.
    """
    dealt = count_terms(docs).repartition(F.col("lang"), F.col("term"))
    by_group = dealt.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    over = Window.partitionBy("lang", "term")
    summed = by_group.select(
        "lang",
        "source",
        "term",
        "count",
        F.sum("count").over(over).alias("lang_count"),
        F.sum("docs").over(over).alias("lang_docs"),
        (F.min("source").over(over) == F.col("source")).alias("first"),
    )
    return summed.where(F.col("lang_docs") >= least_docs).drop("lang_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact beyond 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * terms).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def exact_shares(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """``share`` in numpy: long division by three digits of base 1000, so that 64 bits are enough
    for totals up to 9 * 10^15."""
    below = total + 2 * terms
    rest = count + 2
    out = rest // below
    rest = rest % below
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


class Forest:
    """Hash-consed segment trees of equal width over one block of term ids.

    ``left[i]`` and ``right[i]`` name, for the nodes of level i, nodes of level i - 1; level 0 are
    the leaves, whose counts are ``leaf``. ``roots`` has one node of the top level for each group.
    A width that is no power of two is filled with leaves of count -1, which cost nothing.
    """

    def __init__(self, counts: np.ndarray):
        groups, width = counts.shape
        full = 1 << max(0, width - 1).bit_length()
        padded = np.full((groups, full), -1, dtype=np.int64)
        padded[:, :width] = counts
        self.leaf, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(padded.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        size = len(self.leaf)
        while nodes.shape[1] > 1:
            halves = nodes[:, 0::2].astype(np.int64) * size + nodes[:, 1::2]
            known, nodes = np.unique(halves, return_inverse=True)
            nodes = nodes.reshape(halves.shape)
            self.left.append(known // size)
            self.right.append(known % size)
            size = len(known)
        self.roots = nodes[:, 0]

    def sums(self, pairs: np.ndarray, price: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """For pairs of groups (rows of two indices) the sum over all leaves of
        ``price(pair, count, other_count)``."""
        pair = np.arange(len(pairs))
        a, b = self.roots[pairs[:, 0]], self.roots[pairs[:, 1]]
        edges = []
        for left, right in zip(reversed(self.left), reversed(self.right), strict=True):
            size = np.int64(max(left.max(), right.max()) + 1)
            codes = [(pair * size + half[a]) * size + half[b] for half in (left, right)]
            met, edge = np.unique(np.concatenate(codes), return_inverse=True)
            edges.append((edge[: len(pair)], edge[len(pair) :]))
            pair, a, b = met // (size * size), met // size % size, met % size
        count, other = self.leaf[a], self.leaf[b]
        value = np.where(count < 0, 0, price(pair, np.maximum(count, 0), np.maximum(other, 0)))
        for to_left, to_right in reversed(edges):
            value = value[to_left] + value[to_right]
        return value


def block_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block for the pairs of two tiles of groups.

    ``rows`` are counts (term, source, count, lang_count) and, with a null term, the groups of
    both tiles: source, total, n_terms of the language, block_terms, tile and the tiles' numbers.
    """
    kept = rows["term"].notna()
    groups = rows[~kept].sort_values("source", ignore_index=True)
    counts = rows[kept]
    out = {"source": [], "other": [], "value": []}
    if len(groups) > 1:
        place = {s: i for i, s in enumerate(groups["source"])}
        order = counts[["term", "lang_count"]].drop_duplicates().sort_values(["lang_count", "term"], ascending=[False, True])
        column = {t: i for i, t in enumerate(order["term"])}
        dense = np.zeros((len(groups), max(1, len(column))), dtype=np.int64)
        if not column:
            dense[:] = -1
        dense[counts["source"].map(place).to_numpy(dtype=np.int64), counts["term"].map(column).to_numpy(dtype=np.int64)] = counts["count"]
        forest = Forest(dense)
        total = groups["total"].to_numpy(dtype=np.int64)
        terms = np.int64(groups["n_terms"].iloc[0])
        # terms of the block that no group of these tiles has
        absent = int(groups["block_terms"].iloc[0]) - len(column)
        tiles = groups["tile"].to_numpy()
        low, high = int(groups["tile_a"].iloc[0]), int(groups["tile_b"].iloc[0])
        first = np.flatnonzero(tiles == low)
        for i in first:
            others = np.flatnonzero(tiles == high) if low != high else first[first > i]
            if not len(others):
                continue
            pairs = np.stack([np.full(len(others), i), others], axis=1)

            def price(pair, count, other, pairs=pairs):
                p = exact_shares(count, total[pairs[pair, 0]], terms)
                q = exact_shares(other, total[pairs[pair, 1]], terms)
                return (p - q) ** 2 // (p + q)

            value = forest.sums(pairs, price)
            zero = np.zeros(len(others), dtype=np.int64)
            value = value + absent * price(np.arange(len(others)), zero, zero)
            out["source"] += [groups["source"][i]] * len(others)
            out["other"] += list(groups["source"][others])
            out["value"] += value.tolist()
    out["lang"] = [rows["lang"].iloc[0]] * len(out["value"])
    return pd.DataFrame(out).astype({"lang": object, "source": object, "other": object, "value": "int64"})


def pair_values(groups: DataFrame, kept: DataFrame, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, item (another source of the lang), value; both directions."""
    size = groups.groupBy("lang").agg(F.first("n_terms").alias("n_terms"), F.count("*").alias("n_groups"))
    size = size.select(
        "lang",
        F.greatest(F.lit(1), F.ceil(F.col("n_terms") / block_terms)).alias("n_blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("n_groups") / tile_groups)).alias("n_tiles"),
    )
    block = F.pmod(F.xxhash64("term"), F.col("n_blocks"))
    tile = F.pmod(F.xxhash64("source"), F.col("n_tiles")).cast("int")

    def to_tasks(df: DataFrame) -> DataFrame:
        """Each row once for every tile that its own meets."""
        met = F.explode(F.sequence(F.lit(0), F.col("n_tiles").cast("int") - 1)).alias("met")
        copies = df.select("*", met)
        return copies.withColumns({"tile_a": F.least("tile", "met"), "tile_b": F.greatest("tile", "met")}).drop("met", "n_tiles", "n_blocks")

    counts = kept.join(size, "lang").withColumns({"block": block, "tile": tile})
    blocks = counts.where("first").groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    roster = groups.join(size, "lang").join(blocks, "lang").withColumn("tile", tile)
    both = to_tasks(counts.select("lang", "source", "term", "count", "lang_count", "block", "tile", "n_tiles", "n_blocks")).unionByName(
        to_tasks(roster.select("lang", "source", "total", "n_terms", "block_terms", "block", "tile", "n_tiles", "n_blocks")),
        allowMissingColumns=True,
    )
    parts = both.groupBy("lang", "block", "tile_a", "tile_b").applyInPandas(block_sums, "lang string, source string, other string, value long")
    sums = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("source"), F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    found = sums.select("lang", ends.alias("e"), "value").select("lang", "e.source", "e.item", "value")
    # a language that keeps no term has no block
    bare = groups.where(F.col("n_terms") == 0).select("lang", "source")
    zero = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
    return found.unionByName(zero.withColumn("value", F.lit(0).cast("long")))


def term_values(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item (a kept term that the group has more often than its language), value."""
    whole = groups.select("lang", "source", "total", "lang_total", "n_terms")
    seen = kept.where(F.col("count") > 0).join(whole, ["lang", "source"])
    priced = seen.select(
        "lang",
        "source",
        F.col("term").alias("item"),
        share(F.col("count"), F.col("total"), F.col("n_terms")).alias("p"),
        share(F.col("lang_count"), F.col("lang_total"), F.col("n_terms")).alias("q"),
    )
    return priced.where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see the module."""
    kept = stored(kept_terms(docs, least_docs), "terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count_if("first").alias("firsts"))
    of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("n_terms"))
    named = docs.select(group_name("lang"), group_name("source")).distinct()
    groups = named.join(sums.drop("firsts"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stored(groups.fillna(0, ["total", "lang_total", "n_terms"]), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, kept).withColumn("rank", F.row_number().over(order))
    terms = term_values(groups, kept).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
