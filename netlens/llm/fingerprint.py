"""Document fingerprints by Order MinHash, in built-in expressions only.

A text's k-mers are runs of ``k`` words, numbered by their occurrence, so that repetition counts.
Each numbered k-mer is hashed once; the hash deals it to one of ``bins`` sketches and orders it
there. A sketch keeps its ``depth`` minimal k-mers, puts them back into text order and hashes the
tuple: moved text changes it, as it changes the edit distance. A sketch with fewer k-mers takes the
minimal ones of the next sketches, round the circle, so that short texts have all sketches and each
keeps an order. A fingerprint is the list of its sketches.

Two fingerprints agree in a share r of the sketches. As all ``depth`` k-mers must
agree, r estimates J to the power of depth, J being the share of k-mers in common among all, and
``likeness`` is 2 J / (1 + J): the share of text that they have in common.

Null text counts as empty; an empty text has one k-mer, the empty one. Equal texts have equal
fingerprints. Documents are in descending order of id; equal ids follow a hash of the text, null
ids come last. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.llm.common import text_of

K = 3
BINS = 64
DEPTH = 2
#: Parts of the ids, equal in rows, that are dealt to buckets each in its own measure.
SEGMENTS = 64
#: Documents that share a bucket of neighbouring ids, about.
BUCKET_ROWS = 128
#: Buckets that share a bucket of the second level.
BUCKET_GROUP = 4096
#: Buckets of documents without an id.
NULL_BUCKETS = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column, k: int = K, bins: int = BINS, depth: int = DEPTH) -> Column:
    """Array of int, one for each sketch in use: the bin times 65,536 plus 16 bits of its hash."""
    if not 0 < bins <= 1 << 14:
        raise ValueError("1 to 16,384 bins")

    def numbered(s: Column) -> Column:
        """Occurrence-numbered k-mers of sorted (hash, place): bin, hash, place."""
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["g"] != F.get(s, i - 1)["g"]))

        def one(a: Column, i: Column) -> Column:
            v = F.xxhash64(F.get(s, i)["g"], i - a)
            return F.struct(F.pmod(v, F.lit(bins)).cast("int").alias("b"), v.alias("v"), F.get(s, i)["p"].alias("p"))

        return let(
            starts,
            lambda at: F.flatten(
                F.transform(at, lambda a, r: F.transform(F.sequence(a, F.coalesce(F.get(at, r + 1), n) - 1), lambda i: one(a, i)))
            ),
        )

    def tuple_hash(t: Column, a: Column) -> Column:
        """Of the ``depth`` k-mers from ``a`` on, round the circle, in text order."""
        n = F.size(t)
        least = F.transform(F.sequence(F.lit(0), F.least(F.lit(depth), n) - 1), lambda j: F.get(t, F.pmod(a + j, n)))
        ordered = F.array_sort(F.transform(least, lambda x: F.struct(x["p"].alias("p"), x["v"].alias("v"))))
        return F.xxhash64(F.transform(ordered, lambda x: x["v"])).bitwiseAND(65535)

    def filled(first: Column, last: Column, hashed: Column) -> Column:
        """One tuple for the sketches ``first`` to ``last``."""
        own = let(hashed, lambda h: F.transform(F.sequence(first, last), lambda b: (b * 65536 + h).cast("int")))
        return F.when(first <= last, own).otherwise(F.array().cast("array<int>"))

    def sketches(t: Column) -> Column:
        n = F.size(t)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(t, i)["b"] != F.get(t, i - 1)["b"]))

        def run(at: Column, a: Column, r: Column) -> Column:
            before = F.when(r == 0, F.lit(-1)).otherwise(F.get(t, F.get(at, F.greatest(r - 1, F.lit(0))))["b"])
            return filled(before + 1, F.get(t, a)["b"], tuple_hash(t, a))

        runs = let(starts, lambda at: F.flatten(F.transform(at, lambda a, r: run(at, a, r))))
        return F.concat(runs, filled(F.get(t, n - 1)["b"] + 1, F.lit(bins - 1), tuple_hash(t, F.lit(0))))

    def grams(h: Column) -> Column:
        count = F.greatest(F.size(h) - k, F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), count),
            lambda i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("g"), i.alias("p")),
        )

    words = F.transform(F.split(text, " "), lambda w: F.xxhash64(w))
    return let(words, lambda h: let(F.array_sort(grams(h)), lambda s: let(F.array_sort(numbered(s)), sketches)))


def likeness(a: Column, b: Column, depth: int = DEPTH) -> Column:
    """Estimated share of text in common, 0 to 1."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 16))

    r = F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))
    j = F.pow(r, F.lit(1.0 / depth))
    return F.lit(2.0) * j / (F.lit(1.0) + j)


def as_text(fp: Column) -> Column:
    """Eight hexadecimal digits for each sketch."""
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def bucket_of(ids: list[int], n: int, doc_id: Column, text_hash: Column) -> Column:
    """Buckets that rise with (doc_id, text_hash), of about ``BUCKET_ROWS`` rows; null for a null id.

    ``ids`` are quantiles of the ``n`` ids. Between two of them ids are dealt evenly; an id that is
    several of them, so often it stands in the table, is dealt by the hash of the text.
    """
    rows_each = n / max(1, len(ids) - 1)
    out, first = F.when(doc_id.isNull(), F.lit(None).cast("long")), 0
    values = sorted(set(ids))

    def dealt(share: Column, buckets: int) -> Column:
        return F.lit(first) + F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("long")

    for low, high in zip(values, [*values[1:], None]):
        often = ids.count(low)
        if often > 1:
            buckets = max(1, round(often * rows_each / BUCKET_ROWS))
            out = out.when(doc_id == low, dealt(text_hash.cast("double") / F.lit(2.0**64) + 0.5, buckets))
            first += buckets
        if high is not None:
            buckets = max(1, round(rows_each / BUCKET_ROWS))
            share = (doc_id.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low) or 1.0)
            out = out.when(doc_id < high, dealt(share, buckets))
            first += buckets
    return out.otherwise(F.lit(first))


def next_buckets(buckets: DataFrame) -> DataFrame:
    """bucket and the next lower one there is; after the lowest, the highest. Two levels of
    windows, so that one task sees one row in ``BUCKET_ROWS`` times ``BUCKET_GROUP`` documents."""
    grouped = buckets.withColumn("upper", F.floor(F.col("bucket") / BUCKET_GROUP))
    own = Window.partitionBy("upper").orderBy(F.desc("bucket"))
    below = grouped.withColumn("below", F.lead("bucket").over(own))
    tops = grouped.groupBy("upper").agg(F.max("bucket").alias("top"))
    over = Window.orderBy(F.desc("upper"))
    wrapped = F.coalesce(F.lead("top").over(over), F.max("top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = tops.select("upper", wrapped.alias("next_top"))
    return below.join(tops, "upper").select("bucket", F.coalesce("below", "next_top").alias("next_bucket"))


def with_edits(docs: DataFrame, k: int = K, bins: int = BINS, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited (text), fingerprint, edited_fingerprint and
    next_fingerprint (arrays).

    The edited text is the document with its last half, floor(n_chars / 2) code points, replaced
    by as many first ones of the next document in descending order of id.
    """
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(SEGMENTS + 1)])
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = given.agg(F.percentile_approx("doc_id", shares).alias("ids"), F.count("doc_id").alias("n")).first()
    text_hash = F.xxhash64("text")
    no_id = -1 - F.pmod(text_hash, F.lit(NULL_BUCKETS))
    rows = given.withColumn("bucket", F.coalesce(bucket_of(found["ids"] or [], found["n"], F.col("doc_id"), text_hash), no_id))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), text_hash.desc())
    dealt = rows.withColumns({"next_text": F.lead("text").over(order), "rank": F.row_number().over(order)})
    after = next_buckets(rows.select("bucket").distinct())
    first = dealt.where("rank = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("first_text"))
    borders = after.join(first, "next_bucket").select("bucket", "first_text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, int(length(text) div 2))"))
    joined = (
        dealt.join(borders, "bucket", "left")
        .withColumn("is_last", F.col("next_text").isNull())
        .withColumn("next_text", F.coalesce("next_text", "first_text"))
    )
    marked = joined.select(
        "bucket", "doc_id", text_hash.alias("text_hash"), F.length("text").cast("long").alias("n_chars"), edited.alias("edited"),
        fingerprint(F.col("text"), k, bins, depth).alias("fingerprint"),
        F.when(F.col("is_last"), fingerprint(F.col("next_text"), k, bins, depth)).alias("border_fingerprint"),
    )
    again = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("text_hash"))
    return marked.select(
        "doc_id", "n_chars", "edited", "fingerprint",
        fingerprint(F.col("edited"), k, bins, depth).alias("edited_fingerprint"),
        F.coalesce(F.lead("fingerprint").over(again), "border_fingerprint").alias("next_fingerprint"),
    )
