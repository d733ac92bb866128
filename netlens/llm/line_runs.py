"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of
at least ``least_chars`` code points that stand in at least ``least_docs`` documents lose all
their lines but those of the document with the largest id.

The documents come in batches of falling ids. A run is a table of keys, each once, bucketed and
sorted by the key. A batch's keys meet the runs in merge joins: those that no run has are new (the
anti-join half) and keep their document, for no later batch holds a larger id; the others only add
to the count. Both halves are written as the batch's own run at level 0. As soon as a level has
``fanout`` runs they are merged into one of the next level, so a batch never meets more than
``fanout - 1`` runs of each level. The last merge gives the keys that are dropped elsewhere.

Only DataFrame functions are used. The text is read twice: once for the hashes of its lines, once
for the result. A key is compared by 128 bits of hash.

A key of a third of all lines is counted inside each task first, and is one row of each run; in the
join that marks lines it is a skewed key, which adaptive execution splits. Null or empty text is one
empty line, which is never long enough. Rows with a null id are one document with the smallest
possible id; rows that repeat an id are one document, and each keeps or loses its own lines.
An empty table gives no rows; extra columns are not touched.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import text_of
from netlens.session import scratch_dir, stored

#: White space that is stripped from a line's ends.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS = 20
LEAST_DOCS = 3
#: Batches that one table is taken in, and runs of a level that are merged.
BATCHES = 8
FANOUT = 4
SMALLEST_ID = -(1 << 63)

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped, with A-Z (and no other letter) in lower case."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST_ID))


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """Long lines: doc, text_hash, place and the hash of the key."""
    text = text_of()
    split = docs.select(doc_key().alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    keyed = split.select("doc", "text_hash", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keyed.select("doc", "text_hash", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Least id of each batch but the last, falling: quantiles of the ids."""
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    found = docs.select(F.percentile_approx(doc_key(), F.array(*[F.lit(s) for s in shares])).alias("q")).first()["q"]
    return sorted(set(found or []), reverse=True)


@dataclass
class Runs:
    """Sorted runs by level; each a bucketed table in the shared folder.

    A run has for each key ``keeper``, the largest id that holds it (null where an earlier run
    has the key already), and ``docs``, the documents counted in the run.
    """

    spark: SparkSession
    fanout: int = FANOUT
    levels: dict[int, list[tuple[str, str]]] = field(default_factory=dict)  # table and folder

    def __post_init__(self):
        # as many as a shuffle has partitions: a batch's keys then meet the buckets without another exchange
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in sorted(self.levels, reverse=True) for run in self.levels[level]]

    def add(self, lines: DataFrame) -> None:
        """Take the lines of one batch (doc, h1, h2), whose documents' ids are below all earlier ones."""
        own = lines.select("doc", *KEY).distinct().groupBy(*KEY).agg(F.max("doc").alias("last"), F.count("*").alias("docs"))
        known = F.lit(False)
        for i, (table, _) in enumerate(self.runs()):
            run = self.spark.table(table).select(*KEY, F.lit(True).alias(f"in_{i}"))
            own = own.join(run.hint("merge"), KEY, "left")
            known = known | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        self._put(own.select(*KEY, F.when(~known, F.col("last")).alias("keeper"), "docs"), 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            self._merge(level)
            level += 1

    def merged(self) -> DataFrame:
        """All runs as one: each key once, its keeper and the number of its documents.

        The files are read without their buckets: Spark 4.1 lets a union of bucketed scans keep
        their partitioning and then reads them unbucketed, which loses the grouping.
        """
        rows = self.spark.read.schema("h1 long, h2 long, keeper long, docs long").parquet(*[folder for _, folder in self.runs()])
        return rows.groupBy(*KEY).agg(F.max("keeper").alias("keeper"), F.sum("docs").alias("docs"))

    def drop(self) -> None:
        """Forget the tables; the files go with the shared folder's other steps."""
        for table, _ in self.runs():
            self.spark.sql(f"drop table {table}")
        self.levels.clear()

    def _merge(self, level: int) -> None:
        part = Runs(self.spark, self.fanout, {level: self.levels.pop(level)})
        self._put(part.merged(), level + 1)
        part.drop()

    def _put(self, keys: DataFrame, level: int) -> None:
        table, folder = f"line_run_{uuid.uuid4().hex}", scratch_dir(self.spark, "line-run")
        writer = keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.format("parquet").option("path", folder).saveAsTable(table)
        self.levels.setdefault(level, []).append((table, folder))


def repeated_keys(lines: DataFrame, bounds: list[int], least_docs: int = LEAST_DOCS, fanout: int = FANOUT) -> DataFrame:
    """Keys of at least ``least_docs`` documents: h1, h2, keeper.

    ``lines`` is stored by ``batch``, whose documents' ids fall from one batch to the next.
    """
    runs = Runs(lines.sparkSession, fanout)
    for batch in range(len(bounds) + 1):
        runs.add(lines.where(F.col("batch") == batch))
    found = stored(runs.merged().where(F.col("docs") >= least_docs).select(*KEY, "keeper"), "line-keys")
    runs.drop()
    return found


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, batches)
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (F.col("doc") < bound).cast("int")
    folder = scratch_dir(spark, "lines")
    lines_of(docs, least_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    lines = spark.read.schema("doc long, text_hash long, place int, h1 long, h2 long, batch int").parquet(folder)

    keys = repeated_keys(lines, bounds, least_docs, fanout)
    gone = lines.join(keys, KEY).where(F.col("doc") != F.col("keeper"))
    gone = gone.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("gone"))

    given = docs.select(F.col("doc_id"), doc_key().alias("doc"), text_of().alias("text"))
    marked = given.withColumn("text_hash", F.xxhash64("text")).join(gone, ["doc", "text_hash"], "left")
    split = marked.select("doc_id", "text", "gone", F.split("text", "\n", -1).alias("parts"))
    places = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("parts"), i)), "\n")
    return split.select(
        "doc_id",
        F.size("parts").cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
