"""Continuous capture: packets in, decoded buffer and log rows out.

No state crosses packets, so the stream is stateless and each micro-batch is a small batch job.
A batch's packets are decoded once and kept while it runs; the buffer and the log rows are both
written from them.  Both outputs are named after the streaming query, whose id stays in its
checkpoint, and the batch, so a repeated batch replaces what it wrote.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import host_filter, select_interface, truncate_snaplen
from ..operators.views import log_records
from ..schema import PACKETS_RAW
from ..sources import files
from ..sources.logtable import other_source, read_logs, write_logs
from ..sources.packets import append_packets, clear_buffer, read_buffer, stored_packets

#: Writer numbers of the two rule sets, so that both may log to one folder.
WRITERS = {"base": 0, "ip": 1}
#: Tasks that read a batch, at most, for each core.
TASKS_PER_CORE = 4


def stream_packets(
    spark: SparkSession, path: str, max_files: int = 1_000, snaplen: int | None = None
) -> DataFrame:
    """Raw frames from parquet files landing in ``path``, at most ``max_files`` per batch."""
    landed = (
        spark.readStream.schema(PACKETS_RAW).option("maxFilesPerTrigger", max_files).parquet(path)
    )
    return truncate_snaplen(landed, snaplen)


class Capture:
    """One named capture with its own buffer and checkpoint under ``out``.

    ``rules`` is ``base`` or ``ip``; the host filter belongs to the by-IP form.  ``logs`` may be
    shared by captures whose ``writer`` numbers differ, as those of the two rule sets do.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        out: str,
        rules: str = "base",
        logs: str | None = None,
        writer: int | None = None,
        **rule_options,
    ):
        self.spark, self.name, self.out, self.rules = spark, name, out, rules
        self.rule_options = rule_options
        self.log_path = logs or f"{out}/logs"
        self.writer = WRITERS.get(rules, len(WRITERS)) if writer is None else writer
        self.host: str | None = None

    @property
    def query(self) -> StreamingQuery | None:
        """The running query of this name, if any."""
        return next((q for q in self.spark.streams.active if q.name == self.name), None)

    def start(
        self,
        source: DataFrame,
        iface: str | None = None,
        interfaces: DataFrame | None = None,
        host: str | None = None,
        available_now: bool = False,
        every: str = "1 second",
    ) -> StreamingQuery:
        """Start, or return the running query untouched.

        The stored host filter is replaced even if the capture is running; the
        running query keeps the filter it was started with.
        """
        self.host = host
        if self.query is not None:
            return self.query
        if iface is not None:
            source = select_interface(source, iface, interfaces)
        writer = (
            source.writeStream.queryName(self.name)
            .option("checkpointLocation", f"{self.out}/checkpoint")
            .foreachBatch(self._batch_writer(host))
        )
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=every).start()

    def _batch_writer(self, host: str | None):
        checked: set[str] = set()

        def write(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            source = str(self.query.id)  # active in the session that started it
            if source not in checked and files.exists(spark, self.log_path):
                other = other_source(spark, self.log_path, source, self.writer)
                if other is not None:
                    raise RuntimeError(f"writer {self.writer} of {self.log_path} is taken by the source {other}")
            checked.add(source)
            # every task writes a file of each date that it meets, so a date's frames come together first
            few = batch.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
            dated = few.withColumn("_dt", F.to_date("ts")).hint("rebalance", "_dt", "iface").drop("_dt")
            packets = stored_packets(host_filter(dated, host)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                append_packets(packets, f"{self.out}/packets", f"{source}-{batch_id}")
                rows = log_records(packets, self.rules, **self.rule_options)
                write_logs(rows, self.log_path, source, batch_id, self.writer, f"{self.out}/rejected/batch={batch_id}")
            finally:
                packets.unpersist()

        return write

    def stop(self) -> None:
        """Stop; the buffer stays.  Harmless if nothing is running."""
        if self.query is not None:
            self.query.stop()

    def packets(self, ordered: bool = False) -> DataFrame:
        """Everything captured so far; ``ordered`` sorts it by arrival."""
        return read_buffer(self.spark, f"{self.out}/packets", ordered)

    def logs(self) -> DataFrame:
        return read_logs(self.spark, self.log_path)

    def rejected(self) -> DataFrame | None:
        """Rows that broke a column constraint; None if there were none so far."""
        folder = f"{self.out}/rejected"
        return self.spark.read.parquet(folder) if files.exists(self.spark, folder) else None

    def clear(self) -> None:
        """Empty the packet buffer; the log table is not touched."""
        clear_buffer(self.spark, f"{self.out}/packets")
