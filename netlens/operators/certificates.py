"""Certificates that servers showed, and what is wrong with them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trusted_issuer
from ..functions.tls import certificates
from .decode import fields
from .lookup import lookup_join
from .rules import TLS_PORT
from .tcp import CHUNK, FLOW, HEAD_ARROW, as_batches, head_pieces, head_rows

#: Bytes of a server's side in which its certificates are looked for.
LIMIT = 4 * CHUNK

TEXTS = ["issuer", "issuer_cn", "subject", "serial"]
SHOWN = "src_ip string, src_port int, dst_ip string, dst_port int, connection long, issuer string, issuer_cn string, subject string, serial string, not_before string, not_after string, chain int, shown_at timestamp_ntz"
ARROW = pa.schema([*list(HEAD_ARROW)[:5], *[(n, pa.string()) for n in (*TEXTS, "not_before", "not_after")], ("chain", pa.int32()), ("shown_at", pa.timestamp("us"))])


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The server's own certificate and how many were shown, of the heads with a readable one."""

    def rows() -> Iterator[tuple]:
        for *own, head, seen in head_rows(batches):
            if shown := certificates(head):
                yield *own, *shown[0].values(), len(shown), seen

    return as_batches(rows(), ARROW, 1_000)


def shown_certificates(packets: DataFrame, port: int = TLS_PORT, limit: int = LIMIT) -> DataFrame:
    """One row for each connection in which a server showed a certificate: flow (from the server),
    connection, issuer, issuer_cn, subject, serial, not_before, not_after of the server's own, chain
    (how many were shown), shown_at (its first packet)."""
    found = head_pieces(packets, limit, where=F.col("src_port") == port).mapInArrow(_shown, SHOWN)
    times = [F.col(n).cast("timestamp_ntz").alias(n) for n in ("not_before", "not_after")]
    return found.select(*FLOW, "connection", *TEXTS, *times, "chain", "shown_at")


def judged_certificates(packets: DataFrame, port: int = TLS_PORT, limit: int = LIMIT) -> DataFrame:
    """``shown_certificates`` with ``reasons``: issuer (not trusted), self_signed, expired, not_yet_valid."""
    shown = shown_certificates(packets, port, limit)
    tests = {
        "issuer": ~F.coalesce(trusted_issuer(F.col("issuer_cn")), F.lit(False)),
        "self_signed": F.col("issuer") == F.col("subject"),
        "expired": F.col("shown_at") > F.col("not_after"),
        "not_yet_valid": F.col("shown_at") < F.col("not_before"),
    }
    return shown.withColumn("reasons", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()])))


def with_certificates(packets: DataFrame, port: int = TLS_PORT, limit: int = LIMIT) -> DataFrame:
    """Flat packets with ``certificate_reasons``: of the packets of a flow (either direction) whose
    server showed a certificate that something is wrong with; null for all others.

    A rule of one's own can read it: ``("certificate", lambda: F.col("certificate_reasons").isNotNull())``.
    """
    wrong = judged_certificates(packets, port, limit).where(F.size("reasons") > 0)
    wrong = wrong.select(F.concat_ws(" ", *FLOW).alias("_flow"), F.explode("reasons").alias("_reason"))
    wrong = wrong.groupBy("_flow").agg(F.array_sort(F.collect_set("_reason")).alias("certificate_reasons"))
    flat = fields(packets)
    source, target = [F.coalesce("ipv4_src", "ipv6_src"), "tcp_src_port"], [F.coalesce("ipv4_dst", "ipv6_dst"), "tcp_dst_port"]
    flow = F.when(F.col("tcp_src_port") == port, F.concat_ws(" ", *source, *target)).when(F.col("tcp_dst_port") == port, F.concat_ws(" ", *target, *source))
    return lookup_join(flat.withColumn("_at", flow), wrong, "_at", "_flow", "packet_id").drop("_at")
