"""Counts of a scan's findings, kept by increments as findings come, change and go.

Each change carries a version that grows for its finding. What a finding was last known
as is state, so a change that comes again, or later than a newer one of its finding,
changes nothing, and the counts equal a recount over the latest changes whatever the order.
State lies in the state store by buckets of findings, whatever their scans: a bucket is read and
written as a whole, so a batch asks the store a few times for each bucket it touches, not for
each finding, and a scan of any size is spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lintel.plans.catalog import SEVERITIES

COUNTS = ("total_vulnerabilities", *[f"{s}_count" for s in SEVERITIES])
#: What a change is: a finding of a scan, its version, its severity, and whether it is gone.
CHANGES = "scan_id string, finding_id string, version long, severity string, gone boolean"
#: Buckets of findings; a checkpoint keeps the number it began with.
BUCKETS = 8192
_COUNTED = "scan_id string, " + ", ".join(f"{c} long" for c in COUNTS)
_STEPS = "scan_id string, severity string, step int"
_KNOWN = pa.schema([("scan_id", pa.string()), ("finding_id", pa.string()), ("version", pa.int64()), ("severity", pa.string())])
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Steps(StatefulProcessor):
    """What changes make of the counts: the last known form of each finding of a bucket, a severity of null for those gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "findings binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest: dict = {}
        for part in rows:
            for scan, finding, *form in zip(*[part[c].tolist() for c in ("scan_id", "finding_id", "version", "gone", "severity")]):
                one = newest.get((scan, finding))
                if one is None or one < form:
                    newest[scan, finding] = form
        known: dict = {}
        if self.known.exists():
            scans, findings, *forms = [c.to_pylist() for c in pa.ipc.open_stream(self.known.get()[0]).read_all().columns]
            known = dict(zip(zip(scans, findings), zip(*forms)))
        out = []
        for finding, (version, gone, severity) in newest.items():
            before = known.get(finding)
            if before is not None and before[0] >= version:
                continue  # seen, or late
            now = None if gone else severity
            known[finding] = (version, now)
            steps = [(finding[0], was, step) for step, was in ((-1, before and before[1]), (1, now)) if was is not None]
            out += steps or [(finding[0], None, 0)]
        if out:
            sink = pa.BufferOutputStream()
            columns = [*zip(*known), *zip(*known.values())]
            with pa.ipc.new_stream(sink, _KNOWN) as w:
                w.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, _KNOWN.types)], schema=_KNOWN))
            self.known.update((sink.getvalue().to_pybytes(),))
        yield pd.DataFrame(out, columns=["scan_id", "severity", "step"])

    def close(self) -> None:
        pass


def steps(changes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changes as a stream of steps: (scan_id, severity, 1 or -1), 0 for a finding that came and is gone."""
    changes.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = changes.selectExpr(*[f"CAST({n} AS {t}) AS {n}" for n, t in (c.split() for c in CHANGES.split(", "))]).where("finding_id IS NOT NULL AND version IS NOT NULL")
    rows = rows.withColumns({"severity": F.coalesce("severity", F.lit("")), "gone": F.coalesce("gone", F.lit(False)), "bucket": F.pmod(F.xxhash64("scan_id", "finding_id"), F.lit(buckets)).cast("int")})
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Steps(), outputStructType=_STEPS, outputMode="Update", timeMode="None")


def maintain(changes: DataFrame, sink: str, checkpoint: str, buckets: int = BUCKETS, **trigger):
    """Writes by how much each batch changes the counts of scans; a batch that runs again replaces itself."""
    of = [F.sum("step"), *[F.sum(F.when(F.col("severity") == s, F.col("step")).otherwise(0)) for s in SEVERITIES]]

    def batch(df: DataFrame, number: int) -> None:
        df.groupBy("scan_id").agg(*[x.alias(c) for x, c in zip(of, COUNTS)]).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return steps(changes, buckets).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """Each scan's counts: the sums of what all batches changed."""
    return spark.read.schema(f"{_COUNTED}, batch int").parquet(sink).groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
