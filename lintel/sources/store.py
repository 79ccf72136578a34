"""Scans and their findings as files, and the life of a scan.

A save writes its findings to a folder of its own and then replaces one small file,
the scan's record: it names the folder and holds the scan's row with the counts. That
replacement is the only step that readers see, so a save that dies anywhere leaves the scan
as it was, and a reader that has begun keeps reading what it has begun with.

Findings are bucketed and sorted by fingerprint: compared with a stored scan, only
the other side is shuffled.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

#: What a scan may become.
NEXT = {"pending": ("running", "failed", "cancelled"), "running": ("completed", "failed", "cancelled"), "completed": (), "failed": (), "cancelled": ()}


def may_become(status: Column, target: Column) -> Column:
    """Whether a scan of a status may take another."""
    out = F.lit(False)
    for now, then in NEXT.items():
        out = F.when(status == now, target.isin(list(then)) if then else F.lit(False)).otherwise(out)
    return out


_RECORD = "scan_id string, repository_id string, status string, created_at timestamp, completed_at timestamp, total_vulnerabilities long, critical_count long, high_count long, medium_count long, low_count long, info_count long, folder string, buckets int, schema string"
_COUNTS = ("total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count", "info_count")


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in the place of another in one step, as far as the store renames in one."""
    jvm = spark._jvm
    target, store = _file(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getParent().toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, options)


def _write(findings: DataFrame, root: str, scan_id: str, buckets: int | None) -> dict:
    """The findings in a folder of their own; what the record says of it."""
    spark = findings.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"findings/{quote(scan_id, safe='')}/{uuid.uuid4().hex}"
    rows = findings.withColumn("scan_id", F.lit(scan_id))
    path, store = _file(spark, f"{root}/{folder}")
    name = f"lintel_{uuid.uuid4().hex}"
    # a bucket is one file: the shuffle hashes as the buckets do
    rows.repartition(n, "fingerprint").write.bucketBy(n, "fingerprint").sortBy("fingerprint").option("path", store.makeQualified(path).toString()).format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: their place was given
    return {"scan_id": scan_id, "folder": folder, "buckets": n, "schema": rows.schema.json()}


def _record_of(root: str, scan_id: str) -> str:
    return f"{root}/scans/{quote(scan_id, safe='')}.json"


def save_findings(findings: DataFrame, root: str, scan_id: str, buckets: int | None = None) -> None:
    """A scan's findings without its row; saving it again replaces them at once."""
    _replace(findings.sparkSession, _record_of(root, scan_id), json.dumps(_write(findings, root, scan_id, buckets)))


def save_scan(spark: SparkSession, findings: DataFrame, root: str, scan_id: str, repository_id: str, created_at, completed_at, buckets: int | None = None) -> None:
    """A scan's findings and its row with the counts, both at once."""
    from lintel.operators import delta

    record = _write(findings, root, scan_id, buckets)
    counted = delta.scan_counters(_table(spark, root, record)).first()
    record |= {"repository_id": repository_id, "status": "completed"} | {c: counted[c] if counted else 0 for c in _COUNTS}
    record |= {k: None if t is None else t.isoformat() for k, t in (("created_at", created_at), ("completed_at", completed_at))}
    _replace(spark, _record_of(root, scan_id), json.dumps(record))


def _records(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_RECORD).json(f"{root}/scans")


def _table(spark: SparkSession, root: str, record: dict) -> DataFrame:
    """The findings that a record names, with their buckets known to the planner."""
    path, store = _file(spark, f"{root}/{record['folder']}")
    where = store.makeQualified(path).toString()
    name = "lintel_" + hashlib.sha1(where.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(record["schema"])).fields)
    quoted = where.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {record['buckets']} BUCKETS LOCATION '{quoted}'")
    return spark.table(name)


def load_findings(spark: SparkSession, root: str, scan_id: str | None = None) -> DataFrame | None:
    """All findings or those of a scan; None where nothing is stored.

    Any other trouble with the store is raised: an unreadable baseline is not an empty one.
    """
    try:
        records = _records(spark, root)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if scan_id is not None:
        found = records.where(F.col("scan_id") == scan_id).first()
        return None if found is None else _table(spark, root, found.asDict())
    folders = [r.folder for r in records.select("folder").collect()]  # one short path a scan
    return spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{f}" for f in folders]) if folders else None


def load_scans(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all stored scans."""
    return _records(spark, root).where("status IS NOT NULL").drop("folder", "buckets", "schema")


def remove_unnamed(spark: SparkSession, root: str, hours: float = 24) -> list[str]:
    """Deletes findings that no record names and that are older than any save or read still under way; their folders."""
    import time

    named = {r.folder for r in _records(spark, root).select("folder").collect()}
    top, store = _file(spark, f"{root}/findings")
    gone = []
    for scan in store.listStatus(top) if store.exists(top) else []:
        for version in store.listStatus(scan.getPath()):
            folder = f"findings/{scan.getPath().getName()}/{version.getPath().getName()}"
            if folder not in named and version.getModificationTime() < (time.time() - 3600 * hours) * 1000:
                store.delete(version.getPath(), True)
                gone.append(folder)
    return gone
