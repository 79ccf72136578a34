"""Scans and findings in a relational database, read and written by Spark's JDBC source.

Reads go through a catalog, so filters, aggregates and, where the database's dialect
has them, limits are the database's work; large tables are read in ranges of a column.
Writes go to a table of their own first, from the executors in parallel, and one
transaction then moves them to where they are seen: a task that is run twice, or a
driver that dies, changes nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.sources.shards import Shards

#: Columns of the tables, with SQL types that databases share.
SCANS = {"scan_id": "VARCHAR(64) NOT NULL PRIMARY KEY", "repository_id": "VARCHAR(256)", "status": "VARCHAR(16)", "created_at": "TIMESTAMP", "completed_at": "TIMESTAMP"}
SCANS |= {c: "BIGINT" for c in ("total_vulnerabilities", "critical_count", "high_count", "medium_count", "low_count", "info_count")}
FINDINGS = {
    "scan_id": "VARCHAR(64) NOT NULL", "fingerprint": "VARCHAR(64)", "rule_id": "VARCHAR(128)", "title": "VARCHAR(1024)", "description": "VARCHAR(8192)", "severity": "VARCHAR(16)", "category": "VARCHAR(64)", "file_path": "VARCHAR(4096)",
    "line_start": "INTEGER", "line_end": "INTEGER", "column_start": "INTEGER", "column_end": "INTEGER", "code_snippet": "VARCHAR(30000)", "confidence": "DOUBLE PRECISION", "cvss_score": "DOUBLE PRECISION", "cvss_vector": "VARCHAR(128)",
    "refs": "VARCHAR(30000)", "fix": "VARCHAR(30000)",
}
#: Nested columns, which tables hold as JSON.
NESTED = {"refs": "struct<cwe:array<string>,cve:array<string>,owasp:array<string>,urls:array<string>>", "fix": "struct<summary:string,kind:string,before:string,after:string,replacement:string>"}


def decoded(df: DataFrame, schemas: dict[str, str] = NESTED) -> DataFrame:
    """JSON columns as structs; `damaged` names those of a row that do not fit, whose text goes to `<name>_text`.

    A column damaged as a whole is null; one null text is null and not damaged.
    Members that the schema does not know are no damage.
    """
    out, bad = df, []
    for name, schema in schemas.items():
        typed = F.from_json(F.col(name), f"struct<{schema.removeprefix('struct<')[:-1]},__rest:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__rest"})
        out = out.withColumn(f"__{name}", typed)
        wrong = F.col(name).isNotNull() & (F.col(f"__{name}").isNull() | F.col(f"__{name}.__rest").isNotNull() | ~F.coalesce(F.rlike(F.col(name), F.lit(r"^\s*\{")), F.lit(False)))
        bad.append((name, wrong))
    flags = F.array_compact(F.array(*[F.when(w, n) for n, w in bad]))
    parts = [F.when(w, F.col(n)).alias(f"{n}_text") for n, w in bad]
    whole = {n: F.when(F.col(n).isNotNull() & ~w, F.col(f"__{n}").dropFields("__rest")).alias(n) for n, w in bad}
    return out.select(*[whole[c] if c in whole else F.col(f"`{c}`") for c in df.columns], flags.alias("damaged"), *parts)


class Database:
    """A database by its address; `catalog` is the name under which Spark knows it."""

    def __init__(self, spark: SparkSession, url: str, driver: str, catalog: str = "scans_db", schema: str | None = None, properties: dict | None = None):
        self.spark, self.url, self.driver, self.catalog, self.schema = spark, url, driver, catalog, schema
        self.properties = {"driver": driver} | (properties or {})
        base = f"spark.sql.catalog.{catalog}"
        spark.conf.set(base, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for k, v in ({"url": url, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true"} | self.properties).items():
            spark.conf.set(f"{base}.{k}", v)

    def _connect(self):
        jvm = self.spark._jvm
        loaded = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(self.driver)
        info = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k != "driver":
                info.setProperty(k, v)
        return loaded.getDeclaredConstructor(self.spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(self.spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0)).connect(self.url, info)

    def transaction(self, statements: list[tuple]) -> list[int]:
        """Runs (SQL, values...) statements, all or none; how many rows each changed."""
        con = self._connect()
        try:
            con.setAutoCommit(False)
            out = []
            for sql, *values in statements:
                s = con.prepareStatement(sql)
                for k, v in enumerate(values):
                    s.setObject(k + 1, v)
                out.append(s.executeUpdate())
                s.close()
            con.commit()
            return out
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()

    def tables(self) -> set[str]:
        """Upper-case names of the schema's tables."""
        con = self._connect()
        try:
            rows, out = con.getMetaData().getTables(None, self.schema, "%", None), set()
            while rows.next():
                out.add(rows.getString(3).upper())
            return out
        finally:
            con.close()

    def create(self, table: str, columns: dict[str, str]) -> None:
        """A table with these columns, unless it is there."""
        if table.upper() not in self.tables():
            self.transaction([(f"CREATE TABLE {table} ({', '.join(f'{c} {t}' for c, t in columns.items())})",)])

    def drop(self, table: str) -> None:
        if table.upper() in self.tables():
            self.transaction([(f"DROP TABLE {table}",)])

    def frame(self, table: str) -> DataFrame:
        """A table by the catalog, whose filters, aggregates and limits the database takes over."""
        name = ".".join(f"`{p}`" for p in (self.catalog, self.schema, table.upper()) if p)
        df = self.spark.table(name)
        return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])

    def grouped(self, table: str, by: tuple[str, ...], largest: dict[str, str], where: str) -> DataFrame:
        """Rows that fit by group: `n`, and the largest value of some columns; the database counts."""
        return self.frame(table).where(where).groupBy(*by).agg(F.count("*").alias("n"), *[F.max(c).alias(name) for name, c in largest.items()])

    def ranges(self, table: str, column: str, parts: int) -> DataFrame:
        """A table read in `parts` ranges of a number or time; rows without one come with the first range."""
        low, high = self.frame(table).agg(F.min(column), F.max(column)).first()
        reader = self._options(self.spark.read).option("dbtable", table)
        if low is not None and low < high:
            reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", parts)
        df = reader.load()
        return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])

    def _options(self, side):
        out = side.format("jdbc").option("url", self.url)
        for k, v in self.properties.items():
            out = out.option(k, v)
        return out

    def stage(self, df: DataFrame, table: str) -> str:
        """Rows in a table of their own with the columns of `table`; its name."""
        name = f"stage_{uuid.uuid4().hex[:20]}"
        self.transaction([(f"CREATE TABLE {name} AS SELECT {', '.join(df.columns)} FROM {table} WITH NO DATA",)])
        self._options(df.write).option("dbtable", name).option("batchsize", 5000).mode("append").save()
        return name

    def upsert(self, df: DataFrame, table: str, keys: tuple[str, ...]) -> int:
        """Rows of `df` instead of those with the same keys; its keys must be distinct. How many rows were written."""
        name = self.stage(df, table)
        try:
            same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
            others = [c for c in df.columns if c not in keys]
            update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in others)}" if others else ""
            insert = f"WHEN NOT MATCHED THEN INSERT ({', '.join(df.columns)}) VALUES ({', '.join(f's.{c}' for c in df.columns)})"
            return self.transaction([(f"MERGE INTO {table} t USING {name} s ON {same} {update} {insert}",)])[0]
        finally:
            self.drop(name)

    def save_scan(self, findings: DataFrame, scan_id: str, repository_id: str, created_at, completed_at) -> None:
        """A scan's findings and its row with the counts in one transaction; saving it again replaces both."""
        self.create("scans", SCANS)
        self.create("findings", FINDINGS)
        text = {c: F.to_json(F.col(c)) for c, t in findings.dtypes if t.startswith(("struct", "array", "map"))}
        known = [c for c in FINDINGS if c in findings.columns and c != "scan_id"]
        rows = findings.select(F.lit(scan_id).alias("scan_id"), *[text.get(c, F.col(c)).alias(c) for c in known])
        name = self.stage(rows, "findings")
        times = [self._time(t) for t in (created_at, completed_at)]
        counts = [f"total_vulnerabilities = (SELECT COUNT(*) FROM {name})", *[f"{s}_count = (SELECT COUNT(*) FROM {name} WHERE severity = '{s}')" for s in ("critical", "high", "medium", "low", "info")]]
        columns = ", ".join(rows.columns)
        try:
            self.transaction([
                ("DELETE FROM findings WHERE scan_id = ?", scan_id), (f"INSERT INTO findings ({columns}) SELECT {columns} FROM {name}",), ("DELETE FROM scans WHERE scan_id = ?", scan_id),
                ("INSERT INTO scans (scan_id, repository_id, status, created_at, completed_at) VALUES (?, ?, 'completed', ?, ?)", scan_id, repository_id, *times),
                (f"UPDATE scans SET {', '.join(counts)} WHERE scan_id = ?", scan_id),
            ])
        finally:
            self.drop(name)

    def _time(self, t):
        return None if t is None else self.spark._jvm.java.sql.Timestamp.valueOf(t.strftime("%Y-%m-%d %H:%M:%S.%f"))

    def load_findings(self, scan_id: str | None = None) -> DataFrame:
        """Findings with their nested columns decoded, see `decoded`."""
        df = self.frame("findings")
        return decoded(df if scan_id is None else df.where(F.col("scan_id") == scan_id))

    def findings_page(self, scan_id: str, size: int = 50, number: int = 1) -> DataFrame:
        """A page of a scan's findings by severity's name and line; the database sorts and cuts."""
        from lintel.operators import delta

        skip, take = delta.bounds(size, number)
        quoted = scan_id.replace("'", "''")
        sql = f"SELECT * FROM findings WHERE scan_id = '{quoted}' ORDER BY severity, line_start, file_path, fingerprint OFFSET {skip} ROWS FETCH NEXT {take} ROWS ONLY"
        df = self._options(self.spark.read).option("query", sql).load()
        return decoded(df.select(*[F.col(c).alias(c.lower()) for c in df.columns]))

    def load_scans(self) -> DataFrame:
        return self.frame("scans")


def of_session(spark: SparkSession) -> Database | Shards:
    """The database that `spark.lintel.database` names, as JSON of the arguments; if none is named, one in memory in local sessions, elsewhere shards in the shared folder."""
    named = spark.conf.get("spark.lintel.database", None)
    if named:
        return Database(spark, **json.loads(named))
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        return Shards(spark)
    return Database(spark, "jdbc:derby:memory:lintel;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver", "lintel_memory", "APP")
