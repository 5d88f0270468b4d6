"""Places tables are read from and written to: file folders, the Spark catalog, JDBC databases."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.text import QUOTES, DEFAULT_QUOTE


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so that code outside the JVM means the same place."""
    return _file_system(spark, path).makeQualified(_path(spark, path)).toString()


def swap_folder(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in place of another; the old one goes last."""
    fs = _file_system(spark, target)
    old = f"{target}.old-{uuid.uuid4().hex}"
    had_old = fs.exists(_path(spark, target))
    if had_old and not fs.rename(_path(spark, target), _path(spark, old)):
        raise OSError(f"cannot move {target} aside")
    fs.mkdirs(_path(spark, target).getParent())
    if not fs.rename(_path(spark, staged), _path(spark, target)):
        if had_old:
            fs.rename(_path(spark, old), _path(spark, target))
        raise OSError(f"cannot move {staged} to {target}")
    if had_old:
        fs.delete(_path(spark, old), True)


def delete_folder(spark: SparkSession, path: str) -> None:
    _file_system(spark, path).delete(_path(spark, path), True)


def conformed(df: DataFrame, columns: T.StructType) -> DataFrame:
    """``df`` with exactly these columns, matched without case; those it lacks are NULL."""
    given = {c.lower(): c for c in df.columns}
    return df.select(*[
        (F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in columns])


#: A row's place in its source: struct of file, block and row.
POSITION = "_position"


@dataclass(frozen=True)
class FileStore:
    """Tables as folders (or files ending in the format's name) below one path."""

    path: str
    format: str = "parquet"

    def location(self, spark: SparkSession, table: str) -> str:
        folder = f"{self.path.rstrip('/')}/{table}"
        for place in (f"{folder}.{self.format}", folder):
            if _file_system(spark, place).exists(_path(spark, place)):
                return place
        raise FileNotFoundError(f"no table {table} in {self.path}")

    def tables(self, spark: SparkSession) -> list[str]:
        statuses = _file_system(spark, self.path).listStatus(_path(spark, self.path))
        names = [s.getPath().getName() for s in statuses]
        return sorted(n.removesuffix(f".{self.format}") for n in names if not n.startswith(("_", ".")))

    def read(self, spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
        df = spark.read.format(self.format).load(self.location(spark, table))
        return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df

    def placed(self, spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
        """The columns, and ``_position``: the file and the row's place in it, the same however the file is split."""
        df = spark.read.format(self.format).load(self.location(spark, table))
        index = "row_index" if self.format == "parquet" else None
        place = F.col("_metadata.row_index") if index else F.monotonically_increasing_id()
        block = F.lit(0).cast("long") if index else F.col("_metadata.file_block_start")
        return df.select(*[F.col(f"`{c}`") for c in columns], F.struct(
            F.col("_metadata.file_path").alias("file"), block.alias("block"), place.alias("row")).alias(POSITION))

    def schema(self, spark: SparkSession, table: str) -> T.StructType:
        return self.read(spark, table).schema

    def _place(self, spark: SparkSession, table: str) -> tuple[str, T.StructType | None]:
        """Where the table is, or would be, and its columns if it is there."""
        try:
            place = self.location(spark, table)
        except FileNotFoundError:
            return f"{self.path.rstrip('/')}/{table}", None
        return place, self.schema(spark, table)

    def stage(self, df: DataFrame, table: str) -> Callable[[], None]:
        """Writes a full refresh aside; calling the result swaps it in. Columns that ``df`` lacks stay and become NULL."""
        spark = df.sparkSession
        target, columns = self._place(spark, table)
        staged = f"{self.path.rstrip('/')}/_staged-{table}-{uuid.uuid4().hex}"
        (conformed(df, columns) if columns else df).write.format(self.format).mode("errorifexists").save(staged)
        return lambda: swap_folder(spark, staged, target)

    def replace(self, df: DataFrame, table: str) -> None:
        """Full refresh in the table's place; the rows are written aside first, so a failed job leaves the old ones."""
        self.stage(df, table)()

    def append(self, df: DataFrame, table: str) -> None:
        """Adds rows; columns that ``df`` lacks are NULL in them."""
        spark = df.sparkSession
        target, columns = self._place(spark, table)
        rows = conformed(df, columns) if columns else df
        if columns and _file_system(spark, target).getFileStatus(_path(spark, target)).isFile():
            self.replace(self.read(spark, table).unionByName(rows), table)  # nothing can be added to a single file
        else:
            rows.write.format(self.format).mode("append").save(target)


@dataclass(frozen=True)
class CatalogStore:
    """Tables of a Spark catalog database."""

    database: str = "default"

    def _name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def tables(self, spark: SparkSession) -> list[str]:
        return sorted(t.name for t in spark.catalog.listTables(self.database) if not t.isTemporary)

    def read(self, spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
        df = spark.table(self._name(table))
        return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df

    def schema(self, spark: SparkSession, table: str) -> T.StructType:
        return spark.table(self._name(table)).schema

    def replace(self, df: DataFrame, table: str) -> None:
        """Full refresh by INSERT OVERWRITE; table columns that ``df`` lacks become NULL."""
        spark = df.sparkSession
        if not spark.catalog.tableExists(f"{self.database}.{table}"):
            df.write.saveAsTable(self._name(table))
            return
        conformed(df, self.schema(spark, table)).write.insertInto(self._name(table), overwrite=True)

    def append(self, df: DataFrame, table: str) -> None:
        """Adds rows; table columns that ``df`` lacks are NULL in them."""
        spark = df.sparkSession
        if spark.catalog.tableExists(f"{self.database}.{table}"):
            conformed(df, self.schema(spark, table)).write.insertInto(self._name(table))
        else:
            df.write.saveAsTable(self._name(table))


# Driver settings that make large reads stream.
READ_SETTINGS = {
    "Oracle": {"fetchsize": "10000", "oracle.jdbc.defaultLobPrefetchSize": "4000"},
    "MySQL": {"fetchsize": "-2147483648"},
    "MariaDB": {"fetchsize": "1000"},
}


@dataclass(frozen=True)
class JdbcStore:
    """Tables of a database whose JDBC driver is on the class path.

    ``split`` names, per table, a numeric column with its bounds and the number of
    partitions, so that a large table is read by many tasks.
    """

    backend: str
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    split: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)
    batch_size: int = 10_000
    writers: int = 16

    def quoted(self, name: str) -> str:
        opening, closing = QUOTES.get(self.backend, DEFAULT_QUOTE)
        text = name.upper() if self.backend == "Oracle" else name
        return f"{opening}{text.replace(closing, closing * 2)}{closing}"

    def read_options(self, table: str) -> dict[str, str]:
        options = {"url": self.url, "dbtable": self.quoted(table), "fetchsize": "10000",
                   **READ_SETTINGS.get(self.backend, {}), **self.properties}
        if table in self.split:
            column, low, high, parts = self.split[table]
            options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high),
                        "numPartitions": str(parts)}
        return options

    def write_options(self, table: str) -> dict[str, str]:
        return {"url": self.url, "dbtable": self.quoted(table), "batchsize": str(self.batch_size),
                "numPartitions": str(self.writers), "isolationLevel": "READ_COMMITTED", **self.properties}

    def read(self, spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
        df = spark.read.format("jdbc").options(**self.read_options(table)).load()
        return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df

    def schema(self, spark: SparkSession, table: str) -> T.StructType:
        return self.read(spark, table).schema

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=self.url, query=sql, **self.properties).load()

    def tables(self, spark: SparkSession) -> list[str]:
        rows = self.query(spark, CATALOG_QUERIES[self.backend]["tables"]).collect()
        return sorted(r[0].rstrip() for r in rows)

    def columns(self, spark: SparkSession, db: str) -> DataFrame:
        """Raw column rows for ``catalog.column_catalog``."""
        raw = self.query(spark, CATALOG_QUERIES[self.backend]["columns"])
        names = ["table_name", "position", "column_name", "type_name", "length", "not_null", "identity"]
        return raw.toDF(*names).select(
            F.lit(db).alias("db"), F.lit(self.backend).alias("backend"), F.rtrim("table_name").alias("table_name"),
            F.col("position").cast("int").alias("position"), F.rtrim("column_name").alias("column_name"),
            F.rtrim("type_name").alias("type_name"), F.col("length").try_cast("int").alias("length"),
            F.col("not_null").cast("int").cast("boolean").alias("not_null"),
            F.col("identity").cast("string").alias("identity"))

    def replace(self, df: DataFrame, table: str) -> None:
        """Full refresh that keeps the table and its definition.

        Partitions commit on their own over JDBC. Where readers must never see a part,
        write to a staging table and swap the two in the database.
        """
        df.write.format("jdbc").options(**self.write_options(table)).option("truncate", "true").mode("overwrite").save()

    def append(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").options(**self.write_options(table)).mode("append").save()


_INFORMATION_COLUMNS = (
    "SELECT c.table_name, c.ordinal_position, c.column_name, c.data_type, c.character_maximum_length, "
    "CASE WHEN c.is_nullable = 'NO' THEN 1 ELSE 0 END, {identity} "
    "FROM information_schema.columns c WHERE c.table_schema = {schema}"
)
# Catalog queries for a whole database: table names; and table, position, column, type,
# length, not-null flag (0/1), identity mark.
CATALOG_QUERIES = {
    "SQLite": {
        "tables": "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
        "columns": "SELECT m.name, p.cid + 1, p.name, p.type, 0, p.\"notnull\", '' "
                   "FROM sqlite_master m, pragma_table_info(m.name) p "
                   "WHERE m.type = 'table' AND m.name NOT LIKE 'sqlite_%'",
    },
    "MySQL": {
        "tables": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
        "columns": _INFORMATION_COLUMNS.format(identity="c.extra", schema="DATABASE()"),
    },
    "PostgreSQL": {
        "tables": "SELECT table_name FROM information_schema.tables "
                  "WHERE table_schema = current_schema() AND table_type = 'BASE TABLE'",
        "columns": _INFORMATION_COLUMNS.format(
            identity="CASE WHEN c.is_identity = 'YES' THEN 'YES' ELSE c.column_default END",
            schema="current_schema()"),
    },
    "SqlServer": {
        "tables": "SELECT table_name FROM information_schema.tables "
                  "WHERE table_schema = SCHEMA_NAME() AND table_type = 'BASE TABLE'",
        "columns": _INFORMATION_COLUMNS.format(
            identity="COLUMNPROPERTY(OBJECT_ID(c.table_schema + '.' + c.table_name), c.column_name, 'IsIdentity')",
            schema="SCHEMA_NAME()"),
    },
    "Oracle": {
        "tables": "SELECT table_name FROM user_tables",
        "columns": "SELECT c.table_name, c.column_id, c.column_name, c.data_type, c.char_length, "
                   "CASE WHEN c.nullable = 'N' THEN 1 ELSE 0 END, c.identity_column FROM user_tab_columns c",
    },
    "DB2": {
        "tables": "SELECT tabname FROM syscat.tables WHERE tabschema = CURRENT SCHEMA AND type = 'T'",
        "columns": "SELECT tabname, colno + 1, colname, typename, length, "
                   "CASE WHEN nulls = 'N' THEN 1 ELSE 0 END, identity "
                   "FROM syscat.columns WHERE tabschema = CURRENT SCHEMA",
    },
    "Firebird": {
        "tables": "SELECT rdb$relation_name FROM rdb$relations "
                  "WHERE rdb$system_flag = 0 AND rdb$view_blr IS NULL",
        "columns": "SELECT r.rdb$relation_name, r.rdb$field_position + 1, r.rdb$field_name, "
                   "f.rdb$field_type || ':' || COALESCE(f.rdb$field_sub_type, 0), "
                   "COALESCE(f.rdb$character_length, f.rdb$field_length), COALESCE(r.rdb$null_flag, 0), "
                   "r.rdb$identity_type FROM rdb$relation_fields r "
                   "JOIN rdb$fields f ON f.rdb$field_name = r.rdb$field_source",
    },
}
CATALOG_QUERIES["MariaDB"] = CATALOG_QUERIES["MySQL"]
