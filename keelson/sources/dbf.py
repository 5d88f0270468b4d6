"""dBase tables as a Spark data source, in both directions.

``spark.dataSource.register(DbfSource)`` once, then ``format("dbf")``. A path is one
file or a folder of files. Reading splits every file into ranges of records, which
have a fixed size, so one large file is read by many tasks. Writing gives one
complete file per slice of records; a folder of them is one table, as with Parquet.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

from keelson.functions.convert import digit_counts, to_text
from keelson.functions.encode import fixed_width, fixed_width_overflow
from keelson.functions.text import DBASE_NAME
from keelson.sources.stores import qualified

# Fixed values of the file layout.
HEADER_SIZE, FIELD_SIZE = 32, 32
FIELD_END, FILE_END = b"\x0d", b"\x1a"
LIVE = " "
DELETED = 0x2A
VERSION = 0x03
CODE_PAGE = "cp1250"
# Rows per read range and per written file; a slice is held in memory by one task.
READ_ROWS, WRITE_ROWS, BATCH_ROWS = 1_000_000, 500_000, 50_000


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int
    decimals: int = 0


def parse_header(head: bytes) -> tuple[int, int, int]:
    """(record count, header size, record size)."""
    return struct.unpack_from("<IHH", head, 4)


def parse_fields(block: bytes) -> list[Field]:
    fields = []
    for at in range(0, len(block) - FIELD_SIZE + 1, FIELD_SIZE):
        raw = block[at:at + FIELD_SIZE]
        if raw[:1] == FIELD_END:
            break
        name = raw[:11].split(b"\0")[0].decode("ascii", "replace").strip()
        fields.append(Field(name, chr(raw[11]), raw[16], raw[17]))
    return fields


def build_header(fields: list[Field], rows: int) -> bytes:
    size = HEADER_SIZE + FIELD_SIZE * len(fields) + 1
    width = 1 + sum(f.length for f in fields)
    head = struct.pack("<BBBBIHH20x", VERSION, 95, 7, 26, rows, size, width)
    body = b"".join(
        struct.pack("<11sc4xBB14x", f.name.encode("ascii", "replace")[:DBASE_NAME], f.kind.encode(), f.length, f.decimals)
        for f in fields)
    return head + body + FIELD_END


def spark_field(f: Field, name: str) -> T.StructField:
    kinds = {"L": T.BooleanType(), "D": T.DateType(), "F": T.DoubleType()}
    number = T.DecimalType(38, f.decimals) if f.decimals else T.LongType()
    kind = kinds.get(f.kind, number if f.kind == "N" else T.StringType())
    if f.kind == "N" and not f.decimals and f.length > 18:
        kind = T.DecimalType(38, 0)
    return T.StructField(name, kind)


def field_for(f: T.StructField, text_length: int = 254) -> Field:
    """Field of a Spark column."""
    kind = f.dataType
    if isinstance(kind, T.BooleanType):
        return Field(f.name, "L", 1)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Field(f.name, "D", 8)
    if isinstance(kind, T.IntegralType):
        return Field(f.name, "N", 20 if isinstance(kind, T.LongType) else 11)
    if isinstance(kind, T.DecimalType):
        return Field(f.name, "N", 20, min(kind.scale, 15))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Field(f.name, "F", 20, 4)
    return Field(f.name, "C", text_length)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path and the path inside it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [path]
    found = [i.path for i in system.get_file_info(pafs.FileSelector(inner))
             if i.type == pafs.FileType.File and i.path.lower().endswith(".dbf")]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [prefix + p for p in sorted(found)]


def _layout(path: str) -> tuple[int, int, int, list[Field]]:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        rows, size, width = parse_header(f.read(HEADER_SIZE))
        return rows, size, width, parse_fields(f.read(size - HEADER_SIZE))


def _full_names(path: str, fields: list[Field], names: str | None) -> list[str]:
    """Full column names by position, where a side list gives them."""
    full = [n for n in (names or "").split("\n") if n.strip()]
    return [full[i] if i < len(full) else f.name for i, f in enumerate(fields)]


@dataclass
class RecordRange(InputPartition):
    path: str
    first: int
    rows: int

    def __init__(self, path: str, first: int, rows: int):
        super().__init__(None)
        self.path, self.first, self.rows = path, first, rows


# A cell that is a number; anything else, such as the asterisks of an overflow, reads as NULL.
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def _text(raw: np.ndarray) -> pa.Array:
    """The cells of a block as text without closing blanks. The code page has one character per byte, so the block is
    decoded as one text and cut into cells again."""
    rows, width = raw.shape
    decoded = raw.tobytes().decode(CODE_PAGE, "replace").encode("utf-32-le")
    cells = np.frombuffer(decoded, np.uint32).reshape(rows, width).view(f"<U{width}").ravel()
    return pc.utf8_rtrim(pa.array(cells, pa.string()), characters=" \0")


def _column(raw: np.ndarray, f: Field, kind: pa.DataType) -> pa.Array:
    """One field of a block of records as an Arrow array."""
    text = _text(raw)
    if f.kind == "L":
        return pc.is_in(text, pa.array(["T", "t", "Y", "y"]))
    if f.kind == "D":
        return pc.cast(pc.strptime(pc.if_else(pc.equal(text, ""), None, text), format="%Y%m%d", unit="s",
                                   error_is_null=True), pa.date32())
    if f.kind in ("N", "F"):
        trimmed = pc.utf8_trim_whitespace(text)
        number = pc.if_else(pc.match_substring_regex(trimmed, _NUMBER if f.kind == "N" else _NUMBER[:-1] + "([eE][+-]?\\d+)?$"), trimmed, None)
        if pa.types.is_int64(kind):
            # A whole number may still be spelt with a point.
            number = pc.replace_substring_regex(number, r"\.0*$", "")
            number = pc.if_else(pc.match_substring_regex(number, r"^[+-]?\d+$"), number, None)
        return pc.cast(number, kind)
    return text


class DbfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema = schema
        self.path = options["path"]
        self.step = int(options.get("rowsPerRange", READ_ROWS))

    def partitions(self):
        parts = []
        for path in _files(self.path):
            rows = _layout(path)[0]
            parts += [RecordRange(path, at, min(self.step, rows - at)) for at in range(0, rows, self.step)]
        return parts or [RecordRange("", 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        _, size, width, fields = _layout(partition.path)
        system, inner = _open(partition.path)
        target = pa.schema([(f.name, _arrow_type(f.dataType)) for f in self.schema])
        with system.open_input_file(inner) as f:
            f.seek(size + partition.first * width)
            left = partition.rows
            while left:
                n = min(left, BATCH_ROWS)
                left -= n
                block = np.frombuffer(f.read(n * width), np.uint8).reshape(-1, width)
                block = block[block[:, 0] != DELETED]
                arrays, at = [], 1
                for each, field in zip(fields, target):
                    arrays.append(_column(block[:, at:at + each.length], each, field.type))
                    at += each.length
                yield pa.RecordBatch.from_arrays(arrays, schema=target)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
            T.DateType: pa.date32()}.get(type(kind), pa.string())


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class DbfWriter(DataSourceArrowWriter):
    """Receives rows with one ``record`` text, already cut to field widths."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.fields = [Field(n, k, int(w), int(d)) for n, k, w, d in
                       (line.split("|") for line in options["fields"].split("\n"))]
        self.slice = int(options.get("rowsPerFile", WRITE_ROWS))
        self.overwrite = overwrite
        self.temporary = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[str] = []
        held: list[str] = []
        for batch in iterator:
            held += batch.column(0).to_pylist()
            while len(held) >= self.slice:
                files.append(self._save(held[: self.slice]))
                held = held[self.slice:]
        if held:
            files.append(self._save(held))
        return Written(files)

    def _save(self, records: list[str]) -> str:
        body = "".join(LIVE + record for record in records).encode(CODE_PAGE, "replace")
        system, folder = _open(self.temporary)
        system.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.dbf"
        with system.open_output_stream(f"{folder}/{name}") as out:
            out.write(build_header(self.fields, len(records)) + body + FILE_END)
        return name

    def commit(self, messages) -> None:
        """Only the files of successful tasks are moved in; the data stays where it is."""
        system, folder = _open(self.path)
        _, temporary = _open(self.temporary)
        old = [] if not self.overwrite else [
            i.path for i in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            if i.path.lower().endswith(".dbf")]
        system.create_dir(folder, recursive=True)
        names = [n for m in messages if m for n in m.files]
        if not names and (self.overwrite or not _files(self.path)):
            names = [self._save([])]  # a table without rows keeps its columns
        for name in names:
            system.move(f"{temporary}/{name}", f"{folder}/{name}")
        for path in old:
            system.delete_file(path)
        self._clean(system, temporary)

    def abort(self, messages) -> None:
        system, temporary = _open(self.temporary)
        self._clean(system, temporary)

    @staticmethod
    def _clean(system, folder: str) -> None:
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            return T.StructType([])
        fields = _layout(files[0])[3]
        names = _full_names(files[0], fields, self.options.get("columnNames"))
        return T.StructType([spark_field(f, n) for f, n in zip(fields, names)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return DbfReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return DbfWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbfSource)


def _charset() -> str:
    """Pattern of a character that the code page lacks."""
    held = sorted(ord(c) for c in bytes(range(256)).decode(CODE_PAGE, "ignore"))
    return "[^" + "".join(f"\\x{{{c:X}}}" for c in held) + "]"


def unfit_reasons(df: DataFrame, fields: list[Field]) -> Column:
    """Codes of the cells that a record would change, in column order; empty where the record keeps them all.

    ``length`` (text too long), ``charset`` (a character beyond the code page), ``overflow`` (digits beyond the field),
    ``scale`` (places beyond the field), ``time`` (a moment that is not midnight), ``date`` (no date of eight digits) and
    ``type`` (a value that such a field cannot hold).
    """
    checks = []
    for column, f in zip(df.schema, fields, strict=True):
        c, kind = F.col(f"`{column.name}`"), column.dataType
        if f.kind == "C":
            shown = to_text(c, kind)
            checks.append((F.length(shown) > f.length, f"length:{column.name}"))
            if isinstance(kind, T.StringType):
                checks.append((shown.rlike(_charset()), f"charset:{column.name}"))
        elif f.kind in ("N", "F"):
            if not isinstance(kind, (T.NumericType, T.BooleanType, T.StringType)):
                checks.append((c.isNotNull(), f"type:{column.name}"))
                continue
            if isinstance(kind, (T.FloatType, T.DoubleType)):
                checks.append((F.isnan(c) | (F.abs(c) == float("inf")), f"type:{column.name}"))
            elif isinstance(kind, T.StringType):
                checks.append((c.isNotNull() & c.try_cast("double").isNull(), f"type:{column.name}"))
            checks.append((fixed_width_overflow(c, kind, f.kind, f.length, f.decimals), f"overflow:{column.name}"))
            if not isinstance(kind, (T.IntegralType, T.BooleanType)):
                checks.append((digit_counts(c, kind)["places"] > f.decimals, f"scale:{column.name}"))
        elif f.kind == "D":
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                checks.append((F.date_trunc("day", c) != c, f"time:{column.name}"))
            if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                checks.append((~F.year(c).between(1, 9999), f"date:{column.name}"))
            else:
                ok = F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).isNotNull() & (F.length(c.cast("string")) == 8)
                checks.append((c.isNotNull() & ~ok, f"date:{column.name}"))
        elif f.kind == "L":
            if not isinstance(kind, (T.BooleanType, T.IntegralType)):
                checks.append((c.isNotNull() & ~F.lower(c.cast("string")).isin("t", "f", "true", "false"), f"type:{column.name}"))
            elif not isinstance(kind, T.BooleanType):
                checks.append((~c.isin(0, 1), f"type:{column.name}"))
        else:
            checks.append((c.isNotNull(), f"type:{column.name}"))
    return F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(bad, F.lit(code)) for bad, code in checks]))


def record_text(df: DataFrame, fields: list[Field]) -> DataFrame:
    """Each row as one fixed-width record, built by native expressions."""
    cells = [fixed_width(F.col(f"`{s.name}`"), s.dataType, f.kind, f.length, f.decimals)
             for s, f in zip(df.schema, fields)]
    return df.select(F.concat(*cells).alias("record"))


def short_names(names: list[str]) -> dict[str, str]:
    """full name -> file name; names that would collide after shortening get a number."""
    taken: set[str] = set()
    result = {}
    for name in names:
        short, n = name[:DBASE_NAME], 1
        while short.lower() in taken:
            n += 1
            short = name[: DBASE_NAME - len(str(n))] + str(n)
        taken.add(short.lower())
        result[name] = short
    return result


def match_truncated(field_name: str, columns: list[str]) -> str | None:
    """Column of a shortened field name: the exact one, else the first that starts with it."""
    exact = [c for c in columns if c.lower() == field_name.lower()]
    longer = [c for c in columns if c.lower().startswith(field_name.lower())]
    return (exact + longer + [None])[0]


def collisions(columns: DataFrame) -> DataFrame:
    """Column names of a catalog that shorten to the same field name, with their number."""
    short = F.lower(F.substring("column_name", 1, DBASE_NAME)).alias("short_name")
    return columns.groupBy("db", "table_name", short).agg(F.count_distinct(F.lower("column_name")).alias("n_columns")
                                                        ).filter(F.col("n_columns") > 1)


def write_dbf(df: DataFrame, path: str, fields: list[Field] | None = None, mode: str = "overwrite",
              rows_per_file: int = WRITE_ROWS) -> DataFrame:
    """Write the rows that fit as a folder of dBase files; returns those that do not, with their ``reasons``.

    A row fits when reading its record gives its values back, but for blanks at the end of texts. Whoever calls this
    stores the returned rows; they are found again from ``df`` when they are used.
    """
    register(df.sparkSession)
    fields = fields or [field_for(f) for f in df.schema]
    short = short_names(df.columns)
    named = [Field(short[s.name], f.kind, f.length, f.decimals) for s, f in zip(df.schema, fields)]
    text = "\n".join(f"{f.name}|{f.kind}|{f.length}|{f.decimals}" for f in named)
    reasons = unfit_reasons(df, named)
    record_text(df.filter(F.size(reasons) == 0), named).write.format("dbf").mode(mode).option("fields", text).option(
        "rowsPerFile", rows_per_file).save(qualified(df.sparkSession, path))
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def read_dbf(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Read a file or folder of dBase files; ``names`` are the full column names by position."""
    register(spark)
    reader = spark.read.format("dbf")
    if names:
        reader = reader.option("columnNames", "\n".join(names))
    return reader.load(qualified(spark, path))
