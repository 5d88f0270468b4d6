"""Table transfer: match columns, convert, check, repair or reject rows, full refresh, report.

The source of a table is scanned once. With a reject store or keys the converted rows are landed by status first, in the
shared folder; both parts are then written aside and only swapped in when both are complete. Row counts and the first
error are observed during the scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions import types as ty
from keelson.functions.convert import DECIMAL_TYPE, can_overflow, canonical_value, decimal_lost, decimal_types, default_value, to_text
from keelson.functions.names import any_of
from keelson.operators.filters import common_columns
from keelson.operators.scale import cut_lineage, new_folder
from keelson.sources.stores import POSITION, delete_folder

CLEAN, REPAIRED, REJECTED = "clean", "repaired", "rejected"
#: Repeated keys that may be sent to every task: rows of a key and a position.
FEW_KEYS = 200_000
REPORT = (
    "table_name STRING, status STRING, rows_read BIGINT, rows_clean BIGINT, rows_repaired BIGINT, "
    "rows_rejected BIGINT, error STRING"
)


@dataclass(frozen=True)
class Target:
    """A column of the target table."""

    name: str
    canonical: str
    not_null: bool = False
    max_length: int = 0
    #: Precision and scale of a decimal; None stands for 38 and 10.
    decimal: tuple[int, int] | None = None
    #: The target fills the column itself where the source lacks it.
    filled: bool = False

    def type(self) -> T.DataType | None:
        if self.canonical == ty.DECIMAL and self.decimal:
            return T.DecimalType(*self.decimal)
        return ty.spark_type(self.canonical)


@dataclass(frozen=True)
class Rules:
    """What is known about a table beyond the schemas of its two sides.

    ``source_types`` overrides the canonical type of source columns, ``targets`` states
    the target columns; both default to the Spark schemas. ``keys`` are target columns no two rows
    may share: the first row by position stays. ``fit_decimals`` sizes decimal targets without a
    declared size so that every value is kept, at the cost of a pass over those columns.
    """

    source_types: dict[str, str] = field(default_factory=dict)
    targets: list[Target] | None = None
    decimal_comma: bool = False
    legacy_int_clamp: bool = False
    keys: tuple[str, ...] = ()
    fit_decimals: bool = False


def targets_of(schema: T.StructType) -> list[Target]:
    """Target columns of a Spark schema."""
    return [
        Target(f.name, ty.spark_to_canonical(f.dataType), not f.nullable, getattr(f.dataType, "length", 0) or 0,
               (f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else None)
        for f in schema
    ]


def _needs_fit(held: T.DataType, target: Target) -> bool:
    return target.type() not in (None, held)


def _fit(value: Column, held: T.DataType, target: Target) -> Column:
    """Canonical value as the type of its target column; NULL when it does not fit."""
    if not _needs_fit(held, target):
        return value
    wanted = target.type()
    if target.canonical in (ty.TEXT, ty.GUID):
        return to_text(value, held)
    if isinstance(held, T.StringType) or isinstance(held, T.NumericType) and isinstance(wanted, T.NumericType):
        return value.try_cast(wanted)
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(held, dates) and isinstance(wanted, dates):
        return value.cast(wanted)
    if isinstance(held, T.BooleanType) and isinstance(wanted, T.NumericType):
        return value.cast(wanted)
    return F.lit(None).cast(wanted)


def split_rows(df: DataFrame, targets: list[Target], rules: Rules = Rules()) -> DataFrame:
    """Target rows with ``_status`` (clean, repaired, rejected) and, when rejected, ``_reasons``.

    A row that breaks no rule is clean. When it breaks some, the NULLs in all its
    columns get defaults by source type; if that mends everything the row is repaired,
    otherwise rejected with the codes of its broken rules in column order. A number that its decimal
    type would round is rejected; so is every row where the source lacks a NOT NULL column
    that the target does not fill itself. A ``_position`` in ``df`` is passed on.
    """
    by_name = {t.name: t for t in targets}
    pairs = common_columns(df.columns, list(by_name))
    given = {name.lower(): kind for name, kind in rules.source_types.items()}
    kinds, checks, soft, raw, final = {}, [], [], [], []
    for source, name in pairs:
        dtype = df.schema[source].dataType
        kind = given.get(source.lower(), ty.spark_to_canonical(dtype))
        if rules.legacy_int_clamp and kind == ty.INT64:
            kind = ty.INT32
        kinds[name] = (kind, dtype)

    for i, (source, name) in enumerate(pairs):
        kind, dtype = kinds[name]
        target = by_name[name]
        c = F.col(f"`{source}`")
        scale = target.type().scale if isinstance(target.type(), T.DecimalType) else None
        decimal = f"decimal(38,{scale})" if scale is not None else DECIMAL_TYPE
        raw.append(canonical_value(c, dtype, kind, target.canonical, rules.decimal_comma, decimal).alias(f"_v{i}"))
        rounded = decimal_lost(c, dtype, scale, rules.decimal_comma) if scale is not None and kind == ty.DECIMAL else None
        if rounded is not None:
            raw.append(rounded.alias(f"_r{i}"))
        if can_overflow(dtype, kind):
            raw.append(c.isNotNull().alias(f"_n{i}"))
    # The partition number keeps the optimizer from moving a filter on the status below
    # this projection, where every conversion would be repeated inside the filter.
    place = [POSITION] if POSITION in df.columns else []
    converted = df.select(*raw, F.spark_partition_id().alias("_at"), *place)

    fitted, fitted_types = [], []
    for i, (_, name) in enumerate(pairs):
        held = converted.schema[f"_v{i}"].dataType
        target = by_name[name]
        value = _fit(F.col(f"_v{i}"), held, target)
        fitted.append(value.alias(f"_f{i}"))
        fitted_types.append(target.type() if _needs_fit(held, target) else held)
        lost = F.col(f"_n{i}") & F.col(f"_v{i}").isNull() if f"_n{i}" in converted.columns else None
        if lost is not None:
            checks.append((lost, f"overflow:{name}"))
        if _needs_fit(held, target):
            checks.append((F.col(f"_v{i}").isNotNull() & value.isNull(), f"type:{name}"))
        if f"_r{i}" in converted.columns:
            checks.append((F.col(f"_r{i}"), f"scale:{name}"))
        elif isinstance(target.type(), T.DecimalType) and isinstance(held, (T.FloatType, T.DoubleType)):
            checks.append((F.coalesce(value.cast("double") != F.col(f"_v{i}").cast("double"), F.lit(False)), f"scale:{name}"))
        dtype = fitted_types[i]
        if target.max_length > 0 and isinstance(dtype, T.StringType):
            checks.append((F.coalesce(F.length(value) > target.max_length, F.lit(False)), f"length:{name}"))
        if target.not_null:
            empty = F.col(f"_v{i}").isNull() if lost is None else F.col(f"_v{i}").isNull() & ~F.col(f"_n{i}")
            mend = default_value(kinds[name][0], dtype)
            too_long = F.length(mend.cast("string")) > target.max_length if target.max_length > 0 else F.lit(False)
            checks.append((empty & (mend.isNull() | too_long), f"null:{name}"))
            soft.append(empty)
    held_names = {name for _, name in pairs}
    checks += [(F.lit(True), f"missing:{t.name}") for t in targets if t.not_null and not t.filled and t.name not in held_names]
    status = (
        F.when(any_of([F.col("_at") < 0, *[bad for bad, _ in checks]]), F.lit(REJECTED))
        .when(any_of(soft), F.lit(REPAIRED)).otherwise(F.lit(CLEAN)))
    reasons = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(bad, F.lit(code)) for bad, code in checks]))
    marked = converted.select(*fitted, status.alias("_status"),
                              F.when(status == REJECTED, reasons).alias("_reasons"), *place)
    for i, (_, name) in enumerate(pairs):
        mend = default_value(kinds[name][0], fitted_types[i])
        value = F.col(f"_f{i}")
        final.append(F.when((F.col("_status") == REPAIRED) & value.isNull(), mend).otherwise(value).alias(name))
    return marked.select(*final, "_status", "_reasons", *place)


def accepted(rows: DataFrame) -> DataFrame:
    """Rows to be written: clean and repaired ones, without the marks."""
    return rows.filter(F.col("_status") != REJECTED).drop("_status", "_reasons", POSITION)


def rejected(rows: DataFrame) -> DataFrame:
    """Reject table: the row as far as it could be converted, its first reason and all of them."""
    return rows.filter(F.col("_status") == REJECTED).withColumn("first_reason", F.col("_reasons")[0]).withColumnRenamed(
        "_reasons", "reasons").drop("_status", POSITION)


def repeated_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that several accepted rows share, each with the position of its first row as ``_first``.

    Rows with a NULL in the key share nothing. Keys are counted within the tasks first, so one that owns most rows is a
    handful of rows by the time it is shuffled.
    """
    whole = rows.filter(F.col("_status") != REJECTED)
    for key in keys:
        whole = whole.filter(F.col(f"`{key}`").isNotNull())
    counted = whole.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(POSITION).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return counted.filter("_n > 1").drop("_n")


def reject_repeated(rows: DataFrame, keys: tuple[str, ...], held: DataFrame | None = None) -> DataFrame:
    """``rows`` with those rejected whose key an earlier row has, or a row of ``held``: the target that is appended to.

    ``rows`` must keep their ``_position`` when they are read again. Few repeated keys are sent to every task; many are
    joined by shuffle, where the adaptive plan splits a hot key's rows.
    """
    found = cut_lineage(repeated_keys(rows, keys))
    if held is not None:
        names = [F.col(f"`{k}`") for k in keys]
        known = rows.filter(F.col("_status") != REJECTED).select(*names).join(held.select(*names).distinct(), list(keys), "left_semi").distinct()
        # A key of the target has no first row here: all of its rows are repeats.
        none = F.lit(None).cast(rows.schema[POSITION].dataType)
        found = cut_lineage(found.join(known, list(keys), "left_anti").unionByName(known.withColumn("_first", none)))
    found = found.withColumn("_repeated", F.lit(True))
    joined = rows.join(F.broadcast(found) if found.count() <= FEW_KEYS else found, list(keys), "left")
    late = F.col("_repeated") & (F.col("_status") != REJECTED) & ~F.col(POSITION).eqNullSafe(F.col("_first"))
    late = F.coalesce(late, F.lit(False))
    return joined.withColumns({
        "_reasons": F.when(late, F.array(F.lit("duplicate:" + ",".join(keys)))).otherwise(F.col("_reasons")),
        "_status": F.when(late, F.lit(REJECTED)).otherwise(F.col("_status"))}).select(*rows.columns)


def _measures(position: Column) -> list[Column]:
    """Counts by status, and the first code of the first rejected row by position."""
    status = F.col("_status")
    bad = status == REJECTED
    return [
        F.count(F.lit(1)).alias("rows_read"), F.count_if(status == CLEAN).alias("rows_clean"),
        F.count_if(status == REPAIRED).alias("rows_repaired"), F.count_if(bad).alias("rows_rejected"),
        F.min_by(F.when(bad, F.col("_reasons")[0]), F.when(bad, position)).alias("first_error"),
    ]


def _error_text() -> Column:
    return F.when(F.col("rows_rejected") > 0, F.concat(
        F.col("rows_rejected").cast("string"), F.lit(" row(s) rejected: "), F.col("first_error")))


def report_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Report of split tables without writing them: one row per table.

    A table with some rejected rows is still ``ok`` and has an error text. The first error is that of the first row by
    ``_position`` where the rows have one, else in the order they are read.
    """
    report = None
    for name, rows in tables.items():
        placed = rows if POSITION in rows.columns else rows.withColumn(POSITION, F.monotonically_increasing_id())
        one = placed.agg(*_measures(F.col(POSITION))).select(
            F.lit(name).alias("table_name"), F.lit("ok").alias("status"), "rows_read", "rows_clean", "rows_repaired",
            "rows_rejected", _error_text().alias("error"))
        report = one if report is None else report.unionByName(one)
    return report


def report_totals(report: DataFrame) -> DataFrame:
    """Tables that worked, were skipped, and errors (a table can both work and have an error)."""
    return report.agg(
        F.count_if(F.col("status") == "ok").alias("tables_ok"),
        F.count_if(F.col("status") == "skipped").alias("tables_skipped"),
        F.count(F.col("error")).alias("n_errors"))


def _placed(source, spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """The columns with ``_position``: the place in the file, or the order of reading where a source has no files."""
    if hasattr(source, "placed"):
        return source.placed(spark, table, columns)
    return source.read(spark, table, columns).withColumn(POSITION, F.struct(
        F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("row")))


def _sized(df: DataFrame, targets: list[Target], pairs: list[tuple[str, str]], rules: Rules) -> list[Target]:
    """Targets whose decimals have a size that keeps every value of their source column."""
    given = {name.lower(): kind for name, kind in rules.source_types.items()}
    source = {name: s for s, name in pairs}
    open_ones = [t.name for t in targets if t.canonical == ty.DECIMAL and not t.decimal and t.name in source
                 and given.get(source[t.name].lower(), ty.spark_to_canonical(df.schema[source[t.name]].dataType)) == ty.DECIMAL]
    found = decimal_types(df, [source[name] for name in open_ones], rules.decimal_comma)
    sizes = {name: (found[source[name]].precision, found[source[name]].scale) for name in open_ones}
    return [replace(t, decimal=sizes[t.name]) if t.name in sizes else t for t in targets]


def _finish(store, df: DataFrame, table: str):
    """Writes aside where the store can, and returns what puts the rows in place."""
    return store.stage(df, table) if hasattr(store, "stage") else lambda: store.replace(df, table)


def _land(rows: DataFrame) -> str:
    folder = new_folder(rows.sparkSession, "landed")
    rows.withColumn("_bad", F.col("_status") == REJECTED).write.partitionBy("_bad").parquet(folder)
    return folder


def _landed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.BooleanType())])).parquet(folder)


def _transfer_table(spark: SparkSession, source, target, rejects, landing, table: str, rules: Rules,
                    append: bool) -> tuple:
    targets = rules.targets or targets_of(target.schema(spark, table))
    names = common_columns(source.schema(spark, table).names, [t.name for t in targets])
    if not names:
        return (table, "skipped", 0, 0, 0, 0, None)
    df = _placed(source, spark, table, [s for s, _ in names])
    if landing is not None:
        landing.replace(df, table)
        df = landing.read(spark, table)
    if rules.fit_decimals:
        targets = _sized(df, targets, names, rules)
    rows = split_rows(df, targets, rules)
    seen = Observation(f"transfer {table}")
    measures = _measures(F.col(POSITION))
    if rejects is None and not rules.keys:
        write = target.append if append else target.replace
        write(accepted(rows.observe(seen, *measures)), table)
    else:
        # One write of all rows: the accepted ones and the rejects are folders of it, and later reads prune to one.
        landed = [_land(rows if rules.keys else rows.observe(seen, *measures))]
        rows = _landed(spark, landed[0], rows.schema)
        if rules.keys:
            held = target.read(spark, table, list(rules.keys)) if append and table in target.tables(spark) else None
            judged = reject_repeated(rows.drop("_bad"), rules.keys, held)
            landed.append(_land(judged.observe(seen, *measures)))
            rows = _landed(spark, landed[1], judged.schema)
        good, bad = (rows.filter(F.col("_bad") == flag).drop("_bad") for flag in (False, True))
        # Both parts are complete before either is put in place. Rejects are replaced even by none: old ones are stale.
        swap_rejects = _finish(rejects, rejected(bad), table) if rejects is not None else lambda: None
        if append:
            target.append(accepted(good), table)
        else:
            _finish(target, accepted(good), table)()
        swap_rejects()
        for folder in landed:
            delete_folder(spark, folder)
    found = seen.get
    error = f"{found['rows_rejected']} row(s) rejected: {found['first_error']}" if found["rows_rejected"] else None
    return (table, "ok", found["rows_read"], found["rows_clean"], found["rows_repaired"], found["rows_rejected"], error)


def transfer(spark: SparkSession, source, target, tables: list[str], rules: dict[str, Rules] | None = None,
             rejects=None, landing=None, append: bool = False, at_once: int = 4) -> DataFrame:
    """Copy tables from one store to another; returns the report, one row per table.

    Each table is a full refresh (or an append). Rejected rows replace those of the last run in the
    ``rejects`` store. The source is read once, but for ``fit_decimals``: give a ``landing`` store then where
    it is costly to read or changes meanwhile. A write that fails leaves target and rejects as they were.
    A failing table is reported and does not stop the others; ``at_once`` tables run side
    by side.
    """
    def run(table: str) -> tuple:
        try:
            return _transfer_table(spark, source, target, rejects, landing, table, (rules or {}).get(table, Rules()), append)
        except Exception as failure:  # noqa: BLE001 - any failure is a row of the report
            return (table, "failed", 0, 0, 0, 0, f"{type(failure).__name__}: {str(failure).splitlines()[0]}")

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(run), tables))
    return spark.createDataFrame(rows, REPORT)
