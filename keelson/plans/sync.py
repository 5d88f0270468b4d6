"""Fleet sync: every database against the declared schema of its program."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import types as ty
from keelson.functions.names import as_col
from keelson.functions.types import resolve_any, spark_type
from keelson.operators import diff
from keelson.operators.filters import conform

# Order in which the kinds of change are applied.
STEPS = {diff.CREATE_TABLE: 1, diff.ADD_COLUMN: 2, diff.SURPLUS_COLUMN: 3, diff.SURPLUS_TABLE: 4, diff.ADD_FK: 5,
         diff.SKIP_FK: 6, diff.IDENTITY_MISMATCH: 7}


def fleet_databases(registry: DataFrame, program_id: Column | str) -> DataFrame:
    """Registry entries as the ``databases`` input of a diff; unknown backends carry an error."""
    return registry.select(
        F.col("address").alias("db"), as_col(program_id).alias("program_id"), "backend",
        F.col("reason").alias("error"))


def fleet_sync(databases: DataFrame, declared: DataFrame, live: DataFrame, declared_fks: DataFrame | None = None,
               live_fks: DataFrame | None = None, delete_redundant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(actions, report): all differences, and one summary row per database.

    Databases with an error take no part in the diff and are reported with it.
    """
    usable = databases.filter(F.col("error").isNull()) if "error" in databases.columns else databases
    actions = diff.FleetDiff(usable, declared, live, declared_fks, live_fks).actions
    return actions, diff.summary(databases, actions, delete_redundant)


def apply_plan(actions: DataFrame, delete_redundant: bool = False) -> DataFrame:
    """Changes in the order they are to be applied; drops only on request, mismatches never."""
    wanted = [diff.CREATE_TABLE, diff.ADD_COLUMN, diff.ADD_FK, diff.SKIP_FK]
    if delete_redundant:
        wanted += [diff.SURPLUS_COLUMN, diff.SURPLUS_TABLE]
    step = F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair])
    return actions.filter(F.col("action").isin(wanted)).select(
        "db", F.try_element_at(step, F.col("action")).alias("step"), "action", "table_name", "column_name",
        "position", "reason")


def _spark_column(name: str, type_text: str, canonical: str) -> str:
    kind = spark_type(canonical)
    return f"`{name}` {kind.simpleString() if kind else 'string'}"


def _with_canonical(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("type"), F.lit(""))
    return df.withColumn("_canonical", F.when(text == "", F.lit(ty.TEXT)).when(
        ty.is_auto_number(text), F.lit(ty.INT32)).otherwise(resolve_any(text)))


def apply_to_spark_catalog(spark: SparkSession, database: str, actions: DataFrame, declared: DataFrame,
                           delete_redundant: bool = False) -> list[str]:
    """Carry out the changes of one Spark catalog database; returns the statements run.

    ``actions`` are those of this database, ``declared`` the schema of its program: both
    are the schema of one database, so they are small. The live state is looked at again
    before each step. File tables cannot drop columns, so such a table is rewritten.
    """
    done: list[str] = []

    def run(sql: str) -> None:
        spark.sql(sql)
        done.append(sql)

    def columns(table: str) -> set[str]:
        return {c.lower() for c in spark.table(f"`{database}`.`{table}`").columns}

    plan = _with_canonical(actions).collect()
    made = [r for r in plan if r.action == diff.CREATE_TABLE]
    names = declared.join(actions.filter(F.col("action") == diff.CREATE_TABLE).select("table_name"), "table_name",
                          "left_semi")
    layout: dict[str, list] = {}
    for row in _with_canonical(names).orderBy("table_name", "column_id").collect():
        layout.setdefault(row.table_name, []).append(_spark_column(row.column_name, row.type, row._canonical))
    for r in made:
        if not spark.catalog.tableExists(f"{database}.{r.table_name}"):
            run(f"CREATE TABLE IF NOT EXISTS `{database}`.`{r.table_name}` ({', '.join(layout[r.table_name])}) USING parquet")
    for r in sorted((r for r in plan if r.action == diff.ADD_COLUMN), key=lambda r: (r.table_name, r.position)):
        if r.column_name.lower() not in columns(r.table_name):
            run(f"ALTER TABLE `{database}`.`{r.table_name}` ADD COLUMNS ({_spark_column(r.column_name, r.type, r._canonical)})")
    if delete_redundant:
        surplus: dict[str, list[str]] = {}
        for r in plan:
            if r.action == diff.SURPLUS_COLUMN:
                surplus.setdefault(r.table_name, []).append(r.column_name.lower())
        for table, gone in surplus.items():
            rewrite_without(spark, database, table, gone)
            done.append(f"-- rewritten `{database}`.`{table}` without {', '.join(sorted(gone))}")
        for r in plan:
            if r.action == diff.SURPLUS_TABLE and spark.catalog.tableExists(f"{database}.{r.table_name}"):
                run(f"DROP TABLE IF EXISTS `{database}`.`{r.table_name}`")
    return done


def rewrite_without(spark: SparkSession, database: str, table: str, gone: list[str]) -> None:
    """Table without some columns: a copy takes its name once it is complete."""
    source = spark.table(f"`{database}`.`{table}`")
    kept = [c for c in source.columns if c.lower() not in gone]
    aside = f"{table}_without_surplus"
    source.select(*[F.col(f"`{c}`") for c in kept]).write.mode("overwrite").saveAsTable(f"`{database}`.`{aside}`")
    spark.sql(f"DROP TABLE `{database}`.`{table}`")
    spark.sql(f"ALTER TABLE `{database}`.`{aside}` RENAME TO `{database}`.`{table}`")


def conform_table(df: DataFrame, declared: list[tuple[str, str]], delete_redundant: bool = False) -> DataFrame:
    """Rows of a table after its schema was brought in line; ``declared`` is (column, type text)."""
    names = ty.any_map()
    kinds = []
    for name, text in declared:
        base = text.split("(")[0].strip().lower() if not text.startswith("(") else text
        kinds.append((name, names.get(base, ty.TEXT)))
    return conform(df, kinds, delete_redundant)
