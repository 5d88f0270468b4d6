"""Differences between declared schemas and live databases, for a whole fleet at once.

Inputs (one row per ...):

* ``databases(db, program_id, backend)`` - live database and the program it belongs to
* ``declared(program_id, table_name, column_id, column_name, type, not_null, is_key, field_size)``
* ``live(db, table_name, position, column_name, sql_type, not_null, primary_key, max_length)``
* ``declared_fks(program_id, parent_table, child_table, field, name, cascade)``
* ``live_fks(db, constraint_name, child_table, child_column, parent_table, parent_column)``
* ``tables(program_id, table_name)`` and ``live_tables(db, table_name)`` - tables on their own, so that one
  without (visible) columns is known too

Names match without case. No step pairs every database with every declared name:
counts of matches come first, and only databases (or tables) whose count falls
short are expanded to the names they lack, so the work follows the size of the live
catalog plus the size of the answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.names import key
from keelson.functions.text import fk_name, supports_foreign_keys
from keelson.functions.types import is_auto_number
from keelson.operators.filters import complete_relations
from keelson.operators.scale import FEWEST_SALTS, cut_lineage, salted_join

ACTION_COLUMNS = [
    "db", "action", "table_name", "column_name", "type", "not_null", "is_key", "field_size",
    "position", "n_columns", "parent_table", "fk_name", "cascade", "reason",
]
CREATE_TABLE, ADD_COLUMN = "create_table", "add_column"
SURPLUS_TABLE, SURPLUS_COLUMN = "surplus_table", "surplus_column"
ADD_FK, SKIP_FK, IDENTITY_MISMATCH = "add_fk", "skip_fk", "identity_mismatch"
#: What a relation is compared by within its program: child, field and parent without case.
FK_KEY = ["_ct", "_cf", "_pt"]


def name_status(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Both directions of a difference in one pass: ``create``, ``surplus`` or ``shared``.

    ``left`` is the declared side. Names are compared without case within ``keys``.
    """
    one = left.groupBy(*keys, key(name).alias("_k")).agg(F.min(name).alias("declared_name"))
    two = right.groupBy(*keys, key(name).alias("_k")).agg(F.min(name).alias("live_name"))
    status = (
        F.when(F.col("live_name").isNull(), F.lit("create"))
        .when(F.col("declared_name").isNull(), F.lit("surplus"))
        .otherwise(F.lit("shared"))
    )
    return one.join(two, [*keys, "_k"], "full_outer").select(
        *keys, F.coalesce("declared_name", "live_name").alias(name), status.alias("status"))


@dataclass
class FleetDiff:
    """All differences of a fleet; every property is a lazy DataFrame."""

    databases: DataFrame
    declared: DataFrame
    live: DataFrame
    declared_fks: DataFrame | None = None
    live_fks: DataFrame | None = None
    tables: DataFrame | None = None
    live_tables: DataFrame | None = None

    # ---- keyed inputs ----

    @cached_property
    def _programs(self) -> DataFrame:
        return self.databases.select("db", "program_id")

    @cached_property
    def _declared_columns(self) -> DataFrame:
        """One row per declared column name; of several spellings the lowest id counts."""
        keyed = self.declared.select(
            "program_id", key("table_name").alias("_t"), key("column_name").alias("_c"),
            F.struct("column_id", "table_name", "column_name", "type", "not_null", "is_key", "field_size").alias("_d"))
        return keyed.groupBy("program_id", "_t", "_c").agg(F.min("_d").alias("_d"))

    @cached_property
    def _declared_tables(self) -> DataFrame:
        """Declared tables with the number of their columns, those without any included."""
        held = self._declared_columns.groupBy("program_id", "_t").agg(
            F.min("_d.table_name").alias("table_name"), F.count(F.lit(1)).alias("n_columns"))
        if self.tables is None:
            return held
        named = self.tables.select("program_id", key("table_name").alias("_t"), "table_name", F.lit(0).cast("bigint").alias("n_columns"))
        return held.unionByName(named).groupBy("program_id", "_t").agg(
            F.min("table_name").alias("table_name"), F.max("n_columns").alias("n_columns"))

    @cached_property
    def _columns(self) -> DataFrame:
        """Live columns with their declared counterpart, where there is one."""
        keyed = self.live.select("db", key("table_name").alias("_t"), key("column_name").alias("_c"),
                                 "table_name", "column_name", "position", "sql_type")
        placed = salted_join(keyed, self._programs, ["db"], "inner", F.col("column_name"))
        return salted_join(placed, self._declared_columns, ["program_id", "_t", "_c"], "left", F.col("db"))

    @cached_property
    def _tables(self) -> DataFrame:
        """Live tables with the number of their declared columns, and their declared counterpart, if any."""
        found = F.count_distinct(F.when(F.col("_d").isNotNull(), F.col("_c")))
        live = self._columns.groupBy("db", "program_id", "_t").agg(
            F.min("table_name").alias("live_table"), found.alias("_found"))
        if self.live_tables is not None:
            named = self.live_tables.select("db", key("table_name").alias("_t"), F.col("table_name").alias("live_table")).join(self._programs, "db")
            live = live.unionByName(named.withColumn("_found", F.lit(0).cast("bigint"))).groupBy("db", "program_id", "_t").agg(
                F.min("live_table").alias("live_table"), F.max("_found").alias("_found"))
        return salted_join(live, self._declared_tables, ["program_id", "_t"], "left", F.col("db"))

    def settled(self) -> FleetDiff:
        """The same diff with the matched catalog written out once, for all that follows from it."""
        copy = FleetDiff(self.databases, self.declared, self.live, self.declared_fks, self.live_fks, self.tables, self.live_tables)
        copy.__dict__["_declared_columns"] = cut_lineage(self._declared_columns)
        copy.__dict__["_columns"] = cut_lineage(copy._columns)
        copy.__dict__["_tables"] = cut_lineage(copy._tables)
        return copy

    # ---- tables ----

    @cached_property
    def missing_tables(self) -> DataFrame:
        """(db, table) declared but not live, with the number of columns to create."""
        found = self._tables.filter(F.col("table_name").isNotNull())
        per_db = found.groupBy("db").agg(F.count(F.lit(1)).alias("_has"))
        wanted = self._declared_tables.groupBy("program_id").agg(F.count(F.lit(1)).alias("_wanted"))
        short = (
            salted_join(self._programs, wanted, ["program_id"], "inner", F.col("db"))
            .join(per_db, "db", "left")
            .filter(F.coalesce("_has", F.lit(0)) < F.col("_wanted"))
            .select("db", "program_id")
        )
        expected = salted_join(short, self._declared_tables, ["program_id"], "inner", F.col("db"))
        return expected.join(found.select("db", "_t"), ["db", "_t"], "left_anti").select(
            "db", "program_id", "_t", "table_name", "n_columns")

    @cached_property
    def surplus_tables(self) -> DataFrame:
        """(db, table) live but not declared."""
        return self._tables.filter(F.col("table_name").isNull()).select(
            "db", "program_id", "_t", F.col("live_table").alias("table_name"))

    @cached_property
    def surplus_table_columns(self) -> DataFrame:
        """The columns of wholly surplus tables."""
        tables = self.surplus_tables.select("db", "_t")
        return salted_join(self._columns, tables, ["db", "_t"], "left_semi", F.col("column_name")).select(
            "db", "program_id", "table_name", "column_name", "position")

    # ---- columns ----

    @cached_property
    def missing_columns(self) -> DataFrame:
        """Declared columns that a shared table lacks."""
        short = self._tables.filter(
            F.col("table_name").isNotNull() & (F.col("_found") < F.col("n_columns"))).select("db", "program_id", "_t")
        expected = salted_join(short, self._declared_columns, ["program_id", "_t"], "inner", F.col("db"))
        found = self._columns.filter(F.col("_d").isNotNull()).select("db", "_t", "_c")
        return expected.join(found, ["db", "_t", "_c"], "left_anti").select("db", "program_id", "_t", "_c", "_d.*")

    @cached_property
    def _shared_keys(self) -> DataFrame:
        return self._tables.filter(F.col("table_name").isNotNull()).select(
            "db", "_t", F.col("table_name").alias("_declared_table"))

    @cached_property
    def surplus_columns(self) -> DataFrame:
        """Live columns of shared tables that are not declared."""
        return (
            salted_join(self._columns.filter(F.col("_d").isNull()), self._shared_keys, ["db", "_t"], "inner",
                        F.col("column_name"))
            .select("db", "program_id", F.col("_declared_table").alias("table_name"), "column_name", "position")
        )

    @cached_property
    def identity_mismatches(self) -> DataFrame:
        """Declared identity columns whose live column is a plain one; this cannot be repaired in place."""
        return self._columns.filter(
            F.col("_d").isNotNull() & is_auto_number(F.col("_d.type")) & ~is_auto_number(F.col("sql_type"))
        ).select("db", "program_id", "_d.table_name", "_d.column_name", F.col("_d.type").alias("type"),
                 F.col("sql_type").alias("live_type"))

    # ---- foreign keys ----

    @cached_property
    def _relations(self) -> DataFrame:
        """Complete declared relations with the key they are compared by."""
        return complete_relations(self.declared_fks).select(
            "program_id", "parent_table", "child_table", "field", "name", "cascade",
            key("child_table").alias("_ct"), key("field").alias("_cf"), key("parent_table").alias("_pt"))

    @cached_property
    def _fk_keys(self) -> DataFrame:
        """Every relation key of a program once, however many relations spell it."""
        return self._relations.select("program_id", *FK_KEY).distinct()

    def _missing_keys(self, keys: DataFrame) -> DataFrame:
        """(db, relation key) of the ``keys`` without a live foreign key, with the other columns of ``keys``."""
        programs = self.databases.filter(supports_foreign_keys(F.col("backend"))).select("db", "program_id")
        live = self.live_fks.select(
            "db", key("child_table").alias("_ct"), key("child_column").alias("_cf"),
            key("parent_table").alias("_pt")).distinct()
        found = salted_join(live.join(programs, "db"), self._fk_keys, ["program_id", *FK_KEY], "left_semi", F.col("db"))
        per_db = found.groupBy("db").agg(F.count(F.lit(1)).alias("_found"))
        wanted = self._fk_keys.groupBy("program_id").agg(F.count(F.lit(1)).alias("_wanted"))
        short = (
            salted_join(programs, wanted, ["program_id"], "inner", F.col("db")).join(per_db, "db", "left")
            .filter(F.coalesce("_found", F.lit(0)) < F.col("_wanted")).select("db", "program_id")
        )
        expected = salted_join(short, keys, ["program_id"], "inner", F.col("db"))
        return expected.join(found.select("db", *FK_KEY).hint("merge"), ["db", *FK_KEY], "left_anti")

    def _spelled(self, missing: DataFrame) -> DataFrame:
        """All relations of missing keys. They outnumber the keys by far, so nothing is shuffled after this step."""
        return salted_join(missing, self._relations, ["program_id", *FK_KEY], "inner", F.col("db"), FEWEST_SALTS)

    @cached_property
    def missing_fks(self) -> DataFrame:
        """Declared relations without a live key on the same child, field and parent."""
        return self._spelled(self._missing_keys(self._fk_keys))

    @cached_property
    def fks_to_apply(self) -> DataFrame:
        """Missing relations with the reason why one cannot be added after the sync, if any.

        Tables and columns count as present when they are live or declared, since the
        sync creates the declared ones first. The names of a key settle that for all its relations, and those that the
        program declares need no look at the databases.
        """
        tables = self._declared_tables.select("program_id", "_t").withColumn("_has", F.lit(True))
        columns = self._declared_columns.select("program_id", "_t", "_c").withColumn("_has", F.lit(True))
        live_tables = self._tables.select("db", "_t").withColumn("_has", F.lit(True))
        live_columns = self._columns.select("db", "_t", "_c").distinct().withColumn("_has", F.lit(True))

        def mark(df: DataFrame, side: DataFrame, names: dict[str, str], flag: str, scope: str) -> DataFrame:
            renamed = side.select(scope, *[F.col(k).alias(v) for k, v in names.items()], F.col("_has").alias(flag))
            on = [scope, *names.values()]
            # A name within one database has that database's keys alone, and the live catalog is the larger side:
            # it is not repeated, nor gathered anywhere. A name within a program has all the program's keys.
            return df.join(renamed.hint("merge"), on, "left") if scope == "db" else salted_join(
                df, renamed, on, "left", F.concat(*FK_KEY))

        keys = mark(self._fk_keys, tables, {"_t": "_ct"}, "_child", "program_id")
        keys = mark(keys, tables, {"_t": "_pt"}, "_parent", "program_id")
        keys = mark(keys, columns, {"_t": "_ct", "_c": "_cf"}, "_field", "program_id")
        keys = cut_lineage(keys)
        declared = F.col("_child").isNotNull() & F.col("_parent").isNotNull() & F.col("_field").isNotNull()
        rows = self._missing_keys(keys.filter(~declared))
        rows = mark(rows, live_tables, {"_t": "_ct"}, "_child2", "db")
        rows = mark(rows, live_tables, {"_t": "_pt"}, "_parent2", "db")
        rows = mark(rows, live_columns, {"_t": "_ct", "_c": "_cf"}, "_field2", "db")
        no_table = F.coalesce("_child", "_child2").isNull() | F.coalesce("_parent", "_parent2").isNull()
        reason = F.when(no_table, F.lit("table not found")).when(
            F.coalesce("_field", "_field2").isNull(), F.lit("column not found"))
        names = ["db", "program_id", *FK_KEY]
        sure = self._missing_keys(keys.filter(declared)).select(*names, F.lit(None).cast("string").alias("reason"))
        rows = self._spelled(sure.unionByName(rows.select(*names, reason.alias("reason"))))
        return rows.select("db", "program_id", "child_table", "field", "parent_table",
                           fk_name(F.col("name"), F.col("child_table"), F.col("parent_table")).alias("fk_name"),
                           "cascade", "reason")

    # ---- everything ----

    @cached_property
    def actions(self) -> DataFrame:
        """One row per difference, see ``ACTION_COLUMNS``. The matched catalog is computed once."""
        return self.settled()._all_actions()

    def _all_actions(self) -> DataFrame:
        fields = F.col
        parts = [
            _action(self.missing_tables, CREATE_TABLE, n_columns=fields("n_columns").cast("bigint")),
            _action(self.missing_columns, ADD_COLUMN, column_name=fields("column_name"), type=fields("type"),
                    not_null=fields("not_null"), is_key=fields("is_key"),
                    field_size=fields("field_size").cast("int"), position=fields("column_id").cast("bigint")),
            _action(self.surplus_columns, SURPLUS_COLUMN, column_name=fields("column_name"),
                    position=fields("position").cast("bigint")),
            _action(self.surplus_tables, SURPLUS_TABLE),
            _action(self.identity_mismatches, IDENTITY_MISMATCH, column_name=fields("column_name"),
                    type=fields("type"), reason=F.concat(F.lit("live type "), F.coalesce("live_type", F.lit("")))),
        ]
        if self.declared_fks is not None and self.live_fks is not None:
            rows = self.fks_to_apply.withColumn("table_name", F.col("child_table"))
            kind = F.when(fields("reason").isNull(), F.lit(ADD_FK)).otherwise(F.lit(SKIP_FK))
            parts.append(_action(rows, kind, column_name=fields("field"), parent_table=fields("parent_table"),
                                 fk_name=fields("fk_name"), cascade=fields("cascade"), reason=fields("reason")))
        return reduce(DataFrame.unionByName, parts)

    def surplus(self) -> DataFrame:
        """Surplus register: columns of shared tables, and whole tables with all their columns."""
        partly = self.surplus_columns.withColumn("whole_table", F.lit(False))
        wholly = self.surplus_table_columns.withColumn("whole_table", F.lit(True))
        return partly.unionByName(wholly).select("program_id", "db", "table_name", "column_name", "whole_table")


_ACTION_TYPES = {
    "db": "string", "action": "string", "table_name": "string", "column_name": "string", "type": "string",
    "not_null": "boolean", "is_key": "boolean", "field_size": "int", "position": "bigint",
    "n_columns": "bigint", "parent_table": "string", "fk_name": "string", "cascade": "boolean",
    "reason": "string",
}


def _action(df: DataFrame, action, **values) -> DataFrame:
    values = {"db": F.col("db"), "table_name": F.col("table_name"), **values,
              "action": F.lit(action) if isinstance(action, str) else action}
    return df.select(*[
        values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _ACTION_TYPES.items()
    ])


def summary(databases: DataFrame, actions: DataFrame, delete_redundant: bool = False) -> DataFrame:
    """One row per database: counts of each kind of change, error, and a status text.

    ``databases`` may hold an ``error`` text: such databases report it and no counts.
    """
    def count(action: str, name: str, when: bool = True):
        return (F.count_if(F.col("action") == action) if when else F.lit(0).cast("bigint")).alias(name)

    counts = actions.groupBy("db").agg(
        count(CREATE_TABLE, "tables_created"), count(ADD_COLUMN, "columns_added"), count(ADD_FK, "fks_added"),
        count(SURPLUS_TABLE, "tables_dropped", delete_redundant),
        count(SURPLUS_COLUMN, "columns_dropped", delete_redundant))
    names = ["tables_created", "columns_added", "fks_added", "tables_dropped", "columns_dropped"]
    error = F.col("error") if "error" in databases.columns else F.lit(None).cast("string")
    rows = databases.select("db", "backend", error.alias("error")).join(counts, "db", "left")
    rows = rows.withColumns({
        n: F.when(F.col("error").isNotNull(), F.lit(0)).otherwise(F.coalesce(n, F.lit(0))).cast("bigint")
        for n in names})
    text = {n: F.col(n).cast("string") for n in names}
    status = F.concat(F.lit("+"), text["tables_created"], F.lit("t  +"), text["columns_added"], F.lit("c  +"),
                      text["fks_added"], F.lit("fk"))
    dropped = F.concat(F.lit("  -"), text["tables_dropped"], F.lit("t  -"), text["columns_dropped"], F.lit("c"))
    any_dropped = (F.col("tables_dropped") + F.col("columns_dropped")) > 0
    return rows.withColumn("status", F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
                           .otherwise(F.concat(status, F.when(any_dropped, dropped).otherwise(F.lit("")))))


def totals(report: DataFrame) -> DataFrame:
    """Number of databases that worked and that failed."""
    return report.agg(F.count_if(F.col("error").isNull()).alias("n_ok"),
                      F.count_if(F.col("error").isNotNull()).alias("n_failed"))
