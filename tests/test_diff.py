from pyspark.sql import functions as F

from keelson.operators import ddl
from keelson.operators.diff import FleetDiff
from keelson.plans import sync
from keelson.plans.load_order import load_order
from keelson.sources.catalog import catalog_from_schema, list_tables

DECLARED = "program_id bigint, table_name string, column_id bigint, column_name string, type string, not_null boolean, is_key boolean, field_size int"
LIVE = "db string, table_name string, position int, column_name string, sql_type string, not_null boolean, primary_key boolean, max_length int"
FKS = "program_id bigint, parent_table string, child_table string, field string, name string, cascade boolean"
LIVE_FKS = "db string, constraint_name string, child_table string, child_column string, parent_table string, parent_column string"


def declared(spark):
    return spark.createDataFrame([
        (1, "Clients", 1, "id", "AutoNumber", True, True, 0), (1, "Clients", 2, "name", "adWChar", False, False, 40),
        (1, "Orders", 3, "id", "adLong", True, True, 0), (1, "Orders", 4, "paid", "adBoolean", False, False, 0)], DECLARED)


def mirror(spark, db):
    name = F.concat(F.lit(db), F.substring("table_name", 1, 0))  # not a constant, as in real catalogs
    return declared(spark).select(name.alias("db"), F.upper("table_name").alias("table_name"), F.col("column_id").cast("int").alias("position"),
                                  F.lower("column_name").alias("column_name"), F.col("type").alias("sql_type"), "not_null",
                                  F.col("is_key").alias("primary_key"), F.col("field_size").alias("max_length"))


def databases(spark, *names):
    return spark.createDataFrame([(n, 1, "MySQL") for n in names], "db string, program_id bigint, backend string")


def test_a_database_in_line_has_no_actions(spark):
    fks = spark.createDataFrame([(1, "Clients", "Orders", "id", None, False)], FKS)
    live_fks = spark.createDataFrame([("a", "c", "ORDERS", "ID", "clients", "id")], LIVE_FKS)
    assert FleetDiff(databases(spark, "a"), declared(spark), mirror(spark, "a"), fks, live_fks).actions.count() == 0


def test_an_empty_database_gets_every_table(spark):
    rows = FleetDiff(databases(spark, "a", "b"), declared(spark), mirror(spark, "a")).actions.collect()
    assert {(r.db, r.action, r.table_name, r.n_columns) for r in rows} == {("b", "create_table", "Clients", 2), ("b", "create_table", "Orders", 2)}


def test_an_empty_fleet_of_catalogs(spark):
    live = spark.createDataFrame([], LIVE)
    assert FleetDiff(databases(spark, "a"), declared(spark), live).missing_tables.count() == 2


def test_no_step_is_a_cross_join(spark):
    plan = FleetDiff(databases(spark, "a"), declared(spark), mirror(spark, "a")).actions._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_apply_then_diff_is_empty(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS live")
    spark.sql("CREATE TABLE live.orders (ID INT, extra STRING) USING parquet")
    spark.sql("INSERT INTO live.orders VALUES (1, 'x')")
    spark.sql("CREATE TABLE live.leftover (a INT) USING parquet")

    def live():
        names = [r.table_name for r in list_tables(spark, "live").collect()]
        return catalog_from_schema(spark, "live", {n: spark.table(f"live.{n}").schema for n in names}).drop("canonical")

    def actions():
        return FleetDiff(databases(spark, "live"), declared(spark), live()).actions.filter("action <> 'identity_mismatch'")

    done = sync.apply_to_spark_catalog(spark, "live", actions(), declared(spark), delete_redundant=True)
    assert any(s.startswith("CREATE TABLE") for s in done) and any("ADD COLUMNS" in s for s in done)
    assert actions().count() == 0
    assert [tuple(r) for r in spark.table("live.orders").select("id", "paid").collect()] == [(1, None)]
    assert not spark.catalog.tableExists("live.leftover")
    spark.sql("DROP DATABASE live CASCADE")


def test_a_statement_is_its_lines_in_order(spark):
    rows = declared(spark).filter("table_name = 'Clients'")
    whole = ddl.create_statements(rows, "MySQL", ["program_id"]).collect()
    lines = sorted(ddl.create_lines(rows, "MySQL", ["program_id"]).collect(), key=lambda r: (r.section, r.column_id or 0))
    assert len(whole) == 1 and len(lines) == 5
    assert "\n".join(r.line for r in lines) == whole[0].text
    assert whole[0].text == ("CREATE TABLE `Clients` (\n    `id` INT AUTO_INCREMENT NOT NULL,\n    `name` VARCHAR(40),\n"
                             "    PRIMARY KEY (`id`)\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4;")


def test_a_key_is_one_line(spark):
    rows = spark.createDataFrame([(1, "t", i, f"c{i}", "adLong", True, True, 0) for i in range(3)], DECLARED)
    text = ddl.create_statements(rows, "MySQL", ["program_id"]).first().text
    assert "    PRIMARY KEY (`c0`, `c1`, `c2`)\n)" in text


def test_scripts_are_written_in_order(spark, tmp_path):
    programs = spark.createDataFrame([(1, "p")], "program_id bigint, name string")
    relations = spark.createDataFrame([(5, 1, "Clients", "Orders", "id", "", False, None), (2, 1, "Clients", "Orders", "paid", "", False, None)],
                                      "relation_id bigint, program_id bigint, parent_table string, child_table string, field string, name string, cascade boolean, hidden boolean")
    path = str(tmp_path / "script")
    ddl.write_script(ddl.script_lines(programs, declared(spark), relations, "PostgreSQL", "now"), path)
    files = sorted(p for p in (tmp_path / "script").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text() for p in files)
    assert text.index('CREATE TABLE "Clients"') < text.index('"id" SERIAL NOT NULL,') < text.index('CREATE TABLE "Orders"')
    assert text.index("fk_Orders_paid_1") < text.index("fk_Orders_id_2")
    assert text.index("    ADD CONSTRAINT fk_Orders_paid_1\n    FOREIGN KEY (\"paid\") REFERENCES \"Clients\" (\"paid\");")


def test_load_order_with_diamond_and_cycle(spark):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "a")]
    fks = spark.createDataFrame([("db", c, p) for c, p in edges], "db string, child_table string, parent_table string")
    tables = spark.createDataFrame([("db", "alone")], "db string, table_name string")
    levels = {r.table_name: r.level for r in load_order(tables, fks, ["db"]).collect()}
    assert levels == {"alone": 0, "a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "x": None, "y": None, "z": None}


def test_tables_without_columns_are_known_on_both_sides(spark):
    from keelson.operators.diff import FleetDiff

    databases = spark.createDataFrame([("a", 1, "MySQL"), ("b", 1, "MySQL")], "db string, program_id int, backend string")
    declared = spark.createDataFrame([(1, "T", 1, "c", "INT", False, False, 0)],
                                     "program_id int, table_name string, column_id int, column_name string, type string, not_null boolean, is_key boolean, field_size int")
    live = spark.createDataFrame([("a", "t", 1, "c", "INT", False, False, 0)],
                                 "db string, table_name string, position int, column_name string, sql_type string, not_null boolean, primary_key boolean, max_length int")
    tables = spark.createDataFrame([(1, "Hidden"), (1, "T")], "program_id int, table_name string")
    live_tables = spark.createDataFrame([("a", "HIDDEN"), ("b", "stray"), ("a", "t")], "db string, table_name string")
    found = FleetDiff(databases, declared, live, tables=tables, live_tables=live_tables)
    assert sorted((r.db, r.table_name, r.n_columns) for r in found.missing_tables.collect()) == [("b", "Hidden", 0), ("b", "T", 1)]
    assert [(r.db, r.table_name) for r in found.surplus_tables.collect()] == [("b", "stray")]


def test_an_empty_table_starts_its_numbers_at_one(spark):
    from keelson.operators import checks

    empty = spark.createDataFrame([], "k bigint")
    assert [tuple(r) for r in checks.reseed_values({"t": (empty, ["k"])}).collect()] == [("t", "k", 1)]


def test_statements_have_one_shape_at_every_width(spark):
    from keelson.operators import ddl

    rows = [("p", "wide", i, f"c{i}", "adLong", False, i % 2 == 0, 0) for i in range(1, 3001)] + [("p", "one", 1, "c", "adLong", False, False, 0)]
    declared = spark.createDataFrame(rows, "s string, table_name string, column_id int, column_name string, type string, not_null boolean, is_key boolean, field_size int")
    made = ddl.create_statements(declared.repartition(5), "PostgreSQL", ["s"])
    assert made.explain is not None and made._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    texts = {r.table_name: r.text.split("\n") for r in made.collect()}
    assert len(texts["wide"]) == 3003 and texts["wide"][1].startswith('    "c1" ') and texts["wide"][-2].startswith('    PRIMARY KEY ("c2", "c4", ')
    assert len(texts["one"]) == 3 and not texts["one"][1].endswith(",")
    assert ddl.create_statements(declared.limit(0), "MySQL", ["s"]).count() == 0


def test_post_checks_of_empty_and_uneven_tables(spark):
    from keelson.plans.post_check import TableChecks, post_check

    child = spark.createDataFrame([(i, 7 if i % 10 else i) for i in range(1000)], "id bigint, parent bigint")
    parent = spark.createDataFrame([(7,), (10,), (20,), (20,), (None,)], "k int")
    empty = spark.createDataFrame([], "id bigint, parent bigint")
    rules = {"child": TableChecks(["id"], ["parent"], {"id": 2}, [("parent", "parent", "k")], ["id"]),
             "empty": TableChecks(["id"], foreign_keys=[("parent", "parent", "k")], identity=["id"]), "parent": TableChecks(["k"])}
    found = {(r.table_name, r.check, r.column_name): r.value for r in post_check(
        {"child": child.limit(990), "gone": child}, {"child": child, "parent": parent, "empty": empty}, rules).collect()}
    assert found == {
        ("child", "row_difference", ""): 10, ("gone", "row_difference", ""): -1000, ("parent", "row_difference", ""): 5, ("empty", "row_difference", ""): 0,
        ("child", "duplicate_keys", "id"): 0, ("child", "not_null", "parent"): 0, ("child", "max_length", "id"): 900,
        ("child", "orphan_rows", "parent"): 98, ("child", "next_identity", "id"): 1000, ("empty", "duplicate_keys", "id"): 0,
        ("empty", "orphan_rows", "parent"): 0, ("empty", "next_identity", "id"): 1, ("parent", "duplicate_keys", "k"): 1}
