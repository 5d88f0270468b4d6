"""Identifier, text and connection-address rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions.names import as_value, is_blank, is_empty, strip
from keelson.functions.types import BACKENDS

# Quote characters (opening, closing); the closing one is doubled inside.
QUOTES = {
    "MySQL": ("`", "`"), "MariaDB": ("`", "`"), "SqlServer": ("[", "]"),
    "Access": ("[", "]"), "DBase": ("[", "]"),
}
DEFAULT_QUOTE = ('"', '"')
# Longest identifier per dialect, where names are shortened.
FIREBIRD_NAME, DBASE_NAME, INDEX_NAME = 31, 10, 64


def quote(target: str, name: Column) -> Column:
    """Identifier quoted for a dialect; Oracle names are upper-cased first."""
    opening, closing = QUOTES.get(target, DEFAULT_QUOTE)
    text = F.upper(name) if target == "Oracle" else name
    if target in ("Access", "DBase"):
        inner = text
    else:
        inner = F.replace(text, F.lit(closing), F.lit(closing * 2))
    return F.concat(F.lit(opening), inner, F.lit(closing))


def quote_script(target: str, name: Column) -> Column:
    """Identifier quoted for an exported script: case is kept, only three dialects differ."""
    plain = target if target in ("MySQL", "MariaDB", "SqlServer") else "SQLite"
    return quote(plain, name)


def fit_identifier(target: str, name: Column) -> Column:
    """Identifier shortened or upper-cased to what the dialect stores."""
    if target == "Firebird":
        return F.rtrim(F.substring(name, 1, FIREBIRD_NAME))
    if target == "Oracle":
        return F.upper(name)
    if target == "DBase":
        return F.substring(name, 1, DBASE_NAME)
    if target == "DB2":
        return F.rtrim(name)
    return name


def fk_name(name: Column, child: Column, parent: Column) -> Column:
    """Given constraint name, or ``FK_child_parent`` when blank."""
    return F.when(is_blank(name), F.concat(F.lit("FK_"), child, F.lit("_"), parent)).otherwise(name)


def script_fk_name(child: Column, column: Column, number: Column) -> Column:
    return F.concat(F.lit("fk_"), child, F.lit("_"), column, F.lit("_"), number.cast("string"))


def index_name(table: Column, column: Column) -> Column:
    return F.substring(F.concat(F.lit("IX_"), table, F.lit("_"), column), 1, INDEX_NAME)


def null_if_empty(c: Column) -> Column:
    return F.when(~is_empty(c), c)


def allow_null_text(c: Column) -> Column:
    """Empty or any spelling of yes is ``YES``; other text is kept."""
    return F.when(is_empty(c) | (F.lower(c) == "yes"), F.lit("YES")).otherwise(c)


def key_flag(c: Column) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def type_or_variant(c: Column) -> Column:
    return F.when(is_empty(c), F.lit("adVariant")).otherwise(c)


def to_int_or_zero(c: Column) -> Column:
    """Whole-number text with optional sign and outer blanks; anything else is 0."""
    text = F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c))
    return F.coalesce(text.try_cast("int"), F.lit(0))


def limit_len(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def log_line(ts: Column, level: Column, category: Column, message: Column,
             details: Column, sql: Column) -> Column:
    """One log entry as text, with indented detail and SQL lines when present."""
    empty = F.lit("")
    head = F.concat_ws(" | ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.coalesce(level, empty),
                       F.coalesce(category, empty), F.coalesce(message, empty))
    return F.concat(
        head,
        F.when(is_blank(details), empty).otherwise(F.concat(F.lit("\n  Details: "), details)),
        F.when(is_blank(sql), empty).otherwise(F.concat(F.lit("\n  SQL: "), sql)),
    )


# File endings and address parts by which a backend is recognised, in order.
FILE_ENDINGS = {
    "sqlite": "SQLite", "db": "SQLite", "accdb": "Access", "mdb": "Access",
    "fdb": "Firebird", "gdb": "Firebird", "dbf": "DBase",
}
ADDRESS_PARTS = [
    (["host=", "port=3306"], "MySQL"),
    (["host="], "PostgreSQL"),
    (["datasource=", "database=", "user="], "Firebird"),
    (["data source=", "user id="], "Oracle"),
    (["server=", "uid="], "DB2"),
    (["server=", "database="], "SqlServer"),
    (["server=", "initial catalog="], "SqlServer"),
]


def detect_backend(address: Column) -> Column:
    """Backend of a file path or connection text, NULL when nothing matches."""
    text = F.lower(address)
    # The ending of the last path step: no separator may follow its point.
    ending = F.regexp_extract(text, r"\.([^./\\:]*)$", 1)
    found = F.lit(None).cast("string")
    for parts, backend in reversed(ADDRESS_PARTS):
        matches = F.lit(True)
        for part in parts:
            matches = matches & text.contains(part)
        found = F.when(matches, F.lit(backend)).otherwise(found)
    for word, backend in FILE_ENDINGS.items():
        found = F.when(ending == word, F.lit(backend)).otherwise(found)
    return found


def resolve_address(address: Column) -> Column:
    """Database path inside an ODBC text; other addresses stay as they are."""
    path = F.regexp_extract(address, r"(?i)DATABASE=([^;]+)", 1)
    return F.when(F.lower(address).startswith("odbc") & (path != ""), strip(path)).otherwise(address)


def registry_label(company: Column, address: Column) -> Column:
    return F.when(is_blank(company), address).otherwise(company)


def supports_foreign_keys(backend: Column | str) -> Column:
    """Backends whose live foreign keys can be read and added."""
    return as_value(backend).isin([b for b in BACKENDS if b not in ("SQLite", "DBase")])
