"""Value conversion to canonical types, as native expressions.

NULL always stays NULL. Unreadable text gives the documented default (0, false,
0001-01-01, the zero guid). A number that does not fit its canonical type gives
NULL; ``overflowed`` tells such rows apart so that a transfer can reject them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.names import BLANKS, as_col, is_blank, let
from keelson.functions import types as ty

# Words read as true (compared without case, never trimmed).
TRUE_DIGITS = ["1", "-1"]
TRUE_WORDS = ["true", "yes", "t", ".t."]

ZERO_DATE = "0001-01-01"
ZERO_GUID = "00000000-0000-0000-0000-000000000000"
SERIAL_EPOCH = "1899-12-30 00:00:00"
MILLIS_PER_DAY = 86_400_000
# Serial days outside this open range are not dates.
SERIAL_MIN, SERIAL_MAX = -657435.0, 2958466.0
DECIMAL_TYPE = "decimal(38,10)"
# The source decimal type ends here; text beyond it counts as unreadable.
DECIMAL_LIMIT = 7.9228162514264338e28

_WHITE = r"[ \t\n\r\x0B\f]*"
_MONEY = "\u00a4"
_DIGITS = r"(?:\d[\d,]*(?:\.\d*)?|\.\d+)"
_EXPONENT = r"(?:[eE][+-]?\d+)?"
# A sign or an opening parenthesis may stand before the digits, a sign or the
# closing parenthesis after them, never both kinds; one currency sign is allowed.
_HEAD = rf"{_WHITE}(?:{_MONEY}{_WHITE})?"
_NUMBER = (
    rf"^{_HEAD}(?:"
    rf"[+-](?:{_MONEY}{_WHITE})?{_DIGITS}{_EXPONENT}{_WHITE}{_MONEY}?"
    rf"|\((?:{_MONEY}{_WHITE})?{_DIGITS}{_EXPONENT}{_WHITE}{_MONEY}?{_WHITE}\)"
    rf"|{_DIGITS}{_EXPONENT}{_WHITE}{_MONEY}?{_WHITE}[+-]?"
    rf"){_WHITE}$"
)
_CORE = rf"{_DIGITS}{_EXPONENT}"
_PLAIN = r"^ *-?\d[\d,]{0,17}(?:\.\d{1,9})? *$"
_SHORT_WHOLE = r"^ *[+-]?\d[\d,]{0,17} *$"
_MINUS = rf"^[^0-9.]*[-(]|-{_WHITE}$"


def numeric_text(c: Column) -> Column:
    """Number text as plain ``-12.5e3`` text, or NULL when it is not a number.

    Accepts outer blanks, a sign on either side, parentheses as minus, thousands
    commas, a decimal point and an exponent.
    """
    core = _bare(F.regexp_extract(c, _CORE, 0))
    sign = F.when(c.rlike(_MINUS), F.lit("-")).otherwise(F.lit(""))
    return F.when(c.rlike(_NUMBER), F.concat(sign, core))


def _bare(c: Column) -> Column:
    """The text without thousands commas."""
    return F.replace(c, F.lit(","), F.lit(""))


def _comma_decimal(c: Column) -> Column:
    """The same text with the roles of comma and point exchanged."""
    return F.translate(c, ",.", ".,")


def _whole_number(number: Column) -> Column:
    """Integer of a plain number text, NULL when it has a fraction."""
    by_exponent = let(number.try_cast("decimal(38,18)"), lambda d: F.when(d == F.floor(d), d.try_cast("bigint")))
    plain = F.regexp_extract(number, r"^(-?\d+)(?:\.0*)?$", 1).try_cast("bigint")
    return F.when(number.rlike("[eE]"), by_exponent).otherwise(plain)


def _text_to_long(c: Column) -> Column:
    """Whole number of a text, NULL when there is none. Plain digits take the short way."""
    return F.when(c.rlike(_SHORT_WHOLE), _bare(c).try_cast("bigint")).otherwise(let(numeric_text(c), _whole_number))


def _is(dtype: T.DataType, *kinds: type) -> bool:
    return isinstance(dtype, kinds)


def _is_text(dtype: T.DataType) -> bool:
    return _is(dtype, T.StringType, T.CharType, T.VarcharType)


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    """Numbers: not zero. Text: one of the true words. Anything else: false."""
    if _is(dtype, T.BooleanType):
        return c
    if _is(dtype, T.NumericType):
        return c != 0
    if _is_text(dtype):
        return c.isin(TRUE_DIGITS) | F.lower(c).isin(TRUE_WORDS)
    return F.when(c.isNotNull(), F.lit(False))


def clamp_int32(c: Column) -> Column:
    """64-bit integer cut to the 32-bit range."""
    low, high = F.lit(-2147483648), F.lit(2147483647)
    return F.when(c > high, high).when(c < low, low).otherwise(c.try_cast("int"))


def to_int32(c: Column, dtype: T.DataType) -> Column:
    """64-bit integers clamp; text outside the range is 0; other numbers round half-even."""
    if _is(dtype, T.ByteType, T.ShortType, T.IntegerType, T.BooleanType):
        return c.cast("int")
    if _is(dtype, T.LongType):
        return clamp_int32(c)
    if _is_text(dtype):
        return F.when(c.isNotNull(), F.coalesce(_text_to_long(c).try_cast("int"), F.lit(0)))
    if _is(dtype, T.NumericType):
        return F.bround(c, 0).try_cast("int")
    return F.lit(None).cast("int")


def to_int64(c: Column, dtype: T.DataType) -> Column:
    if _is(dtype, T.IntegralType, T.BooleanType):
        return c.cast("bigint")
    if _is_text(dtype):
        return F.when(c.isNotNull(), F.coalesce(_text_to_long(c), F.lit(0).cast("bigint")))
    if _is(dtype, T.NumericType):
        return F.bround(c, 0).try_cast("bigint")
    return F.lit(None).cast("bigint")


def _text_to_double(c: Column) -> Column:
    def special(word: Column) -> Column:
        return (
            F.when(word.isin("infinity", "+infinity"), F.lit(float("inf")))
            .when(word == "-infinity", F.lit(float("-inf")))
            .when(word.isin("nan", "+nan", "-nan"), F.lit(float("nan")))
        )

    odd = F.coalesce(numeric_text(c).try_cast("double"), let(F.lower(F.btrim(c, F.lit(BLANKS))), special))
    return F.when(c.rlike(_PLAIN), _bare(c).try_cast("double")).otherwise(odd)


def to_double(c: Column, dtype: T.DataType, decimal_comma: bool = False) -> Column:
    if _is_text(dtype):
        found = _text_to_double(c)
        if decimal_comma:
            found = F.coalesce(found, _text_to_double(_comma_decimal(c)))
        return F.when(c.isNotNull(), F.coalesce(found, F.lit(0.0)))
    if _is(dtype, T.NumericType, T.BooleanType):
        return c.cast("double")
    return F.lit(None).cast("double")


def _double_to_decimal(c: Column, kind: str = DECIMAL_TYPE) -> Column:
    """Fifteen significant digits, as the source number type keeps them."""
    return F.when(F.abs(c) < 1e5, c.try_cast(kind)).otherwise(
        F.format_string("%.14e", c).try_cast(kind))


def _text_to_decimal(c: Column, kind: str = DECIMAL_TYPE) -> Column:
    """Decimal of a text: 0 when it is no number the source type holds, NULL when only ours cannot hold it."""
    def odd(number: Column) -> Column:
        held_by_source = F.coalesce(F.abs(number.try_cast("double")) < DECIMAL_LIMIT, F.lit(False))
        return F.coalesce(number.try_cast(kind), F.when(~held_by_source, F.lit(0).cast(kind)))

    return F.when(c.rlike(_PLAIN), _bare(c).try_cast(kind)).otherwise(let(numeric_text(c), odd))


def to_decimal(c: Column, dtype: T.DataType, decimal_comma: bool = False, kind: str = DECIMAL_TYPE) -> Column:
    """Value as a decimal of the given type; digits beyond its scale are rounded, see ``decimal_places``."""
    if _is_text(dtype):
        found = _text_to_decimal(c, kind)
        if decimal_comma:
            readable = c.rlike(_NUMBER)
            found = F.when(readable, found).otherwise(_text_to_decimal(_comma_decimal(c), kind))
        return F.when(c.isNotNull(), found)
    if _is(dtype, T.FloatType, T.DoubleType):
        return _double_to_decimal(c.cast("double"), kind)
    if _is(dtype, T.BooleanType):
        return c.cast("int").cast(kind)
    if _is(dtype, T.NumericType):
        return c.try_cast(kind)
    return F.lit(None).cast(kind)


def _digit_counts(number: Column) -> Column:
    """``struct(whole, places)`` of plain number text: digits before the point, and after it without closing zeros."""
    whole, part = F.regexp_extract(number, r"^[+-]?(\d*)", 1), F.regexp_extract(number, r"\.(\d*)", 1)
    power = F.coalesce(F.regexp_extract(number, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))

    def count(v: Column) -> Column:
        digits = F.concat(v["whole"], v["part"])
        leading = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        closing = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
        zero = F.rtrim(digits, F.lit("0")) == ""
        return F.struct(
            F.when(zero, 0).otherwise(F.greatest(F.length(v["whole"]) + v["power"] - leading, F.lit(0))).alias("whole"),
            F.when(zero, 0).otherwise(F.greatest(F.length(v["part"]) - v["power"] - closing, F.lit(0))).alias("places"))

    return let(F.struct(whole.alias("whole"), part.alias("part"), power.alias("power")), count)


def digit_counts(c: Column, dtype: T.DataType, decimal_comma: bool = False) -> Column:
    """``struct(whole, places)`` of a value that becomes a decimal; NULL where it is no number.

    Floating numbers count with the digits that the source number type keeps: fifteen, of single ones the shortest.
    """
    if _is_text(dtype):
        number = numeric_text(c)
        if decimal_comma:
            number = F.coalesce(number, numeric_text(_comma_decimal(c)))
    elif _is(dtype, T.DoubleType):
        number = F.format_string("%.14e", c)
    elif _is(dtype, T.NumericType):
        number = c.cast("string")
    else:
        return F.lit(None).cast("struct<whole:int,places:int>")
    return F.when(number.isNotNull(), let(number, _digit_counts))


def decimal_lost(c: Column, dtype: T.DataType, scale: int, decimal_comma: bool = False) -> Column | None:
    """True where a decimal of ``scale`` places would change the value; None where no value of the type can change."""
    if _is(dtype, T.DecimalType) and dtype.scale <= scale or not (_is_text(dtype) or _is(dtype, T.DecimalType, T.FloatType, T.DoubleType)):
        return None
    lost = F.coalesce(digit_counts(c, dtype, decimal_comma)["places"] > scale, F.lit(False))
    return F.when(c.rlike(_PLAIN), F.lit(False)).otherwise(lost) if _is_text(dtype) and scale >= 9 else lost


def decimal_types(df: DataFrame, columns: list[str], decimal_comma: bool = False) -> dict[str, T.DecimalType]:
    """The smallest decimal type that keeps every value of each column, from one pass over all rows.

    A column that needs more than 38 digits keeps those before the point; its longer values are for the caller to reject.
    """
    if not columns:
        return {}
    counts = [digit_counts(F.col(f"`{name}`"), df.schema[name].dataType, decimal_comma) for name in columns]
    widths = df.select(*[c.alias(f"_{i}") for i, c in enumerate(counts)]).agg(*[
        F.coalesce(F.max(F.col(f"_{i}.{part}")), F.lit(0)).alias(f"{part}{i}") for i in range(len(columns)) for part in ("whole", "places")]).first()

    def fitting(whole: int, places: int) -> T.DecimalType:
        whole = min(whole, 38)
        places = min(places, 38 - whole)
        return T.DecimalType(max(whole + places, 1), places)

    return {name: fitting(widths[f"whole{i}"], widths[f"places{i}"]) for i, name in enumerate(columns)}


def _double_to_text(c: Column) -> Column:
    """Shortest digits: plain from 1e-5 up to 1e15, else with a signed two-digit exponent."""
    text = c.cast("string")
    plain = F.regexp_replace(c.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    sign = F.when(text.contains("E-"), F.lit("E-")).otherwise(F.lit("E+"))
    return (
        F.when(c == 0, F.lit("0"))
        .when(F.isnan(c) | (F.abs(c) == float("inf")), text)
        .when((F.abs(c) >= 1e-5) & (F.abs(c) < 1e15), plain)
        .otherwise(F.concat(mantissa, sign, power))
    )


def to_text(c: Column, dtype: T.DataType) -> Column:
    """``True``/``False``, culture-free numbers, ISO dates, hexadecimal bytes."""
    if _is(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if _is(dtype, T.FloatType):
        return _double_to_text(c.cast("string").cast("double"))
    if _is(dtype, T.DoubleType):
        return _double_to_text(c)
    if _is(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


_TIME = r"\d{2}:\d{2}:\d{2}"
_YEAR = r"(?!0000)\d{4}"
_ISO = rf"^{_YEAR}-\d{{2}}-\d{{2}}(?:[ T]{_TIME}(?:\.\d{{3}})?)?\z"
# The second alternative takes any other text, which leaves no digits to parse.
_DOTS = rf"(?s)^(?:(\d{{1,2}})\.(\d{{1,2}})\.({_YEAR})((?: {_TIME})?)|.*)\z"
_FULL_DOTS = rf"^\d\d\.\d\d\.{_YEAR}\z"
_SLASHES = rf"(?s)^(?:(\d{{2}})/(\d{{2}})/({_YEAR})((?: {_TIME})?)|.*)\z"
_YEAR_DOTS = rf"(?s)^(?:({_YEAR})\.(\d{{2}})\.(\d{{2}})|.*)\z"


def parse_datetime_text(c: Column) -> Column:
    """Timestamp of a text in one of the accepted layouts, NULL otherwise.

    ISO with blank or ``T`` and optional milliseconds, ``d.M.yyyy``, ``dd/MM/yyyy``,
    ``MM/dd/yyyy``; the latter three with optional time. Day first wins. The layout is
    told by its separator, so that each text meets one pattern.
    """
    dash = F.lit("-")
    full_dots = F.concat(F.substring(c, 7, 4), dash, F.substring(c, 4, 2), dash, F.substring(c, 1, 2))

    def slashes(order: str) -> Column:
        return F.regexp_replace(c, _SLASHES, order).try_cast("timestamp_ntz")

    return (
        F.when(F.substring(c, 5, 1) == "-", F.when(c.rlike(_ISO), c.try_cast("timestamp_ntz")))
        .when(c.contains("/"), F.coalesce(slashes("$3-$2-$1$4"), slashes("$3-$1-$2$4")))
        .when(c.contains("."), F.when(c.rlike(_FULL_DOTS), full_dots).otherwise(
            F.regexp_replace(c, _DOTS, "$3-$2-$1$4")).try_cast("timestamp_ntz"))
    )


def parse_date_text(c: Column) -> Column:
    """Date of a text in one of the accepted layouts (also ``yyyy.MM.dd``), NULL otherwise."""
    year_dots = F.regexp_replace(c, _YEAR_DOTS, "$1-$2-$3").try_cast("date")
    return F.when(F.instr(c, ".") == 5, year_dots).otherwise(parse_datetime_text(c).cast("date"))


def _zero_date() -> Column:
    return F.lit(ZERO_DATE).cast("date")


def _zero_datetime() -> Column:
    return F.lit(ZERO_DATE + " 00:00:00").cast("timestamp_ntz")


def serial_day(c: Column) -> Column:
    """Timestamp of a serial day number (days since 1899-12-30, fraction always forward)."""
    half = F.when(c >= 0, F.lit(0.5)).otherwise(F.lit(-0.5))
    millis = (c * F.lit(float(MILLIS_PER_DAY)) + half).try_cast("bigint")
    flipped = F.when(millis < 0, millis - (millis % MILLIS_PER_DAY) * 2).otherwise(millis)
    moved = F.timestamp_add("MILLISECOND", flipped, F.lit(SERIAL_EPOCH).cast("timestamp_ntz"))
    return F.when((c > SERIAL_MIN) & (c < SERIAL_MAX), moved)


def to_date(c: Column, dtype: T.DataType) -> Column:
    if _is(dtype, T.DateType, T.TimestampType, T.TimestampNTZType):
        return c.cast("date")
    if _is(dtype, T.DoubleType, T.LongType):
        return serial_day(c.cast("double")).cast("date")
    if _is_text(dtype):
        return F.when(c.isNotNull(), F.coalesce(parse_date_text(c), _zero_date()))
    return F.when(c.isNotNull(), _zero_date())


def to_datetime(c: Column, dtype: T.DataType) -> Column:
    if _is(dtype, T.DateType, T.TimestampType, T.TimestampNTZType):
        return c.cast("timestamp_ntz")
    if _is(dtype, T.DayTimeIntervalType):
        return _zero_datetime() + c
    if _is(dtype, T.DoubleType, T.LongType):
        return serial_day(c.cast("double"))
    if _is_text(dtype):
        return F.when(c.isNotNull(), F.coalesce(parse_datetime_text(c), _zero_datetime()))
    return F.when(c.isNotNull(), _zero_datetime())


def to_bytes(c: Column, dtype: T.DataType) -> Column:
    """Bytes are kept, anything else becomes NULL."""
    return c if _is(dtype, T.BinaryType) else F.lit(None).cast("binary")


_DASHED = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_GUID = rf"^(?:[0-9a-f]{{32}}|{_DASHED}|\{{{_DASHED}\}}|\({_DASHED}\))$"
_HEX_GUID = r"^\{0x[0-9a-f]{8},0x[0-9a-f]{4},0x[0-9a-f]{4},\{(?:0x[0-9a-f]{2},){7}0x[0-9a-f]{2}\}\}$"


def _dashed(digits: Column) -> Column:
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    with_dashes = [piece for part in parts for piece in (part, F.lit("-"))][:-1]
    return F.concat(*with_dashes)


def to_guid(c: Column, dtype: T.DataType) -> Column:
    """Lower-case dashed guid; unreadable text or bytes of another length give the zero guid."""
    zero = F.lit(ZERO_GUID)
    if _is(dtype, T.BinaryType):
        digits = F.lower(F.hex(c))
        # The first three groups are stored with their bytes reversed.
        order = [7, 5, 3, 1, 11, 9, 15, 13, 17, 19, 21, 23, 25, 27, 29, 31]
        mixed = F.concat(*[F.substring(digits, start, 2) for start in order])
        return F.when(c.isNotNull(), F.when(F.length(c) == 16, _dashed(mixed)).otherwise(zero))
    if _is_text(dtype):
        text = F.lower(F.btrim(c, F.lit(BLANKS)))
        digits = F.when(text.rlike(_GUID), F.regexp_replace(text, "[^0-9a-f]", "")).when(
            text.rlike(_HEX_GUID), F.regexp_replace(F.replace(text, F.lit("0x"), F.lit("")), "[^0-9a-f]", ""))
        return F.when(c.isNotNull(), F.coalesce(_dashed(digits), zero))
    return F.when(c.isNotNull(), zero)


_CONVERTERS = {
    ty.TEXT: to_text, ty.BOOLEAN: to_boolean, ty.INT32: to_int32, ty.INT64: to_int64,
    ty.DATE: to_date, ty.DATETIME: to_datetime, ty.BYTES: to_bytes, ty.GUID: to_guid,
}


def to_canonical(c: Column | str, source_type: T.DataType, canonical: str, decimal_comma: bool = False,
                 decimal: str = DECIMAL_TYPE) -> Column:
    """Value of a column as its canonical type; ``Unknown`` passes through, decimals are of the type given."""
    c = as_col(c)
    if canonical == ty.DECIMAL:
        return to_decimal(c, source_type, decimal_comma, decimal)
    if canonical == ty.DOUBLE:
        return to_double(c, source_type, decimal_comma)
    build = _CONVERTERS.get(canonical)
    return build(c, source_type) if build else c


def can_overflow(source_type: T.DataType, canonical: str) -> bool:
    """Whether values of a type may be too large for their canonical type."""
    if canonical in (ty.TEXT, ty.BOOLEAN, ty.BYTES, ty.GUID, ty.UNKNOWN):
        return False
    return canonical == ty.DECIMAL or not _is_text(source_type)


def overflowed(c: Column | str, source_type: T.DataType, canonical: str, decimal_comma: bool = False) -> Column:
    """True where a value cannot be held by its canonical type (the row is to be rejected)."""
    if not can_overflow(source_type, canonical):
        return F.lit(False)
    c = as_col(c)
    return c.isNotNull() & to_canonical(c, source_type, canonical, decimal_comma).isNull()


def was_defaulted(c: Column | str, source_type: T.DataType, canonical: str) -> Column:
    """True where a default replaced an unreadable value (dates, and booleans of odd types)."""
    c = as_col(c)
    if canonical == ty.BOOLEAN:
        odd = not (_is_text(source_type) or _is(source_type, T.NumericType, T.BooleanType))
        return c.isNotNull() if odd else F.lit(False)
    if canonical not in (ty.DATE, ty.DATETIME):
        return F.lit(False)
    if _is_text(source_type):
        parse = parse_date_text if canonical == ty.DATE else parse_datetime_text
        return ~is_blank(c) & parse(c).isNull()
    if _is(source_type, T.DateType, T.TimestampType, T.TimestampNTZType, T.DoubleType, T.LongType,
           T.DayTimeIntervalType):
        return F.lit(False)
    return c.isNotNull()


def canonical_value(c: Column | str, source_type: T.DataType, canonical: str, target: str = ty.UNKNOWN,
                    decimal_comma: bool = False, decimal: str = DECIMAL_TYPE) -> Column:
    """Canonical value; a Boolean target turns any other value into a boolean as well."""
    value = to_canonical(c, source_type, canonical, decimal_comma, decimal)
    held = ty.spark_type(canonical) or source_type
    if target == ty.BOOLEAN and not isinstance(held, T.BooleanType):
        return to_boolean(value, held)
    return value


def canonicalise(df: DataFrame, source_types: dict[str, str], target_types: dict[str, str] | None = None,
                 decimal_comma: bool = False) -> DataFrame:
    """Every column as its canonical type. Types are keyed by column name, ignoring case."""
    source = {name.lower(): kind for name, kind in source_types.items()}
    target = {name.lower(): kind for name, kind in (target_types or {}).items()}
    return df.select(*[
        canonical_value(
            F.col(f"`{f.name}`"), f.dataType, source.get(f.name.lower(), ty.UNKNOWN),
            target.get(f.name.lower(), ty.UNKNOWN), decimal_comma,
        ).alias(f.name)
        for f in df.schema
    ])


def default_value(canonical: str, dtype: T.DataType | None = None) -> Column:
    """What replaces NULL for a canonical type, cast to the column's own type when given."""
    plain = {
        ty.INT32: F.lit(0), ty.INT64: F.lit(0).cast("bigint"), ty.DOUBLE: F.lit(0.0),
        ty.DECIMAL: F.lit(0).cast(DECIMAL_TYPE), ty.BOOLEAN: F.lit(False), ty.DATE: _zero_date(),
        ty.DATETIME: _zero_datetime(), ty.BYTES: F.lit("").cast("binary"), ty.GUID: F.lit(ZERO_GUID),
    }.get(canonical, F.lit(""))
    return plain if dtype is None else plain.try_cast(dtype)


def default_nulls(df: DataFrame, types: dict[str, str], when: Column | None = None) -> DataFrame:
    """Replace NULLs by defaults in every listed column, on the rows chosen by ``when``."""
    known = {name.lower(): kind for name, kind in types.items()}
    chosen = F.lit(True) if when is None else when
    return df.select(*[
        F.when(chosen & F.col(f"`{f.name}`").isNull(), default_value(known[f.name.lower()], f.dataType))
        .otherwise(F.col(f"`{f.name}`")).alias(f.name)
        if f.name.lower() in known else F.col(f"`{f.name}`")
        for f in df.schema
    ])
