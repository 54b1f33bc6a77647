"""Column resolution, type guards and scalar expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_TYPES = (T.TimestampType, T.TimestampNTZType)

# A plain decimal number with optional padding. Spark's own string cast also takes Java suffixes
# such as "12d", which are not numbers in the data.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


class KeyTypeMismatch(ValueError):
    """Two frames would be joined on keys of different types, which Spark would coerce silently."""


def ref(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def first_present(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """First candidate that exists, or None."""
    present = set(columns)
    return next((name for name in candidates if name in present), None)


def require_columns(frame: DataFrame, names: Iterable[str], what: str) -> None:
    missing = sorted(set(names) - set(frame.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; observed {sorted(frame.columns)}")


def type_of(frame: DataFrame, name: str) -> T.DataType:
    return frame.schema[name].dataType


def require_same_key_type(left: DataFrame, right: DataFrame, key: str, what: str) -> None:
    """Refuse a join whose key types differ instead of letting Spark cast one side."""
    a, b = type_of(left, key), type_of(right, key)
    if a != b:
        raise KeyTypeMismatch(
            f"{what}: {key} is {a.simpleString()} on one side and {b.simpleString()} on the other; "
            "cast both to one type first"
        )


def require_time_column(frame: DataFrame, name: str, what: str) -> None:
    kind = type_of(frame, name)
    if not isinstance(kind, TIME_TYPES):
        raise ValueError(f"{what}: {name} must be a timestamp, found {kind.simpleString()}")


def require_same_time_type(left: DataFrame, a: str, right: DataFrame, b: str, what: str) -> None:
    """Zoned and zone-less timestamps compare without an error in Spark but shift the window; refuse the mix."""
    if type_of(left, a) != type_of(right, b):
        raise ValueError(
            f"{what}: time zone mismatch, {a} is {type_of(left, a).simpleString()} "
            f"but {b} is {type_of(right, b).simpleString()}"
        )


def needs_parsing(frame: DataFrame, name: str) -> bool:
    """Only text can fail to become a number; numeric columns need no check."""
    return isinstance(type_of(frame, name), (T.StringType, T.VarcharType, T.CharType))


def as_double(frame: DataFrame, name: str) -> Column:
    """Lenient conversion to double: unparseable text becomes null."""
    column = ref(name)
    if needs_parsing(frame, name):
        return F.when(column.rlike(_NUMBER), column.try_cast("double"))
    if isinstance(type_of(frame, name), T.NullType):
        return F.lit(None).cast("double")
    return column.cast("double")


def safe_name(category: str) -> str:
    """Category value as part of a column name: lower case, with space, dash and slash as underscore."""
    return category.lower().translate(str.maketrans(" -/", "___"))


def normalized_text(column: Column) -> Column:
    """Lower case without surrounding white space of any kind."""
    return F.regexp_replace(F.lower(column.cast("string")), r"(?U)^\s+|\s+$", "")


def hours_interval(hours: float) -> Column:
    """Day-time interval of a possibly fractional number of hours."""
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, F.lit(float(hours) * 3600.0).cast("decimal(18,6)"))


def whole_seconds(start: str, end: str) -> Column:
    """Whole seconds from start to end; works for zoned and zone-less timestamps."""
    return F.expr(f"timestampdiff(SECOND, `{start}`, `{end}`)")


def hash_hex(column: Column, seed: object) -> Column:
    """Hex SHA-256 of "seed:value"."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), column.cast("string")), 256)


def hash_fraction(column: Column, seed: object) -> Column:
    """Deterministic fraction in [0, 1): the leading 64 bits of the hash over 2^64."""
    head = F.conv(F.substring(hash_hex(column, seed), 1, 16), 16, 10).cast("double")
    return head / F.lit(float(2**64))
