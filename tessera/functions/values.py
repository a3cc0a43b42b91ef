"""Scalar values: kinds, text form, truth, equality, integer and float arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def kind(cell: Column) -> Column:
    """``bool``, ``int``, ``float`` or ``string``: what the text of one cell is; an empty or null cell is a string."""
    whole = cell.rlike(r"^[+-]?[0-9]+$") & cell.try_cast("bigint").isNotNull()
    return F.when(cell.isin("true", "false"), "bool").when(whole, "int").when(cell.rlike(FLOAT), "float").otherwise("string")


def once(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: The words for the types of values.
TYPE_WORDS = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "string": "string", "void": "null", "array": "list", "map": "map"}


def type_word(c: Column) -> Column:
    """The word for the type of a column's values."""
    name = F.regexp_extract(F.typeof(c), "^([a-z]*)", 1)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in TYPE_WORDS.items() for x in pair))[name], name)


def float_text(c: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 to below 1e6, else with an exponent of two digits or more."""
    s = F.abs(c).cast("string")
    mantissa = F.substring_index(s, "E", 1)
    power = F.when(s.contains("E"), F.substring_index(s, "E", -1).try_cast("int")).otherwise(0)
    left, right = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    every = F.concat(left, right)
    bare = F.ltrim(every, F.lit("0"))
    digits = F.rtrim(bare, F.lit("0"))
    point = F.length(left) + power - (F.length(every) - F.length(bare))
    n, e = F.length(digits), point - 1
    rest = F.when(n > 1, F.concat(F.lit("."), F.expr("''"), digits.substr(F.lit(2), n))).otherwise("")
    scientific = F.concat(digits.substr(1, 1), rest, F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    scientific = F.when(F.abs(e) > 99, F.concat(digits.substr(1, 1), rest, F.when(e < 0, "e-").otherwise("e+"), F.abs(e).cast("string"))).otherwise(scientific)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - n))
    middle = F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, n))
    plain = F.when(point <= 0, small).when(point >= n, large).otherwise(middle)
    body = F.when(n == 0, "0").when((e < -4) | (e >= 6), scientific).otherwise(plain)
    sign = F.when(c < 0, "-").otherwise("")
    return F.when(F.isnan(c), "NaN").when(s == "Infinity", F.when(c > 0, "+Inf").otherwise("-Inf")).otherwise(F.concat(sign, body))


def text(c: Column, type_: str = "string") -> Column:
    """The text of a value of a Spark type; null is empty, lists are joined by a space, maps are ``k=v`` pairs."""
    if type_ in ("double", "float"):
        out = float_text(c)
    elif type_.startswith("array"):
        inner = type_[6:-1]
        out = F.array_join(F.transform(c, lambda x: text(x, inner)), " ")
    elif type_.startswith("map"):
        inner = type_[4:-1].partition(",")[2]
        out = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), text(e["value"], inner))), " ")
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def truthy(c: Column, type_: str = "string") -> Column:
    """Truth of a value: a number that is not 0, a text or list that is not empty; null is false."""
    if type_ == "boolean":
        out = c
    elif type_.startswith(("array", "map")):
        out = F.size(c) > 0
    elif type_ == "string":
        out = c != ""
    else:
        out = c != 0
    return F.coalesce(out, F.lit(False))


_NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def same(a: Column, a_type: str, b: Column, b_type: str) -> Column:
    """Equality: as numbers if both are, else as texts, null being the empty text."""
    if a_type in _NUMBERS and b_type in _NUMBERS:
        return F.coalesce(a == b, a.isNull() & b.isNull())
    return text(a, a_type) == text(b, b_type)


def to_int(c: Column, type_: str) -> Column:
    """Truncates floats, 0 or 1 for booleans, 0 for anything else."""
    if type_ in _NUMBERS:
        return c.cast("double").cast("bigint") if type_ in ("double", "float") else c.cast("bigint")
    return c.cast("bigint") if type_ == "boolean" else F.lit(0).cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, towards zero; a zero divisor raises."""
    q = F.floor(F.abs(a.cast("decimal(38,0)") / b.cast("decimal(20,0)"))).cast("bigint")
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(F.when((a < 0) != (b < 0), -q).otherwise(q)).cast("bigint")


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; floats are truncated first."""
    return a.cast("bigint") % b.cast("bigint")


def float_div(a: Column, b: Column) -> Column:
    """IEEE quotient: a zero divisor gives an infinity or NaN."""
    x, y = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    return F.when(y == 0, F.when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan")))).otherwise(F.try_divide(x, y))


def int_pow(a: Column, n: Column) -> Column:
    """Exact power for exponents from 0; negative exponents are the truncated float power."""
    exact = F.aggregate(F.array_repeat(a.cast("bigint"), F.greatest(n, F.lit(0)).cast("int")), F.lit(1).cast("bigint"), lambda x, y: x * y)
    return F.when(n >= 0, exact).otherwise(F.when(a == 0, F.lit(0)).otherwise(F.pow(a.cast("double"), n)).cast("bigint"))


def default(c: Column, otherwise: Column) -> Column:
    return F.coalesce(c, otherwise)


def required(c: Column, name: str) -> Column:
    """``c``, raising where it is null."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} is not set"))).otherwise(c)


def choose(condition: Column, then: Column, otherwise: Column | None = None) -> Column:
    """Inline conditional; without an alternative it is empty."""
    return F.when(condition, then).otherwise(F.lit("") if otherwise is None else otherwise)
