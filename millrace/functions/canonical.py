"""One text for each JSON value, whatever its depth: keys sorted, as Python's ``json.dumps(sort_keys=True)`` writes it.

A VARIANT keeps the fields of every object sorted by key, so its JSON text has
them in order at all depths. What is left is done token by token, as strings,
numbers and marks of a JSON text can be told apart without knowing where they
are nested: blanks behind commas and colons, escapes of all that is not
printable ASCII, and floats as Python prints them. No Python runs.

Doubles keep their point (1.0), whole numbers have none. Keys are in the order of
UTF-16 units; Python's differs where a key has characters beyond U+FFFF. NaN and
infinities are strings, as a VARIANT writes them. Digits of doubles are the JVM's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"(?:[^"\\]++|\\.)*+"'  # possessive: without recursion, so strings can be long
TOKEN = rf"{STRING}|[-+.0-9eE]+|[a-z]+|[\[\]{{}},:]"
#: Strings, numbers and what is between them.
PARTS = rf'{STRING}|-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|[^"0-9-]+|["-]'
#: In a string: an escape by code, another escape, a character to escape, and what stays.
PIECE = r"\\u[0-9A-Fa-f]{4}|\\.|[^ -~]|[ -\[\]-~]+"


def ascii_string(token: Column) -> Column:
    """A JSON string with lower-case escapes for all but printable ASCII."""

    def piece(p: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(p, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(F.startswith(p, F.lit("\\u")), F.lower(p)).when(p.rlike(r"^[^ -~]$"), units).otherwise(p)

    plain = ~token.rlike(r"[^ -~]|\\u")
    return F.when(plain, token).otherwise(F.array_join(F.transform(F.regexp_extract_all(token, F.lit(PIECE), F.lit(0)), piece), ""))


def python_number(token: Column) -> Column:
    """A number of the JVM as Python prints it: an exponent only below 1e-4 and from 1e16 on."""
    sign = F.when(F.startswith(token, F.lit("-")), "-").otherwise("")
    size = F.regexp_extract(token, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(token, r"E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.replace(size, F.lit("."), F.lit("")), r"(?<=.)0+$", "")
    short = F.regexp_replace(size, r"\.0$", "")
    many = F.concat(sign, short, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), "0"))
    whole = F.concat(sign, F.rpad(digits, exponent + 1, "0"), F.lit(".0"))
    broken = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    positional = F.when(exponent < 0, small).when(F.length(digits) <= exponent + 1, whole).otherwise(broken)
    return F.when(exponent.isNull(), token).when((exponent >= 16) | (exponent < -4), many).otherwise(positional)


def canonical_json(value: Column) -> Column:
    """The text of a VARIANT."""

    def write(t: Column) -> Column:
        return F.when(F.startswith(t, F.lit('"')), ascii_string(t)).when(t.isin(",", ":"), F.concat(t, F.lit(" "))).when(t.rlike("^-?[0-9]"), python_number(t)).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(F.to_json(value), F.lit(TOKEN), F.lit(0)), write), "")


def python_variant(text: Column) -> Column:
    """A JSON text as a VARIANT whose floats stay floats; null for text that is no JSON."""
    tokens = F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))
    return F.try_parse_json(F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"^-?[0-9]+\.[0-9]+$"), F.concat(t, F.lit("e0"))).otherwise(t)), ""))


def row_key(*fields: Column | str, leave_out: tuple[str, ...] = ("choices",)) -> Column:
    """MD5 of the text of a row of these columns; ``choices`` is no part of a row's identity."""
    names = [f for f in fields if not (isinstance(f, str) and f in leave_out)]
    return F.md5(canonical_json(F.to_variant_object(F.struct(*names))))


def json_row_key(text: Column, leave_out: tuple[str, ...] = ("choices",)) -> Column:
    """The same of a row that is a JSON object as text; null for any other text."""
    fields = F.try_variant_get(python_variant(text), "$", "map<string, variant>")
    return F.md5(canonical_json(F.to_variant_object(F.map_filter(fields, lambda k, _: ~k.isin(*leave_out)))))
