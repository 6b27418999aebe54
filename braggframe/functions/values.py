"""CIF values as Columns: nulls, quoting, numbers with standard uncertainties; small codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?:\([0-9]+\))?$"


def is_null(value: Column) -> Column:
    """The bare unknown or inapplicable value; a quoted one is a value."""
    return value.isin("?", ".")


def cif_string(value: Column) -> Column:
    """Without quotes, or the semicolons of a text field; nulls are empty."""
    field = F.regexp_replace(F.regexp_extract(value, r"(?s)^;(.*?)\r?\n?;$", 1), "\r", "")
    quoted = value.rlike(r"(?s)^(['\"]).*\1$") & (F.length(value) >= 2)
    return F.when(is_null(value), F.lit("")).when(value.rlike(r"(?s)^;.*;$") & (F.length(value) >= 2), field).when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def cif_number(value: Column) -> Column:
    """A double, a standard uncertainty in parentheses left out; null for nulls and for what is no number."""
    return F.regexp_extract(value, _NUMBER, 1).try_cast("double")


def cif_int(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value).try_cast("int")


def cif_quoted(value: Column) -> Column:
    """The shortest form that reads back as the string: bare, single or double quotes, or a text field."""
    special = value.rlike(r"""^[_#$'"\[\];]|\s|^$""") | value.isin("?", ".") | F.lower(value).rlike(r"^(data_|save_|loop_$|stop_$|global_$)")
    text = F.concat(F.lit(";"), value, F.lit("\n;"))
    single = F.concat(F.lit("'"), value, F.lit("'"))
    double = F.concat(F.lit('"'), value, F.lit('"'))
    return F.when(~special, value).when(value.contains("\n"), text).when(~value.rlike(r"'(\s|$)"), single).when(~value.rlike(r'"(\s|$)'), double).otherwise(text)


def glob_pattern(glob: str) -> str:
    """A regular expression for * and ?."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def archive_path(code: Column, kind: str = "M") -> Column:
    """Place of an entry in a divided archive: P for PDB, M for mmCIF, S for structure factors."""
    c = F.lower(code)
    mid = F.substring(c, 2, 2)
    if kind == "P":
        return F.concat(F.lit("structures/divided/pdb/"), mid, F.lit("/pdb"), c, F.lit(".ent.gz"))
    if kind == "M":
        return F.concat(F.lit("structures/divided/mmCIF/"), mid, F.lit("/"), c, F.lit(".cif.gz"))
    return F.concat(F.lit("structures/divided/structure_factors/"), mid, F.lit("/r"), c, F.lit("sf.ent.gz"))


def hybrid36(number: int, width: int) -> str:
    """A serial number in a fixed field: decimal, then base 36 with upper-case, then lower-case letters first."""
    if number < 10**width:
        return str(number).rjust(width)
    number -= 10**width
    span = 26 * 36 ** (width - 1)
    upper = number < span
    number = (number if upper else number - span) + 10 * 36 ** (width - 1)
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" if upper else "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    for _ in range(width):
        number, r = divmod(number, 36)
        out = digits[r] + out
    return out


def from_hybrid36(text: str) -> int:
    s, width = text.strip(), len(text)
    if not s[:1].isalpha():
        return int(s)
    base = 10 * 36 ** (width - 1)
    value = int(s, 36) - base + 10**width
    return value if s[0].isupper() else value + 26 * 36 ** (width - 1)


def hybrid36_text(number: Column, width: int) -> Column:
    """hybrid36 of a column, without the blanks before it; null beyond the last letters."""
    number, start, span = number.cast("long"), 10 * 36 ** (width - 1), 26 * 36 ** (width - 1)
    letters = lambda n: F.conv((n + start).cast("string"), 10, 36)
    upper, lower = number - 10**width, number - 10**width - span
    return F.when(upper < 0, number.cast("string")).when(lower < 0, letters(upper)).when(lower < span, F.lower(letters(lower)))


def hybrid36_int(text: Column, width: int) -> Column:
    """from_hybrid36 of a column of trimmed fields; null for what is no number."""
    lower = F.when(text.rlike("^[a-z]"), 26 * 36 ** (width - 1)).otherwise(0)
    wide = F.conv(text, 36, 10).cast("long") - 10 * 36 ** (width - 1) + 10**width + lower
    return F.when(text.rlike(f"^([A-Z][0-9A-Z]{{{width - 1}}}|[a-z][0-9a-z]{{{width - 1}}})$"), wide.cast("int")).otherwise(F.when(text != "", text).try_cast("int"))  # a failing cast costs an exception
