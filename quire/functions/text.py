"""Scalar column functions with the rounding, trimming and padding rules that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s"


def half_up(x: Column) -> Column:
    """Round halves towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not spaces alone."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def pad_number(n: Column, width: Column) -> Column:
    """n with zeros in front, never cut to the width."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), width), "0")


def stem(name: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name, r"\.[^./\\]+\z", "")


def as_pdf_name(name: Column) -> Column:
    """Exactly one .pdf at the end; an empty name is `document`."""
    base = F.regexp_replace(trim_all(name), r"(?i)\.pdf\z", "")
    return F.concat(F.when(base == "", F.lit("document")).otherwise(base), F.lit(".pdf"))


def sanitise(name: Column) -> Column:
    """A name that every file system takes, of at most 180 characters."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[/\\?%*:|"<>]', "-"), rf"{SPACE}+", " ")
    return F.substring(trim_all(safe), 1, 180)


def fill_pattern(pattern: Column, name: Column, n: Column, total: Column) -> Column:
    """<name>, <nn> (padded to the digits of the total) and <n>."""
    out = F.replace(pattern, F.lit("<name>"), name)
    out = F.replace(out, F.lit("<nn>"), pad_number(n, F.length(total.cast("string"))))
    return F.replace(out, F.lit("<n>"), n.cast("string"))


def suffix_name(name: Column, suffix: Column) -> Column:
    """The suffix before the last dot, unless that begins the name or is missing."""
    dot = F.length(name) - F.length(F.substring_index(name, ".", -1))
    cut = (dot > 1) & F.contains(name, F.lit("."))
    return F.when(cut, F.concat(F.left(name, dot - 1), suffix, F.substr(name, dot))).otherwise(F.concat(name, suffix))


def edited_name(name: Column) -> Column:
    pdf = F.rlike(name, F.lit(r"(?i)\.pdf\z"))
    return F.when(pdf, F.regexp_replace(name, r"(?i)\.pdf\z", "-edited.pdf")).otherwise(F.concat(name, F.lit("-edited.pdf")))


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with so many digits, halves away from zero."""
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def format_bytes(n: Column) -> Column:
    mb = F.concat(fixed(n / 1024 / 1024, 1), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(half_up(n / 1024).cast("string"), F.lit(" KB"))).otherwise(mb)


def predicted_size(n: Column) -> Column:
    """A size for a prediction: at least 1 KB."""
    mb = F.concat(fixed(n / 1024 / 1024, 1), F.lit(" MB"))
    return F.when(n < 1024 * 1024, F.concat(F.greatest(F.lit(1), half_up(n / 1024)).cast("string"), F.lit(" KB"))).otherwise(mb)


def fill_template(template: Column, values: Column) -> Column:
    """{key} replaced by values[key] (a map of strings); unknown keys stay."""
    return F.aggregate(F.map_entries(values), template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def utf16_text(hexed: Column) -> Column:
    """Text of UTF-16BE code units in hexadecimal; a partial unit at the end is ignored, half a surrogate pair is U+FFFD."""
    units = F.regexp_extract_all(F.upper(hexed), F.lit("[0-9A-F]{4}"), F.lit(0))
    high, low = (lambda u: F.rlike(u, F.lit("^D[89AB]"))), (lambda u: F.rlike(u, F.lit("^D[C-F]")))
    near = lambda i, test: F.coalesce(test(F.get(units, i)), F.lit(False))
    alone = lambda u, i: high(u) & ~near(i + 1, low) | low(u) & ~near(i - 1, high)
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u, i: F.when(alone(u, i), "FFFD").otherwise(u)), "")), "UTF-16BE")
