"""The page-range language: `1-3, 5, 8-` as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"\A([0-9]+)?(?:(-)([0-9]+)?)?\z"


def chunks(spec: Column) -> Column:
    return F.filter(F.split(spec, r"(?U)[,\s]+"), lambda c: c != "")


def parse_chunk(chunk: Column, pages: Column) -> Column:
    """struct(chunk, first, last, refused, clamped): 1-based bounds inside the file, null if refused."""
    number = lambda k: F.regexp_extract(chunk, _SHAPE, k)
    shaped = F.rlike(chunk, F.lit(_SHAPE))
    # doubles take any number of digits
    first = F.when(number(1) == "", F.lit(1.0)).otherwise(number(1).try_cast("double"))
    last = F.when(number(2) == "", first).when(number(3) == "", pages.cast("double")).otherwise(number(3).try_cast("double"))
    refused = ~shaped | (first < 1) | (first > pages) | (last < first)
    return F.struct(
        chunk.alias("chunk"),
        F.when(~refused, first).cast("int").alias("first"),
        F.when(~refused, F.least(last, pages.cast("double"))).cast("int").alias("last"),
        refused.alias("refused"),
        (~refused & (last > pages)).alias("clamped"),
    )


def parse_spec(spec: Column, pages: Column) -> Column:
    """struct(pages array<int> 0-based distinct sorted, out_of_bounds array<string>, unparsable boolean)."""
    parsed = F.transform(chunks(spec), lambda c: parse_chunk(c, pages))
    good = F.filter(parsed, lambda p: ~p["refused"])
    listed = F.flatten(F.transform(good, lambda p: F.sequence(p["first"] - 1, p["last"] - 1)))
    bad = F.transform(F.filter(parsed, lambda p: p["refused"] | p["clamped"]), lambda p: p["chunk"])
    return F.struct(F.array_sort(F.array_distinct(listed)).alias("pages"), bad.alias("out_of_bounds"), ((F.size(parsed) > 0) & (F.size(good) == 0)).alias("unparsable"))


def parse_groups(spec: Column, pages: Column) -> Column:
    """struct(groups array<array<int>>, out_of_bounds): every comma-separated part is a group; empty ones are dropped."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda c: F.regexp_replace(c, r"\A(?U)\s+|(?U)\s+\z", "")), lambda c: c != "")
    parsed = F.transform(parts, lambda c: parse_spec(c, pages))
    groups = F.filter(F.transform(parsed, lambda p: p["pages"]), lambda g: F.size(g) > 0)
    return F.struct(groups.alias("groups"), F.flatten(F.transform(parsed, lambda p: p["out_of_bounds"])).alias("out_of_bounds"))
