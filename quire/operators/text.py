"""Text runs: finding, replacing, lines and flow. Runs (items) have file_id, page, item_index, text and geometry."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(text: Column, needle: str) -> Column:
    """Places (from 0) of a literal string, not overlapping, case as it is."""
    if not needle:
        return F.array().cast("array<int>")
    parts = F.split(text, re.escape(needle), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, part: F.struct((acc["at"] + F.length(part) + len(needle)).alias("at"), F.array_append(acc["found"], acc["at"] + F.length(part)).alias("found"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["found"]


def count_matches(text: Column, needle: str) -> Column:
    """Literal occurrences without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle)))) / len(needle))


def find(items: DataFrame, needle: str) -> DataFrame:
    """items -> one row a hit: offset, ordinal among the page's hits of its font, x and width by share of the characters."""
    hits = items.withColumn("offset", F.explode(offsets(F.col("text"), needle)))
    per = F.col("width") / F.length("text")
    partial = F.lit(len(needle)) < F.length("text")
    order = Window.partitionBy("file_id", "page", "font").orderBy("item_index", "offset")
    return hits.select(
        "file_id", "page", "item_index", "font", "offset", (F.row_number().over(order) - 1).alias("ordinal"),
        F.when(partial, F.col("x") + per * F.col("offset")).otherwise(F.col("x")).alias("hit_x"),
        F.when(partial, per * len(needle)).otherwise(F.col("width")).alias("hit_width"), "y", "font_size",
    )


def gap_right(items: DataFrame, band: float) -> DataFrame:
    """(file_id, page, item_index, gap): the way to the next run on the same baseline; null if none follows.

    band: a height no smaller than the largest tolerance; runs meet their own band and its two neighbours only.
    """
    tolerance = F.greatest(F.lit(1.0), F.col("font_size") * 0.3)
    left = items.select("file_id", "page", "item_index", "x", "y", (F.col("x") + F.col("width")).alias("edge"), tolerance.alias("tol"), F.explode(F.array(*(F.floor(F.col("y") / band) + k for k in (-1, 0, 1)))).alias("band"))
    right = items.where(F.regexp_replace("text", r"(?U)\s", "") != "").select("file_id", "page", F.col("x").alias("ox"), F.col("y").alias("oy"), F.floor(F.col("y") / band).alias("band"))
    near = left.join(right, ["file_id", "page", "band"], "left")
    gap = F.when((F.abs(F.col("oy") - F.col("y")) <= F.col("tol")) & (F.col("ox") > F.col("x") + 0.01), F.col("ox") - F.col("edge"))
    return near.groupBy("file_id", "page", "item_index").agg(F.min(gap).alias("gap"))


def replacements(hits: DataFrame, find_text: str, replace: str) -> DataFrame:
    """hits -> (file_id, page, id, find, replace, ordinal): one edit a hit, numbered on its page."""
    nth = F.row_number().over(Window.partitionBy("file_id", "page").orderBy("item_index", "offset")) - 1
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-"), nth.cast("string"), F.lit(f"-{find_text}-{replace}"))
    return hits.select("file_id", "page", name.alias("id"), F.lit(find_text).alias("find"), F.lit(replace).alias("replace"), "ordinal")


def edit_outcomes(files: DataFrame, find_text: str) -> DataFrame:
    """files (job_id, file_id, hits, scanned, overlays) -> one row a job: error, warnings, outputs and how they are packed."""
    if not find_text:
        return files.select("job_id").distinct().select("job_id", F.lit("E_BAD_OPTIONS").alias("error"), F.lit(0).cast("long").alias("outputs"), F.lit(None).cast("string").alias("packed"), F.lit("").alias("warnings"))
    edited = F.col("hits") > 0
    rows = files.groupBy("job_id").agg(F.count_if(edited).alias("outputs"), F.count_if(~edited).alias("untouched"), F.bool_and("scanned").alias("scans"), F.sum("overlays").alias("overlays"))
    error = F.when((F.col("outputs") == 0) & F.col("scans"), "E_NO_TEXT_LAYER").when(F.col("outputs") == 0, "E_TEXT_NOT_FOUND")
    warnings = F.array(F.when(error.isNull() & (F.col("untouched") > 0), "W_NO_MATCH_IN_FILE"), F.when(error.isNull() & (F.col("overlays") > 0), "W_EDIT_OVERLAY"))
    packed = F.when(F.col("outputs") == 1, "application/pdf").when(F.col("outputs") > 1, "application/zip")
    return rows.select("job_id", error.alias("error"), "outputs", packed.alias("packed"), F.array_join(warnings, ",").alias("warnings"))


METHODS = ("overlay", "erase", "native")


def batch_report(reports: DataFrame) -> DataFrame:
    """reports (file_id, method, original_removed) -> hits, the worst method and whether every original is gone."""
    rank = F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))
    return reports.groupBy("file_id").agg(F.count("*").alias("hits"), F.min_by("method", rank).alias("method"), F.bool_and("original_removed").alias("clean"))


def batch_rollup(batch: DataFrame) -> DataFrame:
    """batch (batch_id, state, hits, method) -> counts of files by state, hits, and whether one was painted over."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "empty", "failed")]
    return batch.groupBy("batch_id").agg(*states, F.sum("hits").alias("hits"), F.coalesce(F.bool_or(F.col("method") == "overlay"), F.lit(False)).alias("overlay"))


def group_lines(items: DataFrame) -> DataFrame:
    """(file_id, page, line_no, item_index): runs whose baseline is near that of the line's first run, top first.

    The first run of a line is its anchor, so a drifting baseline ends a line; a fold over the page's sorted runs.
    """
    run = F.struct((-F.col("y")).alias("ny"), "x", "item_index", "font_size")
    page = items.where(F.length("text") > 0).groupBy("file_id", "page").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(acc: Column, r: Column) -> Column:
        same = F.coalesce(F.abs(acc["anchor"] - r["ny"]) <= F.greatest(F.lit(1.0), r["font_size"] * 0.4), F.lit(False))
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        return F.struct(F.when(same, acc["anchor"]).otherwise(r["ny"]).alias("anchor"), line.alias("line"), F.array_append(acc["lines"], line).alias("lines"))

    folded = page.select("file_id", "page", F.arrays_zip(F.col("runs.item_index").alias("item_index"), F.aggregate("runs", start, step)["lines"].alias("line_no")).alias("z"))
    return folded.select("file_id", "page", F.explode("z").alias("z")).select("file_id", "page", "z.line_no", "z.item_index")


def join_lines(items: DataFrame) -> DataFrame:
    """items with line_no -> (file_id, page, line_no, text): a gap of over a quarter of the font size becomes a space."""
    order = Window.partitionBy("file_id", "page", "line_no").orderBy("x", "item_index")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(order)
    piece = F.concat(F.when(gap > F.col("font_size") * 0.25, " ").otherwise(""), F.col("text"))
    rows = items.withColumn("piece", F.struct(F.row_number().over(order).alias("k"), piece.alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["t"]), "")
    return rows.groupBy("file_id", "page", "line_no").agg(F.regexp_replace(text, r"(?U)\s+\z", "").alias("text")).where("text <> ''")


def flow_paragraphs(text: Column) -> Column:
    """Single line breaks go, blank lines stay."""
    return F.regexp_replace(text, r"([^\n])\n(?!\n)", "$1")


def text_of_pages(pages: DataFrame, separator: bool, paragraphs: bool = False) -> DataFrame:
    """pages (file_id, page, text) -> one text a file. With `separator`, page marks once something precedes."""
    body = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda line: F.regexp_replace(line, r"(?U)\s+\z", "")), lambda line: line != ""), "\n")
    rows = pages.select("file_id", "page", body.alias("body"))
    before = F.max(F.col("body") != "").over(Window.partitionBy("file_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    mark = F.when(F.lit(separator) & F.coalesce(before, F.lit(False)), F.concat(F.lit("\n--- "), F.col("page").cast("string"), F.lit(" ---\n")))
    flow = flow_paragraphs(F.col("body")) if paragraphs else F.col("body")
    rows = rows.select("file_id", F.struct("page", F.concat_ws("\n", mark, F.when(F.col("body") != "", flow)).alias("t"), (mark.isNotNull() | (F.col("body") != "")).alias("any")).alias("c"))
    chunks = F.transform(F.filter(F.array_sort(F.collect_list("c")), lambda c: c["any"]), lambda c: c["t"])
    joined = F.regexp_replace(F.array_join(chunks, "\n"), r"\n{3,}", "\n\n")
    return rows.groupBy("file_id").agg(F.concat(F.regexp_replace(joined, r"\A(?U)\s+|(?U)\s+\z", ""), F.lit("\n")).alias("text"))


def text_status(files: DataFrame) -> DataFrame:
    """files (job_id, file_id, text) -> outputs, skipped files and the error or warning of the conversion to text."""
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") == ""
    rows = files.groupBy("job_id").agg(F.count_if(~blank).alias("outputs"), F.count_if(blank).alias("skipped"))
    return rows.withColumn("error", F.when(F.col("outputs") == 0, "E_NO_TEXT_LAYER")).withColumn("warning", F.when((F.col("outputs") > 0) & (F.col("skipped") > 0), "W_NO_TEXT_IN_FILE"))


def undo_history(history: DataFrame) -> DataFrame:
    """history (session_id, seq, op, edit_id) -> the edits in force: an undo takes back the last apply that stands.

    The number of edits in force is a walk up and down that never goes below 0; an apply stands if the walk never
    falls below it again. So two sorts of a session's log do, and nothing is folded.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    so_far, later = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("_sum", F.sum(F.when(F.col("op") == "undo", -1).otherwise(1)).over(so_far))
    rows = rows.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(so_far), F.lit(0)))
    stands = (F.col("op") != "undo") & F.coalesce(F.min("_depth").over(later) >= F.col("_depth"), F.lit(True))
    rows = rows.select("session_id", F.when(stands, F.struct("seq", F.col("edit_id").cast("bigint").alias("edit_id"))).alias("_e"))
    return rows.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["edit_id"]).alias("edits"))


def apply_edits(text: Column, edits: Column) -> Column:
    """text with edits (array of struct(start, stop, put), not overlapping) applied; null if the text or something of an edit is null.

    Every place counts in the text as it came, so a place past its end is its end, and no edit takes what another put.
    """
    ordered = F.sort_array(edits)
    stops = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda e: e["stop"]))
    # what stands before an edit, and what it puts; past the last edit the rest of the text
    before = lambda e, at: F.substr(text, at + 1, F.coalesce(e["start"], F.length(text)) - at)
    pieces = F.zip_with(ordered, stops, lambda e, at: F.concat(before(e, at), F.when(e.isNull(), "").otherwise(e["put"])))
    unknown = F.exists(edits, lambda e: e["start"].isNull() | e["stop"].isNull() | e["put"].isNull())
    return F.when(text.isNotNull() & ~unknown, F.array_join(pieces, ""))
