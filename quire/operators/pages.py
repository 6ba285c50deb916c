"""Page-set algebra: splitting, ordering, merging. Files have pages (file_id, page_index), counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.functions.text import fill_pattern, sanitise, stem

A4 = (595.28, 841.89)
LETTER = (612.0, 792.0)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file_id").agg(F.count("*").cast("int").alias("page_count"))


def _placed(rows: DataFrame, *groups: str) -> DataFrame:
    """(file_id, group_no, pos, page_index) with positions from 0 inside each group."""
    order = Window.partitionBy("file_id", *groups).orderBy("page_index")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("file_id", "group_no", "pos", "page_index")


def _selected(pages: DataFrame, selection: DataFrame) -> DataFrame:
    """The distinct selected pages that exist."""
    return pages.join(selection.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_semi")


def extract_merged(pages: DataFrame, selection: DataFrame) -> DataFrame:
    return _placed(_selected(pages, selection).withColumn("group_no", F.lit(0)))


def extract_separate(pages: DataFrame, selection: DataFrame) -> DataFrame:
    group = F.row_number().over(Window.partitionBy("file_id").orderBy("page_index")) - 1
    return _selected(pages, selection).select("file_id", group.alias("group_no"), F.lit(0).alias("pos"), "page_index")


def remove(pages: DataFrame, selection: DataFrame) -> DataFrame:
    kept = pages.join(selection.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_anti")
    return _placed(kept.withColumn("group_no", F.lit(0)))


def every_n(pages: DataFrame, n: float) -> DataFrame:
    n = max(1, int(n // 1))
    return pages.select("file_id", F.expr(f"cast(page_index div {n} as int)").alias("group_no"), F.expr(f"cast(page_index % {n} as int)").alias("pos"), "page_index")


def split_ranges(files: DataFrame, spec: Column) -> DataFrame:
    """files (file_id, page_count) -> one group for each comma-separated part of spec that selects pages."""
    groups = files.select("file_id", F.posexplode(ranges.parse_groups(spec, F.col("page_count"))["groups"]).alias("group_no", "g"))
    return groups.select("file_id", "group_no", F.posexplode("g").alias("pos", "page_index"))


def split_status(files: DataFrame, plan: DataFrame, mode: str) -> DataFrame:
    """(file_id, n_groups, error, warning) of a plan; files without groups fail as their mode says."""
    n = plan.groupBy("file_id").agg(F.countDistinct("group_no").alias("n_groups"))
    error = "E_RANGE_OUT_OF_BOUNDS" if mode == "ranges" else "E_NO_PAGES_SELECTED"
    rows = files.join(n, "file_id", "left").withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    return rows.select("file_id", "n_groups", F.when(F.col("n_groups") == 0, error).alias("error"), F.when(F.col("n_groups") > 0, "W_BOOKMARKS_DROPPED").alias("warning"))


def split_outputs(plan: DataFrame, names: DataFrame, pattern: str, suffix: str, zipped: bool) -> DataFrame:
    """(file_id, group_no, name, pages, packed): one output a group; several are packed into one archive if asked."""
    groups = plan.groupBy("file_id", "group_no").agg(F.count("*").alias("pages"))
    total = F.count("*").over(Window.partitionBy("file_id"))
    rows = groups.withColumn("total", total).join(names, "file_id")
    base = sanitise(stem(F.col("file_name")))
    name = F.when(F.col("total") == 1, F.concat(base, F.lit(f"-{suffix}"))).otherwise(fill_pattern(F.lit(pattern), base, F.col("group_no") + 1, F.col("total")))
    return rows.select("file_id", "group_no", F.concat(name, F.lit(".pdf")).alias("name"), "pages", ((F.col("total") > 1) & F.lit(zipped)).alias("packed"))


def final_order(pages: DataFrame, order: DataFrame, deleted: DataFrame) -> DataFrame:
    """(file_id, pos, page_index): order (file_id, at, page_index), repeats kept, without missing and deleted source pages; files without an order keep theirs."""
    own = pages.join(order.select("file_id").distinct(), "file_id", "left_anti").withColumn("at", F.col("page_index"))
    asked = order.join(pages, ["file_id", "page_index"], "left_semi")
    rows = asked.select("file_id", "at", "page_index").unionByName(own.select("file_id", "at", "page_index"))
    rows = rows.join(deleted.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_anti")
    return rows.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("at")) - 1).alias("pos"), "page_index")


def unchanged(ordered: DataFrame, files: DataFrame, rotations: DataFrame) -> DataFrame:
    """(file_id, unchanged): all pages in their own places and no rotation that is not a full turn."""
    same = ordered.groupBy("file_id").agg(F.count("*").alias("n"), F.bool_and(F.col("pos") == F.col("page_index")).alias("same"))
    turned = rotations.groupBy("file_id").agg(F.bool_or(F.pmod(F.col("quarter"), F.lit(360)) != 0).alias("turned"))
    rows = files.join(same, "file_id", "left").join(turned, "file_id", "left")
    return rows.select("file_id", ((F.coalesce("n", F.lit(0)) == F.col("page_count")) & F.coalesce("same", F.lit(True)) & ~F.coalesce("turned", F.lit(False))).alias("unchanged"))


def rotate(pages: DataFrame, rotations: DataFrame) -> DataFrame:
    """pages with rotation -> the rotation after adding the quarter turns asked for their source page."""
    extra = F.coalesce("quarter", F.lit(0))
    return pages.join(rotations, ["file_id", "page_index"], "left").withColumn("rotation", F.pmod(F.col("rotation") + extra, F.lit(360))).drop("quarter")


def organize_status(jobs: DataFrame) -> DataFrame:
    """jobs (file_id, page_count, kept, ordered: an order was given, turned: a page is turned) -> error and warnings.

    kept: pages that are left. Bookmarks go if pages are missing or an order was given, even the old one.
    """
    error = F.when(F.col("kept") == 0, "E_NO_PAGES_SELECTED")
    same = (F.col("kept") == F.col("page_count")) & ~F.col("ordered") & ~F.col("turned")
    dropped = (F.col("kept") != F.col("page_count")) | F.col("ordered")
    warnings = F.array(F.when(error.isNull() & same, "W_NOTHING_CHANGED"), F.when(error.isNull() & dropped, "W_BOOKMARKS_DROPPED"))
    return jobs.select("file_id", error.alias("error"), F.array_join(warnings, ",").alias("warnings"))


def turn_all(rotations: Column, quarter: Column) -> Column:
    """A map of page to turn with the quarter added to each, from 0 to 359."""
    return F.transform_values(rotations, lambda _, v: F.pmod(v + quarter, F.lit(360)))


def selector(pages: DataFrame, selection: DataFrame, kind: str, first: int = 0, last: int = 0) -> DataFrame:
    """all, none, odd, even (of the page numbers from 1), invert, or range (from first to last, either way round)."""
    low, high = min(first, last), max(first, last)
    tests = {"all": F.lit(True), "none": F.lit(False), "odd": F.col("page_index") % 2 == 0, "even": F.col("page_index") % 2 == 1, "range": F.col("page_index").between(low, high)}
    if kind == "invert":
        return pages.join(selection.select("file_id", "page_index").distinct(), ["file_id", "page_index"], "left_anti").select("file_id", "page_index")
    return pages.where(tests[kind]).select("file_id", "page_index")


def move(order: Column, source: Column, target: Column) -> Column:
    """An array with the element at source taken out and put in at target (clamped)."""
    item = F.slice(order, source + 1, 1)
    rest = F.filter(order, lambda _, i: i != source)
    to = F.least(F.greatest(target, F.lit(0)), F.size(rest))
    return F.concat(F.slice(rest, F.lit(1), to), item, F.slice(rest, to + 1, F.size(rest)))


def describe(pages: DataFrame) -> DataFrame:
    """(file_id, page_index) -> (file_id, ranges): runs of pages as `1-3, 7`."""
    runs = pages.select("file_id", "page_index").distinct()
    runs = runs.withColumn("run", F.col("page_index") - F.row_number().over(Window.partitionBy("file_id").orderBy("page_index")))
    runs = runs.groupBy("file_id", "run").agg(F.min("page_index").alias("a"), F.max("page_index").alias("b"))
    part = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat((F.col("a") + 1).cast("string"), F.lit("-"), (F.col("b") + 1).cast("string")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("a"), part.alias("part"))))
    return runs.groupBy("file_id").agg(F.array_join(F.transform(listed, lambda x: x["part"]), ", ").alias("ranges"))


def chosen_pages(files: DataFrame) -> DataFrame:
    """files (job_id, file_id, ord, page_count, spec) -> job_id, file_id, ord, pages, error, warning. A blank spec takes all pages; a file without pages is skipped."""
    blank = F.coalesce(F.trim("spec"), F.lit("")) == ""
    rows = files.withColumn("r", ranges.parse_spec(F.coalesce("spec", F.lit("")), F.col("page_count")))
    none = F.coalesce(F.col("page_count"), F.lit(0)) <= 0
    every = F.when(none, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.col("page_count"), F.lit(1)) - 1))
    return rows.select(
        "job_id", "file_id", "ord", "page_count",
        F.when(blank, every).otherwise(F.col("r.pages")).alias("pages"),
        F.when(~none & ~blank & (F.size("r.pages") == 0), "E_RANGE_OUT_OF_BOUNDS").alias("error"),
        F.when(none, "W_FILE_SKIPPED").when(~blank & (F.size("r.pages") > 0) & (F.size("r.out_of_bounds") > 0), "W_RANGE_CLAMPED").alias("warning"),
    )


def merge_map(chosen: DataFrame) -> DataFrame:
    """(job_id, out_index, file_id, page_index): the pages of a job's files one after the other."""
    rows = chosen.select("job_id", "file_id", "ord", F.posexplode("pages").alias("at", "page_index"))
    out = F.row_number().over(Window.partitionBy("job_id").orderBy("ord", "at")) - 1
    return rows.select("job_id", out.alias("out_index"), "file_id", "page_index")


def merge_bookmarks(chosen: DataFrame, names: DataFrame) -> DataFrame:
    """(job_id, ord, title, page_index): one for each file, at the pages written before it."""
    before = F.sum(F.size("pages")).over(Window.partitionBy("job_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    rows = chosen.withColumn("page_index", F.coalesce(before, F.lit(0)).cast("long")).join(names, "file_id")
    return rows.select("job_id", "ord", stem(F.col("file_name")).alias("title"), "page_index")


def fit_geometry(sizes: DataFrame, target_w: Column, target_h: Column) -> DataFrame:
    """sizes (page_id, width, height) -> scale and place of each page drawn into the target size, centred."""
    rows = sizes.withColumn("tw", target_w).withColumn("th", target_h)
    rows = rows.withColumn("scale", F.least(F.col("tw") / F.col("width"), F.col("th") / F.col("height")))
    return rows.select("page_id", "scale", ((F.col("tw") - F.col("width") * F.col("scale")) / 2).alias("x"), ((F.col("th") - F.col("height") * F.col("scale")) / 2).alias("y"), ((F.col("tw") != F.col("width")) | (F.col("th") != F.col("height"))).alias("redrawn"))


def outline_links(bookmarks: DataFrame) -> DataFrame:
    """(job_id, ord, ...) -> the neighbours of each entry and, on every row, the first, last and number of entries."""
    order, whole = Window.partitionBy("job_id").orderBy("ord"), Window.partitionBy("job_id")
    return bookmarks.select(
        "job_id", "ord", F.lag("ord").over(order).alias("prev_ord"), F.lead("ord").over(order).alias("next_ord"),
        F.min("ord").over(whole).alias("first_ord"), F.max("ord").over(whole).alias("last_ord"), F.count("*").over(whole).alias("entries"),
        F.hex(F.encode("title", "UTF-16BE")).alias("title_hex"),
    )
