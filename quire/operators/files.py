"""Operators over files: admission, gates, archives' names, probes, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import files as fx
from quire.functions.text import half_up


def admit(picked: DataFrame, loaded: DataFrame, most: int = fx.MAX_FILES, soft: int = fx.SOFT_TOTAL_BYTES, hard: int = fx.HARD_TOTAL_BYTES) -> DataFrame:
    """picked and loaded (session_id, ord, name, size) -> the picked rows with a status: over_limit, duplicate, refused or admitted, and the session's warning.

    The limit on their number comes before the removal of duplicates. If the session would pass the hard limit, all fresh
    files are refused (the first stays if the session had none).
    """
    have = loaded.groupBy("session_id").agg(F.count("*").alias("had"), F.sum("size").alias("had_bytes"))
    rows = picked.join(have, "session_id", "left").fillna(0, ["had", "had_bytes"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("ord")))
    over = F.col("rank") > most - F.col("had")
    known = loaded.select("session_id", "name", "size").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, ["session_id", "name", "size"], "left").withColumn("over", over)
    copy = F.row_number().over(Window.partitionBy("session_id", "name", "size", "over").orderBy("ord")) > 1
    rows = rows.withColumn("twice", ~F.col("over") & (F.col("known").isNotNull() | copy)).withColumn("fresh", ~F.col("over") & ~F.col("twice"))
    whole = Window.partitionBy("session_id")
    total = F.col("had_bytes") + F.sum(F.when(F.col("fresh"), F.col("size")).otherwise(0)).over(whole)
    rows = rows.withColumn("total", total).withColumn("nth", F.sum(F.col("fresh").cast("int")).over(whole.orderBy("ord")))
    stays = (F.col("total") <= hard) | ((F.col("had") == 0) & (F.col("nth") == 1))
    status = F.when(F.col("over"), "over_limit").when(F.col("twice"), "duplicate").when(~stays, "refused").otherwise("admitted")
    notice = F.when(F.col("total") > hard, "E_OUT_OF_MEMORY").when(F.col("total") > soft, "W_MEMORY_HIGH")
    return rows.select("session_id", "ord", "name", "size", status.alias("status"), notice.alias("notice"))


def open_gate(files: DataFrame, least: int, most_pages: int = fx.MAX_PAGES) -> DataFrame:
    """files (job_id, file_id, page_count) -> one row a job: usable files, pages, skipped files and the error that stops it."""
    usable = F.col("page_count") > 0
    rows = files.groupBy("job_id").agg(F.count_if(usable).alias("sources"), F.sum("page_count").alias("pages"), F.count_if(~usable).alias("skipped"))
    return rows.withColumn("error", F.when(F.col("sources") < least, "E_TOO_FEW_FILES").when(F.col("pages") > most_pages, "E_TOO_MANY_PAGES"))


def skip_warning(gate: DataFrame) -> DataFrame:
    """open_gate()'s rows with a warning where files without pages were left out of a job that runs."""
    return gate.withColumn("warning", F.when(F.col("error").isNull() & (F.col("skipped") > 0), "W_FILE_SKIPPED"))


def old_check(name: Column, mime: Column, size: Column) -> Column:
    """Why the older and narrower check refuses a file, or null: no PDF by name or type, over 20 MB, empty."""
    is_pdf = F.coalesce(mime == "application/pdf", F.lit(False)) | F.rlike(F.coalesce(name, F.lit("")), F.lit(r"(?i)\.pdf\z"))
    return F.when(~is_pdf, "E_NOT_PDF").when(size > fx.OLD_MAX_BYTES, "E_TOO_LARGE").when(size == 0, "E_EMPTY_FILE")


def latest(results: DataFrame, *keys: str) -> DataFrame:
    """results (keys..., token, ...): of each key only the row of its highest token, which supersedes the others."""
    names = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*names), "token").alias("r"))
    return best.select(*keys, "r.*")


def with_defaults(defaults: Column, given: Column) -> Column:
    """A map of options with the given ones (null: none) over the defaults."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(F.coalesce(given, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(kept, F.coalesce(given, F.create_map().cast("map<string,string>")))


def text_layer(items: DataFrame, probe_pages: int = 3) -> DataFrame:
    """items (file_id, page, text) -> has_text: a run that is not blank on the first pages."""
    seen = (F.col("page") <= probe_pages) & (F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") != "")
    return items.groupBy("file_id").agg(F.bool_or(seen).alias("has_text"))


def unique_names(entries: DataFrame) -> DataFrame:
    """entries (job_id, ord, name) -> unique_name: the nth of a name gets ` (n)` before its last dot (or at its end)."""
    nth = F.row_number().over(Window.partitionBy("job_id", "name").orderBy("ord"))
    rows = entries.withColumn("nth", nth)
    mark = F.concat(F.lit(" ("), (F.col("nth") - 1).cast("string"), F.lit(")"))
    dot = F.length("name") - F.length(F.substring_index("name", ".", -1))
    cut = F.contains(F.col("name"), F.lit(".")) & (dot > 1)
    named = F.when(F.col("nth") == 1, F.col("name")).when(cut, F.concat(F.left("name", dot - 1), mark, F.substr(F.col("name"), dot))).otherwise(F.concat("name", mark))
    return rows.select("job_id", "ord", "name", named.alias("unique_name"))


def tools_accepting(mimes: Column) -> Column:
    """Names of the tools that take every one of the media types (all tools for none)."""
    tools = F.array(*(F.struct(F.lit(t).alias("id"), F.array(*map(F.lit, m)).alias("takes")) for t, _, _, m in fx.TOOLS))
    return F.transform(F.filter(tools, lambda t: F.forall(mimes, lambda m: F.array_contains(t["takes"], m))), lambda t: t["id"])


def image_page(width: Column, height: Column, size: str, margin_mm: float) -> Column:
    """struct(page_w, page_h, x, y, w, h) of an image on its page: fit-image, a4 or letter."""
    margin = max(0.0, margin_mm) * 72 / 25.4
    if size == "fit-image":
        values = (width + margin * 2, height + margin * 2, F.lit(margin), F.lit(margin), width.cast("double"), height.cast("double"))
    else:
        pw, ph = (595.28, 841.89) if size == "a4" else (612.0, 792.0)
        scale = F.least(F.lit(pw - margin * 2) / width, F.lit(ph - margin * 2) / height)
        values = (F.lit(pw), F.lit(ph), (F.lit(pw) - width * scale) / 2, (F.lit(ph) - height * scale) / 2, width * scale, height * scale)
    return F.struct(*(v.alias(k) for k, v in zip(("page_w", "page_h", "x", "y", "w", "h"), values)))


def raster_plan(pages: DataFrame, dpi: int, to: str, many: int = 60) -> DataFrame:
    """pages (file_id, page_index, width, height) -> pixel sizes and the warnings of the whole job's outputs of each file."""
    scale = dpi / 72
    total = F.count("*").over(Window.partitionBy("file_id"))
    rows = pages.select("file_id", "page_index", F.ceil(F.col("width") * scale).alias("pixel_w"), F.ceil(F.col("height") * scale).alias("pixel_h"), total.alias("outputs"))
    return rows.withColumn("many", F.when(F.col("outputs") > many, "W_MANY_OUTPUTS")).withColumn("larger", F.lit("W_PNG_LARGER" if to == "png" else None))


def heartbeats(spells: DataFrame, every_ms: int = 20_000) -> DataFrame:
    """spells (tab, from_ms, to_ms) in which a tab is visible and online -> (tab, ms): a beat at once and at every interval after."""
    beats = F.sequence(F.col("from_ms"), F.col("to_ms") - 1, F.lit(every_ms).cast("long"))
    return spells.where("to_ms > from_ms").select("tab", F.explode(beats).alias("ms"))


def shown_count(status: Column, online: Column) -> Column:
    """What a client shows of an answer: nothing unless it is fine and counts someone."""
    return F.when((status == 200) & (online > 0), online)


def predicted_bytes(size: Column, pages: Column, taken: Column) -> Column:
    """Bytes that so many of a file's pages take, in proportion."""
    return F.when(pages == 0, 0).otherwise(half_up(size / pages * taken)).cast("long")


def job_rollup(jobs: DataFrame) -> DataFrame:
    """jobs (operation, state, started_ms, finished_ms, outputs) -> counts by state and run times of finished jobs."""
    took = F.when(F.col("state") == "done", F.col("finished_ms") - F.col("started_ms"))
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "cancelled", "running")]
    return jobs.groupBy("operation").agg(F.count("*").alias("jobs"), *states, F.sum(took).alias("total_ms"), F.max(took).alias("longest_ms"), F.sum("outputs").alias("outputs"))
