"""Images: what compression would do, did, and saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import half_up

# Presets (dpi, quality) and limits of compression.
PRESETS = {"extreme": (96, 0.5), "recommended": (150, 0.75), "high-quality": (220, 0.88)}
MIN_PIXELS = 40_000
MIN_STORED = 4096
WORTH = 0.95
READABLE = ("", "FlateDecode", "LZWDecode", "RunLengthDecode", "ASCII85Decode", "ASCIIHexDecode")
NOTABLE_NOT = ("too-small", "no-gain")


def skip_reason() -> Column:
    """Why an image is left alone, by the first rule that holds; null: it is recoded."""
    plain = F.col("colour").isin("rgb", "gray")
    return (
        F.when(F.col("is_mask") | F.col("is_mask_target"), "mask")
        .when(F.col("sample_tricks"), "sample-tricks")
        .when((F.col("width").cast("long") * F.col("height") < MIN_PIXELS) | (F.col("stored") < MIN_STORED), "too-small")
        .when((F.col("filter") == "DCTDecode") & plain, None)
        .when(F.col("filter") == "DCTDecode", "unsupported-colour")
        .when(~F.col("filter").isin(*READABLE), "unsupported-filter")
        .when((F.col("bits") != 8) | ~plain, "unsupported-colour")
    )


def plan(images: DataFrame, placements: DataFrame, level: str = "recommended") -> DataFrame:
    """images and placements (key, width_pt, height_pt) -> resolution, target size, action and reason."""
    dpi = PRESETS[level][0]
    rows = images.join(placements, "key", "left")
    w, h = F.col("width"), F.col("height")
    placed = (F.col("width_pt") > 1) & (F.col("height_pt") > 1)
    scale = F.least(F.lit(1.0), F.col("width_pt") / 72 * dpi / w, F.col("height_pt") / 72 * dpi / h)
    target = lambda side: F.when(placed & (scale < 1), F.greatest(F.lit(1), half_up(side * scale))).otherwise(side).cast("long")
    reason = skip_reason()
    return rows.select(
        "key", "file_id", "stored", F.when(F.col("width_pt") > 1, half_up(w / (F.col("width_pt") / 72))).cast("long").alias("effective_dpi"),
        target(w).alias("target_width"), target(h).alias("target_height"), F.when(reason.isNull(), "recode").otherwise("skip").alias("action"), reason.alias("reason"),
    )


def recode_outcome(planned: DataFrame, answers: DataFrame) -> DataFrame:
    """planned and answers (key, new_bytes; null: the codec declined) -> outcome and reason of each image."""
    rows = planned.join(answers, "key", "left")
    reason = F.coalesce("reason", F.when(F.col("new_bytes").isNull(), "unreadable").when(F.col("new_bytes") >= F.col("stored") * WORTH, "no-gain"))
    return rows.select("key", "file_id", "stored", reason.alias("reason"), F.when(reason.isNull(), F.col("new_bytes")).otherwise(F.col("stored")).alias("kept_bytes"))


def skip_histogram(outcomes: DataFrame) -> DataFrame:
    rows = outcomes.where("reason is not null").groupBy("file_id", "reason").agg(F.count("*").alias("images"))
    return rows.withColumn("notable", ~F.col("reason").isin(*NOTABLE_NOT))


def skip_warning(histogram: DataFrame) -> DataFrame:
    """(file_id, warning): files of which an image was left alone for a reason worth telling."""
    return histogram.groupBy("file_id").agg(F.when(F.bool_or("notable"), F.lit("W_IMAGES_SKIPPED")).alias("warning"))


def recode_totals(outcomes: DataFrame, pages: DataFrame) -> DataFrame:
    """outcomes (file_id, reason, stored, kept_bytes) and pages (file_id, page_count) -> images recoded, bytes saved and pages done."""
    rows = outcomes.groupBy("file_id").agg(F.count_if(F.col("reason").isNull()).alias("recoded"), F.sum(F.col("stored") - F.col("kept_bytes")).alias("saved"))
    return pages.join(rows, "file_id", "left").select("file_id", F.coalesce("recoded", F.lit(0)).alias("recoded"), F.coalesce("saved", F.lit(0)).alias("saved"), F.col("page_count").alias("pages_done"))


def file_outcome(files: DataFrame, never_grow: bool = True) -> DataFrame:
    """files (file_id, original, saved) -> the bytes handed back; a file that would not shrink stays as it was."""
    grew = F.lit(never_grow) & (F.col("saved") >= F.col("original"))
    return files.select("file_id", F.when(grew, F.col("original")).otherwise(F.col("saved")).alias("bytes"), grew.alias("kept_original"))


def savings(files: DataFrame) -> DataFrame:
    """files (job_id, original, bytes) -> totals, percent saved (never below 0) and the warning if nothing was."""
    rows = files.groupBy("job_id").agg(F.sum("original").alias("original"), F.sum("bytes").alias("bytes"))
    percent = F.when(F.col("original") > 0, (F.col("original") - F.col("bytes")) / F.col("original") * 100).otherwise(0.0)
    return rows.select("job_id", "original", "bytes", F.greatest(F.lit(0.0), percent).alias("saved_percent"), F.when(percent < 1, "W_ALREADY_OPTIMIZED").alias("warning"))


def largest_placement(placements: DataFrame) -> DataFrame:
    """placements (key, ord, width_pt, height_pt) -> the largest by area of each image, the first of equals."""
    best = F.struct((F.col("width_pt") * F.col("height_pt")).alias("area"), (-F.col("ord")).alias("nord"))
    rows = placements.groupBy("key").agg(F.max_by(F.struct("width_pt", "height_pt", "ord"), best).alias("p"))
    return rows.select("key", "p.ord", "p.width_pt", "p.height_pt")


def mask_targets(images: DataFrame, references: DataFrame) -> DataFrame:
    """images with is_mask_target: some other image names them as its mask."""
    named = references.where("role in ('SMask', 'Mask')").select(F.col("target").alias("key")).distinct().withColumn("hit", F.lit(True))
    return images.join(named, "key", "left").withColumn("is_mask_target", F.coalesce("hit", F.lit(False))).drop("hit")


def colour_space(name: Column, components: Column) -> Column:
    """struct(colour, components) of a colour space; ICC profiles go by their number of components."""
    icc = F.when(components == 1, "gray").when(components == 3, "rgb").when(components == 4, "cmyk").otherwise("other")
    colour = F.when(name.isin("DeviceGray", "CalGray"), "gray").when(name.isin("DeviceRGB", "CalRGB"), "rgb").when(name == "DeviceCMYK", "cmyk").when(name == "ICCBased", icc).when(name == "Indexed", "indexed").otherwise("other")
    n = F.when(colour == "gray", 1).when(colour == "rgb", 3).when(colour == "cmyk", 4).when(colour == "indexed", 1).otherwise(0)
    return F.struct(colour.alias("colour"), n.alias("components"))


def sample_colours(pixels: DataFrame) -> DataFrame:
    """pixels (region, ord, r, g, b) -> background (the most frequent of 5-bit colours, the first seen of equals) and ink
    (the farthest from it that covers max(3, pixels / 400); black if nothing is farther than 0.15)."""
    five = lambda c: F.shiftright(F.col(c), 3)
    keyed = pixels.select("region", "ord", *(five(c).alias(c) for c in "rgb"))
    counts = keyed.groupBy("region", "r", "g", "b").agg(F.count("*").alias("n"), F.min("ord").alias("seen"))
    back = counts.groupBy("region").agg(F.max(F.struct("n", (-F.col("seen")).alias("s"), "r", "g", "b")).alias("k"), F.sum("n").alias("total"))
    rows = counts.join(back, "region")
    d = F.sqrt(sum((F.pow((F.col(c) - F.col(f"k.{c}")) / 31, 2) for c in "rgb"), F.lit(0.0)))
    usable = (F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("total") / 400))) & (d > 0)
    inks = rows.groupBy("region").agg(F.first("k").alias("k"), F.max(F.when(usable, F.struct(d.alias("d"), (-F.col("seen")).alias("s"), "r", "g", "b"))).alias("ink"))
    found = F.coalesce(F.col("ink.d") > 0.15, F.lit(False))
    return inks.select("region", *((F.col(f"k.{c}") / 31).alias(f"back_{c}") for c in "rgb"), *(F.when(found, F.col(f"ink.{c}") / 31).otherwise(0.0).alias(f"ink_{c}") for c in "rgb"), found.alias("found"))
