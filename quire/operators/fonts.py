"""Fonts and glyph runs: widths, encodings, matching and fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import utf16_text
from quire.pdf.names import ENCODINGS, GLYPHS


def width_of(texts: DataFrame, glyphs: DataFrame) -> DataFrame:
    """texts (id, text, size) x fonts of glyphs (font, char, code, width) -> (id, font, width): null if a character is missing.

    Characters meet glyphs by an equi-join; the names of the fonts (a few, as on a page) are one array of a scalar
    subquery, so there are never more rows than the result has or the characters find.
    """
    chars = texts.select("id", "size", F.explode(F.split("text", "")).alias("char")).where("char <> ''")
    need = chars.groupBy("id", "size", "char").agg(F.count("*").alias("n"))
    found = need.join(glyphs.where("code is not null"), "char", "left")
    each = found.groupBy("id", "font").agg(F.first("size").alias("size"), F.count("*").alias("kinds"), (F.sum(F.col("width") * F.col("n")) / 1000).alias("width"))
    kinds = need.groupBy("id").agg(F.count("*").alias("all"))
    each = each.where("font is not null").join(kinds, "id", "right")
    full = F.when(F.col("kinds") == F.col("all"), F.struct("font", (F.col("width") * F.col("size")).alias("width")))
    fonts = glyphs.agg(F.sort_array(F.collect_set("font"))).scalar()
    rows = each.groupBy("id").agg(F.map_from_entries(F.array_compact(F.collect_list(full))).alias("known"))
    rows = rows.select("id", "known", F.explode(fonts).alias("font"))
    return rows.select("id", "font", F.try_element_at("known", F.col("font")).alias("width"))


def match_by_width(samples: DataFrame, widths: DataFrame, encodable: DataFrame) -> DataFrame:
    """samples (id, sample_width), widths and encodable (id, font, width) -> the font nearest in width; the first of equals."""
    can = encodable.where("width is not null").select("id", "font")
    rows = widths.where("width is not null").join(can, ["id", "font"]).join(samples, "id")
    error = F.abs(F.col("width") - F.col("sample_width"))
    best = rows.groupBy("id").agg(F.min(F.struct(error.alias("error"), F.col("font"))).alias("b"))
    return best.select("id", "b.font", "b.error")


def fit_scale(natural: Column, room: Column) -> Column:
    """How much text shrinks to fit its room (null: no limit)."""
    return F.when((natural > room) & (natural > 0), room / natural).otherwise(F.lit(1.0))


def room(width: Column, gap: Column, font_size: Column, text_size: Column) -> Column:
    """Room in text space; null without a neighbour."""
    return F.when(gap.isNotNull() & (font_size > 0) & (text_size > 0), F.greatest(width, width + gap - font_size * 0.15) * text_size / font_size)


def locate(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (id, page, x, y, font_size, ordinal), found (page, ord, fx, fy) -> (id, ord, candidates): the nearest run within the tolerance, else the ordinal-th (or last) of the page.

    A run within the tolerance lies in a square that is at least as wide as that, or in one beside it. So each wanted run
    meets one list: the places in the nine squares around it, of several runs at one place the first.
    """
    tolerance = F.greatest(F.lit(2.0), F.col("font_size") * 0.6)
    # squares of 2^level; the sum rounds up what is a power of two but for the logarithm's error
    level = F.when(F.isnan(tolerance), 1024).otherwise(F.least(F.ceil(F.log2(tolerance) + 1e-9), F.lit(1024))).cast("int")
    square = lambda v: F.floor(F.least(F.greatest(F.col(v) / F.pow(F.lit(2.0), F.col("level")), F.lit(-(2.0**52))), F.lit(2.0**52)))
    beside = F.array(*map(F.lit, (-1, 0, 1)))
    levels = wanted.agg(F.sort_array(F.collect_set(level))).scalar()
    places = found.where("fx is not null and fy is not null").groupBy("page", "fx", "fy").agg(F.min("ord").alias("ord"))
    around = places.select("page", F.struct("fx", "fy", "ord").alias("run"), "fx", "fy", F.explode(levels).alias("level"))
    around = around.select("page", "run", "level", square("fx").alias("cx"), square("fy").alias("cy"), F.explode(beside).alias("dx"))
    around = around.select("page", "run", "level", (F.col("cx") + F.col("dx")).alias("cx"), "cy", F.explode(beside).alias("dy"))
    # no broadcast: the planner does not see how much the squares add
    lists = around.groupBy("page", "level", "cx", (F.col("cy") + F.col("dy")).alias("cy")).agg(F.collect_list("run").alias("runs")).hint("merge")

    ranked = found.select("page", F.col("ord").alias("nth"), (F.row_number().over(Window.partitionBy("page").orderBy("ord")) - 1).cast("long").alias("place"))
    rows = wanted.select("id", "page", "x", "y", "ordinal", tolerance.alias("tolerance"), level.alias("level"))
    rows = rows.join(found.groupBy("page").agg(F.count("*").alias("candidates")), "page")
    rows = rows.withColumn("cx", square("x")).withColumn("cy", square("y")).join(lists, ["page", "level", "cx", "cy"], "left")
    far = lambda r: F.sqrt(F.pow(r["fx"] - F.col("x"), 2) + F.pow(r["fy"] - F.col("y"), 2))
    near = F.array_min(F.transform("runs", lambda r: F.struct(far(r).alias("far"), r["ord"].alias("ord"))))
    place = F.least(F.col("ordinal"), F.col("candidates") - 1).cast("long")
    rows = rows.select("id", "page", "tolerance", "candidates", near.alias("near"), place.alias("place")).join(ranked, ["page", "place"], "left")
    return rows.select("id", F.when(F.col("near.far") <= F.col("tolerance"), F.col("near.ord")).otherwise(F.col("nth")).alias("ord"), "candidates")


def push_shift(runs: DataFrame, glyphs: DataFrame) -> DataFrame:
    """runs (page, from_x, y, font_size, token), glyphs (page, x, y, token, op) -> what moves when a run grows."""
    rows = runs.join(glyphs.select("page", F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("token").alias("gt"), "op"), "page", "left")
    after = (F.abs(F.col("gy") - F.col("y")) <= F.greatest(F.lit(1.0), F.col("font_size") * 0.35)) & (F.col("gx") >= F.col("from_x") - 0.01)
    own = after & (F.col("gt") == F.col("token"))
    placed = after & (F.col("gt") != F.col("token")) & (F.col("op") == "Tm")
    return rows.groupBy("page").agg(F.count_if(after).alias("after"), F.count_if(own).alias("trailing"), F.count_distinct(F.when(placed, F.col("gt"))).alias("moved_tokens"))


def edit_method(matched: Column, located: Column, spelt: Column, uniform: Column, whole: Column) -> Column:
    """native, erase or overlay: the first that the run allows."""
    native = matched & located & spelt & uniform
    return F.when(native, "native").when(located & whole, "erase").otherwise("overlay")


def hex_codes(codes: Column, bytes_per_code: int) -> Column:
    return F.concat(F.lit("<"), F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c), 2 * bytes_per_code, "0")), ""), F.lit(">"))


def _number(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("long")


def expand_tounicode(maps: DataFrame) -> DataFrame:
    """maps (font, cmap) -> (font, code, char): single, ranged and listed mappings of a ToUnicode program, the first of a character wins.

    A target is UTF-16 text of any length; in a range only its last unit counts up.
    """
    h = "<([0-9A-Fa-f]+)>"
    entries = lambda name, entry: F.flatten(F.transform(F.regexp_extract_all("cmap", F.lit(rf"(?s)begin{name}(.*?)end{name}"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(entry), F.lit(0))))
    pair, span = rf"{h}\s*{h}", rf"{h}\s*{h}\s*(?:{h}|\[([^\]]*)\])"
    part = lambda entry, k: F.regexp_extract("m", entry, k)
    single = maps.select("font", F.posexplode(entries("bfchar", pair)).alias("ord", "m"))
    single = single.select("font", F.lit(0).alias("kind"), "ord", F.lit(0).cast("long").alias("step"), _number(part(pair, 1)).alias("code"), part(pair, 2).alias("to"))
    low, high, base = _number(part(span, 1)), _number(part(span, 2)), part(span, 3)
    unit = lambda step: F.lpad(F.hex(_number(F.right(base, F.lit(4))) + step), 4, "0")
    head = F.left(base, F.greatest(F.length(base) - 4, F.lit(0)))
    counted = F.transform(F.sequence(F.lit(0).cast("long"), high - low), lambda step: F.concat(head, unit(step)))
    listed = F.regexp_extract_all(part(span, 4), F.lit(h), F.lit(1))
    ranged = maps.select("font", F.posexplode(entries("bfrange", span)).alias("ord", "m")).where((high >= low) & (high - low <= 0xFFFF))
    ranged = ranged.select("font", F.lit(1).alias("kind"), "ord", low.alias("low"), F.posexplode(F.when(base != "", counted).otherwise(listed)).alias("step", "to"))
    ranged = ranged.select("font", "kind", "ord", F.col("step").cast("long").alias("step"), (F.col("low") + F.col("step")).alias("code"), "to")
    rows = single.unionByName(ranged).select("font", "code", utf16_text(F.col("to")).alias("char"), F.struct("kind", "ord", "step").alias("at"))
    return rows.where("char <> ''").groupBy("font", "char").agg(F.min_by("code", "at").alias("code"))


def expand_widths(fonts: DataFrame) -> DataFrame:
    """fonts (font, w) -> (font, code, width) of `c [w ...]` and `first last w` entries; later entries win."""
    entry = r"(\d+)\s*\[([^\]]*)\]|(\d+)\s+(\d+)\s+(-?[\d.]+)"
    rows = fonts.select("font", F.posexplode(F.regexp_extract_all("w", F.lit(entry), 0)).alias("ord", "e"))
    part = lambda k: F.regexp_extract("e", entry, k)
    listed = rows.where(part(1) != "").select("font", "ord", part(1).cast("long").alias("c"), F.posexplode(F.filter(F.split(part(2), r"\s+"), lambda x: x != "")).alias("k", "v"))
    listed = listed.select("font", "ord", (F.col("c") + F.col("k")).alias("code"), F.col("v").cast("double").alias("width"))
    ranged = rows.where(part(3) != "").select("font", "ord", F.explode(F.sequence(part(3).cast("long"), part(4).cast("long"))).alias("code"), part(5).cast("double").alias("width"))
    return listed.unionByName(ranged).groupBy("font", "code").agg(F.max_by("width", "ord").alias("width"))


def encoding_layers(base: DataFrame, differences: DataFrame, tounicode: DataFrame) -> DataFrame:
    """Three tables (font, code, char) -> one: a later layer overrides an earlier one."""
    rows = base.withColumn("layer", F.lit(0)).unionByName(differences.withColumn("layer", F.lit(1))).unionByName(tounicode.withColumn("layer", F.lit(2)))
    return rows.groupBy("font", "code").agg(F.max_by("char", "layer").alias("char"))


def first_wins(codes: DataFrame) -> DataFrame:
    """codes (font, ord, char, code) -> the first code of each character."""
    return codes.groupBy("font", "char").agg(F.min_by("code", "ord").alias("code"))




def base_encoding(name: Column, code: Column) -> Column:
    """The character of a code in a base encoding; names that are not known read as WinAnsiEncoding."""
    tables = {k: F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) for k, v in ENCODINGS.items()}
    out = F.try_element_at(tables["WinAnsiEncoding"], code)
    for key in ("StandardEncoding", "MacRomanEncoding"):
        out = F.when(name == key, F.try_element_at(tables[key], code)).otherwise(out)
    return out


def overflow_choice(grew: Column, pushing: Column, moved: Column, collides: Column) -> Column:
    """What becomes of an edit that may not fit: keep, push, or squeeze (with a note where a push was wished but nothing could move)."""
    return F.when(~grew, "keep").when(pushing & (moved > 0), "push").when(~collides, "keep").when(pushing, "squeeze-noted").otherwise("squeeze")


def glyph_char(name: Column) -> Column:
    """The character of a glyph name: listed, one letter, uniXXXX or uXXXX to uXXXXXX; what follows a dot is ignored."""
    base = F.when(F.startswith(name, F.lit(".")), name).otherwise(F.substring_index(name, ".", 1))
    table = F.create_map(*(F.lit(x) for kv in GLYPHS.items() for x in kv))
    four, long = F.regexp_extract(base, r"\Auni([0-9A-Fa-f]{4})(?:[0-9A-Fa-f]{4})*\z", 1), F.regexp_extract(base, r"\Au([0-9A-Fa-f]{4,6})\z", 1)
    utf32 = lambda h: F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(table, base), F.when(F.length(base) == 1, base), F.when(four != "", utf32(four)), F.when(long != "", utf32(long)))
