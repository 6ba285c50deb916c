"""Queries of fonts and images with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import fonts as G
from quire.operators import images as I
from quire.plans import models as M

#: Five invented fonts over the printable ASCII characters.
_FONTS = 5


def _glyphs(spark: SparkSession) -> DataFrame:
    rows = spark.range(32, 127).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(_FONTS - 1))).alias("font"))
    return rows.where("(a + font) % 23 <> 0").select("font", F.chr("a").alias("char"), (F.col("a") + F.col("font")).alias("code"), ((F.col("a") * 7 + F.col("font") * 13) % 600 + 200).cast("double").alias("width"))


_GLYPHS = "glyphs as (select f as font, chr(a::int) as c, (a * 7 + f * 13) % 600 + 200 as w from range(32, 127) t(a), range(0, 5) u(f) where (a + f) % 23 <> 0)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    p = M.read(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type").alias("text"), (F.lit(6.0) + F.col("p_size") % 7).alias("size"))


_WIDTHS = f"""{_GLYPHS}, t as (select p_partkey as id, unnest(string_split(p_name || ' ' || p_type, '')) as c, 6.0::double + p_size % 7 as size from part),
wide as (select t.id, f.f as font, case when bool_and(g.c is not null) then sum(g.w) / 1000.0::double * any_value(size) end as width from t cross join range(0, 5) f(f) left join glyphs g on g.font = f.f and g.c = t.c where t.c <> '' group by all)"""


def font_width_of(spark: SparkSession, sf: str) -> DataFrame:
    return G.width_of(_texts(spark, sf), _glyphs(spark)).withColumn("width", F.round("width", 6))


def font_match_width(spark: SparkSession, sf: str) -> DataFrame:
    widths = G.width_of(_texts(spark, sf), _glyphs(spark))
    samples = M.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 20).alias("sample_width"))
    needs = M.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Q"), "p_brand").alias("text"), F.lit(10.0).alias("size"))
    return G.match_by_width(samples, widths, G.width_of(needs, _glyphs(spark))).withColumn("error", F.round("error", 6))


def fit_scale(spark: SparkSession, sf: str) -> DataFrame:
    li = M.read(spark, sf, "lineitem")
    gap = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 100 - 2)
    r = G.room(F.col("l_quantity"), gap, F.lit(12.0), F.lit(10.0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r.alias("room"), G.fit_scale(F.col("l_extendedprice") / 1000, r).alias("scale"))


def locate_run(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 5 * 12.0).alias("y"), (F.col("c_custkey") % 3 * 60.0 + 6).alias("font_size"), (F.col("c_custkey") % 4).alias("ordinal"))
    s = M.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("ord"), F.col("s_acctbal").alias("fx"), (F.col("s_suppkey") % 5 * 12.0).alias("fy"))
    return G.locate(c, s)


def push_shift(spark: SparkSession, sf: str) -> DataFrame:
    o = M.read(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_totalprice") / 10).alias("from_x"), (F.col("o_orderkey") % 7).cast("double").alias("y"), F.lit(8.0).alias("font_size"), (F.col("o_custkey") % 3).alias("token"))
    g = M.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.col("l_partkey") % 3).alias("token"), F.when(F.col("l_suppkey") % 2 == 0, "Tm").otherwise("Td").alias("op"))
    return G.push_shift(o, g)


def edit_method_cascade(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    m = G.edit_method(k % 2 == 0, k % 3 != 0, k % 5 != 0, k % 7 != 0, k % 11 != 0)
    return M.read(spark, sf, "part").select("p_partkey", m.alias("method"))


def hex_codes(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.transform(F.filter(F.split("p_brand", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return M.read(spark, sf, "part").select("p_partkey", G.hex_codes(codes, 2).alias("wide"), G.hex_codes(codes, 1).alias("narrow"))


def tounicode_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a font with single (a ligature and an astral target among them), ranged and listed mappings."""
    k, x4 = F.col("p_partkey"), "%04X"
    cmap = F.concat(
        F.lit("2 beginbfchar "), F.format_string(f"<{x4}> <{x4}> ", k % 256, 65 + k % 26), F.format_string(f"<{x4}> <00660069> ", 256 + k % 7), F.lit("<0300> <d83dde00> endbfchar "),
        F.lit("3 beginbfrange "), F.format_string(f"<0400> <{x4}> <{x4}> ", 1024 + k % 5, 60 + k % 20), F.format_string(f"<0500> <0502> [<{x4}> <0E01> <00660066>] ", 97 + k % 26), F.lit("<0600> <0500> <0041> "),
        F.format_string(f"<0700> <{x4}> <00410308> endbfrange ", 1792 + k % 3), F.format_string(f"1 beginbfchar <0099> <{x4}> endbfchar", 97 + k % 3),
    )
    return G.expand_tounicode(M.read(spark, sf, "part").select(k.alias("font"), cmap.alias("cmap")))


def font_widths_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a font with listed and ranged widths that overlap."""
    k = F.col("p_partkey")
    w = F.format_string("%d [%d %d.5 700] 300 %d 250 302 [%d] 301 301 999", k % 200, k % 600, k % 500, 300 + k % 6, F.col("p_size"))
    return G.expand_widths(M.read(spark, sf, "part").select(k.alias("font"), w.alias("w")))


def encoding_layers(spark: SparkSession, sf: str) -> DataFrame:
    p = M.read(spark, sf, "part").select((F.col("p_partkey") % 8).alias("font"), F.expr("p_partkey div 8").alias("code"), "p_brand", "p_type", "p_name", "p_partkey")
    return G.encoding_layers(p.select("font", "code", F.col("p_brand").alias("char")), p.where("p_partkey % 3 = 0").select("font", "code", F.col("p_type").alias("char")), p.where("p_partkey % 5 = 0").select("font", "code", F.col("p_name").alias("char")))


def cmap_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    p = M.read(spark, sf, "part").select((F.col("p_partkey") % 8).alias("font"), (-F.col("p_partkey")).alias("ord"), F.col("p_brand").alias("char"), F.col("p_partkey").alias("code"))
    return G.first_wins(p)


def glyph_name_unicode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    u = F.concat(F.lit("uni"), F.lpad(F.hex(k + 64), 4, "0"))
    name = F.element_at(F.array(F.lit("space"), F.lit("Euro.alt"), F.lit("Q"), u, F.concat(u, F.lit(".sc")), F.concat(F.lit("u1"), F.lpad(F.hex(k + 62000), 4, "0")), F.lit("nothing"), F.lit(".notdef")), (k % 8 + 1).cast("int"))
    return M.read(spark, sf, "part").select("p_partkey", name.alias("name"), G.glyph_char(name).alias("char"))


# Images: parts are images, lineitems their placements.


def _images(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    return M.read(spark, sf, "part").select(
        k.alias("key"), (k % 50).alias("file_id"), (F.col("p_size") * 40).alias("width"), (k % 97 * 20 + 10).cast("int").alias("height"), (k * 97 % 60000).alias("stored"),
        pick(("FlateDecode", "DCTDecode", "JPXDecode", "", "LZWDecode"), k).alias("filter"), pick(("rgb", "gray", "cmyk", "indexed"), F.expr("p_partkey div 5")).alias("colour"),
        F.when(k % 13 == 0, 1).otherwise(8).alias("bits"), (k % 17 == 0).alias("is_mask"), (k % 19 == 0).alias("is_mask_target"), (k % 23 == 0).alias("sample_tricks"),
    )


def _placements(spark: SparkSession, sf: str) -> DataFrame:
    li = M.read(spark, sf, "lineitem").where("l_partkey % 4 <> 0")
    ord_ = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_partkey").alias("key"), F.xxhash64(ord_).alias("o"), "l_orderkey", F.col("l_quantity").alias("width_pt"), (F.col("l_linenumber") * 10.0).alias("height_pt"))


def image_placement_max(spark: SparkSession, sf: str) -> DataFrame:
    rows = _placements(spark, sf).groupBy("key", "width_pt", "height_pt").agg(F.min("l_orderkey").alias("ord"))
    return I.largest_placement(rows)


_PLACED = """pl as (select l_partkey as key, l_quantity as w, l_linenumber * 10.0::double as h, min(l_orderkey) as ord from lineitem where l_partkey % 4 <> 0 group by all),
best as (select key, ord, w, h from pl qualify row_number() over (partition by key order by w * h desc, ord) = 1)"""


def compress_plan(spark: SparkSession, sf: str) -> DataFrame:
    return I.plan(_images(spark, sf), image_placement_max(spark, sf).select("key", "width_pt", "height_pt"))


_PLAN = f"""{_PLACED}, img as (select p_partkey as k, p_partkey % 50 as file_id, p_size * 40 as iw, p_partkey % 97 * 20 + 10 as ih, p_partkey * 97 % 60000 as stored, list_extract(['FlateDecode', 'DCTDecode', 'JPXDecode', '', 'LZWDecode'], (p_partkey % 5 + 1)::int) as f,
    list_extract(['rgb', 'gray', 'cmyk', 'indexed'], (p_partkey // 5 % 4 + 1)::int) as c from part),
z as (select img.*, w, h, least(1.0::double, w / 72 * 150 / iw, h / 72 * 150 / ih) as s from img left join best on best.key = k),
plan as (select k as key, file_id, stored, case when w > 1 then floor(iw / (w / 72) + 0.5)::bigint end as effective_dpi,
    case when w > 1 and h > 1 and s < 1 then greatest(1, floor(iw * s + 0.5)) else iw end::bigint as target_width, case when w > 1 and h > 1 and s < 1 then greatest(1, floor(ih * s + 0.5)) else ih end::bigint as target_height,
    case when k % 17 = 0 or k % 19 = 0 then 'mask' when k % 23 = 0 then 'sample-tricks' when iw * ih < 40000 or stored < 4096 then 'too-small' when f = 'DCTDecode' then case when c not in ('rgb', 'gray') then 'unsupported-colour' end
        when f = 'JPXDecode' then 'unsupported-filter' when k % 13 = 0 or c not in ('rgb', 'gray') then 'unsupported-colour' end as reason from z),
outcome as (select key, file_id, stored, coalesce(reason, case when key % 7 = 0 then 'unreadable' when key * 31 % 60000 >= stored * 0.95::double then 'no-gain' end) as reason, key * 31 % 60000 as nb from plan)"""


def compress_recode_outcome(spark: SparkSession, sf: str) -> DataFrame:
    planned = compress_plan(spark, sf)
    answers = planned.where("key % 7 <> 0").select("key", (F.col("key") * 31 % 60000).alias("new_bytes"))
    return I.recode_outcome(planned, answers)


def compress_skip_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return I.skip_histogram(compress_recode_outcome(spark, sf))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    rows = compress_recode_outcome(spark, sf)
    return rows.groupBy("file_id").agg(F.sum("stored").alias("original"), (F.sum("kept_bytes") + F.first("file_id") * 2000).alias("saved"))


def compress_file_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return I.file_outcome(_files(spark, sf))


def compress_savings(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return I.savings(files.join(I.file_outcome(files), "file_id").select(F.expr("file_id div 5").alias("job_id"), "original", "bytes"))


def mask_targets(spark: SparkSession, sf: str) -> DataFrame:
    images = _images(spark, sf).select("key")
    refs = M.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), F.when(F.col("l_orderkey") % 11 == 0, "SMask").when(F.col("l_orderkey") % 13 == 0, "Mask").otherwise("Image").alias("role")).where("target % 3 = 0")
    return I.mask_targets(images, refs)


def colour_space(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    names = ("DeviceGray", "CalRGB", "DeviceCMYK", "ICCBased", "Lab", "Indexed", "DeviceRGB", "CalGray")
    name = F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int"))
    return M.read(spark, sf, "part").select("p_partkey", I.colour_space(name, F.expr("p_partkey div 8 % 5")).alias("c")).select("p_partkey", "c.colour", "c.components")


def color_sample(spark: SparkSession, sf: str) -> DataFrame:
    li = M.read(spark, sf, "lineitem")
    rows = li.select((F.col("l_suppkey") % 40).alias("region"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), ((F.col("l_quantity") % 3) * 100).cast("int").alias("r"), ((F.col("l_linenumber") % 4) * 60).cast("int").alias("g"), (F.col("l_suppkey") % 40 * 6).cast("int").alias("b"))
    out = I.sample_colours(rows)
    return out.select("region", *(F.round(c, 9).alias(c) for c in out.columns if c[:4] in ("back", "ink_")), "found")


QUERIES = {
    f.__name__: f
    for f in (font_match_width, font_width_of, fit_scale, locate_run, push_shift, edit_method_cascade, hex_codes, tounicode_expand, font_widths_expand, encoding_layers, cmap_first_wins, glyph_name_unicode, compress_plan, compress_skip_histogram, compress_recode_outcome, compress_file_outcome, compress_savings, image_placement_max, mask_targets, colour_space, color_sample)
}

ORACLE = {
    "font_width_of": f"with {_WIDTHS} select id, font, round(width, 6) as width from wide",
    "font_match_width": f"""
        with {_WIDTHS}, n as (select p_partkey as id, unnest(string_split('Q' || p_brand, '')) as c from part),
        can as (select n.id, f.f as font from n cross join range(0, 5) f(f) left join glyphs g on g.font = f.f and g.c = n.c where n.c <> '' group by all having bool_and(g.c is not null)),
        e as (select wide.id, wide.font, abs(width - p_retailprice / 20) as error from wide join can on can.id = wide.id and can.font = wide.font join part on p_partkey = wide.id where width is not null)
        select id, font, round(error, 6) as error from e qualify row_number() over (partition by id order by error, font) = 1""",
    "fit_scale": """
        with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 as nat, case when l_linenumber % 3 <> 0 then greatest(l_quantity, l_quantity + (l_discount * 100 - 2) - 12.0::double * 0.15::double) * 10.0::double / 12.0::double end as room from lineitem)
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, room, case when nat > room and nat > 0 then room / nat else 1.0 end as scale from r""",
    "locate_run": """
        with p as (select c_custkey as id, s_suppkey as ord, c_custkey % 3 * 60.0::double + 6 as fs, c_custkey % 4 as o, row_number() over (partition by c_custkey order by s_suppkey) - 1 as k, count(*) over (partition by c_custkey) as n,
            sqrt((s_acctbal - c_acctbal) ** 2 + (s_suppkey % 5 * 12.0::double - c_custkey % 5 * 12.0::double) ** 2) as far from customer join supplier on s_nationkey = c_nationkey),
        a as (select id, any_value(fs) as fs, any_value(n) as n, min(far) as far, arg_min(ord, (far, ord)) as near, max(ord) filter (k = least(o, n - 1)) as nth from p group by 1)
        select id, case when far <= greatest(2.0, fs * 0.6) then near else nth end as ord, n as candidates from a""",
    "push_shift": """
        with r as (select o_orderkey as page, o_custkey % 3 as token, l_partkey % 3 as gt, l_suppkey % 2 = 0 as tm, abs(l_linenumber - o_orderkey % 7) <= 2.8 and l_extendedprice >= o_totalprice / 10 - 0.01 as aft from orders left join lineitem on l_orderkey = o_orderkey)
        select page, count(*) filter (aft) as after, count(*) filter (aft and gt = token) as trailing, count(distinct gt) filter (aft and gt <> token and tm) as moved_tokens from r group by 1""".replace("as after", 'as "after"').replace("as trailing", 'as "trailing"'),
    "edit_method_cascade": """
        select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 <> 0 and p_partkey % 5 <> 0 and p_partkey % 7 <> 0 then 'native' when p_partkey % 3 <> 0 and p_partkey % 11 <> 0 then 'erase' else 'overlay' end as method from part""",
    "hex_codes": """
        select p_partkey, '<' || array_to_string(list_transform(string_split(p_brand, ''), lambda c: '00' || upper(hex(c))), '') || '>' as wide, '<' || array_to_string(list_transform(string_split(p_brand, ''), lambda c: upper(hex(c))), '') || '>' as narrow from part""",
    "tounicode_expand": """
        with p as (select p_partkey as k from part), m as (
            select k, 1 as ord, k % 256 as code, chr((65 + k % 26)::int) as ch from p union all select k, 2, 256 + k % 7, 'fi' from p union all select k, 3, 768, chr(128512) from p
            union all select k, 4, 153, chr((97 + k % 3)::int) from p union all select k, 10 + s, 1024 + s, chr((60 + k % 20 + s)::int) from p, range(0, 5) t(s) where s <= k % 5
            union all select k, 20, 1280, chr((97 + k % 26)::int) from p union all select k, 21, 1281, chr(3585) from p union all select k, 22, 1282, 'ff' from p
            union all select k, 30 + s, 1792 + s, 'A' || chr((776 + s)::int) from p, range(0, 3) t(s) where s <= k % 3)
        select k as font, ch as "char", arg_min(code, ord)::bigint as code from m group by all""",
    "font_widths_expand": """
        with p as (select p_partkey as k, p_size from part), w as (
            select k, 1 as ord, k % 200 as code, (k % 600)::double as width from p union all select k, 1, k % 200 + 1, k % 500 + 0.5::double from p union all select k, 1, k % 200 + 2, 700 from p
            union all select k, 2, 300 + s, 250 from p, range(0, 6) t(s) where s <= k % 6 union all select k, 3, 302, p_size from p union all select k, 4, 301, 999 from p)
        select k as font, code::bigint as code, arg_max(width, ord) as width from w group by all""",
    "encoding_layers": """select p_partkey % 8 as font, p_partkey // 8 as code, case when p_partkey % 5 = 0 then p_name when p_partkey % 3 = 0 then p_type else p_brand end as "char" from part""",
    "cmap_first_wins": """select p_partkey % 8 as font, p_brand as "char", max(p_partkey) as code from part group by all""",
    "glyph_name_unicode": """
        with n as (select p_partkey, 'uni' || lpad(upper(hex(p_partkey + 64)), 4, '0') as u, 'u1' || lpad(upper(hex(p_partkey + 62000)), 4, '0') as v from part)
        select p_partkey, list_extract(['space', 'Euro.alt', 'Q', u, u || '.sc', v, 'nothing', '.notdef'], (p_partkey % 8 + 1)::int) as name,
            list_extract([' ', '€', 'Q', chr((p_partkey + 64)::int), chr((p_partkey + 64)::int), chr((65536 + p_partkey + 62000)::int), null, null], (p_partkey % 8 + 1)::int) as "char" from n""",
    "image_placement_max": f"with {_PLACED} select key, ord, w as width_pt, h as height_pt from best",
    "compress_plan": f"with {_PLAN} select key, file_id, stored, effective_dpi, target_width, target_height, case when reason is null then 'recode' else 'skip' end as action, reason from plan",
    "compress_recode_outcome": f"with {_PLAN} select key, file_id, stored, reason, case when reason is null then nb else stored end as kept_bytes from outcome",
    "compress_skip_histogram": f"with {_PLAN} select file_id, reason, count(*) as images, reason not in ('too-small', 'no-gain') as notable from outcome where reason is not null group by all",
    "compress_file_outcome": f"""
        with {_PLAN}, f as (select file_id, sum(stored)::bigint as o, (sum(case when reason is null then nb else stored end) + file_id * 2000)::bigint as s from outcome group by 1)
        select file_id, case when s >= o then o else s end as bytes, s >= o as kept_original from f""",
    "compress_savings": f"""
        with {_PLAN}, f as (select file_id, sum(stored)::bigint as o, (sum(case when reason is null then nb else stored end) + file_id * 2000)::bigint as s from outcome group by 1),
        j as (select file_id // 5 as job_id, sum(o)::bigint as original, sum(least(s, o))::bigint as bytes from f group by 1)
        select job_id, original, bytes, greatest(0.0::double, (original - bytes) / original * 100) as saved_percent, case when (original - bytes) / original * 100 < 1 then 'W_ALREADY_OPTIMIZED' end as warning from j""",
    "mask_targets": "select p_partkey as key, p_partkey % 3 = 0 and exists (select 1 from lineitem where l_partkey = p_partkey and (l_orderkey % 11 = 0 or l_orderkey % 13 = 0)) as is_mask_target from part",
    "colour_space": """
        with n as (select p_partkey, p_partkey % 8 as m, p_partkey // 8 % 5 as c from part)
        , k as (select p_partkey, case m when 0 then 'gray' when 1 then 'rgb' when 2 then 'cmyk' when 3 then case c when 1 then 'gray' when 3 then 'rgb' when 4 then 'cmyk' else 'other' end when 4 then 'other' when 5 then 'indexed' when 6 then 'rgb' else 'gray' end as colour from n)
        select p_partkey, colour, case colour when 'gray' then 1 when 'rgb' then 3 when 'cmyk' then 4 when 'indexed' then 1 else 0 end as components from k""",
    "color_sample": """
        with p as (select l_suppkey % 40 as region, l_orderkey * 10 + l_linenumber as ord, ((l_quantity % 3) * 100)::int // 8 as r, (l_linenumber % 4) * 60 // 8 as g, l_suppkey % 40 * 6 // 8 as b from lineitem),
        c as (select region, r, g, b, count(*) as n, min(ord) as seen from p group by all), k as (select * from c qualify row_number() over (partition by region order by n desc, seen) = 1), t as (select region, sum(n) as total from c group by 1),
        d as (select c.*, sqrt(((c.r - k.r) / 31.0::double) ** 2 + ((c.g - k.g) / 31.0::double) ** 2 + ((c.b - k.b) / 31.0::double) ** 2) as d from c join k on k.region = c.region join t on t.region = c.region where c.n >= greatest(3, floor(total / 400)) and not (c.r = k.r and c.g = k.g and c.b = k.b)),
        i as (select * from d qualify row_number() over (partition by region order by d desc, seen) = 1)
        select k.region, round(k.r / 31.0::double, 9) as back_r, round(k.g / 31.0::double, 9) as back_g, round(k.b / 31.0::double, 9) as back_b, round(case when d > 0.15 then i.r / 31.0::double else 0 end, 9) as ink_r,
            round(case when d > 0.15 then i.g / 31.0::double else 0 end, 9) as ink_g, round(case when d > 0.15 then i.b / 31.0::double else 0 end, 9) as ink_b, coalesce(d > 0.15, false) as found from k left join i on i.region = k.region""",
}
