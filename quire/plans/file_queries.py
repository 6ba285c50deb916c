"""Queries of files, names, errors, metadata and jobs with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import files as fx
from quire.functions import text as tx
from quire.operators import files as O
from quire.plans import models as M

#: The heads of files by page_id % 4 (pdf, jpeg, png, pdf after another byte).
HEADS = ["255044462D312E37", "FFD8FFE0", "89504E470D0A1A0A", "0025504446"]


def _bytes(spark: SparkSession, sf: str) -> DataFrame:
    head = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (F.col("page_id") % 4 + 1).cast("int")))
    return M.read(spark, sf, "pages").select("page_id", F.concat(head, F.encode("html", "UTF-8")).alias("content"))


_KIND = "case page_id % 4 when 0 then 'pdf' when 1 then 'jpeg' when 2 then 'png' else 'pdf' end"


def sniff_kind(spark: SparkSession, sf: str) -> DataFrame:
    k = fx.kind(F.col("content"))
    return _bytes(spark, sf).select("page_id", k.alias("kind"), fx.mime(k).alias("mime"))


def _picked(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    return d.select(F.expr("doc_id div 30").alias("session_id"), F.col("doc_id").alias("ord"), F.concat("source", F.lit(".pdf")).alias("name"), (F.expr("n_chars div 500") * 7_000_000).alias("size"))


def file_admission(spark: SparkSession, sf: str) -> DataFrame:
    rows = _picked(spark, sf)
    return O.admit(rows.where("ord % 30 >= 3"), rows.where("ord % 30 < 3 and session_id % 2 = 0"))


def open_sources_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents").select(F.expr("doc_id div 4").alias("job_id"), F.col("doc_id").alias("file_id"), F.expr("n_chars div 300 % 900").alias("page_count"))
    return O.open_gate(d, 3)


def text_layer_probe(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "conversations")
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(" \t "), F.when(F.col("turn") >= 3, F.col("text")).otherwise(""))).otherwise(F.col("text"))
    return O.text_layer(c.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), text.alias("text")))


def zip_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    name = F.element_at(F.array(F.concat("source", F.lit(".v1.pdf")), F.lit("noext"), F.lit(".hidden")), (F.col("doc_id") % 3 + 1).cast("int"))
    return O.unique_names(d.select(F.expr("doc_id div 100").alias("job_id"), F.col("doc_id").alias("ord"), name.alias("name")))


def _directions(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of two files; some whose kinds are alike, some mixed."""
    rows = _bytes(spark, sf).select(F.expr("page_id % 97").alias("job_id"), fx.kind(F.col("content")).alias("kind"))
    kinds = rows.groupBy("job_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return kinds.select("job_id", fx.direction(F.col("kinds")).alias("direction"))


def convert_direction(spark: SparkSession, sf: str) -> DataFrame:
    return _directions(spark, sf)


def convert_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _directions(spark, sf).withColumn("wanted", F.element_at(F.array(*map(F.lit, ("jpg", "pdf", "txt"))), (F.col("job_id") % 3 + 1).cast("int")))
    t = fx.targets(F.col("direction"))
    return rows.select("job_id", F.array_join(t, ",").alias("targets"), F.when(~F.array_contains(t, F.col("wanted")), "E_UNSUPPORTED_CONVERSION").alias("error"))


def raster_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.read(spark, sf, "part").select((F.col("p_partkey") % 40).alias("file_id"), F.expr("p_partkey div 40").alias("page_index"), (F.col("p_size") * 13.5).alias("width"), (F.col("p_size") * 9.25 + 1).alias("height"))
    return O.raster_plan(rows, 150, "png", 49)


def image_page_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.read(spark, sf, "part")
    w, h = (F.col("p_size") * 37 + 1).cast("double"), (F.col("p_partkey") % 90 * 11 + 5).cast("double")
    out = None
    for size in ("fit-image", "a4", "letter"):
        one = rows.select("p_partkey", F.lit(size).alias("size"), O.image_page(w, h, size, 10).alias("g")).select("p_partkey", "size", "g.*")
        out = one if out is None else out.unionByName(one)
    return out


def tools_accepting(spark: SparkSession, sf: str) -> DataFrame:
    kinds = _bytes(spark, sf).select(F.expr("page_id % 97").alias("job_id"), fx.mime(fx.kind(F.col("content"))).alias("mime")).groupBy("job_id").agg(F.collect_set("mime").alias("mimes"))
    return kinds.select("job_id", F.array_join(O.tools_accepting(F.col("mimes")), ",").alias("tools"), F.array_join(F.slice(F.filter(O.tools_accepting(F.col("mimes")), lambda t: t != "edit"), 1, 3), ",").alias("next_tools"))


def tool_gate(spark: SparkSession, sf: str) -> DataFrame:
    tools = spark.createDataFrame([t[:3] for t in fx.TOOLS], "tool string, least int, most int")
    n = spark.range(0, 24).select(F.col("id").cast("int").alias("n_files"))
    return n.join(F.broadcast(tools)).select("tool", "n_files", fx.blocked(F.col("n_files"), F.col("least"), F.col("most")).alias("reason"))  # 24 counts times the list of tools


def predict_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.read(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice").cast("long") * 37).alias("size"), (F.col("o_orderkey") % 50).alias("pages"))
    taken = F.expr("pages div 2")
    size = O.predicted_bytes(F.col("size"), F.col("pages"), taken)
    return rows.select("o_orderkey", size.alias("bytes"), tx.predicted_size(size).alias("label"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    tail = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF ", "", ".tar.gz", ".pdf.pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    middle = F.element_at(F.array(*map(F.lit, (" a/b", ": c  d", "*?", ".x", "\t e|<f>"))), (F.expr("doc_id div 5 % 5") + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("  "), "source", middle, tail).alias("name"))


_NAMES = """names as (select doc_id, '  ' || source || list_extract([' a/b', ': c  d', '*?', '.x', chr(9) || chr(160) || 'e|<f>'], (doc_id // 5 % 5 + 1)::int) || list_extract(['.pdf', '.PDF ', '', '.tar.gz', '.pdf.pdf'], (doc_id % 5 + 1)::int) as name from documents)"""
_WS = "[\\s ]+"


def name_stem(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("doc_id", tx.stem(F.col("name")).alias("stem"))


def name_as_pdf(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 7 == 0, F.lit(" .pdf")).otherwise(F.col("name"))
    return _names(spark, sf).select("doc_id", tx.as_pdf_name(n).alias("pdf_name"), tx.edited_name(n).alias("edited_name"))


def name_sanitise(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("doc_id", tx.sanitise(F.concat("name", F.lit(" "), F.repeat(F.lit("long "), 60))).alias("long_name"), tx.sanitise(F.col("name")).alias("safe_name"))


def name_fill_pattern(spark: SparkSession, sf: str) -> DataFrame:
    n, total = (F.col("doc_id") + 1).cast("int"), F.when(F.col("doc_id") % 2 == 0, 1000).otherwise(12)
    return _names(spark, sf).select("doc_id", tx.fill_pattern(F.lit("<name>-<nn>_<n>-<nn>"), F.col("name"), n, total).alias("filled"))


def name_suffix(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("doc_id") % 7 == 0, F.lit(".hidden")).otherwise(F.col("name"))
    return _names(spark, sf).select("doc_id", tx.suffix_name(n, F.lit("-merged")).alias("suffixed"))


def format_bytes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.pow(F.lit(1.9), F.col("p_partkey") % 40).cast("long") + F.col("p_partkey")
    return M.read(spark, sf, "part").select("p_partkey", n.alias("bytes"), tx.format_bytes(n).alias("label"))


def template_fill(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "customer")
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("n"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", tx.fill_template(F.lit("{name} of {n}: {missing}, {n}"), values).alias("filled"))


def metadata_carry(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "customer")
    title = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_name"))
    keep, dated = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 4 == 0
    now = F.lit("2024-01-01 00:00:00")
    created = F.when(F.col("c_custkey") % 8 == 0, F.lit("2019-05-17 09:30:00"))
    return c.select("c_custkey", fx.carry(title, keep).alias("title"), F.lit("quire").alias("producer"), F.coalesce(F.when(keep & dated, created), now).alias("created"), now.alias("modified"))


def metadata_strip(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.array(*map(F.lit, ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")))
    info = F.create_map(F.lit("Title"), F.col("c_name"), F.lit("Author"), F.col("c_mktsegment"), F.lit("Custom"), F.col("c_nationkey").cast("string"), F.lit("Trapped"), F.lit("False"))
    kept = F.map_filter(info, lambda k, v: ~F.array_contains(gone, k))
    return M.read(spark, sf, "customer").select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("info"))


#: What hosts and libraries throw.
THROWN = [
    ("AbortError", "stopped"), ("DataCloneError", "value could not be cloned"), ("Error", "Failed to parse PDF document: no xref table found"),
    ("Error", "Input document to load is encrypted"), ("RangeError", "Array buffer allocation failed"), ("Error", "Out Of Memory"),
    ("TypeError", "x is not a function"), ("PasswordException", "No password given"), ("Error", "Unexpected token at 12"), ("Error", "malformed"),
]


def error_classify(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k: F.element_at(F.array(*(F.lit(t[k]) for t in THROWN)), (F.col("event_id") % len(THROWN) + 1).cast("int"))
    return M.read(spark, sf, "events").select("event_id", fx.classify_error(pick(0), F.concat(pick(1), F.lit(" "), "event_type")).alias("code"))


def encryption_support(spark: SparkSession, sf: str) -> DataFrame:
    p = M.read(spark, sf, "part")
    v, r = (F.col("p_partkey") % 7).cast("int"), F.expr("cast(p_partkey div 7 % 9 as int)")
    handler = F.when(F.col("p_partkey") % 11 == 0, "Own").otherwise("Standard")
    streams, strings = F.when(F.col("p_partkey") % 5 != 0, "aes"), F.when(F.col("p_partkey") % 13 != 0, "identity")
    return p.select("p_partkey", fx.encryption_support(handler, v, r, streams, strings).alias("unsupported"), fx.key_bytes(v, (F.col("p_size") * 8).cast("int")).alias("key_bytes"))


def unlock_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    s = fx.unlock_status(k % 3 != 0, F.when(k % 5 == 0, "/V 3"), k % 7 == 0, k % 2 == 0, k % 4)
    return M.read(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.error", "s.warning")


def job_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = M.read(spark, sf, "orders")
    state = F.element_at(F.array(*map(F.lit, ("done", "failed", "cancelled", "running"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return O.job_rollup(o.select(F.col("o_orderpriority").alias("operation"), state.alias("state"), F.col("o_orderkey").alias("started_ms"), (F.col("o_orderkey") + F.col("o_custkey")).alias("finished_ms"), (F.col("o_custkey") % 3).alias("outputs")))


def progress_span(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "conversations")
    total = F.count("*").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", fx.progress(F.col("turn") + 1, total, 15, 88).cast("long").alias("percent"))


QUERIES = {
    f.__name__: f
    for f in (sniff_kind, file_admission, open_sources_gate, text_layer_probe, zip_unique_names, convert_direction, convert_targets, raster_plan, image_page_fit, tools_accepting, tool_gate, predict_outputs, name_stem, name_as_pdf, name_sanitise, name_fill_pattern, name_suffix, format_bytes, template_fill, metadata_carry, metadata_strip, error_classify, encryption_support, unlock_status, job_rollup, progress_span)
}

_DIRECTION = f"""kinds as (select page_id % 97 as job_id, list_sort(list(distinct {_KIND})) as k from pages group by 1),
dir as (select job_id, case when k = ['pdf'] then 'pdf-in' when not list_contains(k, 'pdf') then 'pdf-out' end as direction from kinds)"""
_MB = "printf('%.1f', round({n} / 1024.0 / 1024.0, 1)) || ' MB'"
_TOOL_ROWS = ", ".join(f"('{t}', {a}, {b})" for t, a, b, _ in fx.TOOLS)

ORACLE = {
    "sniff_kind": f"select page_id, {_KIND} as kind, case page_id % 4 when 1 then 'image/jpeg' when 2 then 'image/png' else 'application/pdf' end as mime from pages",
    "file_admission": """
        with d as (select doc_id // 30 as s, doc_id as ord, source || '.pdf' as name, n_chars // 500 * 7000000 as size from documents),
        had as (select * from d where ord % 30 < 3 and s % 2 = 0), h as (select s, count(*) as n, sum(size) as b from had group by 1),
        p as (select d.*, coalesce(h.n, 0) as n, coalesce(h.b, 0) as b, row_number() over (partition by d.s order by ord) as r from d left join h on h.s = d.s where ord % 30 >= 3),
        taken as (select *, row_number() over (partition by s, name, size order by ord) as c, exists (select 1 from had where had.s = p.s and had.name = p.name and had.size = p.size) as known from p where r <= 20 - n),
        fresh as (select * from taken where c = 1 and not known), t as (select s, sum(size) as fresh_bytes, min(ord) as first_ord from fresh group by 1)
        select p.s as session_id, p.ord, p.name, p.size,
            case when p.r > 20 - p.n then 'over_limit' when f.ord is null then 'duplicate' when p.b + fresh_bytes > 262144000 and not (p.n = 0 and p.ord = first_ord) then 'refused' else 'admitted' end as status,
            case when p.b + coalesce(fresh_bytes, 0) > 262144000 then 'E_OUT_OF_MEMORY' when p.b + coalesce(fresh_bytes, 0) > 104857600 then 'W_MEMORY_HIGH' end as notice
        from p left join fresh f on f.s = p.s and f.ord = p.ord left join t on t.s = p.s""",
    "open_sources_gate": """
        with f as (select doc_id // 4 as job_id, n_chars // 300 % 900 as n from documents)
        select job_id, count(*) filter (n > 0) as sources, sum(n)::bigint as pages, count(*) filter (n <= 0) as skipped,
            case when count(*) filter (n > 0) < 3 then 'E_TOO_FEW_FILES' when sum(n) > 2000 then 'E_TOO_MANY_PAGES' end as error from f group by 1""",
    "text_layer_probe": "select conv_id as file_id, bool_or(turn < 3 and conv_id % 3 <> 0 and regexp_matches(text, '[^\\s]')) as has_text from conversations group by 1",
    "zip_unique_names": """
        with e as (select doc_id // 100 as job_id, doc_id as ord, case doc_id % 3 when 0 then source || '.v1.pdf' when 1 then 'noext' else '.hidden' end as name from documents),
        n as (select *, row_number() over (partition by job_id, name order by ord) - 1 as k from e)
        select job_id, ord, name, case when k = 0 then name when name like '%.pdf' then left(name, len(name) - 4) || ' (' || k || ').pdf' else name || ' (' || k || ')' end as unique_name from n""",
    "convert_direction": f"with {_DIRECTION} select job_id, direction from dir",
    "convert_targets": f"""
        with {_DIRECTION}, t as (select job_id, case direction when 'pdf-in' then 'jpg,png,txt' when 'pdf-out' then 'pdf' else '' end as targets, case job_id % 3 when 0 then 'jpg' when 1 then 'pdf' else 'txt' end as wanted from dir)
        select job_id, targets, case when not list_contains(string_split(targets, ','), wanted) then 'E_UNSUPPORTED_CONVERSION' end as error from t""",
    "raster_plan": """
        with p as (select p_partkey % 40 as file_id, p_partkey // 40 as page_index, p_size * 13.5::double as w, p_size * 9.25::double + 1 as h from part)
        select file_id, page_index, ceil(w * (150::double / 72))::bigint as pixel_w, ceil(h * (150::double / 72))::bigint as pixel_h, count(*) over (partition by file_id) as outputs,
            case when count(*) over (partition by file_id) > 49 then 'W_MANY_OUTPUTS' end as many, 'W_PNG_LARGER' as larger from p""",
    "image_page_fit": """
        with i as (select p_partkey, (p_size * 37 + 1)::double as iw, (p_partkey % 90 * 11 + 5)::double as ih, 10::double * 72 / 25.4::double as m from part),
        s(size, pw, ph) as (values ('a4', 595.28::double, 841.89::double), ('letter', 612::double, 792::double)),
        z as (select *, least((pw - m * 2) / iw, (ph - m * 2) / ih) as k from i, s)
        select p_partkey, size, pw as page_w, ph as page_h, (pw - iw * k) / 2 as x, (ph - ih * k) / 2 as y, iw * k as w, ih * k as h from z
        union all select p_partkey, 'fit-image', iw + m * 2, ih + m * 2, m, m, iw, ih from i""",
    "tools_accepting": f"""
        with k as (select page_id % 97 as job_id, bool_and({_KIND} = 'pdf') as pdfs from pages group by 1)
        select job_id, case when pdfs then 'merge,split,compress,convert,edit,organize,unlock' else 'convert' end as tools, case when pdfs then 'merge,split,compress' else 'convert' end as next_tools from k""",
    "tool_gate": f"""
        with t(tool, least_n, most_n) as (values {_TOOL_ROWS}), n as (select unnest(range(0, 24))::int as n_files)
        select tool, n_files, case when n_files = 0 then 'No files chosen yet' when n_files < least_n then 'This tool needs at least ' || least_n || ' files'
            when n_files > most_n then case when most_n = 1 then 'This tool takes a single file' else 'Takes at most ' || most_n || ' files' end end as reason from t, n""",
    "predict_outputs": f"""
        with o as (select o_orderkey, trunc(o_totalprice)::bigint * 37 as size, o_orderkey % 50 as pages from orders),
        b as (select o_orderkey, case when pages = 0 then 0 else floor(size / pages * (pages // 2) + 0.5) end::bigint as bytes from o)
        select o_orderkey, bytes, case when bytes < 1048576 then greatest(1, floor(bytes / 1024 + 0.5))::bigint || ' KB' else {_MB.format(n="bytes")} end as label from b""",
    "name_stem": f"with {_NAMES} select doc_id, regexp_replace(name, '\\.[^./\\\\]+$', '') as stem from names",
    "name_as_pdf": f"""
        with {_NAMES}, n as (select doc_id, case when doc_id % 7 = 0 then ' .pdf' else name end as name from names),
        t as (select doc_id, name, regexp_replace(regexp_replace(name, '^{_WS}', ''), '{_WS}$', '') as trimmed from n), b as (select *, regexp_replace(trimmed, '\\.pdf$', '', 'i') as base from t)
        select doc_id, case when base = '' then 'document' else base end || '.pdf' as pdf_name,
            case when regexp_matches(name, '\\.pdf$', 'i') then regexp_replace(name, '\\.pdf$', '-edited.pdf', 'i') else name || '-edited.pdf' end as edited_name from b""",
    "name_sanitise": f"""
        with {_NAMES}, n as (select doc_id, name, name || ' ' || repeat('long ', 60) as long from names),
        c as (select doc_id, regexp_replace(regexp_replace(name, '[/\\\\?%*:|"<>]', '-', 'g'), '{_WS}', ' ', 'g') as a, regexp_replace(regexp_replace(long, '[/\\\\?%*:|"<>]', '-', 'g'), '{_WS}', ' ', 'g') as b from n)
        select doc_id, left(trim(b), 180) as long_name, left(trim(a), 180) as safe_name from c""",
    "name_fill_pattern": f"""
        with {_NAMES}, n as (select doc_id, name, (doc_id + 1)::varchar as n, case when doc_id % 2 = 0 then 4 else 2 end as w from names)
        select doc_id, name || '-' || lpad(n, greatest(len(n), w)::int, '0') || '_' || n || '-' || lpad(n, greatest(len(n), w)::int, '0') as filled from n""",
    "name_suffix": f"""
        with {_NAMES}, n as (select doc_id, case when doc_id % 7 = 0 then '.hidden' else name end as name from names)
        select doc_id, case when regexp_matches(name, '^(?s:.+)\\.[^.]*$') then regexp_replace(name, '\\.([^.]*)$', '-merged.\\1') else name || '-merged' end as suffixed from n""",
    "format_bytes": f"""
        with b as (select p_partkey, trunc(pow(1.9::double, p_partkey % 40))::bigint + p_partkey as bytes from part)
        select p_partkey, bytes, case when bytes < 1024 then bytes || ' B' when bytes < 1048576 then floor(bytes / 1024 + 0.5)::bigint || ' KB' else {_MB.format(n="bytes")} end as label from b""",
    "template_fill": "select c_custkey, c_name || ' of ' || c_nationkey || ': {missing}, ' || c_nationkey as filled from customer",
    "metadata_carry": """
        select c_custkey, case when c_custkey % 2 = 0 and c_custkey % 3 <> 0 and c_custkey % 5 <> 0 then c_name end as title, 'quire' as producer,
            case when c_custkey % 8 = 0 then '2019-05-17 09:30:00' else '2024-01-01 00:00:00' end as created, '2024-01-01 00:00:00' as modified from customer""",
    "metadata_strip": "select c_custkey, 'Custom=' || c_nationkey || ';Trapped=False' as info from customer",
    "error_classify": """
        select event_id, list_extract(['E_CANCELLED', 'E_INTERNAL', 'E_CORRUPT', 'E_ENCRYPTED', 'E_OUT_OF_MEMORY', 'E_OUT_OF_MEMORY', 'E_INTERNAL', 'E_ENCRYPTED', 'E_CORRUPT', 'E_CORRUPT'], (event_id % 10 + 1)::int) as code from events""",
    "encryption_support": """
        with p as (select p_partkey, p_partkey % 7 as v, p_partkey // 7 % 9 as r, p_size * 8 as bits from part)
        select p_partkey, case when p_partkey % 11 = 0 then 'security handler /Own' when v not in (1, 2, 4, 5) then '/V ' || v when r < 2 or r > 6 then '/R ' || r
            when v in (4, 5) and (p_partkey % 5 = 0 or p_partkey % 13 = 0) then 'an unrecognised crypt filter' end as unsupported,
            case when v = 1 then 5 when v = 5 then 32 else greatest(5, least(16, bits // 8)) end::int as key_bytes from p""",
    "unlock_status": """
        select p_partkey, case when p_partkey % 3 = 0 then null when p_partkey % 5 = 0 or p_partkey % 7 = 0 then 'E_UNSUPPORTED_ENCRYPTION' when p_partkey % 2 <> 0 then 'E_WRONG_PASSWORD' end as error,
            case when p_partkey % 3 = 0 then 'W_NOTHING_CHANGED' when p_partkey % 5 <> 0 and p_partkey % 7 <> 0 and p_partkey % 4 = 2 then 'W_PARTIAL_DECRYPT' end as warning from part""",
    "job_rollup": """
        select o_orderpriority as operation, count(*) as jobs, count(*) filter (o_custkey % 4 = 0) as done, count(*) filter (o_custkey % 4 = 1) as failed, count(*) filter (o_custkey % 4 = 2) as cancelled,
            count(*) filter (o_custkey % 4 = 3) as running, sum(o_custkey) filter (o_custkey % 4 = 0)::bigint as total_ms, max(o_custkey) filter (o_custkey % 4 = 0) as longest_ms, sum(o_custkey % 3)::bigint as outputs from orders group by 1""",
    "progress_span": "select conv_id, turn, (15 + floor((turn + 1) / count(*) over (partition by conv_id) * 73 + 0.5))::bigint as percent from conversations",
}
