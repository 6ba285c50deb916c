"""Queries of statuses, warnings, the catalogue and options, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import errors as X
from quire.functions import files as fx
from quire.operators import documents as D
from quire.operators import files as O
from quire.operators import fonts as G
from quire.operators import images as I
from quire.operators import pages as P
from quire.plans import document_queries, glyph_queries
from quire.plans import models as M

_CODES = [c for c, *_ in X.ERRORS] + [c for c, _ in X.WARNINGS] + ["E_OF_ANOTHER_VERSION"]


def error_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a code, some unknown, some missing, with what the catalogue says of it."""
    k = F.col("event_id")
    code = F.when(k % 41 != 0, F.element_at(F.array(*map(F.lit, _CODES)), (k % len(_CODES) + 1).cast("int")))
    return X.explained(M.read(spark, sf, "events").select("event_id", code.alias("code")))


def organize_status(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(F.count("*").alias("page_count"), F.count_if((F.col("turn") % 4 < F.col("conv_id") % 5)).alias("kept"))
    return P.organize_status(c.withColumn("ordered", F.col("file_id") % 3 == 0).withColumn("turned", F.col("file_id") % 2 == 0))


def rotate_all(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.map_from_entries(F.collect_list(F.struct(F.col("turn"), (F.col("turn") % 4 * 90).alias("v"))))
    c = M.read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg(turns.alias("turns"))
    quarter = F.when(F.col("file_id") % 2 == 0, 90).otherwise(-90)
    return c.select("file_id", F.explode(P.turn_all(F.col("turns"), quarter)).alias("page_index", "turn"))


def source_skips(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sources, five to a job; those of some numbers have no pages."""
    files = M.read(spark, sf, "documents").select(F.expr("doc_id div 5").alias("job_id"), F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 7 < 2, 0).otherwise(F.col("doc_id") % 900).alias("page_count"))
    return O.skip_warning(O.open_gate(files, 4)).select("job_id", "sources", "skipped", "error", "warning")


def old_file_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, F.concat("source", F.lit(".PDF"))).when(k % 3 == 1, F.concat("source", F.lit(".pdf.txt")))
    mime = F.when(k % 5 == 0, "application/pdf").when(k % 5 == 1, "text/plain")
    size = F.when(k % 7 == 0, 0).otherwise(F.col("n_chars") * 20_000)
    return M.read(spark, sf, "documents").select("doc_id", O.old_check(name, mime, size).alias("error"))


def latest_result(spark: SparkSession, sf: str) -> DataFrame:
    e = M.read(spark, sf, "events").select("user_id", F.col("event_id").alias("token"), "event_type")
    return O.latest(e, "user_id")


def option_defaults(spark: SparkSession, sf: str) -> DataFrame:
    defaults = F.create_map(*map(F.lit, ("level", "recommended", "zip", "true", "name", "out")))
    k = F.col("p_partkey")
    given = F.when(k % 5 == 0, None).when(k % 2 == 0, F.create_map(F.lit("level"), F.col("p_brand"))).otherwise(F.create_map(F.lit("name"), F.col("p_type"), F.lit("more"), F.lit("1")))
    o = M.read(spark, sf, "part").select("p_partkey", O.with_defaults(defaults, given).alias("o"))
    return o.select("p_partkey", *(F.try_element_at("o", F.lit(c)).alias(c) for c in ("level", "zip", "name", "more")))


def heartbeat_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Every event opens a spell of some seconds in which a tab is looked at."""
    k = F.col("event_id")
    spells = M.read(spark, sf, "events").select(k.alias("tab"), (k * 1000).alias("from_ms"), (k * 1000 + k % 7 * 15_000).alias("to_ms"))
    return O.heartbeats(spells)


def heartbeat_shown(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 200, 502, 503))), (k % 4 + 1).cast("int"))
    return M.read(spark, sf, "events").select("event_id", O.shown_count(status, k % 10).alias("shown"))


def described_outputs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    given = {"title": F.col("p_name"), "author": F.when(k % 3 == 0, "").otherwise(F.col("p_brand")), "subject": F.lit(None).cast("string"), "keywords": F.col("p_type"), "creator": F.lit("Writer"), "created": F.timestamp_seconds(k * 86_400)}
    info = F.named_struct(*(x for n, v in given.items() for x in (F.lit(n), v)))
    rows = M.read(spark, sf, "part").select("p_partkey", info.alias("info"), F.explode(F.array(*map(F.lit, ("keep", "merge", "none", "new")))).alias("policy"))
    told = F.coalesce(*(F.when(F.col("policy") == p, fx.described(F.col("info"), p)) for p in ("keep", "merge", "none", "new")))
    return rows.select("p_partkey", "policy", told.alias("d")).select("p_partkey", "policy", "d.title", "d.author", "d.keywords", "d.creator", "d.producer", F.date_diff(F.col("d.created").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"))


def batch_load(spark: SparkSession, sf: str) -> DataFrame:
    """Files of every kind through measuring, and then apart: those kept and those refused."""
    files = document_queries._files(spark, sf)
    k = F.col("file_id")
    spoilt = F.when(k % 6 == 1, F.lit(b"")).when(k % 6 == 2, F.encode(F.lit("%PDF-1.7 but nothing after it"), "UTF-8")).when(k % 6 == 3, F.encode(F.lit("hello"), "UTF-8")).when(k % 6 == 4, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.col("content"))
    kept, refused = D.loaded(D.measure(files.withColumn("content", spoilt)))
    row = lambda df, ok: df.select("file_id", F.lit(ok).alias("kept"), "page_count", "error")
    return row(kept, True).unionByName(row(refused, False))


def base_encodings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("WinAnsiEncoding", "StandardEncoding", "MacRomanEncoding", "Identity"))), (k % 4 + 1).cast("int"))
    code = (F.expr("p_partkey div 4") % 224 + 32).cast("int")
    return M.read(spark, sf, "part").select("p_partkey", name.alias("encoding"), code.alias("code"), G.base_encoding(name, code).alias("char"))


def overflow_choice(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return M.read(spark, sf, "orders").select("o_orderkey", G.overflow_choice(k % 2 == 0, k % 3 == 0, k % 5, k % 7 == 0).alias("choice"))


def images_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return I.skip_warning(glyph_queries.compress_skip_histogram(spark, sf))


def recode_totals(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = glyph_queries.compress_recode_outcome(spark, sf)
    files = outcomes.select("file_id").distinct().withColumn("page_count", F.col("file_id") % 9 + 1)
    return I.recode_totals(outcomes, files)


QUERIES = {
    f.__name__: f
    for f in (error_catalog, organize_status, rotate_all, source_skips, old_file_check, latest_result, option_defaults, heartbeat_beats, heartbeat_shown, described_outputs, batch_load, base_encodings, overflow_choice, images_skipped, recode_totals)
}

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_CATALOG = "(values " + ", ".join(f"({_quoted(c)}, 'error', {_quoted(m)}, {_quoted(a)})" for c, m, a in X.ERRORS) + ", " + ", ".join(f"({_quoted(c)}, 'warning', {_quoted(m)}, 'dismiss')" for c, m in X.WARNINGS) + ") c(code, severity, message, actions)"
#: Code points of 0x80 to 0x9F in the Windows encoding; 0: none.
_UPPER = [ord(bytes([b]).decode("cp1252", "ignore") or "\0") for b in range(0x80, 0xA0)]

ORACLE = {
    "error_catalog": f"""
        with e as (select event_id, case when event_id % 41 <> 0 then list_extract([{", ".join(map(_quoted, _CODES))}], (event_id % {len(_CODES)} + 1)::int) end as code from events)
        select event_id, e.code, severity, message, actions from e left join {_CATALOG} on c.code = case when e.code = 'E_OF_ANOTHER_VERSION' then 'E_INTERNAL' else e.code end""",
    "organize_status": """
        with f as (select conv_id as file_id, count(*) as n, count(*) filter (turn % 4 < conv_id % 5) as kept, conv_id % 3 = 0 as ordered, conv_id % 2 = 0 as turned from conversations group by conv_id)
        select file_id, case when kept = 0 then 'E_NO_PAGES_SELECTED' end as error, case when kept = 0 then '' when kept <> n or ordered then 'W_BOOKMARKS_DROPPED' when not turned then 'W_NOTHING_CHANGED' else '' end as warnings from f""",
    "rotate_all": "select conv_id as file_id, turn as page_index, (turn % 4 * 90 + case when conv_id % 2 = 0 then 90 else 270 end) % 360 as turn from conversations",
    "source_skips": """
        with f as (select doc_id // 5 as job_id, case when doc_id % 7 < 2 then 0 else doc_id % 900 end as n from documents), j as (select job_id, count(*) filter (n > 0) as sources, count(*) filter (n = 0) as skipped, sum(n) as pages from f group by 1),
        g as (select *, case when sources < 4 then 'E_TOO_FEW_FILES' when pages > 2000 then 'E_TOO_MANY_PAGES' end as error from j) select job_id, sources, skipped, error, case when error is null and skipped > 0 then 'W_FILE_SKIPPED' end as warning from g""",
    "old_file_check": """
        select doc_id, case when not (doc_id % 5 = 0 or doc_id % 3 = 0) then 'E_NOT_PDF' when doc_id % 7 = 0 then 'E_EMPTY_FILE' when n_chars * 20000 > 20 * 1024 * 1024 then 'E_TOO_LARGE' when n_chars = 0 then 'E_EMPTY_FILE' end as error from documents""",
    "latest_result": "select user_id, max(event_id) as token, arg_max(event_type, event_id) as event_type from events group by 1",
    "option_defaults": """
        select p_partkey, case when p_partkey % 5 <> 0 and p_partkey % 2 = 0 then p_brand else 'recommended' end as level, 'true' as zip, case when p_partkey % 5 <> 0 and p_partkey % 2 = 1 then p_type else 'out' end as name,
            case when p_partkey % 5 <> 0 and p_partkey % 2 = 1 then '1' end as more from part""",
    "heartbeat_beats": "select event_id as tab, event_id * 1000 + 20000 * b as ms from events, range(0, 6) t(b) where 20000 * b < event_id % 7 * 15000",
    "heartbeat_shown": "select event_id, case when event_id % 4 < 2 and event_id % 10 > 0 then event_id % 10 end as shown from events",
    "described_outputs": """
        select p_partkey, policy, case when policy in ('keep', 'merge') then nullif(p_name, '') end as title, case when policy in ('keep', 'merge') and p_partkey % 3 <> 0 then nullif(p_brand, '') end as author,
            case when policy in ('keep', 'merge') then nullif(p_type, '') end as keywords, case when policy in ('keep', 'merge') then 'Writer' when policy = 'new' then 'quire' end as creator, 'quire' as producer,
            case when policy = 'keep' then p_partkey end::int as day from part, (values ('keep'), ('merge'), ('none'), ('new')) t(policy)""",
    "batch_load": """
        with f as (select conv_id, count(*) as n from conversations group by 1), e as (select *, case conv_id % 6 when 1 then 'E_EMPTY_FILE' when 2 then 'E_CORRUPT' when 3 then 'E_NOT_PDF' end as error from f)
        select conv_id as file_id, error is null as kept, (case when error is not null then 0 when conv_id % 6 = 4 then 1 else n end)::int as page_count, error from e""",
    "base_encodings": f"""
        with p as (select p_partkey, p_partkey % 4 as e, (p_partkey // 4 % 224 + 32)::int as code from part), w as (select *, case when code between 128 and 159 then list_extract([{", ".join(map(str, _UPPER))}], code - 127) else code end as point from p)
        select p_partkey, list_extract(['WinAnsiEncoding', 'StandardEncoding', 'MacRomanEncoding', 'Identity'], e + 1) as encoding, code,
            case when e = 1 and code = 39 then '’' when e = 1 and code = 96 then '‘' when e = 1 and code >= 160 or e = 2 and code >= 128 or point = 0 then null else chr(point::int) end as "char" from w""",
    "overflow_choice": """
        select o_orderkey, case when o_orderkey % 2 <> 0 then 'keep' when o_orderkey % 3 = 0 and o_orderkey % 5 > 0 then 'push' when o_orderkey % 7 <> 0 then 'keep' when o_orderkey % 3 = 0 then 'squeeze-noted' else 'squeeze' end as choice from orders""",
    "images_skipped": f"""
        with {glyph_queries._PLAN} select file_id, case when bool_or(reason not in ('too-small', 'no-gain')) then 'W_IMAGES_SKIPPED' end as warning from outcome where reason is not null group by 1""",
    "recode_totals": f"""
        with {glyph_queries._PLAN} select file_id, count(*) filter (reason is null) as recoded, sum(stored - case when reason is null then nb else stored end)::bigint as saved, file_id % 9 + 1 as pages_done from outcome group by file_id""",
}
