"""Queries of text runs with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import text as T
from quire.plans import models as M

NEEDLE = "the"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of lines as runs: 6 a character; every second gap is closed; the baseline drifts inside a line."""
    line = M.lines(spark, sf).select("file_id", F.col("item_index").alias("line"), F.posexplode(F.split("text", "\\. ", -1)).alias("k", "text"))
    before = Window.partitionBy("file_id", "line").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("file_id").orderBy("line", "k")
    return line.select(
        "file_id", F.lit(1).alias("page"), (F.row_number().over(order) - 1).alias("item_index"), "text", F.when(F.col("line") % 2 == 0, "F1").otherwise("F2").alias("font"),
        (6.0 * F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) + 12.0 * F.expr("k div 2")).alias("x"), (-12.0 * F.col("line") - 2.0 * (F.col("k") % 3)).alias("y"),
        (6.0 * F.length("text")).alias("width"), F.lit(12.0).alias("font_size"), F.col("line").alias("true_line"),
    )


_ITEMS = f"""ln as ({M.LINES}),
st as (select file_id, item_index as line, i - 1 as k, list_extract(p, i) as text from (select file_id, item_index, string_split(text, '. ') as p, unnest(range(1, len(string_split(text, '. ')) + 1)) as i from ln)),
items as (select file_id, 1 as page, row_number() over (partition by file_id order by line, k) - 1 as item_index, text, case when line % 2 = 0 then 'F1' else 'F2' end as font, line, k,
    6.0::double * coalesce(sum(len(text)) over (partition by file_id, line order by k rows between unbounded preceding and 1 preceding), 0) + 12.0::double * (k // 2) as x,
    -12.0::double * line - 2.0::double * (k % 3) as y, 6.0::double * len(text) as width from st),
hits as (select i.*, o as nth, list_sum(list_transform(string_split(text, 'the')[1:o], lambda s: len(s))) + 3 * (o - 1) as hit_offset from (select *, unnest(range(1, len(string_split(text, 'the')))) as o from items) i)"""


def find_on_page(spark: SparkSession, sf: str) -> DataFrame:
    return T.find(_items(spark, sf), NEEDLE)


def match_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents").select("doc_id", F.col("lang"), T.count_matches(F.col("text"), NEEDLE).alias("n"))
    return d.groupBy("lang").agg(F.sum("n").alias("matches"), F.count_if(F.col("n") > 0).alias("files"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("doc_id")))), 1, 5), lambda x: x.cast("string")), ",").alias("first_files"))


def gap_right(spark: SparkSession, sf: str) -> DataFrame:
    return T.gap_right(_items(spark, sf), 12.0)


def collect_replacements(spark: SparkSession, sf: str) -> DataFrame:
    return T.replacements(find_on_page(spark, sf), NEEDLE, "a")


def replace_text(spark: SparkSession, sf: str) -> DataFrame:
    return M.read(spark, sf, "documents").select("doc_id", F.md5(F.encode(F.replace("text", F.lit(NEEDLE), F.lit("$1\\")), "UTF-8")).alias("digest"))


def edit_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    hits = T.count_matches(F.col("text"), "moron")
    return T.edit_outcomes(d.select(F.expr("doc_id div 3").alias("job_id"), F.col("doc_id").alias("file_id"), hits.alias("hits"), (F.col("doc_id") % 2 == 0).alias("scanned"), F.when(F.col("doc_id") % 4 == 0, hits).otherwise(0).alias("overlays")), "moron")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    method = F.element_at(F.array(*map(F.lit, ("native", "native", "erase", "native", "overlay"))), F.greatest(F.lit(1), (F.col("offset") % 8) - 2))
    return find_on_page(spark, sf).select("file_id", method.alias("method"), (F.col("offset") % 16 != 7).alias("original_removed"))


_METHOD = "list_extract(['native', 'native', 'erase', 'native', 'overlay'], greatest(1, hit_offset % 8 - 2)::int)"


def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    return T.batch_report(_reports(spark, sf))


def batch_rollup(spark: SparkSession, sf: str) -> DataFrame:
    files = M.read(spark, sf, "documents").select(F.col("doc_id").alias("file_id")).join(batch_report(spark, sf), "file_id", "left")
    state = F.when(F.col("file_id") % 17 == 0, "failed").when(F.col("hits").isNull(), "empty").otherwise("done")
    return T.batch_rollup(files.select(F.expr("file_id div 50").alias("batch_id"), state.alias("state"), F.coalesce("hits", F.lit(0)).alias("hits"), "method"))


def text_group_lines(spark: SparkSession, sf: str) -> DataFrame:
    return T.group_lines(_items(spark, sf))


def text_join_line(spark: SparkSession, sf: str) -> DataFrame:
    return T.join_lines(_items(spark, sf).withColumnRenamed("true_line", "line_no")).withColumn("text", F.md5("text"))


def text_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "conversations")
    text = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return T.text_of_pages(c.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("page"), text.alias("text")), True)


def text_flow_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    return d.select("doc_id", F.md5(T.flow_paragraphs(F.replace("text", F.lit(". "), F.lit(".\n\n")))).alias("digest"))


def convert_txt_status(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.lit(" \n")).when(F.expr("doc_id div 5 % 7 = 0"), F.lit("")).otherwise(F.col("text"))
    return T.text_status(d.select(F.expr("doc_id div 5").alias("job_id"), F.col("doc_id").alias("file_id"), text.alias("text")))


def edit_history_undo(spark: SparkSession, sf: str) -> DataFrame:
    e = M.read(spark, sf, "events")
    op = F.when(F.col("event_id") % 3 == 0, "undo").otherwise("apply")
    out = T.undo_history(e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").alias("edit_id")))
    return out.select("session_id", F.array_join(F.col("edits").cast("array<string>"), ",").alias("edits"))


def apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    edit = lambda a, b, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(p).alias("put"))
    edits = F.array(edit(9, 11, ""), edit(0, 3, "<A>"), edit(5, 5, "+"))
    return M.read(spark, sf, "documents").select("doc_id", F.md5(T.apply_edits(F.col("text"), edits)).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (find_on_page, match_counts, gap_right, collect_replacements, replace_text, edit_outcomes, batch_report, batch_rollup, text_group_lines, text_join_line, text_of_pages, text_flow_paragraphs, convert_txt_status, edit_history_undo, apply_edits)
}

_BLANK_SEQ = "regexp_replace(text, '^\\s+|\\s+$', '', 'g') = ''"

ORACLE = {
    "find_on_page": f"""
        with {_ITEMS} select file_id, page, item_index, font, hit_offset::int as offset, row_number() over (partition by file_id, page, font order by item_index, hit_offset) - 1 as ordinal,
            case when 3 < len(text) then x + width / len(text) * hit_offset else x end as hit_x, case when 3 < len(text) then width / len(text) * 3 else width end as hit_width, y, 12.0::double as font_size from hits""".replace("as offset", 'as "offset"'),
    "match_counts": """
        with d as (select doc_id, lang, (len(text) - len(replace(text, 'the', ''))) // 3 as n from documents)
        select lang, sum(n)::bigint as matches, count(*) filter (n > 0) as files, array_to_string(list_sort(coalesce(list(doc_id) filter (n > 0), []))[1:5], ',') as first_files from d group by 1""",
    "gap_right": f"""
        with {_ITEMS} select a.file_id, a.page, a.item_index, min(b.x - (a.x + a.width)) as gap from items a left join items b
            on b.file_id = a.file_id and b.line between a.line - 1 and a.line + 1 and abs(b.y - a.y) <= 3.6 and b.x > a.x + 0.01 and regexp_matches(b.text, '[^\\s]') group by all""",
    "collect_replacements": f"""
        with {_ITEMS} select file_id, page, 'p1-' || (row_number() over (partition by file_id order by item_index, hit_offset) - 1) || '-the-a' as id, 'the' as find, 'a' as replace,
            row_number() over (partition by file_id, font order by item_index, hit_offset) - 1 as ordinal from hits""",
    "replace_text": "select doc_id, md5(replace(text, 'the', '$1\\')) as digest from documents",
    "edit_outcomes": """
        with f as (select doc_id // 3 as job_id, doc_id, (len(text) - len(replace(text, 'moron', ''))) // 5 as h from documents),
        j as (select job_id, count(*) filter (h > 0) as outputs, count(*) filter (h = 0) as untouched, bool_and(doc_id % 2 = 0) as scans, sum(case when doc_id % 4 = 0 then h else 0 end) as o from f group by 1)
        select job_id, case when outputs = 0 then case when scans then 'E_NO_TEXT_LAYER' else 'E_TEXT_NOT_FOUND' end end as error, outputs, case when outputs = 1 then 'application/pdf' when outputs > 1 then 'application/zip' end as packed,
            case when outputs = 0 then '' else concat_ws(',', case when untouched > 0 then 'W_NO_MATCH_IN_FILE' end, case when o > 0 then 'W_EDIT_OVERLAY' end) end as warnings from j""",
    "batch_report": f"""
        with {_ITEMS}, m as (select file_id, {_METHOD} as method, hit_offset % 16 <> 7 as gone from hits)
        select file_id, count(*) as hits, case when bool_or(method = 'overlay') then 'overlay' when bool_or(method = 'erase') then 'erase' else 'native' end as method, bool_and(gone) as clean from m group by 1""",
    "batch_rollup": f"""
        with {_ITEMS}, m as (select file_id, count(*) as h, bool_or({_METHOD} = 'overlay') as o from hits group by 1),
        f as (select doc_id, case when doc_id % 17 = 0 then 'failed' when h is null then 'empty' else 'done' end as state, coalesce(h, 0) as h, coalesce(o, false) as o from documents left join m on file_id = doc_id)
        select doc_id // 50 as batch_id, count(*) filter (state = 'done') as done, count(*) filter (state = 'empty') as empty, count(*) filter (state = 'failed') as failed, sum(h)::bigint as hits, bool_or(o) as overlay from f group by 1""",
    "text_group_lines": f"with {_ITEMS} select file_id, page, dense_rank() over (partition by file_id order by line) - 1 as line_no, item_index from items where len(text) > 0",
    "text_join_line": f"""
        with {_ITEMS}, j as (select file_id, page, line, string_agg(case when k > 0 and k % 2 = 0 then ' ' else '' end || text, '' order by k) as t from items group by all),
        r as (select file_id, page, line as line_no, regexp_replace(t, '\\s+$', '') as t from j) select file_id, page, line_no, md5(t) as text from r where t <> ''""",
    "text_of_pages": """
        with p as (select conv_id, turn, case when (conv_id + turn) % 4 = 0 then '' else regexp_replace(text, '\\s+$', '') end as b from conversations),
        s as (select *, coalesce(bool_or(b <> '') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as seen from p),
        c as (select conv_id, turn, case when seen then chr(10) || '--- ' || (turn + 1) || ' ---' || chr(10) end as m, b from s),
        j as (select conv_id, coalesce(string_agg(concat_ws(chr(10), m, nullif(b, '')), chr(10) order by turn) filter (m is not null or b <> ''), '') as t from c group by 1)
        select conv_id as file_id, regexp_replace(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', ''), '\\s+$', '') || chr(10) as text from j""",
    "text_flow_paragraphs": """
        with l as (select doc_id, string_split(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10)) as p from documents), e as (select doc_id, p, unnest(range(1, len(p) + 1)) as i from l)
        select doc_id, md5(string_agg(p[i] || case when i < len(p) and (p[i] = '' or (p[i + 1] = '' and i + 1 < len(p))) then chr(10) else '' end, '' order by i)) as digest from e group by 1""",
    "convert_txt_status": """
        with f as (select doc_id // 5 as job_id, doc_id % 3 = 0 or doc_id // 5 % 7 = 0 or not regexp_matches(text, '[^\\s]') as blank from documents)
        select job_id, count(*) filter (not blank) as outputs, count(*) filter (blank) as skipped, case when bool_and(blank) then 'E_NO_TEXT_LAYER' end as error, case when bool_or(blank) and not bool_and(blank) then 'W_NO_TEXT_IN_FILE' end as warning from f group by 1""",
    "edit_history_undo": """
        with l as (select user_id, list_prepend([0], list(case when event_id % 3 = 0 then [] else [event_id] end order by event_id)) as log from events group by 1)
        select user_id as session_id, array_to_string(list_reduce(log, lambda acc, e: case when len(e) > 0 then list_concat(acc, e) when len(acc) > 1 then acc[:-2] else acc end)[2:], ',') as edits from l""",
    "apply_edits": "select doc_id, md5('<A>' || substr(text, 4, 2) || '+' || substr(text, 6, 4) || substr(text, 12)) as digest from documents",
}
