"""Queries that write documents, archives and locked files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import documents as D
from quire.operators import files as O
from quire.operators import pages as P
from quire.operators import text as T
from quire.plans import models as M

_LINES = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    c = M.read(spark, sf, "conversations")
    return D.build_files(c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page_index"), "text"))


def _spread(files: DataFrame) -> DataFrame:
    """Files that cost more to work on than to shuffle, over many tasks."""
    return files.repartition(32, "file_id")


def _page_texts(files: DataFrame) -> DataFrame:
    """(file_id, page, digest) of the text that is read back, line by line."""
    runs = D.read_runs(files).withColumn("line_no", F.col("item_index"))
    lines = F.array_sort(F.collect_list(F.struct("item_index", "text")))
    return runs.groupBy("file_id", "page").agg(F.md5(F.array_join(lines["text"], "\n")).alias("digest"))


def pdf_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _page_texts(_files(spark, sf))


def pdf_measure(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    spoilt = F.when(F.col("file_id") % 5 == 1, F.lit(b"")).when(F.col("file_id") % 5 == 2, F.unhex(F.lit("89504E470D0A"))).when(F.col("file_id") % 5 == 3, F.encode(F.lit("hello"), "UTF-8")).otherwise(F.col("content"))
    return D.measure(files.withColumn("content", spoilt)).select("file_id", "page_count", "has_text", "error")


def chain_split_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Files split after every second page, the pieces merged again, last first."""
    pieces = D.split_files(_files(spark, sf), P.every_n(M.pages(spark, sf), 2))
    merged = D.merge_files(pieces.select(F.col("file_id").alias("job_id"), (-F.col("group_no")).alias("ord"), F.format_string("part-%d.pdf", "group_no").alias("name"), "content"))
    return _page_texts(merged.select(F.col("job_id").alias("file_id"), "content"))


def pdf_organize(spark: SparkSession, sf: str) -> DataFrame:
    """Pages backwards; read back by text."""
    back = M.pages(spark, sf).select("file_id", (-F.col("page_index")).alias("pos"), "page_index", F.lit(90).alias("quarter"))
    return _page_texts(D.organize_files(_files(spark, sf), back))


def zip_sink(spark: SparkSession, sf: str) -> DataFrame:
    d = M.read(spark, sf, "documents")
    entries = d.select(F.expr("doc_id div 20").alias("job_id"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 2 == 0, "a.txt").otherwise(F.col("source")).alias("name"))
    named = O.unique_names(entries).join(D.text_files(d.select(F.col("doc_id").alias("file_id"), "text")).withColumnRenamed("file_id", "ord"), "ord")
    back = D.unzip_files(D.zip_files(named))
    return back.select("job_id", "ord", F.length("content").alias("bytes"), F.md5("content").alias("digest"))


def unlock_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations locked in five ways, opened with the user's or the owner's password; every fifth with a wrong one."""
    from quire.ship import ship

    ship(spark)
    # reading pages costs more than a shuffle of the files; the one shuffle also serves the grouping
    c = M.read(spark, sf, "conversations").withColumnRenamed("conv_id", "file_id").repartition(32, "file_id")
    pages = c.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("pages"))

    def lock(row: dict) -> list[dict]:
        from quire.pdf.build import locked_pdf

        k = row["file_id"]
        v, r, size, method = (5, 6, 32, "aes") if k % 25 == 7 else [(1, 2, 5, "rc4"), (2, 3, 16, "rc4"), (4, 4, 16, "aes"), (5, 5, 32, "aes")][k % 4]
        lines = [[x for x in (p["text"] or "").split("\n") if x] for p in row["pages"]]
        content = locked_pdf(lines, {"Title": "geheim"}, f"user{k}", f"owner{k}", v, r, size, method)
        return [{"file_id": k, "content": content, "password": "wrong" if k % 5 == 0 else f"owner{k}" if k % 3 == 0 else f"user{k}"}]

    opened = D.unlock_files(D._rows(pages, lock, "file_id long, content binary, password string"))

    def count(row: dict) -> list[dict]:
        from quire.pdf.objects import Document
        from quire.pdf.text import page_runs

        doc = Document.open(row["content"]) if row["error"] is None else None
        return [row | {"pages": sum(bool(page_runs(doc, p)) for p in doc.pages()) if doc else None}]

    return D._rows(opened, count, "file_id long, error string, warning string, pages long")


FIND, PUT = "the", "THE!!"


def page_fonts(spark: SparkSession, sf: str) -> DataFrame:
    return D.page_fonts(_files(spark, sf))


def glyph_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each page the marks, the sum of their codes and how far the last string of the page goes."""
    marks = D.glyph_marks(_files(spark, sf))
    return marks.groupBy("file_id", "page").agg(F.count("*").alias("marks"), F.sum("code").cast("long").alias("codes"), F.count_distinct("string_no").alias("strings"), F.round(F.max("x"), 3).alias("farthest"))


def merge_to_size(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations merged by fives and redrawn to a4, packed; read back by text."""
    f = _files(spark, sf).select(F.expr("file_id div 5").alias("job_id"), F.col("file_id").alias("ord"), F.format_string("f-%d.pdf", "file_id").alias("name"), "content")
    merged = D.merge_files(f, "a4", True).select(F.col("job_id").alias("file_id"), "content", "warning")
    return _page_texts(merged).join(merged.select("file_id", "warning"), "file_id")


def chain_measure(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of split files, measured like files that come in."""
    pieces = D.split_files(_files(spark, sf), P.every_n(M.pages(spark, sf), 3))
    named = pieces.select((F.col("file_id") * 1000 + F.col("group_no")).alias("file_id"), "content")
    return D.measure(named).select("file_id", "page_count", "has_text", "error")


def edit_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with a text replaced by a longer one inside the documents, read back."""
    return _page_texts(D.edit_files(_spread(_files(spark, sf)), FIND, PUT))


def edit_report(spark: SparkSession, sf: str) -> DataFrame:
    out = D.edit_files(_spread(_files(spark, sf)), FIND, PUT).select("file_id", "error", F.explode_outer("edits").alias("e"))
    return out.groupBy("file_id", "error").agg(F.count("e.method").alias("hits"), F.count_if(F.col("e.method") == "native").alias("native"), F.count_distinct("e.page").alias("pages"))


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as documents with one image each, in four ways."""

    def step(row: dict) -> list[dict]:
        from quire.pdf.build import image_pdf

        k = row["s_suppkey"]
        return [{"file_id": k, "content": image_pdf(k % 4, k % 200, 100.0 + k % 50)}]

    return D._rows(M.read(spark, sf, "supplier").select("s_suppkey"), step, "file_id long, content binary")


def image_placements(spark: SparkSession, sf: str) -> DataFrame:
    return D.image_placements(_pictures(spark, sf)).select("file_id", "page", "ord", F.round("width_pt", 6).alias("width_pt"), F.round("height_pt", 6).alias("height_pt"))


def image_objects(spark: SparkSession, sf: str) -> DataFrame:
    return D.image_objects(_pictures(spark, sf)).drop("key")


def compress_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The images after compression, read back from the documents, and what the description still says."""
    out = D.compress_files(_pictures(spark, sf))

    def step(row: dict) -> list[dict]:
        from quire.pdf.images import objects, samples
        from quire.pdf.objects import Document

        doc = Document.open(row["content"])
        image = objects(doc)[0]
        pixels = samples(doc, image["key"])
        return [{"file_id": row["file_id"], "reason": row["images"][0]["reason"], "width": image["width"], "height": image["height"], "filter": image["filter"], "least": int(pixels.min()), "most": int(pixels.max()), "described": len(doc.info())}]

    return D._rows(out.select("file_id", "content", "images"), step, "file_id long, reason string, width int, height int, filter string, least int, most int, described int")


def images_to_pdf(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pictures, three to a document of a4 pages: their places and sizes."""

    def step(row: dict) -> list[dict]:
        from quire.pdf.build import png

        k = row["s_suppkey"]
        return [{"job_id": k // 3, "ord": k, "content": png(30 + k % 40, 20 + k % 30, (k % 256, 7, 9))}]

    made = D.images_to_pdf(D._rows(M.read(spark, sf, "supplier").select("s_suppkey"), step, "job_id long, ord long, content binary"), "a4", 10.0)
    drawn = D.image_placements(made.select(F.col("job_id").alias("file_id"), "content"))
    found = D.image_objects(made.select(F.col("job_id").alias("file_id"), "content"))
    return drawn.join(found, ["file_id", "key"]).select("file_id", "page", F.round("width_pt", 3).alias("width_pt"), F.round("height_pt", 3).alias("height_pt"), "width", "height", "colour")


QUERIES = {
    f.__name__: f
    for f in (pdf_roundtrip, pdf_measure, chain_split_merge, pdf_organize, zip_sink, unlock_roundtrip, page_fonts, glyph_marks, merge_to_size, chain_measure, edit_roundtrip, edit_report, image_placements, image_objects, compress_roundtrip, images_to_pdf)
}

_IMAGES = """img as (select s_suppkey as k, s_suppkey % 4 as kind, list_extract([220, 300, 100, 200], (s_suppkey % 4 + 1)::int) as w, list_extract([200, 250, 100, 200], (s_suppkey % 4 + 1)::int) as h,
    case s_suppkey % 4 when 0 then 100.0::double + s_suppkey % 50 when 1 then 72 when 2 then 50 else 60 end as wpt, case s_suppkey % 4 when 0 then 90.0::double when 1 then 72 when 2 then 50 else 60 end as hpt from supplier)"""

ORACLE = {
    "pdf_roundtrip": f"select conv_id as file_id, (turn + 1)::int as page, md5({_LINES}) as digest from conversations where {_LINES} <> ''",
    "pdf_measure": """
        select conv_id as file_id, (case conv_id % 5 when 1 then 0 when 2 then 1 when 3 then 0 else count(*) end)::int as page_count, conv_id % 5 in (0, 4) as has_text,
            case conv_id % 5 when 1 then 'E_EMPTY_FILE' when 3 then 'E_NOT_PDF' end as error from conversations group by 1""",
    "chain_split_merge": f"""
        with p as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn // 2 desc, turn) as page from conversations)
        select conv_id as file_id, page::int as page, md5({_LINES}) as digest from p where {_LINES} <> ''""",
    "pdf_organize": f"""
        with p as (select conv_id, text, row_number() over (partition by conv_id order by turn desc) as page from conversations) select conv_id as file_id, page::int as page, md5({_LINES}) as digest from p where {_LINES} <> ''""",
    "zip_sink": """
        select doc_id // 20 as job_id, (row_number() over (partition by doc_id // 20 order by doc_id) - 1)::int as ord, strlen(text) + 3 as bytes, md5('\\xEF\\xBB\\xBF'::blob || encode(text)) as digest from documents""",
    "page_fonts": """select conv_id as file_id, (turn + 1)::int as page, 'F1' as name, 'Type1' as subtype, 'Helvetica' as base_font, false as embedded, 219 as mapped, false as wide from conversations""",
    "glyph_marks": f"""
        with l as (select conv_id, turn, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) as t from conversations),
        c as (select conv_id, turn, list_transform(string_split(t, ''), lambda x: case when ord(x) < 256 then ord(x) when x = '€' then 128 else 63 end) as codes from l)
        select conv_id as file_id, (turn + 1)::int as page, sum(len(codes))::bigint as marks, sum(list_sum(codes))::bigint as codes, count(*) as strings, round(max(40 + 6.0::double * (len(codes) - 1)), 3) as farthest from c group by all""",
    "merge_to_size": f"""
        with p as (select conv_id // 5 as file_id, text, row_number() over (partition by conv_id // 5 order by conv_id, turn) as page from conversations)
        select file_id, page::int as page, md5({_LINES}) as digest, 'W_PAGE_SIZE_REDRAW' as warning from p where {_LINES} <> ''""",
    "chain_measure": """
        with g as (select conv_id, turn // 3 as g, count(*) as n, bool_or(regexp_matches(text, '[^\\s]')) as texts from conversations group by all) select conv_id * 1000 + g as file_id, n::int as page_count, texts as has_text, null::varchar as error from g""",
    "edit_roundtrip": f"select conv_id as file_id, (turn + 1)::int as page, md5(replace({_LINES}, '{FIND}', '{PUT}')) as digest from conversations where {_LINES} <> ''",
    "edit_report": f"""
        with p as (select conv_id, turn, (len(text) - len(replace(text, '{FIND}', ''))) // 3 as n from conversations)
        select conv_id as file_id, case when sum(n) = 0 then 'E_TEXT_NOT_FOUND' end as error, sum(n)::bigint as hits, sum(n)::bigint as native, count(*) filter (n > 0) as pages from p group by 1""",
    "image_placements": f"""
        with {_IMAGES} select k as file_id, 1 as page, 0 as ord, wpt as width_pt, hpt as height_pt from img union all select k, 1, 1, 10, 10 from img where kind = 0""",
    "image_objects": f"""
        with {_IMAGES} select k as file_id, w as width, h as height, 8 as bits, '' as filter, case when kind in (0, 3) then 'rgb' else 'gray' end as colour, case when kind in (0, 3) then 3 else 1 end as components,
            (w * h * case when kind in (0, 3) then 3 else 1 end)::bigint as stored, false as is_mask, false as is_mask_target, kind = 3 as sample_tricks from img""",
    "compress_roundtrip": f"""
        with {_IMAGES}, s as (select *, least(1.0::double, wpt / 72 * 150 / w, hpt / 72 * 150 / h) as scale, case kind when 2 then 'too-small' when 3 then 'sample-tricks' end as reason from img)
        select k as file_id, reason, (case when reason is null then floor(w * scale + 0.5) else w end)::int as width, (case when reason is null then floor(h * scale + 0.5) else h end)::int as height,
            case when reason is null then 'FlateDecode' else '' end as filter, (k % 200)::int as least, (k % 200)::int as most, 0 as described from s""",
    "images_to_pdf": """
        with p as (select s_suppkey as k, 30 + s_suppkey % 40 as w, 20 + s_suppkey % 30 as h from supplier), s as (select *, least((595.28::double - 2 * 10 * 72 / 25.4::double) / w, (841.89::double - 2 * 10 * 72 / 25.4::double) / h) as scale from p)
        select k // 3 as file_id, row_number() over (partition by k // 3 order by k)::int as page, round(w * scale, 3) as width_pt, round(h * scale, 3) as height_pt, w::int as width, h::int as height, 'rgb' as colour from s""",
    "unlock_roundtrip": """
        select conv_id as file_id, case when conv_id % 5 = 0 then 'E_WRONG_PASSWORD' end as error, null::varchar as warning, case when conv_id % 5 <> 0 then count(*) filter (text <> '') end as pages from conversations group by 1""",
}
