"""Operators over whole documents: measuring, reading, splitting, merging, archives, unlocking. One file is one row."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import files as fx
from quire.ship import ship

FACTS = "page_count int, is_encrypted boolean, has_text boolean, page_sizes array<struct<w: double, h: double>>, error string"
#: Rows go back together until their values have so many bytes.
BATCH_BYTES = 1 << 18
RUNS = "page int, item_index int, text string, x double, y double, width double, font_size double, font string"


def _rows(frame: DataFrame, step: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """Each row through a Python function that gives rows of the schema."""
    ship(frame.sparkSession)
    names = [f.name for f in frame.sparkSession.createDataFrame([], schema).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = list(zip(batch.schema.names, batch.columns))
            for k in range(batch.num_rows):
                for r in step({n: c[k].as_py() for n, c in columns}):
                    held.append({n: r.get(n) for n in names})
                    size += 64 + sum(len(v) for v in r.values() if isinstance(v, (bytes, str)))
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=target)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(frame.sparkSession.createDataFrame([], schema).schema)
    return frame.mapInArrow(run, schema)


def measure(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> FACTS: pages, sizes of the first 25, a text layer on the first 3; errors as a code."""

    def step(row: dict) -> list[dict]:
        from quire.pdf.crypt import read_lock
        from quire.pdf.objects import Document, PdfError
        from quire.pdf.text import page_runs

        data = row["content"] or b""
        out = {"file_id": row["file_id"], "page_count": 0, "is_encrypted": False, "has_text": False, "page_sizes": []}
        if not data:
            return [out | {"error": "E_EMPTY_FILE"}]
        if len(data) > fx.MAX_FILE_BYTES:
            return [out | {"error": "E_TOO_LARGE"}]
        if data.startswith((b"\xff\xd8\xff", b"\x89PNG")):
            return [out | {"page_count": 1}]
        if b"%PDF" not in data[:1028]:
            return [out | {"error": "E_NOT_PDF"}]
        try:
            doc = Document.open(data)
            if read_lock(doc) is not None:
                return [out | {"is_encrypted": True}]
            pages = doc.pages()
            if len(pages) > fx.MAX_PAGES:
                return [out | {"error": "E_TOO_MANY_PAGES"}]
            sizes = [dict(zip("wh", (round(s, 2) for s in doc.box(p)))) for p in pages[:25]]
            text = any(r["text"].strip() for p in pages[:3] for r in page_runs(doc, p))
            return [out | {"page_count": len(pages), "has_text": text, "page_sizes": sizes}]
        except (PdfError, RecursionError, TypeError, ValueError, KeyError):
            return [out | {"error": "E_CORRUPT"}]

    return _rows(files.select("file_id", "content"), step, f"file_id long, {FACTS}")


def read_runs(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> RUNS of every page; unreadable files give none."""

    def step(row: dict) -> list[dict]:
        from quire.pdf.objects import Document, PdfError
        from quire.pdf.text import page_runs

        try:
            doc = Document.open(row["content"] or b"")
            return [r | {"file_id": row["file_id"], "page": n} for n, p in enumerate(doc.pages(), 1) for r in page_runs(doc, p)]
        except PdfError:
            return []

    return _rows(files.select("file_id", "content"), step, f"file_id long, {RUNS}")


def split_files(files: DataFrame, plan: DataFrame) -> DataFrame:
    """files and a plan (file_id, group_no, pos, page_index) -> (file_id, group_no, content)."""
    groups = plan.groupBy("file_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("pos", "page_index"))).alias("g"))
    groups = groups.groupBy("file_id").agg(F.collect_list(F.struct("group_no", F.col("g.page_index").alias("pages"))).alias("groups"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.objects import Document, assemble

        doc = Document.open(row["content"])
        info = {k: v for k, v in doc.info().items() if k not in ("Producer", "ModDate")}
        return [{"file_id": row["file_id"], "group_no": g["group_no"], "content": assemble([(doc, g["pages"], {})], info)} for g in row["groups"]]

    return _rows(files.select("file_id", "content").join(groups, "file_id"), step, "file_id long, group_no int, content binary")


def organize_files(files: DataFrame, order: DataFrame) -> DataFrame:
    """files and pages in order (file_id, pos, page_index, quarter) -> (file_id, content)."""
    orders = order.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "page_index", "quarter"))).alias("pages"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.objects import Document, assemble

        doc = Document.open(row["content"])
        parts = [(doc, [p["page_index"]], {p["page_index"]: p["quarter"] or 0}) for p in row["pages"]]
        return [{"file_id": row["file_id"], "content": assemble(parts, doc.info())}]

    return _rows(files.select("file_id", "content").join(orders, "file_id"), step, "file_id long, content binary")


def merge_files(files: DataFrame, page_size: str = "keep", packed: bool = False) -> DataFrame:
    """files (job_id, ord, name, content) -> (job_id, content, warning): all pages in order, a bookmark for each file.

    page_size: keep, first (that of the first page) or a4; pages are redrawn to it, which costs their links. packed: with
    object streams.
    """
    jobs = files.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "content"))).alias("files"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.objects import Document, assemble

        parts, marks, at = [], [], 0
        for f in row["files"]:
            doc = Document.open(f["content"])
            n = len(doc.pages())
            if n:
                parts.append((doc, list(range(n)), {}))
                marks.append((f["name"].rpartition(".")[0] or f["name"], at))
                at += n
        size = (595.28, 841.89) if page_size == "a4" else parts[0][0].box(parts[0][0].pages()[0]) if page_size == "first" and parts else None
        return [{"job_id": row["job_id"], "content": assemble(parts, None, marks, size, packed), "warning": "W_PAGE_SIZE_REDRAW" if size else None}]

    return _rows(jobs, step, "job_id long, content binary, warning string")


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """Write each file (name, content) under its name into a folder that all executors share -> (name, path, bytes).

    A file is written beside its place and moved when it is whole; names are made safe and must be unique.
    """

    def step(row: dict) -> list[dict]:
        import re
        import uuid

        from pyarrow.fs import FileSystem, FileType

        fs, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else folder.replace("file:/", "file:///", 1))
        name = re.sub(r'[\\/:*?"<>|\x00-\x1f]', "-", row["name"] or "") or "file"
        fs.create_dir(root, recursive=True)
        draft, path, content = f"{root}/.{uuid.uuid4().hex}.tmp", f"{root}/{name}", row["content"] or b""
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(content)
        if fs.get_file_info(path).type == FileType.File:
            fs.delete_file(path)
        fs.move(draft, path)
        return [{"name": name, "path": path, "bytes": len(content)}]

    return _rows(files.select("name", "content"), step, "name string, path string, bytes long")


FONTS = "page int, name string, subtype string, base_font string, embedded boolean, mapped int, wide boolean"


def page_fonts(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> FONTS of every page's resources; those that cannot be read are left out."""

    def step(doc) -> list[dict]:
        from quire.pdf.text import read_font

        out = []
        for number, page in enumerate(doc.pages(), 1):
            listed = doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}
            for name, ref in listed.items():
                d = doc.get(ref)
                if isinstance(d, dict) and d.get("Subtype") in ("Type0", "TrueType", "Type1", "MMType1"):
                    inner = doc.get((doc.get(d.get("DescendantFonts")) or [{}])[0]) if d["Subtype"] == "Type0" else d
                    shape = doc.get((inner or {}).get("FontDescriptor")) or {}
                    font = read_font(doc, d)
                    out.append({"page": number, "name": str(name), "subtype": str(d["Subtype"]), "base_font": str(d.get("BaseFont") or ""), "embedded": any(k in shape for k in ("FontFile", "FontFile2", "FontFile3")), "mapped": len(font.chars), "wide": font.wide})
        return out

    return _parsed(files, step, FONTS)


MARKS = "page int, mark int, font string, code int, x double, y double, string_no int, slot int, placed_op string"


def glyph_marks(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> MARKS: every code that a page paints, in painting order, with its string and what placed it."""

    def step(doc) -> list[dict]:
        from quire.pdf.edit import marks_of, pieces_of
        from quire.pdf.objects import Stream
        from quire.pdf.text import read_font

        out = []
        for number, page in enumerate(doc.pages(), 1):
            contents = doc.get(page.get("Contents"))
            data = b"\n".join(doc.decode(s) for p in (contents if isinstance(contents, list) else [contents]) if isinstance(s := doc.get(p), Stream))
            listed = doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}
            fonts = {str(k): read_font(doc, doc.get(v) or {}) for k, v in listed.items()}
            out += [{"page": number, "mark": k, "font": m.font, "code": m.code, "x": m.x, "y": m.y, "string_no": m.piece, "slot": m.slot, "placed_op": m.placed_op} for k, m in enumerate(marks_of(pieces_of(data), fonts))]
        return out

    return _parsed(files, step, MARKS)


def zip_files(entries: DataFrame) -> DataFrame:
    """entries (job_id, ord, unique_name, content) -> (job_id, content): stored archives with a fixed stamp."""
    jobs = entries.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "unique_name", "content"))).alias("entries"))

    def step(row: dict) -> list[dict]:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for e in row["entries"]:
                z.writestr(zipfile.ZipInfo(e["unique_name"], (2024, 1, 1, 0, 0, 0)), e["content"] or b"")
        return [{"job_id": row["job_id"], "content": raw.getvalue()}]

    return _rows(jobs, step, "job_id long, content binary")


def unzip_files(archives: DataFrame) -> DataFrame:
    """(job_id, content) -> (job_id, ord, name, content)."""

    def step(row: dict) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
            return [{"job_id": row["job_id"], "ord": k, "name": i.filename, "content": z.read(i)} for k, i in enumerate(z.infolist())]

    return _rows(archives.select("job_id", "content"), step, "job_id long, ord int, name string, content binary")


def unlock_files(files: DataFrame) -> DataFrame:
    """files (file_id, content, password) -> (file_id, content, error, warning); the password must be known."""

    def step(row: dict) -> list[dict]:
        from quire.pdf.crypt import unlock_document
        from quire.pdf.objects import PdfError

        try:
            content, error, warning = unlock_document(row["content"], row["password"] or "")
        except PdfError:
            content, error, warning = None, "E_CORRUPT", None
        return [{"file_id": row["file_id"], "content": content, "error": error, "warning": warning}]

    return _rows(files.select("file_id", "content", "password"), step, "file_id long, content binary, error string, warning string")


def text_files(files: DataFrame) -> DataFrame:
    """(file_id, text) -> (file_id, content): UTF-8 with its mark."""
    return files.select("file_id", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")).alias("content"))


def build_files(pages: DataFrame) -> DataFrame:
    """pages (file_id, page_index, text) -> (file_id, content): documents of text lines, empty lines left out."""
    files = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "text"))).alias("pages"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.build import text_pdf

        lines = [[x for x in (p["text"] or "").split("\n") if x] for p in row["pages"]]
        return [{"file_id": row["file_id"], "content": text_pdf(lines, {"Title": f"File {row['file_id']}"})}]

    return _rows(files, step, "file_id long, content binary")


EDITS = "page int, ordinal int, method string, moved int, scale double, note string"


def edit_files(files: DataFrame, find: str, replace: str, overflow: str = "squeeze") -> DataFrame:
    """files (file_id, content) -> (file_id, content, edits, error): every match of a text replaced where it is drawn.

    edits: an array of EDITS, one for each match: native, erase or overlay, what moved, how far it was squeezed. A longer
    text is squeezed into its room, or pushes what follows it on its line (overflow).
    """

    def step(row: dict) -> list[dict]:
        from quire.pdf.edit import replace_text
        from quire.pdf.objects import PdfError

        try:
            content, edits = replace_text(row["content"] or b"", find, replace, overflow)
        except PdfError:
            return [{"file_id": row["file_id"], "error": "E_CORRUPT"}]
        return [{"file_id": row["file_id"], "content": content, "edits": edits, "error": None if edits else "E_TEXT_NOT_FOUND"}]

    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in EDITS.split(", "))
    return _rows(files.select("file_id", "content"), step, f"file_id long, content binary, edits array<struct<{fields}>>, error string")


IMAGES = "key long, width int, height int, bits int, filter string, colour string, components int, stored long, is_mask boolean, is_mask_target boolean, sample_tricks boolean"


def _parsed(files: DataFrame, step: Callable, schema: str) -> DataFrame:
    """Rows of each file that opens (with its file_id); files that do not open give none."""

    def run(row: dict) -> list[dict]:
        from quire.pdf.objects import Document, PdfError

        try:
            return [{"file_id": row["file_id"]} | r for r in step(Document.open(row["content"] or b""))]
        except PdfError:
            return []

    return _rows(files.select("file_id", "content"), run, f"file_id long, {schema}")


def image_objects(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> IMAGES of every image object."""

    def step(doc) -> list[dict]:
        from quire.pdf.images import objects

        return objects(doc)

    return _parsed(files, step, IMAGES)


def image_placements(files: DataFrame) -> DataFrame:
    """files (file_id, content) -> (file_id, key, page, ord, width_pt, height_pt): every drawing of an image, in forms too."""

    def step(doc) -> list[dict]:
        from quire.pdf.images import placements

        return placements(doc)

    return _parsed(files, step, "key long, page int, ord int, width_pt double, height_pt double")


def compress_files(files: DataFrame, level: str = "recommended", strip: bool = True) -> DataFrame:
    """files (file_id, content) -> (file_id, content, original, bytes, images, warning).

    The images that the plan of the level takes are made smaller and deflated; one that would not shrink, or cannot be
    read, stays. images: (key, reason; null: replaced, kept_bytes). strip: title, author and programs go. A file that
    would not shrink stays as it was.
    """
    from quire.operators import images as I

    one = F.struct("file_id", "key").alias("key")
    found = image_objects(files).select(*(one if c == "key" else c for c in image_objects(files).columns))
    drawn = image_placements(files).select(one, "ord", "width_pt", "height_pt")
    plan = I.plan(found, I.largest_placement(drawn).select("key", "width_pt", "height_pt"), level)
    item = F.struct(F.col("key.key").alias("key"), "stored", "target_width", "target_height", "reason")
    plans = plan.groupBy("file_id").agg(F.sort_array(F.collect_list(item)).alias("plan"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.images import recoded, without_description
        from quire.pdf.objects import Document, PdfError, rewrite

        content, images, changes = row["content"] or b"", [], {}
        base = {"file_id": row["file_id"], "original": len(content)}
        try:
            doc = Document.open(content)
            for x in row["plan"] or []:
                reason, size = x["reason"], x["stored"]
                if reason is None:
                    new = recoded(doc, x["key"], x["target_width"], x["target_height"])
                    reason = "unreadable" if new is None else "no-gain" if len(new.raw) >= I.WORTH * x["stored"] else None
                    if reason is None:
                        changes[x["key"]], size = new, len(new.raw)
                images.append({"key": x["key"], "reason": reason, "kept_bytes": size})
            out = rewrite(doc, changes | (without_description(doc) if strip else {}), drop=("Metadata",) if strip else ())
        except PdfError:
            return [base | {"content": content, "bytes": len(content), "images": []}]
        out = content if len(out) >= len(content) else out
        skipped = any(i["reason"] not in (None, *I.NOTABLE_NOT) for i in images)
        warning = "W_ALREADY_OPTIMIZED" if out is content or (len(content) - len(out)) * 100 < len(content) else "W_IMAGES_SKIPPED" if skipped else None
        return [base | {"content": out, "bytes": len(out), "images": images, "warning": warning}]

    rows = files.select("file_id", "content").join(plans, "file_id", "left")
    return _rows(rows, step, "file_id long, content binary, original long, bytes long, images array<struct<key: long, reason: string, kept_bytes: long>>, warning string")


def images_to_pdf(pictures: DataFrame, size: str = "fit-image", margin_mm: float = 0.0) -> DataFrame:
    """pictures (job_id, ord, content: PNG or JPEG) -> (job_id, content, error): a page for each picture, in order."""
    jobs = pictures.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("files"))

    def step(row: dict) -> list[dict]:
        from quire.pdf.images import pictures_pdf
        from quire.pdf.objects import PdfError

        try:
            return [{"job_id": row["job_id"], "content": pictures_pdf([f["content"] or b"" for f in row["files"]], size, margin_mm)}]
        except PdfError:
            return [{"job_id": row["job_id"], "error": "E_CORRUPT"}]

    return _rows(jobs, step, "job_id long, content binary, error string")


def loaded(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """measure()'s rows with their order -> the files that are kept and the errors of the others, each in the order they came."""
    return measured.where("error is null"), measured.where("error is not null")
