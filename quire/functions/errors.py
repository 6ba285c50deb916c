"""The catalogue of errors and warnings: what each says and what one can do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Codes, messages and the ways out of the data model.
ERRORS = [
    ("E_NOT_PDF", "That file is not a PDF", "pick-file"),
    ("E_CORRUPT", "We could not open this file — it may be damaged", "pick-file"),
    ("E_ENCRYPTED", "This file is password protected", "goto-tool:unlock,pick-file"),
    ("E_TOO_LARGE", "This file is larger than we can handle", "goto-tool:compress,pick-file"),
    ("E_TOO_MANY_PAGES", "This document has more pages than we can handle", "goto-tool:split,pick-file"),
    ("E_TOO_FEW_FILES", "This tool needs more files than that", "add-files"),
    ("E_TOO_MANY_FILES", "That is more files than this tool accepts", "dismiss"),
    ("E_EMPTY_FILE", "That file is empty", "pick-file"),
    ("E_NO_PAGES_SELECTED", "No pages selected yet", "dismiss"),
    ("E_RANGE_OUT_OF_BOUNDS", "That page range goes past the end of the document", "dismiss"),
    ("E_NO_TEXT_LAYER", "This document is a scan — there is no text layer to read", "dismiss,pick-file"),
    ("E_TEXT_NOT_FOUND", "That text does not appear in this document", "dismiss"),
    ("E_OUT_OF_MEMORY", "This document is too large for the browser to hold", "goto-tool:split,pick-file"),
    ("E_CANCELLED", "Cancelled", "dismiss"),
    ("E_SERVER_UNAVAILABLE", "This tool needs a connection, and we could not reach it", "retry,go-home"),
    ("E_NOT_BUILT_YET", "This tool is not finished yet", "go-home"),
    ("E_BAD_OPTIONS", "Those settings are not valid", "dismiss"),
    ("E_UNSUPPORTED_CONVERSION", "That conversion is not possible", "dismiss"),
    ("E_UNSUPPORTED_ENCRYPTION", "This file is locked in a way we cannot open", "dismiss,pick-file"),
    ("E_WRONG_PASSWORD", "That password does not open this file", "dismiss"),
    ("E_INTERNAL", "Something went wrong inside the app", "retry,go-home"),
]
WARNINGS = [
    ("W_FILE_SKIPPED", "A file was skipped"),
    ("W_RANGE_CLAMPED", "Part of a page range went past the end"),
    ("W_PAGE_SIZE_REDRAW", "Forcing a page size redraws each page, so links and comments from the originals are lost"),
    ("W_FILES_DROPPED", "Some files were skipped — too many at once"),
    ("W_MEMORY_HIGH", "That is a lot open at once — things may get slow"),
    ("W_ALREADY_OPTIMIZED", "This file is already well compressed — there was nothing left to save"),
    ("W_IMAGES_SKIPPED", "Some images could not be touched and were left exactly as they were"),
    ("W_NO_MATCH_IN_FILE", "Some files did not contain the text, so they were left alone"),
    ("W_EDIT_OVERLAY", "Some spots could not be edited in place and were painted over — copying the text still shows the old value"),
    ("W_NOTHING_CHANGED", "Nothing was changed, so the result matches the original"),
    ("W_BOOKMARKS_DROPPED", "The original bookmarks are gone, because pages moved or were removed"),
    ("W_MANY_OUTPUTS", "This produces a lot of files, and they add up"),
    ("W_PNG_LARGER", "PNG files are several times larger than JPG — pick JPG unless you need transparency"),
    ("W_NO_TEXT_IN_FILE", "Some files had no text layer and were skipped"),
    ("W_PARTIAL_DECRYPT", "Parts of the file would not decrypt and were left as they were"),
    ("W_CANCELLED", "Cancelled — your files are still loaded"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(code, severity, message, actions): actions as names, with the tool that one goes to; warnings are only dismissed."""
    rows = [(c, "error", m, a) for c, m, a in ERRORS] + [(c, "warning", m, "dismiss") for c, m in WARNINGS]
    return spark.createDataFrame(rows, "code string, severity string, message string, actions string")


def explained(rows: DataFrame, column: str = "code") -> DataFrame:
    """rows with severity, message and actions of their code; a code that is not in the catalogue reads as E_INTERNAL, null stays null."""
    from pyspark.sql import functions as F

    table = catalogue(rows.sparkSession)
    known = [c for c, *_ in ERRORS] + [c for c, _ in WARNINGS]
    key = F.when(F.col(column).isin(known) | F.col(column).isNull(), F.col(column)).otherwise("E_INTERNAL")
    return rows.withColumn("_code", key).join(F.broadcast(table.withColumnRenamed("code", "_code")), "_code", "left").drop("_code")  # 37 rows
