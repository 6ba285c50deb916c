"""Column functions for files: kinds by content, limits, conversions, errors, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import half_up

# Limits, media types, tools and error patterns of the data model.
MAX_FILE_BYTES = 100 << 20
OLD_MAX_BYTES = 20 << 20
MAX_PAGES = 2000
MAX_FILES = 20
SOFT_TOTAL_BYTES = 100 << 20
HARD_TOTAL_BYTES = 250 << 20
MIME = {"pdf": "application/pdf", "jpeg": "image/jpeg", "png": "image/png", "unknown": "application/octet-stream"}
TOOLS = [
    ("merge", 2, 20, ["application/pdf"]),
    ("split", 1, 1, ["application/pdf"]),
    ("compress", 1, 20, ["application/pdf"]),
    ("convert", 1, 20, ["application/pdf", "image/jpeg", "image/png"]),
    ("edit", 1, 20, ["application/pdf"]),
    ("organize", 1, 1, ["application/pdf"]),
    ("unlock", 1, 1, ["application/pdf"]),
]
NO_MEMORY, LOCKED = r"(?i)out of memory|allocation (size overflow|failed)", r"(?i)password|encrypted"
NO_FILES, TOO_FEW, ONE_FILE, TOO_MANY = "No files chosen yet", "This tool needs at least %d files", "This tool takes a single file", "Takes at most %d files"
BAD_PDF = r"(?i)pdf (header|document)|parse|xref|trailer|invalid object|unexpected (object|token)|corrupt|malformed|stream"


def kind(content: Column) -> Column:
    """pdf (its mark at offset 0 to 1024), jpeg, png (at 0) or unknown."""
    at = F.locate("%PDF", F.decode(F.substring(content, 1, 1028), "ISO-8859-1"))
    return F.when(at.between(1, 1025), "pdf").when(F.startswith(content, F.unhex(F.lit("FFD8FF"))), "jpeg").when(F.startswith(content, F.unhex(F.lit("89504E47"))), "png").otherwise("unknown")


def mime(k: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), k)


def direction(kinds: Column) -> Column:
    """Of the distinct kinds of a job's files: pdf-in, pdf-out or null."""
    return F.when(F.size(kinds) == 0, None).when(kinds == F.array(F.lit("pdf")), "pdf-in").when(~F.array_contains(kinds, "pdf") & ~F.array_contains(kinds, "unknown"), "pdf-out")


def targets(d: Column) -> Column:
    return F.when(d == "pdf-in", F.array(*map(F.lit, ("jpg", "png", "txt")))).when(d == "pdf-out", F.array(F.lit("pdf"))).otherwise(F.array().cast("array<string>"))


def classify_error(name: Column, message: Column) -> Column:
    """The error code of something thrown: by its name, then by what its text reads like."""
    detail = F.concat(name, F.lit(": "), message)
    like = lambda p: F.rlike(detail, F.lit(p))
    return (
        F.when(name == "AbortError", "E_CANCELLED")
        .when(like(NO_MEMORY), "E_OUT_OF_MEMORY")
        .when(like(LOCKED), "E_ENCRYPTED")
        .when(like(BAD_PDF), "E_CORRUPT")
        .otherwise("E_INTERNAL")
    )


def encryption_support(handler: Column, v: Column, r: Column, streams: Column, strings: Column) -> Column:
    """Null if an encryption dictionary can be read, else what is not supported. streams, strings: crypt methods or null."""
    return (
        F.when(handler != "Standard", F.concat(F.lit("security handler /"), handler))
        .when(~v.isin(1, 2, 4, 5), F.concat(F.lit("/V "), v.cast("string")))
        .when(~r.between(2, 6), F.concat(F.lit("/R "), r.cast("string")))
        .when(v.isin(4, 5) & (streams.isNull() | strings.isNull()), F.lit("an unrecognised crypt filter"))
    )


def key_bytes(v: Column, bits: Column) -> Column:
    held = lambda default: F.greatest(F.lit(5), F.least(F.lit(16), F.shiftright(F.coalesce(bits, F.lit(default)), 3)))
    return F.when(v == 1, 5).when(v == 2, held(40)).when(v == 5, 32).otherwise(held(128))


def unlock_status(encrypted: Column, unsupported: Column, packed: Column, opened: Column, failed: Column) -> Column:
    """struct(error, warning): refusals in order, then what a finished run says."""
    error = F.when(~encrypted, None).when(unsupported.isNotNull() | packed, "E_UNSUPPORTED_ENCRYPTION").when(~opened, "E_WRONG_PASSWORD")
    warning = F.when(~encrypted, "W_NOTHING_CHANGED").when(error.isNull() & (failed > 0), "W_PARTIAL_DECRYPT")
    return F.struct(error.alias("error"), warning.alias("warning"))


def carry(source: Column, keep: Column) -> Column:
    """A description field of a source: kept unless empty or asked not to."""
    return F.when(keep, F.nullif(source, F.lit("")))


APP = "quire"


def described(info: Column, policy: str) -> Column:
    """The description of an output from its source's: by the tool's policy all that is known, all but the date, or nothing.

    info: struct(title, author, subject, keywords, creator, created). keep: split and organize; merge: no date; none; new:
    pages that were no document before, so the program made them. The program is the producer always.
    """
    kept = {c: F.nullif(info[c], F.lit("")) for c in ("title", "author", "subject", "keywords", "creator")} if policy in ("keep", "merge") else {}
    fields = {c: kept.get(c, F.lit(None).cast("string")) for c in ("title", "author", "subject", "keywords", "creator")}
    if policy == "new":
        fields["creator"] = F.lit(APP)
    created = info["created"] if policy == "keep" else F.lit(None).cast("timestamp")
    return F.struct(*(v.alias(k) for k, v in fields.items()), F.lit(APP).alias("producer"), created.alias("created"))


def blocked(n_files: Column, least: Column, most: Column) -> Column:
    """Why a tool cannot run yet, or null."""
    return (
        F.when(n_files == 0, NO_FILES)
        .when(n_files < least, F.format_string(TOO_FEW, least))
        .when(n_files > most, F.when(most == 1, ONE_FILE).otherwise(F.format_string(TOO_MANY, most)))
    )


def progress(done: Column, total: Column, first: int, last: int) -> Column:
    """Percent of a step that covers first to last."""
    return F.lit(first) + half_up(done / F.greatest(F.lit(1), total) * (last - first))
