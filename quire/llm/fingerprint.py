"""Canonical exact fingerprints, all in Spark's own functions.

The canonical form is NFKC, folded case and single spaces. Its fingerprint is two chained XXH64 (128 bits); inside such a
bucket the bytes are compared, and where they are not the same a mark tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut, range_bounds, range_number, release

ROWS_PER_RANGE = 2_000


def canonical(text: Column) -> Column:
    """NFKC, lower case (sharp s as ss, final sigma as sigma), white space runs one space, trimmed. Null: ''."""
    text = F.coalesce(text, F.lit(""))
    # plain ASCII is its own normal form
    normal = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)))
    folded = F.translate(F.replace(F.lower(normal), F.lit("ß"), F.lit("ss")), "ς", "σ")
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(form: Column) -> Column:
    """128 bits in hexadecimal: XXH64 of the bytes, and XXH64 of them after a first value."""
    hexed = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(hexed(F.xxhash64(form)), hexed(F.xxhash64(F.lit(0x5851F42D4C957F2D), form)))


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, value, text, next_value, next_text: the text of the next row by (doc_id, text), nulls
    first; after the last, the first. value: doc_id, the least long where it is null.

    Rows are dealt into ranges of doc_id. The rows at the start of a range go to the range before it as well, the
    first range's to the last, so that every range finds its last row's neighbour in itself.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", ROWS_PER_RANGE)
    n = len(bounds)
    rows = docs.withColumn("own", range_number("doc_id", bounds)).withColumn("value", F.coalesce("doc_id", F.lit(-(1 << 63))))
    starts = F.array(*(F.lit(b) for b in bounds))
    before = F.when(F.element_at(starts, F.col("own") + 1) == F.col("value"), F.pmod(F.col("own") - 1 + n, F.lit(n)))
    place = lambda at, copy: F.struct(at.cast("int").alias("at"), F.lit(copy).alias("copy"))
    rows = rows.withColumn("place", F.explode(F.filter(F.array(place(F.col("own"), False), place(before, True)), lambda x: x["at"].isNotNull())))
    # a copy follows all rows of its range
    order = Window.partitionBy("at").orderBy("copy", F.col("value"), "text")
    rows = rows.select("doc_id", "text", "value", "place.at", "place.copy").withColumn("next_text", F.lead("text").over(order)).withColumn("next_value", F.lead("value").over(order))
    return rows.where("not copy").select("doc_id", "value", "text", "next_value", "next_text")


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter (rounded down) replaced by as much of the start of the following text."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def mixed_keys(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key) of the buckets whose canonical texts are not all the same bytes.

    docs (doc_id, text); rows (value, next_value, a, b) with the keys of every text and edited text. Only texts of
    buckets of two or more are formed again; a bucket is compared by the least and greatest of its texts, which tasks
    work out before anything is shuffled, so a bucket of many copies costs no more than a small one.
    """
    part = lambda v, c: F.struct(F.lit(v).alias("v"), F.col(c)["key"].alias("key"))
    entries = rows.select("value", "next_value", F.explode(F.array(part(0, "a"), part(1, "b"))).alias("x")).select("value", "next_value", "x.v", "x.key")
    many = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = entries.join(many, "key", "left_semi")
    need = wanted.select("value").unionAll(wanted.where("v = 1").select("next_value")).distinct()
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("value"), F.coalesce("text", F.lit("")).alias("text")).join(need, "value", "left_semi")
    own = wanted.join(texts, "value")
    following = texts.select(F.col("value").alias("next_value"), F.col("text").alias("next_text"))
    whole = own.where("v = 0").select("key", canonical(F.col("text")).alias("form"))
    changed = own.where("v = 1").join(following, "next_value").select("key", canonical(edited(F.col("text"), F.col("next_text"))).alias("form"))
    # rows of one doc_id with other texts are told apart by their keys
    forms = whole.unionAll(changed).where(wide_hash(F.col("form")) == F.col("key"))
    return forms.groupBy("key").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("key")


def resolve(keys: DataFrame) -> DataFrame:
    """(key, size, proof) of the canonical texts of mixed buckets -> distinct (key, size, proof, fingerprint).

    Of the texts of a bucket, told apart by length and SHA-256, the first keeps the key alone, the others carry
    their proof after it.
    """
    kinds = keys.groupBy("key", "size", "proof").agg(F.count("*").alias("n"))
    first = kinds.groupBy("key").agg(F.min(F.struct("size", "proof")).alias("first"))
    mark = F.when(F.struct("size", "proof") == F.col("first"), F.col("key")).otherwise(F.concat("key", F.lit("-"), "proof"))
    return kinds.join(first, "key").select("key", "size", "proof", mark.alias("fingerprint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_fingerprint.

    One row per row. Null texts are empty; the empty text has a fingerprint like any other. Equal canonical forms have
    equal fingerprints, different ones different fingerprints; the likeness of two is 1 if they are equal, else 0.
    Repeated rows and ties of doc_id follow each other by text. A null doc_id comes first. A table of one row is its own
    neighbour; an empty table gives no rows. Other columns are not read.
    """
    rows = with_next(docs).withColumn("changed", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", "value", "next_value", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("changed", "UTF-8"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("a"), canonical(F.col("changed")).alias("b"), canonical(F.col("next_text")).alias("c"))
    prove = lambda c: F.struct(wide_hash(F.col(c)).alias("key"), F.octet_length(c).alias("size"), F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 32).alias("proof")).alias(c)
    rows = cut(rows.select("doc_id", "value", "next_value", "n_chars", "edited_sha256", prove("a"), prove("b"), prove("c")))
    release(docs.sparkSession)
    mixed = cut(mixed_keys(docs, rows))
    release(docs.sparkSession)
    like = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    marked = None if mixed.isEmpty() else resolve(rows.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").join(mixed, "key", "left_semi")).where("fingerprint <> key")
    for c in "abc":
        if marked is None:  # every key stands for one text, so it is the fingerprint
            rows = rows.withColumn(f"f{c}", F.col(c)["key"])
            continue
        # buckets of one text need no mark, so only marked ones are joined
        found = marked.select(F.struct("key", "size", "proof").alias(f"k{c}"), F.col("fingerprint").alias(f"f{c}"))
        rows = rows.join(found, F.col(c) == F.col(f"k{c}"), "left").withColumn(f"f{c}", F.coalesce(f"f{c}", F.col(c)["key"]))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("fa").alias("fingerprint"), F.col("fb").alias("edited_fingerprint"), like("fa", "fb").alias("near_edited"), like("fa", "fc").alias("near_next"), F.col("fc").alias("next_fingerprint"))
