"""The driver's tables seen as files, pages, text lines and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a file, its turns are pages."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("page_index"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected pages: every third, some of them twice, and one past each file's end."""
    own = pages(spark, sf_dir)
    some = own.where("(file_id + page_index) % 3 = 0")
    past = own.groupBy("file_id").agg((F.max("page_index") + 5).alias("page_index"))
    return some.unionByName(some.where("page_index = 0")).unionByName(past)


SELECTED = "select distinct conv_id as file_id, turn::int as page_index from conversations where (conv_id + turn) % 3 = 0"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Report: "), F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 2 == 0, ".v1.pdf").otherwise(".PDF"))
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), name.alias("file_name")).distinct()


FILE_NAMES = "select distinct conv_id as file_id, 'Report: ' || conv_id || case when conv_id % 2 = 0 then '.v1.pdf' else '.PDF' end as file_name from conversations"

#: Range specs, among them every corner of the language.
SPECS = ["1-3, 5, 8-", "1-2, 40-50", "99-120", "2-3", "2-4, 8", "8, 2-4", "9-", "", "-", "-5", "0", "3-1", "2-50", "1 - 5", "a", "5-5", "1,1,2", "99999999999999999999", "1-99999999999999999999", "2,,4\t1"]


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SPECS)), "spec_id int, spec string")


SPECS_SQL = "(values " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SPECS)) + ") s(spec_id, spec)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text runs on one page: y falls by 12 a line, a character is 6 wide."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("item_index", "text"))
    return rows.withColumn("y", -12.0 * F.col("item_index")).withColumn("width", 6.0 * F.length("text"))


LINES = "select doc_id as file_id, i - 1 as item_index, list_extract(parts, i) as text from (select doc_id, string_split(text, chr(10)) as parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)"
