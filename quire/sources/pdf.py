"""A Spark data source for folders of documents: `spark.read.format("quire_pdf").option("view", ...).load(folder)`.

Files that cannot be read give no rows in the views of pages, runs and images; the view `errors` names them and says why.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VIEWS = {
    "pages": "path string, page int, width double, height double",
    "runs": "path string, page int, item_index int, text string, x double, y double, width double, font_size double, font string",
    "errors": "path string, error string, detail string",
    "images": "path string, page int, name string, width int, height int, bits int, filter string, space string, stored long, is_mask boolean",
}


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.view, self.folder = options.get("view", "pages"), options["path"]
        self.files_per_task = int(options.get("filesPerTask", 64))

    def _fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder)

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, root = self._fs()
        names = sorted(f.path for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.is_file and f.path.lower().endswith(".pdf"))
        return [_File(names[k : k + self.files_per_task]) for k in range(0, len(names), self.files_per_task)] or [_File([])]

    def read(self, partition: _File) -> Iterator[tuple]:
        from quire.pdf.objects import Document, PdfError
        from quire.pdf.text import page_images, page_runs

        fs, _ = self._fs()
        for path in partition.paths:
            with fs.open_input_stream(path) as stream:
                data = stream.read()
            try:
                doc = Document.open(data)
                failed = "" if doc.pages() else "no pages"
            except PdfError as error:
                failed = str(error) or "unreadable"
            if self.view == "errors":
                if failed:
                    yield path, "E_EMPTY_FILE" if not data else "E_CORRUPT" if b"%PDF" in data[:1028] else "E_NOT_PDF", failed
                continue
            if failed:
                continue
            for n, page in enumerate(doc.pages(), 1):
                if self.view == "pages":
                    yield (path, n, *doc.box(page))
                elif self.view == "runs":
                    for r in page_runs(doc, page):
                        yield path, n, r["item_index"], r["text"], r["x"], r["y"], r["width"], r["font_size"], r["font"]
                else:
                    for i in page_images(doc, page):
                        yield path, n, i["name"], i["width"], i["height"], i["bits"], i["filter"], i["space"], i["stored"], i["is_mask"]


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pdf"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "pages")]

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(dict(self.options))


def register(spark: SparkSession) -> None:
    from quire.ship import ship

    ship(spark)
    spark.dataSource.register(PdfSource)
