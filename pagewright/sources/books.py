"""Book files: listing them and turning them into page rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as tx
from pagewright.operators.boilerplate import drop_boilerplate
from pagewright.operators.generation import RateLimited
from pagewright.plans.materialize import materialize
from pagewright.plans.once import with_once

#: Page rows handed to Spark at a time while one file is being read.
_PAGES_AT_ONCE = 256
_PAGES = "path string, page_number int, text string, images array<binary>, error string"


class PageExtractor(Protocol):
    """Reads one file: (text layer, page images) per page, in order."""

    def pages(self, content: bytes) -> Iterable[tuple[str, list[bytes]]]: ...


class ImageReader(Protocol):
    """Reads the text of one page image; ``""`` when it cannot."""

    def read(self, image: bytes) -> str: ...


class PdfExtractor:
    """Text layer and embedded images of a PDF, when a PDF library is installed."""

    def pages(self, content: bytes) -> Iterator[tuple[str, list[bytes]]]:
        try:
            from io import BytesIO

            from pypdf import PdfReader
        except ImportError as error:
            raise RuntimeError("reading PDF files needs the pypdf library") from error
        for page in PdfReader(BytesIO(content)).pages:
            text = page.extract_text() or ""
            yield text, [] if text.strip() else [image.data for image in page.images]


def list_files(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Book files under ``root``, at any depth; contents are read only when selected."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
    )


def extract_or_report(files: DataFrame, make_extractor: Callable[[], PageExtractor] = PdfExtractor) -> DataFrame:
    """One row per page of every file; pages leave the task in small batches.

    A file that cannot be read to its end leaves, besides the pages before, a row
    with page number 0 and the ``error``; the other files go on.
    """
    names = [c.split()[0] for c in _PAGES.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make_extractor()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    for number, (text, images) in enumerate(extractor.pages(content), start=1):
                        rows.append((path, number, text, images, None))
                        if len(rows) == _PAGES_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as failure:
                    rows.append((path, 0, None, None, f"{type(failure).__name__}: {failure}"))
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(read, _PAGES)


def extract_pages(files: DataFrame, make_extractor: Callable[[], PageExtractor] = PdfExtractor) -> DataFrame:
    """The pages of :func:`extract_or_report`, without its errors."""
    return extract_or_report(files, make_extractor).where(F.col("error").isNull()).drop("error")


class FallbackReader:
    """Readers in order: a rate-limited one passes the image on, any other failure reads nothing.

    One image that cannot be read leaves its page as it is; the others go on.
    """

    def __init__(self, makers: list[Callable[[], ImageReader]]) -> None:
        self.readers = [make() for make in makers]

    def read(self, image: bytes) -> str:
        for reader in self.readers:
            try:
                return reader.read(image) or ""
            except RateLimited:
                continue
            except Exception:
                return ""
        return ""


def read_images(pages: DataFrame, make_reader: Callable[[], ImageReader], *others: Callable[[], ImageReader]) -> DataFrame:
    """Fill blank text layers from the page images, by the first reader that has quota left.

    Only pages to be read are dealt out anew, each on its own, so one long scanned
    book is spread over all tasks; pages with text stay where they are.
    """

    @F.pandas_udf("string")
    def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = FallbackReader([make_reader, *others])
        for images in batches:
            yield images.map(
                lambda found: "\n".join(t for t in map(reader.read, found) if t.strip()),
                na_action="ignore",
            )

    pages = materialize(pages, "pages-with-images")
    wanted = tx.is_blank(F.col("text")) & (F.size("images") > 0)
    blank = pages.where(wanted).repartition("path", "page_number").withColumn("text", recognise(F.col("images")))
    return pages.where(~F.coalesce(wanted, F.lit(False))).unionByName(blank).drop("images")


def clean_pages(pages: DataFrame, book: str = "path", strip_boilerplate: bool = True) -> DataFrame:
    """Cleaned pages without running headers; pages left blank are dropped."""
    cleaned = with_once(pages, "text", tx.clean_text(F.col("text")))
    if strip_boilerplate:
        cleaned = drop_boilerplate(cleaned, book, "page_number", "text")
    return cleaned.where(F.col("text") != "")
