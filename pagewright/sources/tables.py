"""Stored inputs and outputs: page cache, offsets, repairs, the chunk table and CSV sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagewright.operators.index import latest
from pagewright.plans.materialize import materialize

PAGES = "page_number int, text string"
REPAIRS = (
    "pages array<struct<grade:int,subject:string,book_title:string,source_file:string,"
    "page:int,text:string,kinds:array<string>>>"
)
_CACHE_PATH = r"/(\d+)/([^/]+)\.json$"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """Whole-file JSON, NULL columns for an unreadable file; None when there is no such path."""
    try:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_page_cache(spark: SparkSession, root: str) -> DataFrame:
    """Pages from ``<root>/<grade>/<book>.json``; unreadable files count as absent."""
    pages = _json(spark, f"{root.rstrip('/')}/*/*.json", PAGES)
    if pages is None:
        return spark.createDataFrame([], "grade int, book string, " + PAGES)
    path = F.url_decode(F.col("_metadata.file_path"))
    return pages.select(
        F.regexp_extract(path, _CACHE_PATH, 1).try_cast("int").alias("grade"),
        F.regexp_extract(path, _CACHE_PATH, 2).alias("book"),
        "page_number",
        "text",
    ).where(F.col("grade").isNotNull() & (F.col("page_number") >= 1) & F.col("text").isNotNull())


#: Pages kept between runs, in folders by grade and book.
CACHED = "page_number int, text string, grade int, book string"


def read_cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the page cache written by :func:`load_through`; none when there is no cache."""
    try:
        return spark.read.schema(CACHED).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], CACHED)
        raise


def load_through(
    books: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], force: bool = False
) -> DataFrame:
    """Pages of ``books`` (grade, book and whatever ``extract`` reads), from the cache where it has them.

    Books the cache lacks (all with ``force``) are given to ``extract``, which returns grade,
    book, page_number and text; their pages replace or join the cache by
    book, and no other book's files are written.  A book whose pages could not
    be read has no page and is extracted again by the next run.  The list of books
    is stored, so that its size is known where pages are joined with it: it is
    broadcast, and no page is shuffled to its book.
    """
    spark = books.sparkSession
    keys = ["grade", "book"]
    books = materialize(books, "books")
    known = read_cached_pages(spark, path).select(*keys).distinct()
    missing = books if force else books.join(known, keys, "left_anti")
    fresh = extract(missing).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(CACHED).fields])
    fresh = materialize(fresh, "extracted-pages")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return read_cached_pages(spark, path).join(books.select(*keys).distinct(), keys, "left_semi")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """source_file, offset of an offsets document; anything but a whole number >= 0 is left out."""
    document = _json(spark, path, "offsets map<string,string>")
    if document is None:
        return spark.createDataFrame([], "source_file string, offset int")
    entries = document.select(F.explode("offsets").alias("source_file", "__raw"))
    whole = F.when(F.col("__raw").rlike(r"^\d+$"), F.col("__raw").try_cast("int"))
    return entries.select("source_file", whole.alias("offset")).where(F.col("offset").isNotNull())


def read_repairs(spark: SparkSession, path: str) -> DataFrame:
    """Saved page repairs; none when there is no such file."""
    document = _json(spark, path, REPAIRS)
    rows = spark.createDataFrame([], REPAIRS) if document is None else document
    return rows.select(F.inline("pages"))


def write_offsets(offsets: DataFrame, path: str) -> None:
    """source_file, offset as one offsets document; it has an entry for each book."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_file", "offset"))))
    offsets.where(F.col("offset").isNotNull()).agg(entries.alias("offsets")).write.mode("overwrite").json(path)


def save_repairs(spark: SparkSession, path: str, repairs: DataFrame, run: int) -> DataFrame:
    """Add the page readings of a run to those saved at ``path``; returns the last one of each page.

    Each run has a folder of its own, so one that is repeated replaces only itself.
    """
    fields = StructType.fromDDL(REPAIRS)["pages"].dataType.elementType.fields
    rows = repairs.select(*[F.col(f.name).cast(f.dataType) for f in fields])
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")
    return saved_repairs(spark, path)


def saved_repairs(spark: SparkSession, path: str) -> DataFrame:
    """The last reading of each page of all runs."""
    fields = StructType.fromDDL(REPAIRS)["pages"].dataType.elementType.fields
    schema = StructType(fields).add("run", "long")
    saved = spark.read.schema(schema).parquet(path)
    return latest(saved, ["source_file", "page"], ["run"]).drop("run")


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The chunk table, laid out by the scope every question filters on."""
    chunks.write.mode(mode).partitionBy("grade", "subject").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Fails when the table does not exist: an empty index would refuse every question."""
    return spark.read.parquet(path)


def one_line(col):
    return F.trim(F.replace(col, F.lit("\n"), F.lit(" ")))


def benchmark_sheet(outcomes: DataFrame) -> DataFrame:
    """Twelve columns for a person to mark; expects ``position`` and scored outcomes."""
    yes_no = lambda c: F.when(c, "có").otherwise("không")
    return outcomes.select(
        F.col("position").alias("stt"),
        F.col("grade").alias("lop"),
        F.col("subject").alias("mon"),
        F.col("question").alias("cau_hoi"),
        yes_no(F.col("in_textbook")).alias("co_trong_sach"),
        yes_no(~F.col("refused")).alias("da_tra_loi"),
        F.col("verdict").alias("ket_qua_tu_dong"),
        F.col("retrieved").alias("so_doan_tra_duoc"),
        F.array_join(F.slice("retrieved_sources", 1, 3), "; ").alias("trang_da_trich"),
        F.array_join(F.col("invented_pages").cast("array<string>"), "; ").alias("trang_bia_dat"),
        F.lit("").alias("dung_sai_nguoi_cham"),
        one_line(F.col("answer")).alias("cau_tra_loi"),
    )


def feedback_sheet(reports: DataFrame) -> DataFrame:
    """Twelve columns, two of them blank; expects the output of ``recent_reports``."""
    return reports.select(
        F.col("report_id").alias("bao_sai_id"),
        F.col("created_at").alias("thoi_diem"),
        F.col("reporter").alias("nguoi_bao"),
        F.col("grade").alias("lop"),
        F.col("subject").alias("mon"),
        F.col("question").alias("cau_hoi"),
        one_line(F.col("answer")).alias("cau_tra_loi"),
        F.coalesce("note", F.lit("")).alias("hoc_sinh_noi_sai_o_dau"),
        F.array_join(F.filter(F.split("citations", "\n"), lambda c: c != ""), "; ").alias("trang_sach"),
        F.when(F.col("grounded") == 1, "có").otherwise("không").alias("tra_loi_duoc_tu_sach"),
        F.lit("").alias("ket_luan_cua_thay_co"),
        F.lit("").alias("noi_dung_dung_theo_sach"),
    )


def write_csv(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", "true").option("quoteAll", "false").csv(path)


def markdown_table(small: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of a small aggregate (at most ``limit`` rows, else an error)."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write a table instead")
    lines = ["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows]
    return "\n".join(lines)
