"""Sources: tables of documents, file snapshots, manifests, parser evidence, pages of PDF files where a parser is there."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from variorum.functions import text as T

BLOCK = "struct<page_number:int,kind:string,text:string,bbox:array<double>,reading_order:int>"
GOLD = (
    "schema_version int, minimum_distinct_families int, cases array<struct<id:string,family:string,required:boolean,"
    "old:struct<path:string,start_page:int,end_page:int>,new:struct<path:string,start_page:int,end_page:int>,oracle_complete:boolean,"
    "expected_events:array<struct<id:string,kind:string,old:string,new:string,old_page:int,new_page:int,location:string,occurrences:int,critical:boolean,reader_visible:boolean>>>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """Files with their digest: path, size, sha. The bytes stay in the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), "content")


def gold_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) of a gold manifest: ids must be there and unique, pages must be ranges, counts positive."""
    cases = spark.read.schema(GOLD).json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    repeated = cases.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    checked = cases.join(repeated, "id", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("id").isNull(), "no_id"),
            F.when(F.col("_n") > 1, "repeated_id"),
            F.when(F.col("old.end_page") < F.col("old.start_page"), "old_range"),
            F.when(F.col("new.end_page") < F.col("new.start_page"), "new_range"),
            F.when(F.exists("expected_events", lambda e: F.coalesce(e["occurrences"], F.lit(1)) < 1), "occurrences"),
            F.when(F.exists("expected_events", lambda e: ~e["kind"].isin("modified", "added", "deleted")), "kind"),
        )
    )
    return cases, checked.select("id", problems.alias("problems")).filter(F.size("problems") > 0)


def parser_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Frozen output of a parser, one document to a line: sha, blocks -> one row for each block."""
    docs = spark.read.schema(f"sha string, complete boolean, blocks array<{BLOCK}>").json(path)
    return docs.select("sha", "complete", F.posexplode("blocks").alias("block_no", "b")).select("sha", "complete", "block_no", F.col("b.page_number").alias("page_no"), "b.kind", "b.text")


def html_lines(pages: DataFrame) -> DataFrame:
    """Text lines of HTML pages: page_id, line_no, line. Headings h1 to h6 carry their level as ``tag_level``."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6]|/title)\b[^>]*>", "\n")
    told = pages.select("page_id", F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))
    level = F.regexp_extract("raw", r"(?i)<h([1-6])\b", 1).try_cast("int")
    plain = F.regexp_replace("raw", r"<[^>]*>", " ")
    for code, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    return told.select("page_id", "line_no", level.alias("tag_level"), T.collapsed(plain).alias("line")).filter("line <> ''")


class PdfPages(DataSource):
    """``spark.read.format("pdf_pages").option("path", ...).option("pages_per_task", 16)``: path, page_no, text, total_pages.

    Needs the pypdf package on the executors; a range of pages is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, page_no int, text string, total_pages int"

    def reader(self, schema) -> DataSourceReader:
        return _PdfReader(self.options)


class _PdfReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        from pypdf import PdfReader

        step = int(self.options.get("pages_per_task", "16"))
        path = self.options["path"]
        total = len(PdfReader(path).pages)
        first, last = int(self.options.get("start_page", "1")), int(self.options.get("end_page", str(total)))
        return [InputPartition((path, k, min(last, k + step - 1), total)) for k in range(first, last + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pypdf import PdfReader

        path, first, last, total = partition.value
        pages = PdfReader(path).pages
        for k in range(first, last + 1):
            yield path, k, pages[k - 1].extract_text() or "", total


def uncached(pages: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Pages whose recognition isn't in the cache table yet: keyed by pixels, settings, language and engine."""
    return pages.join(cache.select(*key), key, "left_anti")


def merged_observations(native: DataFrame, seen: DataFrame, page: list[str]) -> DataFrame:
    """Two readings of a page's lines in one: native lines first, then those of the other that native lacks, in order."""
    extra = seen.join(native.select(*page, "line"), [*page, "line"], "left_anti")
    return native.withColumn("origin", F.lit("native")).unionByName(extra.withColumn("origin", F.lit("ocr")))
