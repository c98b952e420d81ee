"""Filing lists, documents inside submissions, and exhibits as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import any_date, cik

_LISTS = ("accessionNumber", "filingDate", "reportDate", "form", "primaryDocument")
_RECENT = ", ".join(f"{c}: array<string>" for c in _LISTS)
SUBMISSIONS = f"name string, cik string, filings struct<recent: struct<{_RECENT}>, files: array<struct<name: string>>>"
CONTINUATION = _RECENT.replace(":", "")


def submissions(spark: SparkSession, path: str, forms: list[str] | None = None) -> DataFrame:
    """Filings of column-oriented submission files, oldest first: cik, deal_name, accession_number, form_type,
    filing_date, report_date, primary_document, seq.

    Long lists go on in further files, which the main one names and which lie beside it: they are read too.
    """
    each = spark.read.schema(
        f"{SUBMISSIONS}, {CONTINUATION}"
    ).json(path, multiLine=True).withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return filings(each.filter("filings IS NOT NULL"), forms, each.filter("filings IS NULL"))


def filings(raw: DataFrame, forms: list[str] | None = None, further: DataFrame | None = None) -> DataFrame:
    """further: continuation files (file, and the lists as columns) that filings.files of raw may name; what no list names
    is left out. They come after the main list, in the order of their names; of an accession number that a
    deal lists twice the first row counts.
    """
    zipped = lambda at: F.arrays_zip(*(F.col(at + c).alias(c) for c in _LISTS))
    deal = [cik(F.col("cik")).alias("cik"), F.col("name").alias("deal_name")]
    each = raw.select(*deal, F.lit("").alias("file"), F.posexplode(zipped("filings.recent.")).alias("pos", "f"))
    if further is not None:
        named = raw.select(*deal, F.explode("filings.files.name").alias("file")).distinct()
        rest = further.select("file", F.posexplode(zipped("")).alias("pos", "f"))
        both = each.unionByName(rest.join(named, "file").select(*each.columns))
        first = Window.partitionBy("cik", "f.accessionNumber").orderBy("file", "pos")
        each = both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    out = each.select(
        "cik", "deal_name", F.col("f.accessionNumber").alias("accession_number"), F.col("f.form").alias("form_type"), any_date(F.col("f.filingDate")).alias("filing_date"),
        any_date(F.col("f.reportDate")).alias("report_date"), F.col("f.primaryDocument").alias("primary_document"), "file", "pos",
    )
    if forms is not None:
        out = out.filter(F.col("form_type").isin(*forms))
    # equal dates keep the order of the list
    return out.withColumn(
        "seq", F.row_number().over(Window.partitionBy("cik").orderBy("filing_date", "file", "pos"))
    ).drop("file", "pos")


def newest(filings_: DataFrame, n: int = 8) -> DataFrame:
    """The n newest filings of each deal."""
    return filings_.withColumn(
        "_n", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("seq")))
    ).filter(F.col("_n") <= n).drop("_n")


def document_list(texts: DataFrame, key: str = "accession_number", text: str = "value") -> DataFrame:
    """Documents that a submission's text declares: key, seq, document_type, filename; of a repeated filename the first.
    A key without documents has no rows.
    """
    pattern = r"<TYPE>([^\s<]+)[\s\S]*?<FILENAME>([^\s<]+)"
    pair = lambda g: F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(g))
    each = texts.select(
        key, F.posexplode(F.arrays_zip(pair(1).alias("document_type"), pair(2).alias("filename"))).alias("seq", "d")
    )
    each = each.select(
        key, "seq", F.col("d.document_type").alias("document_type"), F.col("d.filename").alias("filename")
    )
    first = Window.partitionBy(key, "filename").orderBy("seq")
    return each.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def submission_documents(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("accession_number"), "value"
    )
    return document_list(texts)


def exhibit(documents: DataFrame, document_type: str, key: str = "accession_number") -> DataFrame:
    """The first document of a type in each filing."""
    return documents.filter(F.col("document_type") == document_type).groupBy(key).agg(
        F.min_by("filename", "seq").alias("filename")
    )


def primary_document(documents: DataFrame, filings_: DataFrame, key: str = "accession_number") -> DataFrame:
    """The document that the filing names as primary, else its first .htm."""
    met = documents.join(filings_.select(key, "primary_document"), key)
    named = F.min(F.when(F.col("filename") == F.col("primary_document"), F.struct("seq", "filename")))["filename"]
    page = F.min(F.when(F.col("filename").endswith(".htm"), F.struct("seq", "filename")))["filename"]
    return met.groupBy(key).agg(F.coalesce(named, page).alias("filename"))


def first_document(documents: DataFrame, document_type: str, key: str = "accession_number") -> DataFrame:
    """The first document of a type in each filing, with all its columns."""
    rest = [c for c in documents.columns if c != key]
    return documents.filter(F.col("document_type") == document_type).groupBy(key).agg(
        F.min_by(F.struct(*rest), "seq").alias("d")
    ).select(key, "d.*")


def exhibits(spark: SparkSession, path: str) -> DataFrame:
    """Files with their checksums: path, size, retrieved_at, checksum, content."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("retrieved_at"),
        F.sha2("content", 256).alias("checksum"), "content"
    )
