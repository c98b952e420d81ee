"""From a landing folder to tables of filings: a run replaces each of its filings in all tables at once, so doing it again changes
nothing, and a re-filing with fewer loans, none, or without issues leaves nothing behind.

A filing that can't be read gives an outcome, not an error; unreadable values give issues.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import content_type_ok
from ..operators import analytics, retrieval, store
from ..schemas import SOURCE
from ..sources import asset_xml, certificates, filings as filing_lists, html

# Forms and exhibits that are read, and content types that a page may have.
REPORT_FORM, REPORT_EXHIBIT, NARRATIVE_FORMS, NEWEST = "10-D", "EX-99.1", ("10-D", "8-K"), 8
HTML_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
CREATED, SKIPPED, FAILED = "created", "skipped", "failed"
#: tables that change together, by the kind of filing that they are read from
TABLES = {
    "assets": ("loans", "issues", "reporting_periods", "outcomes_assets"),
    "reports": ("certificates", "reconciliations", "outcomes_reports"), "narrative": ("chunks", "outcomes_narrative")
}
KIND = {name: kind for kind, names in TABLES.items() for name in names}


def read_documents(spark: SparkSession, path: str, source_name: str = "landing") -> DataFrame:
    """Whole documents under path/<cik>/<accession_number>/<file>, with their provenance."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    source = F.struct(
        F.lit(source_name).alias("source_name"), F.col("path").alias("source_url"),
        F.col("modificationTime").alias("retrieved_at"), F.sha2("content", 256).alias("checksum"),
        part(-2).alias("record_id"), F.lit(None).cast("string").alias("field_path")
    )
    return raw.select(
        part(-3).alias("cik"), part(-2).alias("accession_number"), part(-1).alias("filename"),
        F.decode("content", "UTF-8").alias("value"), source.cast(SOURCE).alias("source")
    )


def asset_filings(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Loans, issues, and an outcome per filing: created, or failed where no loan could be read."""
    parsed = asset_xml.parsed(documents)
    return asset_xml.loans(parsed), asset_xml.issues(parsed), asset_outcomes(documents, parsed)


def asset_outcomes(documents: DataFrame, parsed: DataFrame) -> DataFrame:
    per = parsed.groupBy("cik", "accession_number").agg(
        F.count("*").alias("loan_count"), F.sum(F.size("issues")).alias("issue_count")
    )
    keys = documents.select("cik", "accession_number").distinct()
    status = F.when(F.col("loan_count") > 0, CREATED).otherwise(FAILED)
    return keys.join(per, ["cik", "accession_number"], "left").select(
        "cik", "accession_number", status.alias("status"), F.coalesce("loan_count", F.lit(0)).alias("loan_count"), F.coalesce("issue_count", F.lit(0)).alias("issue_count")
    )


def status_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(*(F.count_if(F.col("status") == s).alias(s) for s in (CREATED, SKIPPED, FAILED)))


def monthly_reports(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificate distributions and reconciliations."""
    grid = html.html_rows(documents.select("accession_number", "value"), "accession_number", "value")
    return certificates.distributions(grid), certificates.reconciliations(grid)


def _first_reason(*reasons) -> Column:
    return F.coalesce(*(F.when(bad, F.lit(reason)) for bad, reason in reasons))


def report_filings(
    filings: DataFrame, documents: DataFrame, n: int = NEWEST, stored: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distributions and reconciliations of the n newest monthly reports of each deal, and an outcome per filing.

    filings: as filings.filings gives them. documents: accession_number, seq, document_type, filename, content_type, value.
    A filing without the exhibit is skipped. One whose page has another content type, no table that is known, or balances that
    don't reconcile has failed and gives no rows; the others are not touched by it. The outcome's plan parses each page once; with
    stored, a folder, the parsed rows are written there first and all three results read them.
    """
    recent = filing_lists.newest(
        filings.filter(F.col("form_type") == REPORT_FORM), n
    ).select("cik", "accession_number", "report_date", "seq")
    page = filing_lists.first_document(documents, REPORT_EXHIBIT).select(
        "accession_number", "filename", "content_type", "value"
    )
    # the planner knows nothing of the length of pages; by its guess it would broadcast them
    met = recent.join(page.hint("merge"), "accession_number", "left").withColumn(
        "typed", content_type_ok(F.col("content_type"), HTML_TYPES)
    )
    grid = html.html_rows(met.filter("filename IS NOT NULL AND typed"), "accession_number", "value")
    if stored:
        grid.write.mode("overwrite").parquet(stored)
        grid = grid.sparkSession.read.parquet(stored)
    dist, rec = certificates.distributions(grid), certificates.reconciliations(grid)
    judged = met.drop("value").join(certificates.findings(grid).hint("merge"), "accession_number", "left")
    missing = F.col("filename").isNull()
    reason = _first_reason(
        (missing, f"no {REPORT_EXHIBIT} exhibit"), (~F.col("typed"), "not a page by its content type"), (
            F.col("class_count").isNull(), "no known table"
        ),
        (~F.col("reconciles"), "balances don't reconcile"),
    )
    outcome = judged.select(
        "cik", "accession_number", "report_date", "seq",
        F.when(missing, SKIPPED).when(reason.isNotNull(), FAILED).otherwise(CREATED).alias("status"),
        reason.alias("reason"), F.coalesce("class_count", F.lit(0)).alias("class_count")
    )
    good = outcome.filter(F.col("status") == CREATED).select("accession_number")
    return dist.join(good, "accession_number", "left_semi"), rec.join(good, "accession_number", "left_semi"), outcome


def narrative_filings(filings: DataFrame, documents: DataFrame, n: int = NEWEST) -> tuple[DataFrame, DataFrame]:
    """Chunks, with the source of their page, of the n newest narrative filings of each deal, and an outcome per filing: created, or skipped with a reason.

    documents as for report_filings, and a source struct.
    """
    recent = filing_lists.newest(filings.filter(F.col("form_type").isin(*NARRATIVE_FORMS)), n).select(
        "cik", "accession_number", "report_date", "seq", "primary_document"
    )
    chosen = filing_lists.primary_document(documents, recent)
    known = [c for c in ("accession_number", "filename", "content_type", "value", "source") if c in documents.columns]
    page = documents.select(*known).join(chosen.hint("merge"), ["accession_number", "filename"]).dropDuplicates(["accession_number"])
    met = recent.join(page.hint("merge"), "accession_number", "left").withColumn(
        "typed", content_type_ok(F.col("content_type"), HTML_TYPES)
    )
    chunks = narrative(met.filter("filename IS NOT NULL AND typed"))
    counts = chunks.groupBy("accession_number").agg(F.count("*").alias("chunk_count"))
    reason = _first_reason(
        (F.col("filename").isNull(), "no page"), (~F.col("typed"), "not a page by its content type"),
        (F.col("chunk_count").isNull(), "no text")
    )
    outcome = met.drop("value").join(counts, "accession_number", "left")
    return chunks, outcome.select(
        "cik", "accession_number", "report_date", "seq",
        F.when(reason.isNull(), CREATED).otherwise(SKIPPED).alias("status"), reason.alias("reason"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )


def narrative(documents: DataFrame, target: int = retrieval.TARGET, overlap: int = retrieval.OVERLAP) -> DataFrame:
    """Chunks of filing text with their vectors, and the source of the page where documents have one."""
    chunks = retrieval.chunk(
        html.html_sections(documents, "accession_number", "value"), "accession_number", target, overlap
    )
    if "source" in documents.columns:
        chunks = chunks.join(documents.select("accession_number", "source"), "accession_number")
    return chunks.withColumn("embedding", retrieval.hashed_embedding(F.col("text")))


def exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deals(filings: DataFrame) -> DataFrame:
    """cik, name (the latest filing's), ingest_seq."""
    return filings.groupBy("cik").agg(F.max_by("deal_name", "seq").alias("name"), F.max("seq").alias("ingest_seq"))


def filing_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages under path/<cik>/<accession_number>/<file>, with the type that the filing's submission text
    (<accession_number>.txt beside them) declares; without one, reports and primary documents by their name.
    """
    pages = read_documents(spark, path)
    texts, rest = pages.filter(F.col("filename").endswith(".txt")), pages.filter(~F.col("filename").endswith(".txt"))
    declared = filing_lists.document_list(texts.select("accession_number", "value"))
    name = F.lower("filename")
    kind = F.when(name.rlike(r"\.html?$"), "text/html").when(name.endswith(".xml"), "text/xml").otherwise("application/octet-stream")
    return rest.join(declared, ["accession_number", "filename"], "left").select(
        "cik", "accession_number", F.coalesce("seq", F.lit(1 << 30)).alias("seq"),
        F.coalesce("document_type", F.lit(REPORT_EXHIBIT)).alias("document_type"), "filename",
        kind.alias("content_type"), "value", "source"
    )


def _outcome_rows(done: DataFrame, kind: str, n: str) -> DataFrame:
    extra = {c: F.lit(None).cast(t) for c, t in (("report_date", "date"), ("reason", "string")) if c not in done.columns}
    return done.withColumns(extra).select(
        "cik", "accession_number", F.lit(kind).alias("kind"), "report_date", "status", "reason", F.col(n).cast("long").alias("n")
    )


def take_assets(documents: DataFrame, tables: str) -> int:
    """Replace the filings of documents in loans, issues, reporting_periods and outcomes_assets; gives the run's number."""
    parsed = asset_xml.parsed(documents).persist(StorageLevel.DISK_ONLY)  # parsed once; a lost part is parsed again
    try:
        return store.commit(
            documents.sparkSession, tables, "assets",
            {
                "loans": asset_xml.loans(parsed), "issues": asset_xml.issues(parsed),
                "reporting_periods": reporting_periods(parsed),
                "outcomes_assets": _outcome_rows(asset_outcomes(documents, parsed), "assets", "loan_count")
            },
            "outcomes_assets"
        )
    finally:
        parsed.unpersist()


def run(spark: SparkSession, landing: str, tables: str) -> DataFrame:
    """Ingest landing/assets, landing/submissions (filing lists), and landing/reports and landing/narrative where they exist; outcomes per asset filing.

    Every filing's outcome is kept with its rows, and both change together; deals and filings are upserted by the run's number.
    Without filing lists every report and page that is there counts as a filing of its deal, in the order of accession numbers.
    """
    documents = read_documents(spark, f"{landing}/assets")
    seq = take_assets(documents, tables)
    listed = None
    if exists(spark, f"{landing}/submissions"):
        listed = filing_lists.submissions(spark, f"{landing}/submissions")
        store.upsert_table(deals(listed).withColumn("ingest_seq", F.lit(seq)), f"{tables}/deals", ["cik"])
        store.upsert_table(
            listed.drop("deal_name").withColumn("ingest_seq", F.lit(seq)), f"{tables}/filings", ["accession_number"],
            ["ingest_seq", "seq"]
        )
    for kind in ("reports", "narrative"):
        if not exists(spark, f"{landing}/{kind}"):
            continue
        pages = filing_documents(spark, f"{landing}/{kind}")
        filings = listed if listed is not None else _as_filings(
            pages, REPORT_FORM if kind == "reports" else NARRATIVE_FORMS[0]
        )
        if kind == "reports":
            parsed = f"{tables}/parsing/{seq}"
            dist, rec, done = report_filings(filings, pages, stored=parsed)
            written = {"certificates": dist, "reconciliations": rec}
        else:
            chunks, done = narrative_filings(filings, pages)
            written = {"chunks": chunks}
        of = filings.select("cik", "accession_number").distinct()
        outputs = {name: out.join(of, "accession_number") for name, out in written.items()}
        n = "class_count" if kind == "reports" else "chunk_count"
        store.commit(
            spark, tables, kind, outputs | {f"outcomes_{kind}": _outcome_rows(done, kind, n)}, f"outcomes_{kind}"
        )
        if kind == "reports":
            store.removed(spark, parsed)
    return store.current(spark, tables, "outcomes_assets", "assets").filter(F.col("ingest_seq") == seq)


def _as_filings(pages: DataFrame, form: str) -> DataFrame:
    each = pages.groupBy("cik", "accession_number").agg(F.min_by("filename", "seq").alias("primary_document"))
    return each.select(
        "cik", "accession_number", F.lit(form).alias("form_type"), F.lit(None).cast("date").alias("report_date"),
        "primary_document", F.row_number().over(Window.partitionBy("cik").orderBy("accession_number")).alias("seq")
    )


def reporting_periods(loans: DataFrame) -> DataFrame:
    """One per filing, from its first loan; consistent tells whether all loans agree."""
    p = F.struct("period_beginning_date", "period_ending_date")
    return loans.groupBy("cik", "accession_number").agg(
        F.min_by(p, "doc_position").alias("p"),
        (F.count_distinct(F.coalesce(F.col("period_ending_date").cast("string"), F.lit(""))) == 1).alias("consistent")
    ).select("cik", "accession_number", "p.*", "consistent")


def latest_pair(loans: DataFrame, cik: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots of a deal's last two periods, earlier first; both the only one's where there is one."""
    own = loans.filter(F.col("cik") == cik)
    periods = reporting_periods(own).select(
        "cik", "accession_number", F.col("period_ending_date").alias("report_date"),
        F.col("accession_number").alias("seq")
    )
    # two rows at most
    last = {
        r["recency"]: r["accession_number"] for r in analytics.latest_periods(periods).select("recency", "accession_number").collect()
    }
    pick = lambda i: own.filter(F.col("accession_number") == last.get(i, last.get(1)))
    return pick(2), pick(1)


class DealNotFound(LookupError):
    pass


class InsufficientPeriods(ValueError):
    pass


def both_periods(loans: DataFrame, cik: str) -> tuple[DataFrame, DataFrame]:
    """As latest_pair, but refuses a deal that is unknown or has one period only."""
    n = loans.filter(F.col("cik") == cik).select("accession_number").distinct().limit(2).count()
    if n == 0:
        raise DealNotFound(cik)
    if n == 1:
        raise InsufficientPeriods(cik)
    return latest_pair(loans, cik)
