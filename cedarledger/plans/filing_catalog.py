"""Queries on filings, reports, storage and evidence over the given tables, each with its SQL.

A deal is a customer (or, where many loans are needed, a nation), a filing an order, a document what is written around an
order's values. Some documents are made wrong on purpose, by remainders of their key, so that every outcome occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from ..functions.spread import spread
from ..operators import analytics as A, citations, retrieval, store, verify
from ..sources import asset_xml, certificates, filings, html
from . import ingest, proxy
from .proxy import AFTER, BEFORE, table

_SQL = proxy.sql()


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def _row(*cells) -> Column:
    return _tag("tr", F.concat(*(_tag("td", c if isinstance(c, Column) else F.lit(c)) for c in cells)))


# ---- filings and their outcomes


def _filings(spark, sf_dir) -> DataFrame:
    """Orders as monthly reports of their customers, numbered by date."""
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(_text("o_custkey").alias("cik"), F.concat(F.lit("Deal "), _text("o_custkey"), F.lit(" as of "), F.col("o_orderpriority")).alias("deal_name"), _text("o_orderkey").alias("accession_number"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "8-K").otherwise("10-D").alias("form_type"),
                    F.col("o_orderdate").cast("date").alias("report_date"), F.lit("main.htm").alias("primary_document"), pos.alias("seq"))


_NUMBERED = "SELECT o_custkey, o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '8-K' ELSE '10-D' END AS form, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders"


def _report_documents(spark, sf_dir) -> DataFrame:
    """Two documents a filing, the second an exhibit for most; every seventh is declared as something else, every
    eleventh has no table, every thirteenth doesn't reconcile.
    """
    k = F.col("o_orderkey")
    zero = ["0.00"] * 7
    detail = F.concat(
        F.lit(f"<table><tr><td>{certificates.DETAIL}</td></tr><tr><td>Class</td><td>CUSIP</td></tr>"),
        _row("A-1", F.concat(F.lit("X"), F.lpad(_text("o_orderkey"), 8, "0")), "1%", "1.00", *zero, "30%", "30%"),
        F.lit("</table>")
    )
    balances = F.concat(
        F.lit(f"<table><tr><td>{certificates.BALANCES}</td></tr>"),
        _row("Beginning Scheduled Collateral Balance", "1.00"),
        _row(
            "Ending Scheduled Collateral Balance", "100.00", "", "Ending Certificate Balance",
            F.when(k % 13 == 0, "101.00").otherwise("100.00")
        ),
        _row("Ending UC / (OC)", "0.00"), F.lit("</table>")
    )
    page = F.when(k % 11 == 0, F.lit("<p>nothing here</p>")).otherwise(F.concat(detail, balances))
    one = lambda seq, kind, name, content, value: F.struct(
        F.lit(seq).alias("seq"), kind.alias("document_type"), F.lit(name).alias("filename"),
        content.alias("content_type"), value.alias("value")
    )
    both = F.array(
        one(0, F.lit("10-D"), "main.htm", F.lit("text/html"), F.lit("<p>cover</p>")),
        one(
            1, F.when(k % 5 == 0, "EX-99.2").otherwise("EX-99.1"), "exhibit.htm",
            F.when(k % 7 == 0, "application/pdf").otherwise("text/html; charset=utf-8"), page
        )
    )
    return table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("accession_number"), F.explode(both).alias("d")
    ).select("accession_number", "d.*")


def report_outcomes(spark, sf_dir):
    """What became of the two newest monthly reports of each deal, and why."""
    _, _, done = ingest.report_filings(_filings(spark, sf_dir), _report_documents(spark, sf_dir), 2)
    return done.select(
        "cik", "accession_number", "status", F.coalesce("reason", F.lit("")).alias("reason"), "class_count"
    )


_REPORT_OUTCOMES = f"""WITH n AS ({_NUMBERED}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seq DESC) AS back FROM n WHERE form = '10-D'),
d AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'no EX-99.1 exhibit' WHEN o_orderkey % 7 = 0 THEN 'not a page by its content type' WHEN o_orderkey % 11 = 0 THEN 'no known table' WHEN o_orderkey % 13 = 0 THEN 'balances don''t reconcile' ELSE '' END AS reason FROM r WHERE back <= 2)
SELECT cast(o_custkey AS varchar) AS cik, cast(o_orderkey AS varchar) AS accession_number, CASE reason WHEN '' THEN 'created' WHEN 'no EX-99.1 exhibit' THEN 'skipped' ELSE 'failed' END AS status, reason,
 cast(CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS bigint) AS class_count FROM d"""


def report_status_counts(spark, sf_dir):
    """Created, skipped and failed monthly reports."""
    return ingest.status_counts(report_outcomes(spark, sf_dir))


_STATUS_COUNTS = f"SELECT count(*) FILTER (WHERE status = 'created') AS created, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed FROM ({_REPORT_OUTCOMES})"


def narrative_outcomes(spark, sf_dir):
    """What became of the eight newest narrative filings of each deal; every third has no text, every seventh is
    declared as something else, every fifth has no page.
    """
    k = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("accession_number"), F.lit(0).alias("seq"), F.lit("8-K").alias("document_type"), F.when(k % 5 == 0, "data.xml").when(k % 2 == 0, "main.htm").otherwise("other.htm").alias("filename"),
        F.when(k % 7 == 0, "application/pdf").otherwise("text/html").alias("content_type"), F.when(k % 3 == 0, "<div> </div>").otherwise("<h1>Item</h1><p>two words</p>").alias("value"),
    )
    _, done = ingest.narrative_filings(_filings(spark, sf_dir), docs)
    return done.select(
        "cik", "accession_number", "status", F.coalesce("reason", F.lit("")).alias("reason"), "chunk_count"
    )


_NARRATIVE_OUTCOMES = f"""WITH n AS ({_NUMBERED}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY seq DESC) AS back FROM n),
d AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'no page' WHEN o_orderkey % 7 = 0 THEN 'not a page by its content type' WHEN o_orderkey % 3 = 0 THEN 'no text' ELSE '' END AS reason FROM r WHERE back <= 8)
SELECT cast(o_custkey AS varchar) AS cik, cast(o_orderkey AS varchar) AS accession_number, CASE reason WHEN '' THEN 'created' ELSE 'skipped' END AS status, reason, cast(reason = '' AS bigint) AS chunk_count FROM d"""


def deal_names(spark, sf_dir):
    """Deals upserted from filing lists: of each the name in its latest filing, over what was stored before."""
    old = table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.lit(0).alias("ingest_seq")
    )
    return store.upsert(old, ingest.deals(_filings(spark, sf_dir)), ["cik"]).select("cik", "name")


_DEAL_NAMES = f"WITH n AS ({_NUMBERED}), d AS (SELECT o_custkey, arg_max('Deal ' || o_custkey || ' as of ' || o_orderpriority, seq) AS name FROM n GROUP BY o_custkey) SELECT cast(coalesce(c_custkey, o_custkey) AS varchar) AS cik, coalesce(name, c_name) AS name FROM customer FULL JOIN d ON o_custkey = c_custkey"


def latest_report(spark, sf_dir):
    """Of each deal the report with the latest date; reports without one come last."""
    o = table(spark, sf_dir, "orders")
    reports = o.select(
        _text("o_custkey").alias("cik"), "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("report_date"),
        F.col("o_orderkey").alias("seq")
    )
    return certificates.latest_report(reports).select("cik", "o_orderkey", _day("report_date").alias("report_date"))


_LATEST_REPORT = "WITH r AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey DESC) AS n FROM r) SELECT cast(o_custkey AS varchar) AS cik, o_orderkey, strftime(d, '%Y-%m-%d') AS report_date FROM n WHERE n = 1"


def reporting_periods(spark, sf_dir):
    """Of each filing (a customer's year) the period of its first loan, and whether all loans agree."""
    day = F.col("o_orderdate").cast("date")
    loans = table(spark, sf_dir, "orders").select(
        _text("o_custkey").alias("cik"), F.concat_ws("-", "o_custkey", F.year(day)).alias("accession_number"),
        F.col("o_orderkey").alias("doc_position"), F.trunc(day, "month").alias("period_beginning_date"),
        F.last_day(day).alias("period_ending_date")
    )
    return ingest.reporting_periods(loans).select(
        "cik", "accession_number", _day("period_beginning_date").alias("beginning"),
        _day("period_ending_date").alias("ending"), "consistent"
    )


_REPORTING_PERIODS = "SELECT cast(o_custkey AS varchar) AS cik, o_custkey || '-' || year(o_orderdate) AS accession_number, strftime(date_trunc('month', arg_min(o_orderdate, o_orderkey)), '%Y-%m-%d') AS beginning, strftime(last_day(arg_min(o_orderdate, o_orderkey)), '%Y-%m-%d') AS ending, count(DISTINCT last_day(o_orderdate)) = 1 AS consistent FROM orders GROUP BY o_custkey, year(o_orderdate)"


def exhibit_choice(spark, sf_dir):
    """Of each filing the exhibit by its type and the page by the name that the filing gives, else the first page."""
    k = F.col("o_orderkey")
    declared = lambda kind, name: F.concat(F.lit("<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<FILENAME>"), name, F.lit("\n"))
    texts = table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("accession_number"),
        F.concat(
            declared(F.lit("8-K"), F.when(k % 2 == 0, "a.htm").otherwise("cover.htm")),
            declared(F.when(k % 3 == 0, "EX-99").otherwise("EX-102"), F.lit("data.xml")),
            declared(F.lit("EX-102"), F.lit("more.xml")), declared(F.lit("EX-1"), F.lit("b.htm"))
        ).alias("value")
    )
    docs = filings.document_list(texts)
    names = table(spark, sf_dir, "orders").select(
        _text("o_orderkey").alias("accession_number"),
        F.when(k % 5 == 0, "b.htm").otherwise("missing.htm").alias("primary_document")
    )
    exhibit = filings.exhibit(docs, "EX-102").withColumnRenamed("filename", "exhibit")
    return exhibit.join(filings.primary_document(docs, names).withColumnRenamed("filename", "page"), "accession_number")


_EXHIBIT_CHOICE = "SELECT cast(o_orderkey AS varchar) AS accession_number, CASE WHEN o_orderkey % 3 = 0 THEN 'more.xml' ELSE 'data.xml' END AS exhibit, CASE WHEN o_orderkey % 5 = 0 THEN 'b.htm' WHEN o_orderkey % 2 = 0 THEN 'a.htm' ELSE 'cover.htm' END AS page FROM orders"


# ---- asset data


def _asset_documents(spark, sf_dir) -> DataFrame:
    """One document a customer, in a namespace with a prefix: a loan an order, with two properties; some values can't be
    read.
    """
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t = lambda n, v: _tag(f"x:{n}", v)
    recent = F.when(
        k % 4 == 0, t("mostRecentRevenueAmount", F.lit("5.00"))
    ).when(k % 4 == 1, t("mostRecentRevenueAmount", F.lit(" "))).otherwise("")
    first = t(
        "property",
        F.concat(t("propertyName", F.lit("North")), t("yearBuiltNumber", F.when(k % 17 == 0, "19x0").otherwise("1990")))
    )
    second = t("property", F.concat(t("propertyName", F.lit("South")), recent))
    one = t(
        "assets",
        F.concat(
            t("assetNumber", _text("o_orderkey")),
            t("reportPeriodEndActualBalanceAmount", F.when(k % 10 == 0, "unknown").otherwise("7.00")),
            t("maturityDate", F.when(k % 6 == 0, "02-30-2030").otherwise("12-31-2030")), first, second
        )
    )
    body = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("x")))), lambda s: s["x"]), ""
    )
    whole = F.concat(F.lit('<x:assetData xmlns:x="urn:x">'), body, F.lit("</x:assetData>"))
    # dealt out while the rows are small: parsing costs more than the documents' bytes say
    docs = spread(o, "o_custkey").groupBy("o_custkey").agg(whole.alias("value"))
    return docs.select(
        _text("o_custkey").alias("cik"), F.concat(F.lit("f"), _text("o_custkey")).alias("accession_number"),
        F.when(F.col("o_custkey") % 9 == 0, "no xml").otherwise(F.col("value")).alias("value")
    )


def asset_issues(spark, sf_dir):
    """Values of asset data that could not be read."""
    return asset_xml.issues(
        asset_xml.parsed(_asset_documents(spark, sf_dir), raw=False)
    ).select("cik", "asset_number", "field_name", "raw_value")


_ASSET_ISSUES = " UNION ALL ".join(
    f"SELECT cast(o_custkey AS varchar) AS cik, cast(o_orderkey AS varchar) AS asset_number, '{name}' AS field_name, '{raw}' AS raw_value FROM orders WHERE o_orderkey % {n} = 0 AND o_custkey % 9 <> 0"
    for name, raw, n in (
        ("actual_balance_amount", "unknown", 10), ("maturity_date", "02-30-2030", 6), ("year_built", "19x0", 17)
    )
)


def asset_outcomes(spark, sf_dir):
    """Status, loans and issues of each asset filing."""
    docs = _asset_documents(spark, sf_dir)
    return ingest.asset_outcomes(docs, asset_xml.parsed(docs)).select(
        "cik", "status", F.col("loan_count").cast("long").alias("loan_count"),
        F.col("issue_count").cast("long").alias("issue_count")
    )


_ASSET_OUTCOMES = "SELECT cast(o_custkey AS varchar) AS cik, CASE WHEN o_custkey % 9 = 0 THEN 'failed' ELSE 'created' END AS status, cast(CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE count(*) END AS bigint) AS loan_count, cast(CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE sum(cast(o_orderkey % 10 = 0 AS int) + cast(o_orderkey % 6 = 0 AS int) + cast(o_orderkey % 17 = 0 AS int)) END AS bigint) AS issue_count FROM orders GROUP BY o_custkey"


def property_rows(spark, sf_dir):
    """Properties by loan, in the order of the document, with what is known of the most recent financials."""
    loans = asset_xml.loans(asset_xml.parsed(_asset_documents(spark, sf_dir)))
    each = loans.select("asset_number", F.posexplode("properties").alias("property_index", "p"))
    return each.select(
        "asset_number", "property_index", F.col("p.property_name").alias("property_name"),
        F.coalesce("p.year_built", F.lit(0)).alias("year_built"),
        F.col("p.most_recent").isNotNull().alias("has_recent"),
        F.col("p.most_recent.revenue_amount").cast("double").alias("revenue")
    )


_PROPERTY_ROWS = """SELECT cast(o_orderkey AS varchar) AS asset_number, 0 AS property_index, 'North' AS property_name, CASE WHEN o_orderkey % 17 <> 0 THEN 1990 ELSE 0 END AS year_built, false AS has_recent, cast(NULL AS double) AS revenue FROM orders WHERE o_custkey % 9 <> 0
UNION ALL SELECT cast(o_orderkey AS varchar), 1, 'South', 0, o_orderkey % 4 = 0, CASE WHEN o_orderkey % 4 = 0 THEN 5.0::double END FROM orders WHERE o_custkey % 9 <> 0"""


def property_lists(spark, sf_dir):
    """Names of a loan's properties as a sentence shows them, and as JSON."""
    each = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.transform(
            F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(F.lit("P"), k.cast("string"))
        ).alias("names")
    )
    return each.select(
        "o_custkey", X.property_list(F.col("names")).alias("shown"),
        F.to_json(F.struct(F.size("names").alias("n"), F.col("names"))).alias("json")
    )


_PROPERTY_LISTS = "WITH n AS (SELECT o_custkey, list('P' || o_orderkey ORDER BY o_orderkey) AS names FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN len(names) <= 3 THEN array_to_string(names, ', ') ELSE array_to_string(names[1:3], ', ') || ' and ' || (len(names) - 3) || ' more properties' END AS shown, '{\"n\":' || len(names) || ',\"names\":[\"' || array_to_string(names, '\",\"') || '\"]}' AS json FROM n"


# ---- certificates


def identifier_cleanup(spark, sf_dir):
    """Certificate identifiers and class names as reports print them."""
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", X.clean_cusip(F.concat("p_brand", F.lit(" "), F.lpad(_text("p_partkey"), 7, "0"))).alias("cusip"),
        X.clean_class(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "**").otherwise(" "))).alias("class_name")
    )


_IDENTIFIER_CLEANUP = "SELECT p_partkey, regexp_replace(upper(p_brand || ' ' || lpad(cast(p_partkey AS varchar), 7, '0')), '[^A-Z0-9]', '', 'g') AS cusip, trim(p_name) AS class_name FROM part"


def certificate_summary(spark, sf_dir):
    """Certificates of reports in the second layout, whose identifiers stand in a table of their own, in one cell or
    two.
    """
    k = _text("c_custkey")
    balance = X.money(F.abs("c_acctbal").cast("decimal(18,2)"))
    digits = F.lpad(k, 8, "0")
    page = F.concat(
        F.lit(
            f"<table><tr><td>Trust</td></tr><tr><td>{certificates.SUMMARY}</td></tr><tr><td>Class</td><td>Pass-Through Rate</td></tr>"
        ), _row("B", balance, balance, "4.5", "%", "30/360", "2.00", "-", "3.00", "5.00", "0.00", "-", "", balance),
        _row("unlisted", *["1.00"] * 13), F.lit(
            f"</table><table><tr><td>{certificates.FACTORS}</td></tr></table><table><tr><td>Class</td><td>CUSIP</td></tr>"
        ),
        _row("B", "old"), F.when(F.col("c_custkey") % 2 == 0, _row("B", F.concat(F.lit("y "), digits), "date")).otherwise(
            _row("B", F.concat(F.lit("Y"), F.substring(digits, 1, 4)), F.substring(digits, 5, 4))
        ), F.lit("</table>"),
    )
    grid = html.html_rows(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("accession_number"), page.alias("html")),
        "accession_number"
    )
    d = certificates.distributions(grid)
    n = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return d.select(
        "accession_number", "class_name", "cusip", n("pass_through_rate"), n("ending_balance"), n("total_distribution")
    )


_CERTIFICATE_SUMMARY = "SELECT c_custkey AS accession_number, 'B' AS class_name, 'Y' || lpad(cast(c_custkey AS varchar), 8, '0') AS cusip, 0.045::double AS pass_through_rate, round(cast(cast(abs(c_acctbal) AS decimal(18,2)) AS double), 6) AS ending_balance, 5.0::double AS total_distribution FROM customer"


def certificate_lookup(spark, sf_dir):
    """Each customer asks about a certificate of its nation's report, by identifier; what other nations have doesn't
    answer.
    """
    c = table(spark, sf_dir, "customer")
    cusip = F.concat(F.lit("X"), F.lpad(_text("c_custkey"), 8, "0"))
    amount = F.col("c_acctbal").cast("decimal(20,8)")
    own = c.select(
        F.col("c_nationkey").alias("accession_number"), F.col("c_custkey").alias("row_idx"),
        F.concat(F.lit("class-"), _text("c_custkey"), F.lit("-")).alias("class_name"), cusip.alias("cusip"),
        *(
            amount.alias(x) for x in (
                "beginning_balance", "principal_distribution", "interest_distribution", "ending_balance"
            )
        )
    )
    asked = F.concat(
        F.lit("What does x"), F.lpad((F.col("c_custkey") + F.col("c_custkey") % 2).cast("string"), 8, "0"),
        F.lit(" pay?")
    )
    q = c.select(
        F.col("c_custkey").alias("question_id"), F.col("c_nationkey").alias("accession_number"), asked.alias("question")
    )
    return certificates.lookup(q, own).select(
        "question_id", "cusip", F.round(F.col("ending_balance").cast("double"), 2).alias("ending_balance")
    )


_CERTIFICATE_LOOKUP = "SELECT q.c_custkey AS question_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'X' || lpad(cast(c.c_custkey AS varchar), 8, '0') END AS cusip, round(c.c_acctbal, 2) AS ending_balance FROM customer q LEFT JOIN customer c ON c.c_nationkey = q.c_nationkey AND c.c_custkey = q.c_custkey + q.c_custkey % 2"


# ---- evidence and drafts


def evidence_sources(spark, sf_dir):
    """Sources of the loans whose status changed, by deal; where none changed, the deal's filings."""
    before, after = proxy.period(spark, sf_dir, BEFORE), proxy.period(spark, sf_dir, AFTER)
    source = F.struct(
        F.concat(F.lit("https://www.sec.gov/"), "accession_number").alias("source_url"),
        F.concat(F.lit("assets["), "asset_number", F.lit("]")).alias("field_path")
    )
    loans = after.select("cik", "asset_number", source.alias("source"), F.col("doc_position").alias("seq"))
    # a nation with an odd number counts as one whose loans did not change
    entries = A.status_changes(before, after).select("cik", "asset_number").filter(F.col("cik").cast("int") % 2 == 0)
    deals = table(spark, sf_dir, "nation").select(F.lpad(_text("n_nationkey"), 10, "0").alias("cik"))
    return citations.evidence_sources(deals, entries, loans, "cik").select(
        "cik", "source_url", F.coalesce("field_path", F.lit("")).alias("field_path"), "position"
    )


_EVIDENCE_SOURCES = _SQL + f""", e AS (SELECT b.cik, b.asset FROM b JOIN a ON a.asset = b.asset WHERE a.status IS DISTINCT FROM b.status AND cast(b.cik AS int) % 2 = 0),
f AS (SELECT cik, 'https://www.sec.gov/' || cik || '-{AFTER}' AS source_url, 'assets[' || asset || ']' AS field_path, cast(asset AS bigint) AS seq FROM b WHERE asset IN (SELECT asset FROM e)
UNION ALL SELECT cik, 'https://www.sec.gov/' || cik || '-{AFTER}', '', min(cast(asset AS bigint)) FROM b WHERE cik NOT IN (SELECT cik FROM e) GROUP BY cik)
SELECT cik, source_url, field_path, cast(row_number() OVER (PARTITION BY cik ORDER BY seq) AS int) AS position FROM f"""


def _drafts(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    evidence = F.concat(F.lit("[totals] loan "), _text("o_orderkey"), F.lit(": status B"))
    named = F.concat(F.lit("Loan "), _text("o_orderkey"), F.lit(" has status B."))
    draft = F.when(k % 4 == 0, named).when(
        k % 4 == 1, F.concat(named, F.lit(" Loan x7700 and loan 987654321 too."))
    ).when(k % 4 == 2, F.repeat(F.lit("the same words again "), 8)).otherwise(F.lit(" "))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", evidence.alias("evidence"), draft.alias("draft"), (k % 8 < 4).cast("int").alias("n_citations")
    )


def draft_verdicts(spark, sf_dir):
    """Why drafts are rejected, and what is answered in their place."""
    d = _drafts(spark, sf_dir)
    found = verify.errors(F.col("draft"), F.col("evidence"), F.lit(True), F.col("n_citations"))
    out = d.withColumn("errors", found)
    return out.select(
        "o_orderkey", F.concat_ws("|", "errors").alias("errors"),
        F.md5(verify.final_answer(F.col("draft"), F.col("evidence"), F.col("errors"))).alias("answer_md5")
    )


def _verdicts() -> str:
    refusal = verify.REFUSAL.replace("'", "''")
    return f"""WITH d AS (SELECT o_orderkey, o_orderkey % 4 AS r, '[totals] loan ' || o_orderkey || ': status B' AS evidence, 'Loan ' || o_orderkey || ' has status B.' AS named FROM orders),
e AS (SELECT *, CASE r WHEN 0 THEN named WHEN 1 THEN named || ' Loan x7700 and loan 987654321 too.' WHEN 2 THEN repeat('the same words again ', 8) ELSE ' ' END AS draft,
 CASE WHEN r = 1 THEN '{verify.NUMBERS}' || array_to_string(list_filter(['7700', '987654321'], lambda x: NOT contains(cast(o_orderkey AS varchar), x) AND NOT contains(x, cast(o_orderkey AS varchar))), ', ') END AS numbers FROM d),
f AS (SELECT *, concat_ws('|', CASE WHEN numbers <> '{verify.NUMBERS}' THEN numbers END, CASE WHEN r = 1 THEN '{verify.LOANS}987654321' END, CASE WHEN r = 2 THEN '{verify.LOOP}' END, CASE WHEN r <> 3 AND o_orderkey % 8 >= 4 THEN '{verify.UNCITED}' END) AS errors FROM e)
SELECT o_orderkey, errors, md5(CASE WHEN errors = '' THEN draft ELSE '{refusal}' || chr(10) || evidence END) AS answer_md5 FROM f"""


# ---- chunks, vectors, content


def section_chunks(spark, sf_dir):
    """Chunks of documents of two sections, none of which goes across both."""
    d = table(spark, sf_dir, "documents")
    part = lambda i, heading, text: F.struct(
        F.lit(i).alias("pos"), F.lit(heading).cast("string").alias("heading"), text.alias("text")
    )
    sections = d.select(
        "doc_id",
        F.explode(F.array(part(0, None, F.lit("  what comes\tfirst ")), part(1, "Item 1", F.col("text")))).alias("s")
    ).select("doc_id", "s.*")
    return retrieval.chunk(sections, "doc_id").select(
        "doc_id", F.coalesce("section_heading", F.lit("")).alias("section_heading"), "start_offset", "end_offset",
        "token_count", F.md5("text").alias("text_md5")
    )


_SECTION_CHUNKS = """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, string_split(t, ' ') AS w FROM c WHERE t <> ''),
e AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) > 800 THEN cast(ceil((len(w) - 800) / 700.0) AS int) * 700 ELSE 0 END + 1, 700)) AS i FROM w),
x AS (SELECT doc_id, 17 + CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1:i], ' ')) + 1 END AS s, array_to_string(w[i + 1:i + 800], ' ') AS t, least(800, len(w) - i) AS n FROM e)
SELECT doc_id, 'Item 1' AS section_heading, cast(s AS bigint) AS start_offset, cast(s + length(t) AS bigint) AS end_offset, cast(n AS int) AS token_count, md5(t) AS text_md5 FROM x
UNION ALL SELECT doc_id, '', 0, 16, 3, md5('what comes first') FROM documents"""


def vector_upsert(spark, sf_dir):
    """An index into which vectors with the next keys are put: all but the first are replaced, one is new."""
    v = table(spark, sf_dir, "embeddings")
    index = v.select("vec_id", F.lit("old").alias("version"), F.col("label").alias("label"))
    return retrieval.upsert(
        index,
        v.select(
            (F.col("vec_id") + 1).alias("vec_id"), F.lit("new").alias("version"), (F.col("label") + 100).alias("label")
        ),
        "vec_id"
    )


_VECTOR_UPSERT = "SELECT vec_id + 1 AS vec_id, 'new' AS version, label + 100 AS label FROM embeddings UNION ALL SELECT vec_id, 'old', label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id + 1 FROM embeddings)"


def vector_delete(spark, sf_dir):
    """An index without the vectors of one filing (a label)."""
    v = table(spark, sf_dir, "embeddings").withColumn(
        "accession_number", F.when(F.col("label") != 0, F.concat(F.lit("f"), _text("label")))
    )
    return retrieval.delete(v, "f1").select("vec_id", "accession_number")


_VECTOR_DELETE = "SELECT vec_id, CASE WHEN label <> 0 THEN 'f' || label END AS accession_number FROM embeddings WHERE label <> 1"


def snapshot_hash(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p/"), _text("page_id")).alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    return store.snapshot_hash(p)


_SNAPSHOT = """WITH f AS (SELECT 'p/' || page_id AS path, sha256(html) AS c FROM pages), g AS (SELECT substr(sha256(path), 1, 4) AS g, sha256(string_agg(path || ':' || c, ',' ORDER BY path || ':' || c)) AS h FROM f GROUP BY 1)
SELECT substr(sha256(string_agg(g || ':' || h, ',' ORDER BY g || ':' || h)), 1, 16) AS snapshot FROM g"""


_QUERIES = {
    report_outcomes: _REPORT_OUTCOMES, report_status_counts: _STATUS_COUNTS, narrative_outcomes: _NARRATIVE_OUTCOMES, deal_names: _DEAL_NAMES, latest_report: _LATEST_REPORT, reporting_periods: _REPORTING_PERIODS,
    exhibit_choice: _EXHIBIT_CHOICE, asset_issues: _ASSET_ISSUES, asset_outcomes: _ASSET_OUTCOMES, property_rows: _PROPERTY_ROWS, property_lists: _PROPERTY_LISTS, identifier_cleanup: _IDENTIFIER_CLEANUP,
    certificate_summary: _CERTIFICATE_SUMMARY, certificate_lookup: _CERTIFICATE_LOOKUP, evidence_sources: _EVIDENCE_SOURCES, draft_verdicts: _verdicts(), section_chunks: _SECTION_CHUNKS, vector_upsert: _VECTOR_UPSERT,
    vector_delete: _VECTOR_DELETE, snapshot_hash: _SNAPSHOT,
}


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _QUERIES.items()}
