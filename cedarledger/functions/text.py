"""Column functions on identifiers, money, numbers in prose and untrusted text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as an instruction hidden in a filing, and what replaces it.
INJECTION = (
    r"(?i)\b(ignore (the )?(previous|above) instructions?|system\s*:|you are now|"
    r"disregard (all|any) (prior|previous) (instructions?|rules)|new instructions?:)"
)
REDACTED = "[redacted directive-like text]"
# Hosts that citations may name.
CITATION_PREFIXES = ("https://www.sec.gov/", "https://data.sec.gov/")
NUMBER = r"\d[\d,]*\.?\d*"
LOAN_REFERENCE = r"(?i)\bloans?[\s_#]*(\d+)\b"
SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), "^ | $", "")


def cik(raw: Column) -> Column:
    """Ten digits with leading zeros; null for what isn't a number. Longer numbers stay as they are."""
    c = F.trim(raw)
    return F.when(c.rlike("^[0-9]+$"), F.when(F.length(c) < 10, F.lpad(c, 10, "0")).otherwise(c))


def accession(raw: Column) -> Column:
    """dddddddddd-dd-dddddd, from 18 digits with or without hyphens; else null."""
    d = F.replace(F.trim(raw), F.lit("-"), F.lit(""))
    return F.when(d.rlike("^[0-9]{18}$"), F.regexp_replace(d, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3"))


def submission_url(cik_: Column, accession_: Column) -> Column:
    short = F.regexp_replace(cik_, "^0+", "")
    return F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), short, F.lit("/"),
        F.replace(accession_, F.lit("-"), F.lit("")), F.lit("/"), accession_, F.lit(".txt")
    )


def money(x: Column) -> Column:
    """$70,000,000.00, half to even; n/a for null."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(x, 2)), F.lit("n/a"))


def compact_money(x: Column) -> Column:
    """$1.23B, $1.23M, $1.2K or whole dollars."""
    size = F.abs(x)
    return (
        F.when(x.isNull(), "n/a").when(size >= 1e9, F.concat(F.lit("$"), F.format_number(x / 1e9, 2), F.lit("B")))
        .when(size >= 1e6, F.concat(F.lit("$"), F.format_number(x / 1e6, 2), F.lit("M"))).when(
            size >= 1e3, F.concat(F.lit("$"), F.format_number(x / 1e3, 1), F.lit("K"))
        )
        .otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def scrub(text: Column) -> Column:
    return F.regexp_replace(text, INJECTION, REDACTED)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def plain_number(token: Column) -> Column:
    """Without separators, and without zeros that end a fraction."""
    bare = F.regexp_replace(token, "[,$]", "")
    cut = F.when(
        F.contains(bare, F.lit(".")), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.+$", "")
    ).otherwise(bare)
    return F.when(cut == "", "0").otherwise(cut)


def loan_references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LOAN_REFERENCE), F.lit(1))


def loan_in_question(question: Column) -> Column:
    """Number after the word loan, or null."""
    return F.nullif(F.regexp_extract(question, r"(?i)\bloan\s+(\d+)\b", 1), F.lit(""))


def fact_form(text: Column) -> Column:
    """Lower case, with the nouns loan and property in the singular."""
    return F.lower(
        F.regexp_replace(
            F.regexp_replace(text, r"(?i)\b(loan)(?:s|ies)\b", "$1"), r"(?i)\bpropert(?:s|ies)\b", "property"
        )
    )


def property_list(names: Column, shown: int = 3) -> Column:
    more = F.size(names) - shown
    return F.when(more <= 0, F.concat_ws(", ", names)).otherwise(
        F.concat(
            F.concat_ws(", ", F.slice(names, 1, shown)), F.lit(" and "), more.cast("string"), F.lit(" more properties")
        )
    )


def citation_ok(url: Column) -> Column:
    return F.startswith(url, F.lit(CITATION_PREFIXES[0])) | F.startswith(url, F.lit(CITATION_PREFIXES[1]))


def fetch_ok(url: Column, host: str = "www.sec.gov") -> Column:
    """https, the one host, and no parent folder in the path."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.coalesce(
        (part("PROTOCOL") == "https") & (part("HOST") == host) & ~F.array_contains(
            F.split(F.coalesce(part("PATH"), F.lit("")), "/"), ".."
        ),
        F.lit(False)
    )


def content_type_ok(content_type: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a declared content type names one of the allowed ones, whatever parameters follow it; undeclared is not
    allowed.
    """
    return F.coalesce(has_any(content_type, allowed), F.lit(False))


def chunk_id(accession_: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", accession_, start.cast("string"), end.cast("string")), 256), 1, 16)


def clean_class(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"\*+$", ""))


def clean_cusip(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), "[^A-Z0-9]", "")


def report_text(raw: Column) -> Column:
    """A report's cell as a number's text; null where the report shows that there is none."""
    bare = F.trim(F.regexp_replace(raw, "[,$%]", ""))
    return F.when(
        raw.isNull() | raw.isin("", "--", "N/A"), None
    ).otherwise(F.regexp_replace(bare, r"^\((.*)\)$", "-$1"))


def report_decimal(raw: Column, percent: bool = False) -> Column:
    x = report_text(raw).try_cast("decimal(20,8)")
    return (x / 100).cast("decimal(20,8)") if percent else x


def report_issue(raw: Column) -> Column:
    """Whether a cell has text that isn't a number."""
    return report_text(raw).isNotNull() & report_text(raw).try_cast("decimal(20,8)").isNull()


def any_date(raw: Column) -> Column:
    """Month-day-year first, then ISO with and without hyphens; else null."""
    c = F.nullif(F.trim(raw), F.lit(""))
    return F.coalesce(*(F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in ("M-d-yyyy", "yyyy-MM-dd", "yyyyMMdd")))


def has_any(text: Column, keywords: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out |= F.contains(text, F.lit(k))
    return out
