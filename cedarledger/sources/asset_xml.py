"""Asset-level XML to loans with nested properties, and the values that could not be read.

A document is parsed as a whole, so a loan knows its place in it; elements are matched by local name in any namespace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.text import any_date

_LEAVES = {**S.PROPERTY_STRINGS, **S.PROPERTY_INTS, **S.PROPERTY_AMOUNTS}
_PROPERTY_NAMES = sorted(
    {
        *_LEAVES.values(), *S.SECURITIZATION_DATES.values(), *S.SECURITIZATION_AMOUNTS.values(),
        *S.RECENT_DATES.values(), *S.RECENT_AMOUNTS.values()
    }
)
_LOAN_NAMES = sorted({*S.LOAN_STRINGS.values(), *S.LOAN_DATES.values(), *S.LOAN_AMOUNTS.values(), S.ADVANCES})
_PROPERTY = "array<struct<" + ", ".join(f"`{n}`: string" for n in _PROPERTY_NAMES) + ">>"
_ASSET = "assets array<struct<" + ", ".join(f"`{n}`: string" for n in _LOAN_NAMES) + f", property: {_PROPERTY}>>"
_RAW = "assets array<map<string, string>>"
_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}


def _leaf(row: Column, name: str) -> Column:
    """An element's text; blank counts as absent."""
    return F.nullif(F.trim(row[name]), F.lit(""))


def _amount(raw: Column) -> Column:
    return raw.try_cast("decimal(20,8)")


def _coarse(raw: Column) -> Column:
    """More than eight decimals: the typed value is rounded."""
    return F.length(F.regexp_extract(raw, r"\.([0-9]*)", 1)) > 8


def _struct(row: Column, dates: dict, amounts: dict) -> Column:
    return F.struct(
        *(any_date(_leaf(row, n)).alias(c) for c, n in dates.items()),
        *(_amount(_leaf(row, n)).alias(c) for c, n in amounts.items())
    )


def _property(p: Column) -> Column:
    reported = F.lit(False)
    for n in (*S.RECENT_DATES.values(), *S.RECENT_AMOUNTS.values()):
        reported |= _leaf(p, n).isNotNull()
    return F.struct(
        *(
            F.coalesce(_leaf(p, n), F.lit("")).alias(c) if c == "property_name" else _leaf(p, n).alias(c) for c, n in S.PROPERTY_STRINGS.items()
        ),
        *(
            _leaf(p, n).try_cast("int").alias(c) for c, n in S.PROPERTY_INTS.items()
        ), *(_amount(_leaf(p, n)).alias(c) for c, n in S.PROPERTY_AMOUNTS.items()),
        _struct(p, S.SECURITIZATION_DATES, S.SECURITIZATION_AMOUNTS).alias("at_securitization"), F.when(
            reported, _struct(p, S.RECENT_DATES, S.RECENT_AMOUNTS)
        ).alias("most_recent"),
    )


def _issues(row: Column, dates: dict, amounts: dict, ints: dict) -> list[Column]:
    out = []
    for c, n in dates.items():
        raw = _leaf(row, n)
        out.append(
            F.when(
                raw.isNotNull() & any_date(raw).isNull(),
                F.struct(
                    F.lit(c).alias("field_name"), F.lit("could not read date").alias("message"), raw.alias("raw_value")
                )
            )
        )
    for c, n in amounts.items():
        raw = _leaf(row, n)
        bad, rounded = raw.isNotNull() & _amount(raw).isNull(), raw.isNotNull() & _coarse(raw)
        out.append(
            F.when(
                bad | rounded,
                F.struct(
                    F.lit(c).alias("field_name"),
                    F.when(bad, "could not read number").otherwise("more than eight decimals").alias("message"),
                    raw.alias("raw_value")
                )
            )
        )
    for c, n in ints.items():
        raw = _leaf(row, n)
        out.append(
            F.when(
                raw.isNotNull() & raw.try_cast("int").isNull(),
                F.struct(
                    F.lit(c).alias("field_name"), F.lit("could not read whole number").alias("message"),
                    raw.alias("raw_value")
                )
            )
        )
    return out


def parsed(documents: DataFrame, text: str = "value", raw: bool = True) -> DataFrame:
    """documents: cik, accession_number, text, and a source struct if known. One row per loan, with its issues as an
    array. Without raw the text is parsed once, not twice, and raw_fields is left out.
    """
    known = "source" in documents.columns
    both = documents.select(
        "cik", "accession_number", F.col("source") if known else F.lit(None).cast(S.SOURCE).alias("source"),
        F.from_xml(F.col(text), _ASSET, _OPTIONS)["assets"].alias("typed"),
        *([F.from_xml(F.col(text), _RAW, _OPTIONS)["assets"].alias("raw")] if raw else []),
    )
    each = both.select(
        "cik", "accession_number", "source", F.posexplode(F.arrays_zip("typed", *["raw"] * raw)).alias("doc_position", "z")
    ).select("*", F.col("z.typed").alias("t"), *([F.col("z.raw").alias("r")] if raw else []))
    t = F.col("t")
    properties = F.coalesce(t["property"], F.array())
    asset = F.coalesce(_leaf(t, "assetNumber"), F.lit(""))
    path = F.concat(F.lit("assets[assetNumber="), asset, F.lit("]"))
    own = F.filter(F.array(*_issues(t, S.LOAN_DATES, S.LOAN_AMOUNTS, {})), lambda i: i.isNotNull())
    nested = F.flatten(
        F.transform(
            properties,
            lambda p: F.filter(
                F.array(
                    *_issues(
                        p, S.SECURITIZATION_DATES | S.RECENT_DATES,
                        S.SECURITIZATION_AMOUNTS | S.RECENT_AMOUNTS | S.PROPERTY_AMOUNTS, S.PROPERTY_INTS
                    )
                ),
                lambda i: i.isNotNull()
            )
        )
    )
    return each.select(
        "cik", "accession_number", "doc_position", *(
            asset.alias(c) if c == "asset_number" else _leaf(t, n).alias(c) for c, n in S.LOAN_STRINGS.items()
        ), *(any_date(_leaf(t, n)).alias(c) for c, n in S.LOAN_DATES.items()),
        *(
            _amount(_leaf(t, n)).alias(c) for c, n in S.LOAN_AMOUNTS.items()
        ), F.transform(properties, _property).alias("properties"),
        *([
            F.map_filter(
                F.transform_values("r", lambda k, v: F.trim(v)), lambda k, v: (k != "property") & v.isNotNull() & (v != "")
            ).alias("raw_fields")
        ] if raw else []),
        F.struct(
            *(
                path.alias("field_path") if f.name == "field_path" else F.col("source")[f.name].alias(f.name) for f in S.SOURCE
            )
        ).alias("source"), F.concat(own, nested).alias("issues"),
    )


def loans(parsed_: DataFrame) -> DataFrame:
    return parsed_.drop("issues")


def issues(parsed_: DataFrame) -> DataFrame:
    return parsed_.select(
        "cik", "accession_number", "asset_number", F.explode("issues").alias("i")
    ).select("cik", "accession_number", "asset_number", "i.*")
