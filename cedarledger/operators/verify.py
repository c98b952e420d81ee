"""Mechanical checks of drafted answers against computed evidence, as column expressions over a table of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from ..functions.text import loan_references, number_tokens, plain_number

WINDOW = 20  # characters
MOST = 4  # times a window may occur
# Fixed value: how an answer begins that only repeats the evidence.
REFUSAL = (
    "I could not produce a narrative answer that stays fully within the verified "
    "evidence, so here is exactly what the deterministic tools found instead:"
)


def unsupported_numbers(draft: Column, evidence: Column, strict: bool = False) -> Column:
    """Number tokens of two digits or more that the evidence doesn't support. A rounded or more precise form of an
    evidence number is supported; strict asks for three digits at least on both sides before one may contain the other.
    """
    known = F.array_distinct(F.transform(number_tokens(evidence), plain_number))

    def supported(n: Column) -> Column:
        part = lambda e: F.contains(e, n) | F.contains(n, e)
        if strict:
            return F.exists(known, lambda e: (e == n) | ((F.length(e) >= 3) & (F.length(n) >= 3) & part(e)))
        return F.exists(known, lambda e: part(e))

    return F.filter(
        number_tokens(draft), lambda t: (F.length(F.regexp_replace(t, "[,.]", "")) >= 2) & ~supported(plain_number(t))
    )


def unsupported_loans(draft: Column, evidence: Column) -> Column:
    """Loan numbers named in the draft but not in the evidence, each once, in order."""
    return F.array_except(loan_references(draft), loan_references(evidence))


def _windows(chars: Column, width: int) -> Column:
    """Hash of every run of width characters, from hashes of runs half as long: linear in the text's length."""
    if width == 1:
        return F.transform(chars, lambda c: F.xxhash64(c))
    whole, half = width, 1 << (width - 1).bit_length() - 1
    rest = whole - half

    def pair(h: Column) -> Column:  # of runs of half: each with the run that ends where the whole does
        n = F.greatest(F.size(h) - rest, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(rest + 1), n), lambda a, b: F.xxhash64(a, b))

    return let(_windows(chars, half), pair)


def repetitive(text: Column, window: int = WINDOW, most: int = MOST) -> Column:
    """Whether any window of characters occurs more than most times. The windows are sorted in the text's own row, so
    one that occurs most + 1 times equals the one most places on; no row is exploded.
    """
    chars = F.when(F.length(text) >= window * most, F.split(text, "")).otherwise(F.array().cast("array<string>"))

    def any_more(a: Column) -> Column:
        left = F.greatest(F.size(a) - most, F.lit(0))
        return F.exists(
            F.zip_with(F.slice(a, F.lit(1), left), F.slice(a, F.lit(most + 1), left), lambda x, y: x == y), lambda x: x
        )

    return F.coalesce(let(F.sort_array(_windows(chars, window)), any_more), F.lit(False))


# Why a draft is rejected.
NUMBERS, LOANS = "numbers not present in evidence: ", "loans not present in evidence: "
LOOP = "the draft repeats itself"
# Fixed value: the reason as readers of answers know it, and as the tests hold it.
UNCITED = "evidence was gathered but no citation is available"


def errors(draft: Column, evidence: Column, has_evidence: Column, n_citations: Column, strict: bool = False) -> Column:
    """Reasons to reject a draft, in order; empty if there are none."""
    numbers, loans = unsupported_numbers(draft, evidence, strict), unsupported_loans(draft, evidence)
    found = F.array(
        F.when(F.size(numbers) > 0, F.concat(F.lit(NUMBERS), F.concat_ws(", ", numbers))),
        F.when(F.size(loans) > 0, F.concat(F.lit(LOANS), F.concat_ws(", ", loans))),
        F.when(repetitive(draft), F.lit(LOOP)),
        F.when(has_evidence & (F.trim(draft) != "") & (n_citations == 0), F.lit(UNCITED)),
    )
    return F.filter(found, lambda e: e.isNotNull())


def final_answer(draft: Column, evidence: Column, found: Column) -> Column:
    shown = F.when(evidence == "", F.lit("(no evidence was gathered for this question)")).otherwise(evidence)
    return F.when(F.size(found) == 0, draft).otherwise(F.concat(F.lit(REFUSAL + "\n"), shown))


def is_refusal(answer: Column) -> Column:
    return F.startswith(answer, F.lit(REFUSAL))
