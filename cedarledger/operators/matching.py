"""Which of very many names a text contains: candidates by each name's rarest piece, then the comparison itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.spread import spread

SIEVE = 1 << 19  # longs, at most
SIZES = (8, 4, 2, 1)  # lengths of the pieces; a name is looked for by pieces of the largest that it has room for


def _pieces(text: Column, size: int) -> Column:
    """All pieces of a length, by their hashes, each once: no cost but for texts that are long enough."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substr(text, i, F.lit(size)), F.lit(size)))
    )).otherwise(F.array().cast("array<bigint>"))


def _size(low: Column) -> Column:
    """Length of the pieces by which a name is looked for."""
    out = F.lit(None).cast("int")
    for size in reversed(SIZES):
        out = F.when(F.length(low) >= size, F.lit(size)).otherwise(out)
    return out


def anchors(names: DataFrame, name: str = "name", within: str | None = None) -> DataFrame:
    """name and anchor: each distinct name once (of each value of within), with the piece of it that the fewest names have."""
    scope = [within] if within else []
    each = names.select(*scope, F.col(name).alias("name")).filter("name <> ''").distinct()
    low = F.lower("name")
    own = F.lit(None).cast("array<bigint>")
    for size in reversed(SIZES):
        own = F.when(F.length(low) >= size, _pieces(low, size)).otherwise(own)
    pieces = each.select(*scope, "name", F.explode(own).alias("piece"))
    rare = pieces.groupBy(*scope, "piece").count()
    # rows that were exploded look small to the planner, which would broadcast them
    return pieces.join(rare.hint("merge"), [*scope, "piece"]).groupBy(*scope, "name").agg(
        F.min_by("piece", F.struct("count", "piece")).alias("anchor")
    )


def _sieved(pieces: DataFrame, own: DataFrame) -> DataFrame:
    """Without the pieces that are surely no name's anchor: two bits an anchor in at most SIEVE longs, which are broadcast."""
    place = F.pmod(F.col("anchor"), F.lit(SIEVE)).cast("int")
    bit = lambda n: F.shiftrightunsigned("anchor", n).bitwiseAND(F.lit(63)).cast("int")
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), bit(n))
    bits = own.groupBy(place.alias("_place")).agg(F.bit_or(one(40).bitwiseOR(one(50))).alias("_bits"))
    met = pieces.withColumn("_place", place).join(F.broadcast(bits), "_place")
    return met.filter((F.getbit("_bits", bit(40)) == 1) & (F.getbit("_bits", bit(50)) == 1)).drop("_place", "_bits")


def contained(
    texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "question", name: str = "name",
    within: str | None = None
) -> DataFrame:
    """key and name of every distinct name that a text contains, in any case; with within, a column of both sides, before them,
    of names that have the text's value of it.

    A name meets only texts that have its rarest piece, and each such pair is compared in full, so the result is exact. Nothing
    gathers the names: of a text only pieces of lengths in use that pass a sieve of fixed size are shuffled, and texts follow by key.
    Null and empty names are in no text, a null text contains none; rows of texts that share a key count together.
    """
    scope = [within] if within else []
    t = spread(
        texts.select(*scope, F.col(key).alias("_key"), F.lower(F.col(text)).alias("_text")).filter("_text <> ''"), *scope, "_key"
    )
    used = names.select(F.bit_or(_size(F.lower(name)))).scalar()
    of_size = lambda n: F.when(used.bitwiseAND(F.lit(n)) != 0, _pieces(F.col("_text"), n)).otherwise(F.array().cast("array<bigint>"))
    pieces = t.select(*scope, "_key", F.explode(F.array_distinct(F.flatten(F.array(*map(of_size, SIZES))))).alias("anchor"))
    own = anchors(names, name, within)
    candidates = _sieved(pieces, own).join(own.hint("merge"), [*scope, "anchor"]).select(*scope, "_key", "name")
    met = candidates.join(t.hint("merge"), [*scope, "_key"]).filter(F.contains("_text", F.lower("name")))
    return met.select(*scope, F.col("_key").alias(key), F.col("name").alias(name)).distinct()


def first_contained(
    texts: DataFrame, names: DataFrame, key: str = "question_id", text: str = "question", name: str = "name"
) -> DataFrame:
    """key and the first name, in order, that each text contains; texts without one have no row."""
    return contained(texts, names, key, text, name).groupBy(key).agg(F.min(name).alias(name))
