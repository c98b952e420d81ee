"""Benchmark decontamination: a broadcast hash table of test n-grams, scanned over training windows, hits verified.

Windows of WIDTH normalised words of every benchmark item (an item of fewer words is one window) go into a hash table that
is broadcast while it has at most BROADCAST_WINDOWS entries, four times as many item ids and BROADCAST_CHARS characters, and
joined by shuffle beyond that. Every window of every document is hashed and passes a sieve of the table's hashes in its own
row, whatever the table's size; what passes is looked up by its hash, and a hit counts only if the words themselves agree.
Everything is built from DataFrame functions.

Null texts have no words. Repeated documents each get a result; repeated items with one id count once. A benchmark without
words hits nothing; an empty table of documents gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WIDTH = 13
BROADCAST_WINDOWS = 500_000
BROADCAST_CHARS = 64 << 20
SIEVE = 1 << 17  # longs of the sieve, at most
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of characters that don't stand between words."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda x: x != "")


def let(value: Column, then) -> Column:
    """then(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hashes(h: Column, width: int) -> Column:
    """Hash of every run of width words, from word hashes: runs are made of two overlapping runs of about half the
    width.
    """
    if width == 1:
        return h
    half = 1 << (width - 1).bit_length() - 1
    rest = width - half

    def pair(x: Column) -> Column:
        n = F.greatest(F.size(x) - rest, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(rest + 1), n), lambda a, b: F.xxhash64(a, b))

    return let(hashes(h, half), pair)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows of the items: width, hash, words, ids of the items that have them."""
    w = items.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.select(
        "item_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.least(F.size("w"), F.lit(width)).alias("width")
    )
    of = F.coalesce(*(F.when(F.col("width") == n, hashes(F.col("h"), n)) for n in range(1, width + 1)))
    each = w.select("item_id", "width", "w", F.posexplode(of).alias("at", "hash"))
    each = each.select("item_id", "width", "hash", F.slice("w", F.col("at") + 1, F.col("width")).alias("words"))
    return each.groupBy("width", "hash", "words").agg(F.collect_set("item_id").alias("items"))


def sieve(table: DataFrame, n_windows: int):
    """Whether a hash may be among the table's, as a column function: eight bits for each window at least, up to SIEVE
    longs.
    """
    n = min(SIEVE, 1 << max(12, (n_windows // 8).bit_length()))
    place = lambda h: F.pmod(h, F.lit(n)).cast("int")
    bit = lambda h: F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")
    bits = [0] * n
    # n rows at most
    for r in table.groupBy(place(F.col("hash")).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("hash")))).alias("b")
    ).collect():
        bits[r["i"]] = r["b"]
    longs = F.from_json(F.lit("[" + ",".join(map(str, bits)) + "]"), "array<bigint>")
    return lambda h: F.getbit(F.get(longs, place(h)), bit(h)) == 1


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, spans (start and number of words of each hit), items (ids of
    items with hits).
    """
    table = windows(items, width)
    chars = F.aggregate("words", F.lit(0), lambda s, x: s + F.length(x))
    # width rows at most
    by_width = table.groupBy("width").agg(
        F.count("*").alias("n"), F.sum(F.size("items")).alias("ids"), F.sum(chars).alias("chars")
    ).collect()
    n_windows = sum(r["n"] for r in by_width)
    fits = n_windows <= BROADCAST_WINDOWS and sum(r["ids"] for r in by_width) <= 4 * BROADCAST_WINDOWS and sum(r["chars"] for r in by_width) <= BROADCAST_CHARS
    passes = sieve(table, n_windows)
    table = table.select(F.col("hash").alias("_hash"), F.col("words").alias("_words"), F.col("items").alias("_items"))
    w = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"),
        words(F.col("text")).alias("w")
    )
    w = w.select(
        "row", "doc_id", "text_key", "w", F.size("w").cast("long").alias("n_words"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h")
    )

    def passing(n: int) -> Column:
        """What passes of the windows of n words."""
        own = F.transform(
            hashes(F.col("h"), n),
            lambda h, i: F.when(
                passes(h),
                F.struct(
                    i.alias("at"), F.lit(n).alias("width"), h.alias("hash"),
                    F.slice(F.col("w"), i + 1, F.lit(n)).alias("words")
                )
            )
        )
        return F.filter(own, lambda x: x.isNotNull())

    some = F.concat(*map(passing, sorted(r["width"] for r in by_width) or [width]))
    each = w.select(
        "row", "doc_id", "text_key", "n_words", F.explode_outer(some).alias("x")
    ).select("row", "doc_id", "text_key", "n_words", "x.*")
    met = each.join(F.broadcast(table) if fits else table, F.col("hash") == F.col("_hash"), "left")
    true = F.coalesce(F.col("words") == F.col("_words"), F.lit(False))
    span = F.when(true, F.struct(F.col("at").alias("at"), F.col("width").alias("width")))
    return met.groupBy("row", "doc_id", "text_key", "n_words").agg(
        F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.when(true, F.col("_items"))))).alias("items")
    )


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are in order of their start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        end = F.greatest(acc["end"], s["at"] + s["width"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(F.least(s["at"], end), acc["end"])).alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"]).cast("long")


def judged(found: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated: hit words are a twentieth of the words at
    least.
    """
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    out = found.select(
        "doc_id", "text_key", "n_words", covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256")
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, without the contaminated ones; rows that share doc_id and text share the verdict."""
    bad = judged(find(docs, items)).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    ).distinct()
    return docs.join(
        bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]), "left_anti"
    )
