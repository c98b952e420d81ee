"""Quality rules: counts a rule can test, and importance of a text by hashed n-grams.

Words and neighbouring word pairs are hashed into BUCKETS counters. Two multinomials are estimated over them: one from all
documents of the corpus, one from trusted documents (labelled good and not toxic; a bounded sample of labelled ids). A text's
score is its log-likelihood ratio of trusted against raw, divided by its number of n-grams; one threshold decides every
document, with no random draw. Toxic words stand in a few places of a text and hardly move that ratio, so they are weighed
apart: the words that tell documents labelled toxic from good ones (learned from a bounded sample) add up to a text's
toxicity, which has a threshold of its own. Both thresholds are fitted on histograms of all labelled documents, toxicity's with
the toxic ones on the bad side and the ratio's with those of quality 0, so that next to none of the good ones are lost. Everything is built from DataFrame functions.

Null texts have no words; a text without words scores 0. A table without trusted documents scores 0 everywhere, and without
documents labelled bad there is no threshold, so only the rules decide. Null labels are not trusted; repeated labels count once; repeated rows each get their own result; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .exchange import stored, text_key

BUCKETS = 1 << 15
DIGITS = 4  # of a weight after the point: the table is part of the plan, and plans are printed and logged
TRUSTED = 20_000  # labelled ids at most; these are broadcast
JUDGED = 2_000  # documents of either label, at most, from which toxic words are learned
TOXIC_WORDS = 256
TELLING = 20  # times more frequent in toxic documents than in good ones, at least
BINS = 10_000  # of a histogram to a unit of score
COST = 20  # documents labelled bad that a lost good one outweighs
SMOOTHING = 1.0
BETWEEN = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


def let(value: Column, then) -> Column:
    """then(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda x: x != "")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pairs(h: Column, f) -> Column:
    """f over neighbouring hashes."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: f(F.xxhash64(a, b)))


def _first(labels: DataFrame, which: Column, most: int) -> DataFrame:
    """Ids of labelled rows, at most so many, drawn by hash."""
    return labels.filter(which & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _good() -> Column:
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def _bad() -> Column:
    return F.coalesce(F.col("quality") == 0, F.lit(False))


def _toxic() -> Column:
    return F.coalesce(F.col("toxic") == 1, F.lit(False))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    return _first(labels, _good(), most)


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Log ratio of trusted to raw probability for each bucket, from n-grams of all documents."""
    trusted = trusted_ids(labels).select(F.col("doc_id").alias("_trusted"))
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("_trusted"), "left")
    buckets = let(
        F.transform(words(F.col("text")), lambda w: F.xxhash64(w)),
        lambda h: F.concat(F.transform(h, _bucket), _pairs(h, _bucket))
    )
    counted = (
        marked.select(F.col("_trusted").isNotNull().cast("long").alias("t"), F.explode(buckets).alias("b"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("trusted"))
        .collect()  # a row for each of BUCKETS at most
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counted:
        raw[r["b"]], target[r["b"]] = r["raw"], r["trusted"]
    total_raw, total_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    if not sum(target):
        return [0.0] * BUCKETS
    return [
        round(
            math.log((t + SMOOTHING) / total_target) - math.log((r + SMOOTHING) / total_raw), DIGITS
        ) for t, r in zip(target, raw)
    ]


def _repeats(h: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    m = F.greatest(F.size(h) - 2, F.lit(0))
    windows = F.zip_with(
        F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(2), m), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.slice(h, F.lit(3), m), lambda ab, c: F.xxhash64(ab["a"], ab["b"], c)
    )

    def covered(at: Column) -> Column:  # positions in order; each covers three words
        start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(
            (p + 3).alias("end"), (acc["n"] + (p + 3 - F.greatest(p, acc["end"]))).alias("n")
        )
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def few(t: Column, twice: Column) -> Column:
        return covered(
            F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())
        )

    def many(t: Column) -> Column:  # sorted by window, so equal windows are neighbours
        return let(
            F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i")))),
            lambda s: covered(
                F.sort_array(
                    F.transform(
                        F.filter(
                            s,
                            lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(
                                F.get(s, j + 1)["x"] == e["x"], F.lit(False)
                            )
                        ),
                        lambda e: e["i"]
                    )
                )
            ),
        )

    def at_all(t: Column) -> Column:
        return let(
            let(
                F.sort_array(t),
                lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False))))
            ),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0)).when(F.size(twice) <= 32, few(t, twice)).otherwise(many(t)),
        )

    return let(windows, at_all)


def _table(weights: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")


def _ratio(h: Column, table: Column) -> Column:
    """Score of a text by its word hashes."""
    weight = lambda x: F.get(table, _bucket(x))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return (total(F.transform(h, weight)) + total(_pairs(h, weight))) / F.greatest(2 * F.size(h) - 1, F.lit(1))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def toxic_words(docs: DataFrame, labels: DataFrame, most: int = JUDGED) -> dict[int, float]:
    """Hashes of the words that tell toxic documents from good ones, with their log ratio of document frequencies."""
    toxic = _first(labels, _toxic(), most).select(F.col("doc_id").alias("_judged"), F.lit(1).alias("_t"))
    good = _first(labels, _good(), most).select(F.col("doc_id").alias("_judged"), F.lit(0).alias("_t"))
    met = docs.select("doc_id", "text").join(F.broadcast(toxic.unionByName(good)), F.col("doc_id") == F.col("_judged"))
    own = met.select(
        "_t",
        F.explode(
            F.array_distinct(
                F.concat(F.array(F.lit(None).cast("long")), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
            )
        ).alias("h")
    )
    counts = own.groupBy("h").agg(F.sum("_t").alias("t"), F.sum(1 - F.col("_t")).alias("g"))
    sizes = counts.filter("h IS NULL").first()  # every document has the null once
    if sizes is None or not sizes["t"] or not sizes["g"]:
        return {}
    ratio = F.log((F.col("t") + 0.5) / (sizes["t"] + 1.0)) - F.log((F.col("g") + 0.5) / (sizes["g"] + 1.0))
    told = counts.filter("h IS NOT NULL AND t > 1").select("h", "t", ratio.alias("r")).filter(F.col("r") >= math.log(TELLING))
    return {
        x["h"]: round(x["r"], 2) for x in told.orderBy((F.col("t") * F.col("r")).desc(), "h").limit(TOXIC_WORDS).collect()
    }


def _toxicity(h: Column, telling: dict[int, float]) -> Column:
    """Sum of the weights of the telling words that a text has, each once."""
    if not telling:
        return F.lit(0.0)
    weight = F.create_map(*(F.lit(x) for kv in telling.items() for x in kv))
    return F.aggregate(
        F.array_distinct(F.filter(h, lambda x: x.isin(*telling))), F.lit(0.0), lambda s, x: s + F.element_at(weight, x)
    )


def cut(bins: list[tuple[float, float, int, int]]) -> float:
    """The value with most bad documents less COST times the good ones below it, in the middle of the widest gap that
    has it. Bins in order: least and largest value, bad and good documents.
    """
    best, found, gain = (0, math.inf), -math.inf, 0
    for (_, s, bad, good_), (t, *_) in zip(bins, bins[1:]):  # never above the last
        gain += bad - COST * good_
        if (gain, t - s) > best:  # a cut must gain something
            best, found = (gain, t - s), (s + t) / 2
    return found


def _histogram(judged: DataFrame, value: Column) -> list[tuple[float, float, int, int]]:
    """Of all labelled documents; as many rows as there are bins."""
    bins = judged.select(value.alias("x"), "_bad", "_good").groupBy(F.floor(F.col("x") * BINS).alias("bin")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("_bad").alias("bad"), F.sum("_good").alias("good")
    )
    return sorted(tuple(r) for r in bins.select("lo", "hi", "bad", "good").collect())


def fit_thresholds(scored: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Least score and, below it, largest toxicity of a kept document, from all labelled documents that the rules don't
    reject anyway.
    """
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_judged")).agg(
        F.max(_bad().cast("int")).alias("_bad"), F.max(_toxic().cast("int")).alias("_toxic"),
        F.max(F.coalesce(_good(), F.lit(False)).cast("int")).alias("_good")
    )
    judged = scored.filter(~F.col("base_failed")).select("doc_id", "score", "toxicity").join(
        one, F.col("doc_id") == F.col("_judged")
    )
    most = -cut(_histogram(judged.select("toxicity", F.col("_toxic").alias("_bad"), "_good"), -F.col("toxicity")))
    return cut(_histogram(judged.filter(F.col("toxicity") <= most), F.col("score"))), most


def score(docs: DataFrame, labels: DataFrame, threshold: float | None = None, *carry: str) -> DataFrame:
    """doc_id, counts, base_failed, score and kept; carry names columns to pass through. Without a threshold of the
    score one is fitted, and one of toxicity.
    """
    table = _table(ratios(docs, labels))
    telling = toxic_words(docs, labels) if threshold is None else {}
    text = F.coalesce(F.col("text"), F.lit(""))
    one = let(
        words(text),
        lambda w: let(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("word_chars"),
                _repeats(h).cast("long").alias("n_repeat_words"),
                _ratio(h, table).alias("score"),
                _toxicity(h, telling).alias("toxicity"),
            ),
        ),
    )
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.size(x) - F.size(F.array_distinct(x))
    )
    got = docs.select(
        "doc_id", *carry, one.alias("_q"), F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines")
    )
    q = F.col("_q")
    scored = got.select(
        "doc_id", *carry, q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), "n_symbols", "n_dup_lines", q["n_repeat_words"].alias("n_repeat_words"),
        _failed(q["n_words"], q["n_repeat_words"]).alias("base_failed"), q["score"].alias("score"), q["toxicity"].alias("toxicity"),
    )
    most = math.inf
    if threshold is None:
        scored = stored(scored)  # a text is scored once, for the thresholds and for the result
        threshold, most = fit_thresholds(scored, labels)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)) & (F.col("toxicity") <= F.lit(most))
    return scored.withColumn("kept", kept).drop("toxicity")


def good(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that are kept, with all their columns."""
    # whole rows are not carried through the stored scores: reading those back takes too much memory
    keyed = docs.select("doc_id", "text", text_key().alias("_key"))
    gone = score(keyed, labels, threshold, "_key").filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), "_key").distinct()
    return docs.join(
        gone.hint("shuffle_hash"),
        docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs["text"]) == gone["_key"]), "left_anti"
    )
