"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Every word gives two hashed n-grams: with its successor (a word bigram) and
its last two characters (a character bigram). Two multinomials over the hash
bins are counted: over a bounded sample of
trusted documents, and over all documents. A document's score is the mean log
ratio of its n-grams; a fixed threshold decides. All expressions are built in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, let, words_col
from .training import bounded_ids, one_label

BINS = 1 << 14
#: Bound of the trusted sample (least id hash); n-grams of the raw profile that are mixed into the trusted one.
MAX_TRUSTED, LEAN = 4000, 4.0 * BINS
MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD = 50, 50, -0.25


def _bin(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BINS)).cast("int")


def _pair(x: Column, w: Column, i: Column) -> Column:
    return _bin(x, F.get(w, i + 1))


def _tail(x: Column) -> Column:
    return _bin(F.lit("-"), F.right(x, F.lit(2)))


def ngram_bins(w: Column) -> Column:
    """Bins of a document's n-grams, two a word; w must be a column or a lambda's variable."""
    return F.concat(F.transform(w, lambda x, i: _pair(x, w, i)), F.transform(w, _tail))


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more; windows are
    told apart by 64-bit hashes, within one text. w must be a column or a
    lambda's variable."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), n)

    def covered(s):
        at = F.transform(s, lambda x, k: F.when((x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]), x["i"]))
        return let(F.filter(at, lambda x: x.isNotNull()), lambda d: F.size(F.array_distinct(F.concat(d, F.transform(d, lambda x: x + 1), F.transform(d, lambda x: x + 2)))))

    def counted(g):
        placed = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(placed), covered))

    return let(grams, counted).cast("long")


def base_counts(text: Column, w: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(w),
    }


def log_ratios(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_trusted: int = MAX_TRUSTED) -> list[float]:
    """log p_trusted / p_raw of every bin. The raw counts cover all documents."""
    good = one_label(labels, id_col, F.col(label_col)).filter("y = 1").select("doc_id")
    trusted = bounded_ids(good, max_trusted).withColumn("trusted", F.lit(1))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_col(F.col(text_col)).alias("w"))
    placed = own.join(F.broadcast(trusted), "doc_id", "left").select("trusted", "w", F.posexplode("w").alias("i", "x"))
    bins = placed.select("trusted", F.explode(F.array(_pair(F.col("x"), F.col("w"), F.col("i")), _tail(F.col("x")))).alias("b"))
    rows = bins.groupBy("b").agg(F.count("*").alias("raw"), F.sum("trusted").alias("good")).collect()
    raw, good_n = [0] * BINS, [0] * BINS
    for r in rows:
        raw[r["b"]], good_n[r["b"]] = r["raw"], r["good"] or 0
    n_raw, n_good = sum(raw), sum(good_n)
    if not n_good:
        return [0.0] * BINS
    # the trusted profile leans on the raw one until the sample is large
    common = [(r + 1) / (n_raw + BINS) for r in raw]
    return [math.log((g + LEAN * c) / (n_good + LEAN)) - math.log(c) for g, c in zip(good_n, common)]


def literal(values: list[float]) -> Column:
    """An array literal of fixed length."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def apply_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED, keep_columns: bool = False) -> DataFrame:
    """Base counts, ``base_failed``, ``score`` and ``kept`` of every whole text.

    base_failed: fewer than 50 words, or over half of the words in repeated
    3-word windows. kept: not base_failed and score >= threshold, where score
    is the mean log ratio of the n-grams (0 for a text without words).

    Null and empty texts have no words and fail the base. Without any trusted
    label all scores are 0, so only the base decides. Null ids are never
    trusted; repeated labels count by majority, 1 on a tie. Repeated documents
    each give a row. Other columns are ignored, whatever their names; with
    keep_columns the result is the rows of docs that are kept.
    """
    ratios = literal(log_ratios(docs, labels, label_col, id_col, text_col, max_trusted))
    own = docs if keep_columns else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    text = F.col(text_col if keep_columns else "text")
    q, kept = fresh(own, "q", "kept")

    def judge(w):
        mean = let(ngram_bins(w), lambda f: F.aggregate(f, F.lit(0.0), lambda a, j: a + F.get(ratios, j)) / F.greatest(F.size(f), F.lit(1)))
        counts = {"n_words": F.size(w).cast("long"), "n_repeat_words": repeat_words(w)} if keep_columns else base_counts(text, w)
        return F.struct(*[c.alias(k) for k, c in counts.items()], mean.alias("score"))

    # bound in a lambda: a filter that Spark moves below would otherwise carry
    # the splitting of the text into every inner lambda
    judged = own.withColumn(q, let(words_col(text), judge))
    n, rep = F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    verdict = ~failed & (F.col(f"{q}.score") >= threshold)
    if keep_columns:
        return judged.filter(verdict).select(*docs.columns)
    return judged.select("doc_id", f"{q}.*", failed.alias("base_failed"), verdict.alias(kept))
