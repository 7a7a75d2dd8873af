"""Quality rules: counted rules, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import TEXT_KEY, shingle_hashes, text_hashes, text_of, words_of
from tabloom.operators.shared import quoted, settle

#: Buckets of the hashed n-grams (one- and two-word); the weight table has as many rows.
BUCKETS = 1 << 18
#: Mean log ratio below which a document is not like the trusted ones. Nats an n-gram.
THRESHOLD = -0.3
#: Trusted documents that the target multinomial is fitted on, at most: those with the
#: lowest hashes of their keys. All documents count for the corpus multinomial.
TRUSTED_MOST = 20_000
#: Added to every bucket's count, in occurrences among the trusted texts.
SMOOTHING = 5.0


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """Words inside runs of ``width`` words that occur twice or more, from the runs' hashes.

    The repeated runs' places in order; each adds the words up to the next one, at most
    ``width``. Only texts with a repeat are sorted.
    """
    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), marked)
    after = F.concat(F.slice(marked, F.lit(2), F.size(hashes)), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    rows = F.arrays_zip(marked.alias("m"), before.alias("b"), after.alias("a"))
    repeated = F.filter(rows, lambda r: (r["m"]["h"] == r["b"]["h"]) | (r["m"]["h"] == r["a"]["h"]))
    places = F.sort_array(F.transform(repeated, lambda r: r["m"]["i"]))
    start = F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate(places, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(width), p - s["last"])).alias("n")))["n"]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count).otherwise(F.lit(0)).cast("long")


def rule_counts(df: DataFrame) -> DataFrame:
    """Adds the rule columns to rows of (_tl_text, ...): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.col("_tl_text")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = df.withColumn("_tl_words", words_of(body)).withColumn("n_words", F.size("_tl_words").cast("long"))
    rows = rows.withColumn("_tl_runs", shingle_hashes(F.col("_tl_words"), F.col("n_words").cast("int"), 5)).withColumn("_tl_lines", lines)
    return rows.withColumns({
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_tl_lines") - F.size(F.array_distinct("_tl_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_tl_runs")),
    }).drop("_tl_runs", "_tl_lines")


def _grams(df: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """(keep..., bucket): a row for every word and every pair of neighbouring words."""
    words = words_of(F.col("_tl_text"))
    rows = df.select(*keep, words.alias("_tl_w"))
    rows = rows.select(*keep, F.explode(F.arrays_zip(F.col("_tl_w").alias("a"), F.slice("_tl_w", F.lit(2), F.greatest(F.size("_tl_w"), F.lit(1))).alias("b"))).alias("g"))
    one, two = F.pmod(F.xxhash64("g.a"), F.lit(buckets)), F.when(F.col("g.b").isNotNull(), F.pmod(F.xxhash64("g.a", "g.b"), F.lit(buckets)))
    pair = rows.select(*keep, one.cast("int").alias("one"), two.cast("int").alias("two"))
    return pair


def fit_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """(bucket, weight): log of a bucket's share in the trusted texts over that in all texts.

    ``docs`` and ``trusted`` have a column _tl_text. Counts cover every n-gram of every
    document; they are summed in the tasks, so at most ``buckets`` rows leave a task.
    Both counts get ``smoothing`` occurrences at the size of the trusted corpus, so that a
    bucket that hardly occurs says little, and the weights are alike for corpora of any
    size. Buckets that no document has are not in the table.
    """

    def counts(df: DataFrame, name: str) -> DataFrame:
        grams = _grams(df, [], buckets)
        both = grams.select(F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
        return both.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    raw, good = settle(counts(docs, "raw"), "grams"), settle(counts(trusted, "good"), "grams")
    n_raw, n_good = raw.agg(F.sum("raw")).first()[0] or 0, good.agg(F.sum("good")).first()[0] or 0
    if not n_good:
        return raw.select("bucket", F.lit(0.0).alias("weight"))
    joined = raw.join(good, "bucket", "left")
    expected = F.col("raw") * F.lit(n_good / n_raw) + F.lit(smoothing)
    return joined.select("bucket", F.ln((F.coalesce("good", F.lit(0)) + F.lit(smoothing)) / expected).alias("weight"))


def score(df: DataFrame, weights: DataFrame, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(keep..., score): the mean weight of a row's n-grams.

    Each row's n-grams look up the table and are summed in the task that has the text. The
    table has at most ``buckets`` rows, 12 bytes each, which is what the broadcast relies on.
    """
    grams = _grams(df, keep, buckets)
    one = F.broadcast(weights.select(F.col("bucket").alias("one"), F.col("weight").alias("w1")))
    two = F.broadcast(weights.select(F.col("bucket").alias("two"), F.col("weight").alias("w2")))
    found = grams.join(one, "one", "left").join(two, "two", "left")
    total = F.sum(F.coalesce("w1", F.lit(0.0)) + F.coalesce("w2", F.lit(0.0)))
    n = F.count("one") + F.count("two")
    return found.groupBy(*keep).agg((total / n).alias("score"))


def judge(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD,
    least_words: int = 10, most_repeated: int = 20, trusted_most: int = TRUSTED_MOST,
) -> DataFrame:
    """key, the rule columns, base_failed, score and kept, for every row; also _tl_text_a and _tl_text_b.

    A document fails the base rules with fewer than ``least_words`` words, or with
    more than ``most_repeated`` percent of them in repeated five-word runs. Of the others
    those are kept whose n-grams are, on average, at least exp(threshold) times as likely
    under the trusted multinomial as under that of the whole corpus. Trusted are documents
    with a label and no label other than quality 1; the target multinomial is fitted on
    those of at most ``trusted_most`` keys, the lowest by hash. The score is a mean, so
    length does not move the threshold.

    Null text: no words, not kept. Null keys: counted in the corpus, never trusted, judged.
    Repeated rows are judged each. Without trusted documents all scores are 0. Empty table:
    no rows. Extra columns are ignored. ``labels`` has (key, quality). No text moves:
    the trusted keys, a bounded list, are broadcast.
    """
    # Equal texts have equal scores, so a row finds its score by the hashes of its text.
    rows = df.select(quoted(key).alias(key), text_of(text).alias("_tl_text"), *text_hashes(text_of(text)))
    marks = labels.groupBy(quoted(key).alias(key)).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_tl_quality")).where(f"_tl_quality = 1 and `{key}` is not null")
    marks = settle(marks.orderBy(F.xxhash64(quoted(key)), quoted(key)).limit(trusted_most).select(quoted(key).alias(key)), "trusted")
    weights = fit_weights(rows.select("_tl_text"), rows.join(F.broadcast(marks), key, "left_semi").select("_tl_text"), buckets)
    weights = settle(weights, "weights")
    scores = score(rows, weights, TEXT_KEY, buckets)
    ruled = rule_counts(rows).drop("_tl_words", "_tl_text")
    out = ruled.join(scores, TEXT_KEY, "left")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "score": F.coalesce("score", F.lit(0.0))})
    return out.select(
        quoted(key).alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score", *TEXT_KEY,
    )


def filter_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows of ``df`` that `judge` keeps, with all columns; equal texts fare alike."""
    rows = df.withColumns(dict(zip(TEXT_KEY, text_hashes(text_of(text)), strict=True)))
    # Written before it is filtered: a filter would be moved below the rules and count them anew.
    judged = settle(judge(df, labels, key, text, **rules).select(*TEXT_KEY, "kept"), "judged")
    kept = judged.where("kept").select(*TEXT_KEY).distinct()
    return rows.join(kept, TEXT_KEY, "left_semi").select(*[quoted(c) for c in df.columns])
