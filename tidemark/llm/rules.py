"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

The ratio compares two multinomials over hashed n-grams (one and two): the trusted target (documents
labelled good) and the raw corpus (all documents).  N-grams run over the words themselves and over
their forms, which keep signs and turn letters, capitals and digits into classes, so that an unseen
text has seen n-grams too.  A document's score is the mean over its n-grams; those below
LEAST_SCORE fail.

The raw corpus is counted whole.  The target is a bounded sample of the labelled rows, so its ids
can be broadcast and no text is ever shuffled; what is shuffled is one row a bucket and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
#: Buckets of n-grams of words and, after them, of forms.
WORD_BUCKETS, FORM_BUCKETS = 16384, 8192
WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Mean log-likelihood ratio (nats per n-gram) below which a document fails.
LEAST_SCORE = -0.25
#: Labelled documents that stand for the target at most (those with the smallest hashes of doc_id).
SAMPLE_TRUSTED = 20_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain column inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def forms(text: Column) -> Column:
    """Word forms of a text: runs of small (and caseless) letters become a, of capitals A, of digits 0."""
    out = F.regexp_replace(text, r"[\p{L}&&[^\p{Lu}]]+", "a")
    out = F.regexp_replace(out, r"\p{Lu}+", "A")
    return words(F.regexp_replace(out, r"\p{N}+", "0"))


def pairs(own: Column, apart: int = 1) -> Column:
    """Hash of every two hashes that stand `apart` from each other; own is bound by let."""
    return F.transform(F.slice(own, F.lit(1), F.greatest(F.size(own) - apart, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(own, i + apart)))


def grams(text: Column) -> Column:
    """w and f: the hashes (one) of a text's words and forms, and of every two in a row (two)."""

    def hashes(own: Column) -> Column:
        both = lambda one: let(pairs(one), lambda two: F.struct(one.alias("one"), two.alias("two")))
        return let(F.transform(own, lambda w: F.xxhash64(w)), both)

    return F.struct(hashes(words(text)).alias("w"), hashes(forms(text)).alias("f"))


def repeat_words(word: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more, each word once; word (one, two: see grams) is bound by let."""
    n = F.size(word["one"])
    # Doubled three times: a window is a pair of halves, a half a pair of pairs.
    windows = let(pairs(word["two"], 2), lambda four: pairs(four, 4))

    def ordered(own: Column) -> Column:
        return F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(own: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(own, k - 1)["h"])
            after = F.get(own, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(own, twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        spread = F.transform(at, lambda p, k: F.when(k > 0, F.least(F.lit(WINDOW), p - F.get(at, k - 1))).otherwise(F.lit(WINDOW)))
        return F.aggregate(spread, F.lit(0), lambda a, b: a + b)

    def found(own: Column) -> Column:
        # Most texts repeat no window: those are not sorted.
        return F.when(F.size(F.array_distinct(own)) < F.size(own), let(let(ordered(own), starts), covered)).otherwise(F.lit(0))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(windows, found)).cast("bigint")


def ratios(docs: DataFrame, trusted: DataFrame, sample: int = SAMPLE_TRUSTED) -> list[float]:
    """Log of target over raw probability for every bucket, with add-one counts; words and forms are multinomials of their own.

    docs: doc_id, text (null: empty); trusted: doc_id of the target documents, of which the `sample` with the smallest
    hashes count (repeats of an id count once).  Raw counts cover all rows; they are summed before the shuffle, and one row a bucket
    reaches the driver.
    """
    ids = trusted.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    flag = ids.select("doc_id", F.lit(1).alias("_target"))
    each = docs.select("doc_id", "text").join(F.broadcast(flag), "doc_id", "left").select(grams(F.coalesce("text", F.lit(""))).alias("g"), "_target")
    kinds = F.inline(F.array(*(F.struct(F.lit(n).alias("kind"), F.concat(f"g.{k}.one", f"g.{k}.two").alias("hashes")) for n, k in enumerate("wf"))))
    one = each.select("_target", kinds).select("_target", "kind", F.explode("hashes").alias("h"))
    bucket = F.when(F.col("kind") == 0, F.pmod("h", F.lit(WORD_BUCKETS))).otherwise(F.pmod("h", F.lit(FORM_BUCKETS)) + WORD_BUCKETS).cast("int")
    rows = one.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("raw"), F.count("_target").alias("target")).collect()
    whole = WORD_BUCKETS + FORM_BUCKETS
    raw, target = [1.0] * whole, [1.0] * whole
    for r in rows:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    out = []
    for lo, hi in ((0, WORD_BUCKETS), (WORD_BUCKETS, whole)):
        shift = math.log(sum(raw[lo:hi])) - math.log(sum(target[lo:hi]))
        out += [round(math.log(t / r) + shift, 4) for t, r in zip(target[lo:hi], raw[lo:hi], strict=True)]
    return out


def measure(docs: DataFrame, ratio: list[float] | None) -> DataFrame:
    """docs (all columns, text may be null) with the base measures, llr, base_failed and kept.

    Columns of these names are replaced; all others stay.  An empty or null text has no words, fails
    by LEAST_WORDS and has llr 0.  Without a trusted target (ratio None) llr is 0.  Repeated rows are
    measured alike; an empty table gives an empty result.  No shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    if ratio is None:
        llr = lambda x: F.lit(0.0)
    else:
        known = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")

        def total(own: Column, size: int, first: int) -> Column:
            place = lambda h: F.pmod(h, F.lit(size)).cast("int") + first if first else F.pmod(h, F.lit(size)).cast("int")
            return F.aggregate(own, F.lit(0.0), lambda a, h: a + F.get(known, place(h)))

        def llr(x: Column) -> Column:
            own = [total(x[k][n], size, first) for k, size, first in (("w", WORD_BUCKETS, 0), ("f", FORM_BUCKETS, WORD_BUCKETS)) for n in ("one", "two")]
            n = sum((F.size(x[k][m]) for k in "wf" for m in ("one", "two")), F.lit(0))
            return F.when(n > 0, F.round((own[0] + own[1] + own[2] + own[3]) / n, 6)).otherwise(F.lit(0.0))

    counts = let(grams(text), lambda x: F.struct(F.size(x["w"]["one"]).cast("bigint").alias("n"), repeat_words(x["w"]).alias("repeat"), llr(x).alias("llr")))
    held = next(f"_counts{n}" for n in range(len(docs.columns) + 1) if f"_counts{n}" not in docs.columns)
    out = docs.withColumn(held, counts).withColumns(
        {
            "n_words": F.col(f"{held}.n"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": F.col(f"{held}.repeat"),
            "llr": F.col(f"{held}.llr"),
        }
    )
    out = out.drop(held)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= LEAST_SCORE))


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """measure() over all documents; the target is a sample of the documents labelled good.  Null texts count as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    out = measure(docs, ratios(docs, trusted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
