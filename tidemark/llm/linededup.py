"""Repeated line runs by a suffix array over line ids, with DataFrame functions only.

The sequence is the corpus's lines that have words, document by document; no suffix reaches over a document's end.
Line ids are the ranks of the lines' digests in sorted order.  Prefix doubling turns the ranks of runs of
2^k lines into those of 2^(k+1): pairs of ranks are counted, sorted by range over all tasks, and
numbered in that order; suffixes whose run is unique leave the work at once.  The rank of any
longer run is a pair of two ranks that overlap, so the suffixes that share their first n lines
are the rows that share (n, rank, rank): the interval of the suffix array with an LCP of at least n.

A run counts as repeated from MIN_WORDS words on; its first copy stays and later ones go.  Every
line of such a run lies in a window of it that just reaches MIN_WORDS words, and every window
of a later copy has an earlier copy too.  So the array is sorted only as deep as those windows are long, and
the maximal runs are the unions of the windows that are no first copies.  A line that has the words by itself is a
window of its own: its interval is known from the counts of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions, table
from tidemark.llm.rules import let

#: About one sentence: shorter repeated runs (greetings, headings, list marks) stay.
MIN_WORDS = 6
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: A document: its id and a digest of its text, so that texts that share an id stay apart.
DOC = ["doc", "digest"]


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, digest, i (position among the lines with words), line (number in the text), words (min_words at most), a and b (digests of the line)."""
    each = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda v, n: F.struct(n.alias("line"), v.alias("value")))
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("digest"), F.posexplode(F.filter(each, lambda x: F.btrim(x["value"], F.lit(BLANKS)) != "")).alias("i", "x"))
    value = F.col("x.value")
    enough = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{min_words - 1}}}[^\x20\x09-\x0D]"
    words = F.when(value.rlike(enough), min_words).otherwise(F.regexp_count(value, F.lit(WORD)))
    return lines.select(*DOC, "i", F.col("x.line").alias("line"), words.alias("words"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def _ranked(keys: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """by, new (their rank in sorted order over all tasks) and head (the first place) of those with two places or more.

    keys: by, doc, digest, i.
    """
    again = keys.groupBy(*by).agg(F.min(F.struct(*DOC, "i")).alias("head"), F.max(F.struct(*DOC, "i")).alias("last")).where("head <> last").drop("last")
    ordered = again.repartitionByRange(partitions(keys.sparkSession), *by).sortWithinPartitions(*by)
    return scratch.save(name, ordered.select(*by, F.monotonically_increasing_id().alias("new"), "head"))


def _spans(at: DataFrame, min_words: int) -> DataFrame:
    """doc, digest, i, n of the windows of two lines or more that just reach min_words words, from or up to each repeated line.

    at: doc, digest, i, words of the repeated lines.
    """
    rows = F.sort_array(F.collect_set(F.struct("i", "words"))).alias("rows")
    each = at.groupBy(*DOC).agg(rows).where(F.exists("rows", lambda x: x["words"] < min_words))

    def reach(own: Column, start: Column, step: int) -> Column:
        """Lines in a row from start (1-based) until min_words are reached; null if they are not."""
        first = own[start - 1]["i"]
        nothing = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"), F.lit(True).alias("whole"))

        def add(s: Column, x: Column) -> Column:
            done = (s["words"] >= min_words) | ~s["whole"]
            more = F.struct((s["words"] + x["words"]).alias("words"), (s["n"] + 1).alias("n"), (x["i"] == first + s["n"] * step).alias("whole"))
            return F.when(done, s).otherwise(more)

        return let(F.aggregate(F.slice(own, start, min_words), nothing, add), lambda s: F.when((s["words"] >= min_words) & s["whole"], s["n"]))

    def windows(forth: Column, back: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(forth))
        ahead = F.transform(places, lambda p: F.struct(forth[p - 1]["i"].alias("i"), reach(forth, p, 1).alias("n")))
        behind = F.transform(places, lambda p: let(reach(back, p, -1), lambda n: F.struct((back[p - 1]["i"] + 1 - n).alias("i"), n.alias("n"))))
        return F.array_distinct(F.filter(F.concat(ahead, behind), lambda x: x["n"] > 1))

    found = let(F.struct(F.col("rows").alias("f"), F.reverse("rows").alias("b")), lambda x: windows(x["f"], x["b"]))
    return each.select(*DOC, F.explode(found).alias("x")).select(*DOC, "x.i", "x.n")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, digest (xxhash64 of the text) and line of every line in a later copy of a repeated run of at least min_words words.

    docs: doc_id, text (null: no lines).  Copies are ordered by document and line; the first stays.  Texts
    with the same doc_id are documents of their own, ordered by digest; rows that repeat both are
    one document.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    own = scratch.save("own", _lines(docs, min_words))
    ids = _ranked(own, ["a", "b"], scratch, "ids")
    place = F.struct(*DOC, "i")
    at = scratch.save("at", own.join(ids.hint("merge"), ["a", "b"]).select(*DOC, "i", "line", "words", F.col("new").alias("rank"), (place != F.col("head")).alias("later")))
    scratch.drop("own", "ids")
    gone = at.where((F.col("words") >= min_words) & F.col("later")).select(*DOC, "line").distinct()

    spans = _spans(at, min_words).withColumn("level", F.floor(F.log2("n") + 1e-9).cast("int"))
    spans = scratch.save("spans", spans)
    inside = spans.select(*DOC, F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    lines = scratch.save("inside", at.join(inside.hint("merge"), [*DOC, "i"]).select(*DOC, "i", "line", "rank").distinct())
    top = spans.agg(F.max("level")).first()[0] or 0
    ranks = here = lines.select(*DOC, "i", F.lit(0).alias("level"), "rank")
    for k in range(top):
        there = here.select(*DOC, (F.col("i") - (1 << k)).alias("i"), F.col("rank").alias("next"))
        pairs = scratch.save(f"pairs-{k}", here.join(there.hint("merge"), [*DOC, "i"]).select(*DOC, "i", "rank", "next"))
        new = _ranked(pairs, ["rank", "next"], scratch, f"ids-{k + 1}")
        here = scratch.save(f"rank-{k + 1}", pairs.join(new.hint("merge"), ["rank", "next"]).select(*DOC, "i", F.lit(k + 1).alias("level"), F.col("new").alias("rank")))
        scratch.drop(f"pairs-{k}", f"ids-{k + 1}")
        ranks = ranks.unionByName(here)

    first = spans.join(ranks.select(*DOC, "i", "level", F.col("rank").alias("a")).hint("merge"), [*DOC, "i", "level"])
    tail = first.withColumn("j", F.col("i") + F.col("n") - F.expr("shiftleft(1, level)"))
    runs = tail.join(ranks.select(*DOC, F.col("i").alias("j"), "level", F.col("rank").alias("b")).hint("merge"), [*DOC, "j", "level"])
    runs = scratch.save("runs", runs.select(*DOC, "i", "n", "a", "b"))
    heads = runs.groupBy("n", "a", "b").agg(F.min(place).alias("head"), F.max(place).alias("last")).where("head <> last").drop("last")
    later = runs.join(heads.hint("merge"), ["n", "a", "b"]).where(place != F.col("head"))
    covered = later.select(*DOC, F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    more = lines.join(covered.hint("merge"), [*DOC, "i"], "left_semi").select(*DOC, "line")
    out = scratch.save("gone", gone.unionByName(more).distinct())
    scratch.drop("at", "spans", "inside", "runs", *(f"rank-{k + 1}" for k in range(top)))
    return out


def delete_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the repeated lines, n_lines (lines of the text before) and removed (their numbers, sorted).

    Null texts have no lines and stay null (n_lines 0).  A text of which nothing is left is empty.
    All rows stay, also those that repeat doc_id and text, which are treated alike.  Of texts
    without an id only lines that have min_words by themselves are compared.
    Columns named n_lines or removed are replaced; all others stay.  An empty table gives an empty result.
    """
    plain = docs.drop("n_lines", "removed")
    gone = repeated_lines(plain.select("doc_id", "text"), min_words)
    lists = gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("line")).alias("_gone")).select(F.col("doc").alias("_doc"), F.col("digest").alias("_digest"), "_gone")
    held = {c: f"column_{n}" for n, c in enumerate(plain.columns) if c not in ("doc_id", "text")}
    out = plain.select("doc_id", "text", *(F.col(f"`{c}`").alias(v) for c, v in held.items()))
    # One plan at every size: the texts that lose lines must meet their lists.
    out = out.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_digest")), "left")
    none = F.array().cast("array<int>")
    removed = F.coalesce("_gone", none)
    parts = F.split("text", "\n", -1)
    # Numbers are looked up in pieces between removed lines, so long lists cost no more than their length.
    edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(parts)))

    def between(e: Column, s: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(s, e[k - 1] + 2, e[k] - e[k - 1] - 1))
        return F.array_join(F.flatten(pieces), "\n")

    left = F.transform(F.array(F.struct(edges.alias("e"), parts.alias("s"))), lambda x: between(x["e"], x["s"]))[0]
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(left)
    own = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(v) for c, v in held.items()}
    return out.select(*(own[c].alias(c) for c in plain.columns), F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), removed.alias("removed"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delete_lines() over all documents: the numbers of the lines that go and a digest of what stays (null texts: of the empty one)."""
    out = delete_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
