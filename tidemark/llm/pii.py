"""Information-theoretic sanitisation, with DataFrame functions only.

Fixed patterns find protected entities (email, ip, card, phone).  The corpus then tells how much
each term gives away about them: with p the share of documents, a term t discloses entity kind e to the
degree PMI(t, e) / -log p(e), which is 1 if every document with t holds an entity of that kind.
The share of t's documents that hold one is taken at the lower end of its Wilson interval (CONFIDENCE
standard deviations), so a rare term needs fewer documents the rarer the entity is, and chance does not
disclose.  Terms are generalised from GENERALISE on (to their first
letter or digit) and removed from REMOVE on, in the documents that hold such an entity.  Base entities are always
masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table
from tidemark.llm.rules import SPACE, let

KINDS = ("email", "ip", "card", "phone")
#: The patterns match as plain leftmost greedy ones would; possessive repeats and the look-behinds only
#: stop the engine from trying again inside a run that has failed as a whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": r"[0-9]", "phone": "+"}
CONFIDENCE, GENERALISE, REMOVE = 3.0, 0.9, 0.98
#: What makes a word a term.
TERM = r"[\p{L}\p{N}]{3}"
#: Elements of an array that are added up one by one in running().
STRETCH = 128


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check digit of a string of at most 19 digits holds."""

    def value(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def is_kind(k: int):
    return lambda x: x["kind"] == k


def running(own: Column, add) -> Column:
    """add (associative, with 0 as its start) of every element and all before it; own (of integers, from 0 on) is bound by let.

    Elements are added up within stretches, and so are the stretches, so long arrays cost no square.
    """
    n = F.size(own)
    total = lambda x: F.aggregate(x, F.lit(0), add)
    places = F.when(n > 0, F.sequence(F.lit(0), F.shiftright(n - 1, 7))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(places, lambda b: total(F.slice(own, b * STRETCH + 1, F.lit(STRETCH))))
    before = let(sums, lambda x: F.transform(x, lambda _, b: total(F.slice(x, F.lit(1), b))))

    def at(x: Column, i: Column) -> Column:
        b = F.shiftright(i, 7)
        return add(F.get(x, b), total(F.slice(own, b * STRETCH + 1, i - b * STRETCH + 1)))

    return let(before, lambda x: F.transform(own, lambda _, i: at(x, i)))


EMPTY = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, kind: str) -> Column:
    """Spans (start, kind, end) in code points of the matches that hold, in order."""
    number, pattern = KINDS.index(kind), PATTERNS[kind]

    def spans(both: Column) -> Column:
        found, between = both["m"], both["s"]
        steps = F.transform(found, lambda m, i: F.length(F.get(between, i)) + F.length(m))

        def placed(ends: Column) -> Column:
            each = F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(number).alias("kind"), F.get(ends, i).alias("end"), m.alias("m")))
            good = F.filter(each, lambda x: holds(kind, x["m"]))
            return F.transform(good, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

        return let(let(steps, lambda x: running(x, lambda a, b: a + b)), placed)

    some = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("s"))
    need = NEEDS[kind]
    tried = text.rlike(need) if need.startswith("[") else F.instr(text, need) > 0
    return F.when(tried, let(some, spans)).otherwise(F.array().cast(EMPTY))


def entities(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with _text (never null) and _base, the spans of all kinds by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_text", text).withColumn("_base", F.sort_array(F.concat(*(matches(text, k) for k in KINDS))))


def bare(word: Column) -> Column:
    """A word's term: lower case without the signs around it."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def disclosing(found: DataFrame) -> DataFrame:
    """term, kind (number), remove: terms whose disclosure of a kind reaches GENERALISE.

    found: _text, _base of the whole corpus (rows that repeat count each).  Counts are of documents; they are summed before
    the shuffle, and nothing reaches the driver but their totals.  An empty corpus has no terms.
    """
    has = [F.exists("_base", is_kind(k)).alias(f"has{k}") for k in range(len(KINDS))]
    one = [F.count_if(f"has{k}").alias(f"n{k}") for k in range(len(KINDS))]
    total = found.select(*has).agg(F.count("*").alias("all"), *(F.count_if(f"has{k}").alias(f"all{k}") for k in range(len(KINDS)))).first()
    terms = found.select(F.explode(F.array_distinct(F.transform(F.filter(F.split("_text", SPACE), lambda w: w.rlike(TERM)), bare))).alias("term"), *has)
    counts = terms.groupBy("term").agg(F.count("*").alias("n"), *one)
    rows, z = [], CONFIDENCE**2
    for k in range(len(KINDS)):
        share = total[f"all{k}"] / total["all"] if total["all"] else 0
        if 0 < share < 1:
            n, p = F.col("n").cast("double"), F.col(f"n{k}") / F.col("n")
            least = (p + z / (2 * n) - F.sqrt(z * (p * (1 - p) + z / (4 * n)) / n)) / (1 + z / n)
            degree = F.when(least > share, F.log(least / share) / F.log(F.lit(1 / share)))
            rows.append(F.struct(F.lit(k).alias("kind"), degree.alias("degree")))
    if not rows:
        return counts.select("term", F.lit(0).alias("kind"), F.lit(False).alias("remove")).limit(0)
    each = counts.where(F.greatest(*(F.col(f"n{k}") for k in range(len(KINDS)))) > 1).select("term", F.explode(F.array(*rows)).alias("x"))
    return each.where(F.col("x.degree") >= GENERALISE).select("term", F.col("x.kind").alias("kind"), (F.col("x.degree") >= REMOVE).alias("remove"))


def _term_spans(found: DataFrame, terms: DataFrame) -> DataFrame:
    """_row and _extra: spans (start, kind, end) of disclosing terms; kind 4 is generalised, 5 removed.

    found: _row (unique), _text, _base.  Only rows with entities are split into words, and words are placed only in
    rows that have such a term; a word that a base entity overlaps is left to it.
    """
    with_some = found.where(F.size("_base") > 0).select("_row", "_text", "_base")
    pieces = F.posexplode(F.split("_text", r"[\x20\x09-\x0D]", -1)).alias("pos", "word")
    words = with_some.select("_row", F.transform("_base", lambda x: x["kind"]).alias("kinds"), pieces).where(F.col("word").rlike(TERM))
    hit = words.select("_row", "kinds", "pos", bare(F.col("word")).alias("term")).join(terms, "term").where(F.array_contains("kinds", F.col("kind")))
    hit = hit.groupBy("_row", "pos").agg(F.max("remove").alias("remove"))
    rows = with_some.join(hit.select("_row").distinct(), "_row", "left_semi")
    upto = F.sum(F.length("word") + 1).over(Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = rows.select("_row", pieces).withColumn("end", upto.cast("int")).join(hit, ["_row", "pos"])
    span = F.struct((F.col("end") - F.length("word")).alias("start"), F.when(F.col("remove"), 5).otherwise(4).alias("kind"), F.col("end"))
    spans = placed.groupBy("_row").agg(F.collect_list(span).alias("each")).join(rows.select("_row", "_base"), "_row")
    free = F.filter("each", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return spans.select("_row", free.alias("_extra"))


MASKS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "", "")


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by the mask of its kind; what spans share is replaced once.  A generalised term keeps its first sign."""

    def cut(own: Column) -> Column:
        ends = let(F.transform(own, lambda x: x["end"]), lambda e: running(e, lambda a, b: F.greatest(a, b)))

        def parts(done: Column) -> Column:
            def part(x: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(done, i - 1)).otherwise(F.lit(0))
                mask = F.when(x["kind"] == 4, F.concat(F.lit("<TERM "), F.upper(F.substring(text, x["start"] + 1, F.lit(1))), F.lit(">"))).otherwise(F.get(F.array(*map(F.lit, MASKS)), x["kind"]))
                return F.concat(F.substring(text, before + 1, F.greatest(x["start"] - before, F.lit(0))), F.when(x["end"] > before, mask).otherwise(F.lit("")))

            last = F.array_max(F.transform(own, lambda x: x["end"]))
            return F.concat(F.array_join(F.transform(own, part), ""), F.substring(text, last + 1, F.length(text)))

        return let(ends, parts)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, cut))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text masked and spans (array of start, kind, end; kinds 0 to 3 are KINDS, 4 a term
    generalised, 5 a term removed) and base (the first four kinds).  Positions are code points of the text as it was.

    A null text holds nothing and stays null.  Every row is a document of its own, also where it
    repeats a doc_id (which may be null).  Columns named spans or base are replaced, all others stay.
    An empty table gives an empty result.  Rows with their base spans are written once, and all steps read them there.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    plain = {c: f"column_{n}" for n, c in enumerate(docs.drop("spans", "base").columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(v) for c, v in plain.items())).withColumn("text", F.col(plain["text"]))
    found = scratch.save("found", entities(rows).drop("text", "_text").withColumn("_row", F.monotonically_increasing_id()))
    found = found.withColumn("_text", F.coalesce(F.col(plain["text"]), F.lit("")))
    terms = scratch.save("terms", disclosing(found))
    extra = scratch.save("extra", _term_spans(found, terms))
    out = found.join(extra, "_row", "left").withColumn("spans", F.sort_array(F.concat("_base", F.coalesce("_extra", F.array().cast(EMPTY)))))
    own = {c: F.col(v) for c, v in plain.items()} | {"text": F.when(F.col(plain["text"]).isNotNull(), masked(F.col("_text"), F.col("spans")))}
    return out.select(*(x.alias(c) for c, x in own.items()), "spans", F.col("_base").alias("base"))


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term", "removed")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sanitise() over all documents: counts and digests of its spans; a null text holds nothing."""
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", is_kind(k))).cast("bigint").alias(f"n_{KINDS[k]}")

    return out.select("doc_id", *map(count, range(len(KINDS))), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.sha2("text", 256).alias("text_sha256"))
