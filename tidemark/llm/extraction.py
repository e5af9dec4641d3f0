"""Main text of web pages by equivalence classes of their tokens.

A page is a row of tokens: tags in their place (the path of tags above them, with class and id)
and its text blocks, each told from earlier copies on the page and counted as its words.  Over the different pages of a
host every token has an occurrence vector; tokens with the same vector form a class.  A class is
valid if it has two tokens or more, each once a page, on enough pages; valid classes nest along their
paths into the host's template, in which a tag stays only below tags that are in it too.  What is left between
its tokens are slots, and a text block belongs to the slot of the innermost template tag around it.

Roles are given to slots, once for a host.  The text of template tokens goes; so do the slots inside menus, headers,
footers, sidebars, notices, adverts, forms and comments, which only names can tell from data, unless a named one
holds most of the host's text; and where the template has an article or main, the slots outside
it.  All other slots are extracted.  An h1 inside article or main is its title and stays, also where it repeats.  Names of
tags that are not in the template (all of them, on pages without one) decide on their own.
"""

from __future__ import annotations

import dataclasses
import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: Share of a host's different pages that a class must be on, the least number of them, and the least size of a class.
SUPPORT, LEAST_PAGES, LEAST_TOKENS = 0.5, 3, 2
#: An element with this share of the text outside menus and the like is not set aside for its class.
MOST_TEXT = 0.6

# Element names of HTML by their role.
RAW = ("script", "style", "textarea", "title", "template", "svg", "iframe")
ASIDE = frozenset("nav header footer aside form button dialog menu head fieldset label input select".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul aside dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Names in class, id or role (whole, or joined of nothing but these) that mark an element as none of the main text.
_MARK = r"(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|menu|nav\w*|breadcrumbs?|sidebar\w*|side|header|footer|masthead|comments?|replies|disqus|respond|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|widget|pagination|pager|skip)"
MARKS = re.compile(rf"(?:^|\s){_MARK}(?:[_-]{_MARK})*(?:$|\s)", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
TITLE = re.compile(r"/h1(?:\[[^\]]*\])?(?:/|\Z)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclasses.dataclass
class Element:
    path: str
    parent: str
    #: "tag" (its name sets it aside), "mark" (its class or id may), "main", or "".
    role: str
    #: Characters of the text in it that no tag sets aside.
    held: int = 0


@dataclasses.dataclass
class Block:
    text: str
    #: The elements around it, from the outermost; where a main element opens, what is open around it counts no more.
    around: tuple[int, ...]
    path: str
    token: str


def parse(page: str | None) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its elements in the order of their tags."""
    page = page or ""
    blocks: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int, tuple[int, ...], bool]] = []  # name, element, elements around, whether in main
    text: list[str] = []
    seen: dict[str, int] = {}

    def flush() -> None:
        own = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if own:
            _, at, around, _ = stack[-1] if stack else ("", -1, (), False)
            path = elements[at].path if stack else ""
            token = f"{path}={own}"
            seen[token] = n = seen.get(token, 0) + 1
            blocks.append(Block(own, around, path, token if n == 1 else f"{n}:{token}"))

    at = 0
    for m in TOKEN.finditer(page):
        text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCKS
        if block:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if not block and any(x[0] in BLOCKS for x in stack[k + 1 :]):
                        break
                    del stack[k:]
                    break
            continue
        if block:
            while stack and (stack[-1][0] not in BLOCKS or stack[-1][0] == "p" or (name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == name)):
                stack.pop()
        marks = " ".join(a or b or c for a, b, c in NAMED.findall(m[4])) if m[4] else ""
        _, above, around, main = stack[-1] if stack else ("", -1, (), False)
        parent = elements[above].path if stack else ""
        role = ""
        if name in MAIN:
            role = "main"
            if not main:
                around = ()  # an unclosed menu or header does not swallow the article
        elif name in ASIDE and not (name == "header" and main):
            role = "tag"
        elif marks and name not in ("html", "body") and MARKS.search(marks):
            role = "mark"
        elements.append(Element(f"{parent}/{name}" + (f"[{marks}]" if marks else ""), parent, role))
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, len(elements) - 1, (*around, len(elements) - 1), main or role == "main"))
    text.append(page[at:].split("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", page[at:]) else page[at:])
    flush()
    for b in blocks:
        if not any(elements[k].role == "tag" for k in b.around):
            for k in b.around:
                elements[k].held += len(b.text)
    return blocks, elements


def host_of(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m[1].lower() if m else ""


@functools.lru_cache(1 << 16)
def _name(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode()) - (1 << 63)


def open_text(blocks: list[Block], elements: list[Element]) -> int:
    """Characters of the text that no tag sets aside."""
    return sum(len(b.text) for b in blocks if not any(elements[k].role == "tag" for k in b.around))


ROLES = ("", "tag", "mark", "main")
ROW = "host string, page bigint, token bigint, n bigint, size bigint, parent bigint, role int, held bigint, whole bigint"


def tokens(pages: DataFrame) -> DataFrame:
    """Rows of ROW: host, page (digest of the html), token, its count on the page and its size (words of a text block, LEAST_TOKENS at most; 1 of a tag).

    Of tags also the token of the parent, the role, the characters held and those of the whole page.
    Pages without a host give none, those with a null html none but their count: tag and text tokens of an empty page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32()}.get(x.split()[1], pa.int64()) for x in ROW.split(", ")]
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, digest = host_of(url), _name(page or "")
                if not host:
                    continue
                blocks, elements = parse(page)
                whole = open_text(blocks, elements)
                count: dict[str, int] = {}
                held: dict[str, int] = {}
                for e in elements:
                    count[e.path] = count.get(e.path, 0) + 1
                    held[e.path] = held.get(e.path, 0) + e.held
                for e in {e.path: e for e in elements}.values():
                    rows.append((host, digest, _name(e.path), count[e.path], 1, _name(e.parent) if e.parent else None, ROLES.index(e.role), held[e.path], whole))
                rows += [(host, digest, _name(b.token), 1, min(LEAST_TOKENS, b.text.count(" ") + 1), None, None, 0, whole) for b in blocks]
                if not rows or rows[-1][1] != digest:
                    rows.append((host, digest, _name(""), 2, 0, None, None, 0, 0))  # so that the page is counted
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pages.select("url", "html").mapInArrow(run, ROW)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host and the tokens of its valid equivalence classes: one string a host, of "token parent role" joined by commas.

    Sums replace the vectors themselves: tokens on the same pages with the same counts have the
    same sum of hashes.  A host's template is bounded, as each of its tokens is on half of the pages at least.
    A named element that holds most of the host's text has no role.
    """
    seen = scratch.save("tokens", tokens(pages))
    # A page that repeats counts once: its rows are the same in every copy.
    once = seen.groupBy("host", "page", "token").agg(*(F.max(c).alias(c) for c in ("n", "size", "parent", "role", "held", "whole")))
    share = F.coalesce(F.sum("held") / F.nullif(F.sum("whole"), F.lit(0)), F.lit(0.0))
    role = F.when((F.max("role") == ROLES.index("mark")) & (share >= MOST_TEXT), 0).otherwise(F.max("role"))
    vector = once.groupBy("host", "token").agg(F.count("*").alias("pages"), F.max("n").alias("most"), F.max("size").alias("size"), F.max("parent").alias("parent"), role.alias("role"), F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"))
    whole = seen.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all"))
    row = F.concat_ws(" ", F.col("token").cast("string"), F.coalesce(F.col("parent").cast("string"), F.lit("-")), F.coalesce(F.get(F.array(*(F.lit(x or "plain") for x in ROLES)), F.col("role")), F.lit("text")))
    classes = vector.where((F.col("most") == 1) & (F.col("pages") >= LEAST_PAGES)).groupBy("host", "vector").agg(F.sum("size").alias("size"), F.max("pages").alias("pages"), F.collect_list(row).alias("tokens"))
    valid = classes.where(F.col("size") >= LEAST_TOKENS).join(whole, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    return scratch.save("templates", valid.groupBy("host").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("tokens"))), ",").alias("template")))


class Template:
    """The nested tokens of a host: its texts, its tags, and those of them that are set aside or are the main element."""

    def __init__(self, packed: str | None):
        rows = {int(t): (p, r) for t, p, r in (x.split() for x in packed.split(","))} if packed else {}
        self.texts = frozenset(t for t, (_, r) in rows.items() if r == "text")

        def nested(t: int) -> bool:
            while t in rows:
                parent = rows[t][0]
                if parent == "-":
                    return True
                t = int(parent)
            return False

        tags = {t: r for t, (_, r) in rows.items() if r != "text" and nested(t)}
        self.tags, self.aside, self.main = frozenset(tags), frozenset(t for t, r in tags.items() if r in ("tag", "mark")), frozenset(t for t, r in tags.items() if r == "main")


NONE = Template(None)


def main_text(page: str | None, template: Template = NONE) -> str:
    blocks, elements = parse(page)
    most = MOST_TEXT * open_text(blocks, elements)
    names = [_name(e.path) for e in elements]

    def out(k: int) -> bool:
        if names[k] in template.tags:
            return names[k] in template.aside
        e = elements[k]
        return e.role == "tag" or (e.role == "mark" and e.held < most)

    aside = [out(k) for k in range(len(elements))]
    kept = [b for b in blocks if not any(aside[k] for k in b.around)]
    own = [b for b in kept if any(names[k] in template.main for k in b.around)]
    inside = {id(b) for b in kept if any(elements[k].role == "main" for k in b.around)}
    region = own or [b for b in kept if id(b) in inside] or kept
    return "\n".join(b.text for b in region if _name(b.token) not in template.texts or (id(b) in inside and TITLE.search(b.path)))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html and any other columns) with text; a column of that name is replaced.

    A null html is empty and gives an empty text, as does a page without main text.  Pages without
    a host (null urls too), or of hosts with fewer than LEAST_PAGES different pages, have no template and are read
    by their tags alone.  Repeated pages count once in the template and are read alike.  An empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    pages = pages.drop("text")
    plain = {c: f"column_{n}" for n, c in enumerate(pages.columns)}
    known = templates(pages, scratch).where("host <> ''")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    joined = pages.select(*(F.col(f"`{c}`").alias(p) for c, p in plain.items()), host.alias("host")).join(known, "host", "left").select(*plain.values(), "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = functools.lru_cache(256)(Template)
        for batch in batches:
            html, known = (batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (plain["html"], "template"))
            text = [main_text(h, read(t)) for h, t in zip(html, known, strict=True)]
            yield pa.record_batch([*batch.columns[: len(plain)], pa.array(text, pa.string())], [*plain.values(), "text"])

    shape = ", ".join(f"{p} {pages.schema[c].dataType.simpleString()}" for c, p in plain.items())
    return joined.mapInArrow(run, f"{shape}, text string").select(*(F.col(p).alias(c) for c, p in plain.items()), "text")


def op4_template_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract() over all pages; a null html or url counts as empty."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
