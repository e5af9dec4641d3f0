"""Each query against a plain version on the awkward tables, on empty tables, and on held-out labels."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import extraction, linededup, neardup, packing, pii, search
from tidemark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_best_two_fit", "op4_template_slots", "op10_block_max_wand"}))
def test_one_row_a_document(spark, odd, name):
    path, rows = odd
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, path).collect()) == [i for i, _ in rows]


def luhn(d: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def personal(text: str):
    found = [(m.start(), k, m.end(), name) for k, (name, (p, ok)) in enumerate(KINDS.items()) for m in re.finditer(p, text) if ok(m.group())]
    return Counter(f[3] for f in found), sha(",".join(f"{n}:{s}:{e}" for s, _, e, n in sorted(found)).encode())


def documents(path):
    return duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet'").fetchall()


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op1(spark, odd, where):
    path = odd[0] if where == "odd" else SMALL
    got = {r["doc_id"]: r for r in QUERIES["op1_disclosure"](spark, path).collect()}
    for i, text in documents(path):
        n, digest = personal(text or "")
        assert [got[i][f"n_{k}"] for k in KINDS] == [n[k] for k in KINDS], i
        assert got[i]["base_sha256"] == digest, i


def test_op1_terms(spark):
    """Planted terms: one seen only with emails, one nearly only; degrees and masked texts by hand."""
    rows = [(n, f"note{n} zorblax mail a{n}@b.example now") for n in range(200)]
    rows += [(200 + n, f"note quixel mail c{n}@d.example 5551234x") for n in range(60)] + [(300, "quixel alone"), (301, "zorblax"), (301, "mail x@y.example zorblax")]
    rows += [(1000 + n, f"plain words of text {n}") for n in range(2000)]
    out = pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    share = 261 / len(rows)
    z = pii.CONFIDENCE**2

    def degree(hits, n):
        p = hits / n
        least = (p + z / (2 * n) - math.sqrt(z * (p * (1 - p) + z / (4 * n)) / n)) / (1 + z / n)
        return math.log(least / share) / math.log(1 / share)

    state = {w: degree(*c) for w, c in {"zorblax": (201, 202), "quixel": (60, 61), "mail": (261, 261), "now": (200, 200), "5551234x": (60, 60), "note": (60, 60)}.items()}
    mask = {w: w if d < pii.GENERALISE else "" if d >= pii.REMOVE else f"<TERM {w[0].upper()}>" for w, d in state.items()}
    assert set(mask.values()) & {""} and any("TERM" in m for m in mask.values())
    want = []
    for i, t in rows:
        words = [re.sub(r"^[^@ ]+@[^@ ]+$", "<EMAIL>", w) if "@" in w else mask.get(w, w) if "@" in t else w for w in t.split(" ")]
        want.append((i, " ".join(words)))
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(want)


def test_op1_many_matches(spark):
    """A text with thousands of addresses, and two texts with one id."""
    text = " ".join(f"user{n}@host{n}.example 10.0.{n % 300}.7" for n in range(3000))
    rows = [(7, text), (7, "a@b.cd tail"), (None, "x@y.zz")]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((len(r["base"]), r["text"][-8:]) for r in got) == [(1, "<EMAIL>"), (1, "IL> tail"), (6000 - sum(n % 300 > 255 for n in range(3000)), "<EMAIL> 10.0.299.7"[-8:])]
    own = next(r for r in got if len(r["base"]) > 1)
    want = sorted((m.start(), k, m.end()) for k, p in enumerate(list(KINDS.values())[:2]) for m in re.finditer(p[0], text) if p[1](m.group()))
    assert [tuple(x) for x in own["base"]] == want


def held_out(spark, name, label, mod, rest, at, path=SMALL):
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{path}/labels.parquet' WHERE {label} IS NOT NULL").fetchall())
    rows = QUERIES[name](spark, path).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= at) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)
    return [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def rates(pairs):
    """Shares of the rows labelled 1, and of those labelled 0, that are predicted right."""
    return [sum(p == y for p, y in pairs if y == k) / sum(y == k for _, y in pairs) for k in (1, 0)]


def test_op2_held_out(spark):
    pairs = held_out(spark, "op2_latent_neighbours", "quality", 3, 1, 0.5)
    assert min(rates(pairs)) >= 0.9


def test_op7_held_out(spark):
    pairs = held_out(spark, "op7_string_kernel", "toxic", 4, 2, 0.3)
    assert sum(p == y for p, y in pairs) >= 0.9 * len(pairs)


def test_op7_recall(spark):
    """With the labels of a table of 10000 documents: nine in ten toxic ones are caught, and nine in ten of those caught are toxic."""
    pairs = held_out(spark, "op7_string_kernel", "toxic", 4, 2, 0.3, "/root/testdata/sf0.1")
    caught = sum(p == y == 1 for p, y in pairs)
    assert caught >= 0.9 * sum(y for _, y in pairs) and caught >= 0.9 * sum(p for p, _ in pairs)


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op3(spark, odd, where):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = odd[0] if where == "odd" else SMALL
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, used = defaultdict(list), defaultdict(list)
    for r in QUERIES["op3_best_two_fit"](spark, path).collect():
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    rows = documents(path)
    assert set(pieces) == {i for i, _ in rows}
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(n, n * 4096, len(p), zlib.crc32(struct.pack(f"<{len(p)}I", *p))) for n, p in enumerate(parts)], i
    total = 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
    assert len(used) <= math.ceil(total / 4096 * 1.03) + 1


def test_op3_special_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>word<|endoftext|>", "A <|ENDOFTEXT|> b.", "x<|endoftext|", "<|endoftext|><|endoftext|>", "plain words here, too."]
    got = packing.WordEncoder(path).encode_all([t.encode() for t in texts])
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_op4(spark, odd):
    got = {r["page_id"]: r for r in QUERIES["op4_template_slots"](spark, odd[0]).collect()}
    assert len(got) == 12 and got[0]["text"] == "" and got[1]["text"] == ""
    for n in range(3, 12):
        assert got[n]["text"] == f"T\nBody & soul number {n}" and got[n]["n_chars"] == len(got[n]["text"])


def mains(spark, bodies):
    pages = [(n, f"https://b.example/{n}", x) for n, x in enumerate(bodies)]
    out = extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]


def test_op4_repeated_blocks(spark):
    notice, own = "<p>Read this note first</p>", "<p>Story {0} goes on</p>"
    named = [f"<html><article><h1>News</h1>{notice if n < 6 else ''}{own.format(n)}{notice if n < 6 else ''}</article></html>" for n in range(8)]
    assert mains(spark, named) == [f"News\nStory {n} goes on" for n in range(8)]
    bare = [f"<html><body><div><h2>Head {n}</h2></div>{notice}<div>{own.format(n) * 2}</div></body></html>" for n in range(5)]
    assert mains(spark, bare) == [f"Head {n}" + f"\nStory {n} goes on" * 2 for n in range(5)]


def soup(n):
    """A page whose tags tell nothing: menu and footer repeat, headline and body are its own; a remark is on two pages only."""
    remark = "<div><div>Said twice only</div></div>" if n < 2 else ""
    return f"<html><body><div><div>Home and news</div></div><section><p>Head {n}</p><p>Body of page {n} here</p>{remark}</section><div><p>All rights are ours</p></div></body></html>"


def test_op4_template_decides():
    """Without the template every page keeps its menu and footer; with it, none does."""
    pages = [soup(n) for n in range(8)]
    want = [f"Head {n}\nBody of page {n} here" + ("\nSaid twice only" if n < 2 else "") for n in range(8)]
    assert all(extraction.main_text(x) == f"Home and news\n{w}\nAll rights are ours" for x, w in zip(pages, want, strict=True))


def test_op4_soup(spark):
    assert mains(spark, [soup(n) for n in range(8)]) == [f"Head {n}\nBody of page {n} here" + ("\nSaid twice only" if n < 2 else "") for n in range(8)]


def brute_template(bodies):
    """Token -> occurrence vector over the different pages, and the tokens of the valid classes."""
    pages = sorted(set(bodies))
    vectors = defaultdict(lambda: [0] * len(pages))
    size = {}
    for n, page in enumerate(pages):
        blocks, elements = extraction.parse(page)
        for e in elements:
            vectors[e.path][n] += 1
            size[e.path] = 1
        for b in blocks:
            vectors[b.token][n] += 1
            size[b.token] = min(2, len(b.text.split(" ")))
    classes = defaultdict(list)
    for token, v in vectors.items():
        classes[tuple(v)].append(token)
    out = set()
    for v, own in classes.items():
        if max(v) == 1 and sum(v) >= 3 and 2 * sum(v) >= len(pages) and sum(size[t] for t in own) >= 2:
            out.update(own)
    return {extraction._name(t) for t in out}


def test_op4_classes_brute_force(spark):
    """The classes of several hosts, one of them given pages, against occurrence vectors written out."""
    hosts = {"a.example": [soup(n) for n in range(8)], "b.example": [soup(n % 3) for n in range(9)], "c.example": ["<p>x y</p>"] * 5}
    for url, page in duckdb.sql(f"SELECT url, html FROM '{SMALL}/pages.parquet' WHERE html IS NOT NULL ORDER BY page_id").fetchall():
        hosts.setdefault(extraction.host_of(url), []).append(page)
    rows = [(f"https://{h}/{n}", x) for h, own in hosts.items() for n, x in enumerate(own)]
    got = extraction.templates(spark.createDataFrame(rows, "url string, html string"), extraction.Scratch(spark, "t")).collect()
    got = {r["host"]: {int(x.split()[0]) for x in r["template"].split(",")} for r in got}
    want = {h: brute_template(own) for h, own in hosts.items()}
    assert got == {h: t for h, t in want.items() if t} and len(got) > 3


def test_op4_awkward(spark):
    """Null urls have no template; clashing columns stay; elements that show text are not cut."""
    rows = [(n, None, soup(n), "x", "y", "z") for n in range(6)]
    out = extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, _host string, template string, `odd name` string")).collect()
    assert all(r["text"].startswith("Home and news\n") and (r["_host"], r["template"], r["odd name"]) == ("x", "y", "z") for r in out) and len(out) == 6
    assert extraction.main_text("<article><p>a <math><mi>x</mi></math> b</p><noscript>c</noscript></article>") == "a x b\nc"


def test_op4_classes():
    none = extraction.NONE
    assert extraction.main_text('<article class="post comments-open search"><h1 class="entry-header">A</h1><section class="social-history"><p>B</p></section><div class="ad">C</div></article>', none) == "A\nB"
    assert extraction.main_text('<body class="no-sidebar menu"><p>A b c</p><div class="x sidebar">D</div></body>', none) == "A b c"
    assert extraction.main_text('<div class="widget"><p>Nearly all of the text</p></div><p>x</p>', none) == "Nearly all of the text\nx"


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op5(spark, odd, where):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    path = odd[0] if where == "odd" else SMALL
    got = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, path).collect()}
    for i, text in documents(path):
        ids = own.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((text or "").encode())), i


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op6(spark, odd, where):
    path = odd[0] if where == "odd" else SMALL
    got = {r["doc_id"]: r for r in QUERIES["op6_ngram_ratio"](spark, path).collect()}
    for i, text in documents(path):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = Counter(windows)
        repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def later_copies(rows, least):
    """doc -> numbers of lines in a later copy of a run (within one document) of `least` words or more: every window counted."""
    first, gone = {}, defaultdict(set)
    for i, text in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        lines = [(n, x) for n, x in enumerate(text.split("\n")) if WORD.search(x)]
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(WORD.findall(lines[b][1]))
                if words >= least:
                    run = tuple(x for _, x in lines[a : b + 1])
                    if first.setdefault(run, (i, a)) != (i, a):
                        gone[i].update(n for n, _ in lines[a : b + 1])
    return {i: sorted(v) for i, v in gone.items()}


def test_op8(spark, odd):
    path, rows = odd
    out = linededup.delete_lines(spark.read.parquet(f"{path}/documents.parquet")).select("doc_id", "removed", "text").collect()
    want = later_copies(rows, linededup.MIN_WORDS)
    assert {r["doc_id"]: r["removed"] for r in out if r["removed"]} == want and want
    for r in out:
        text = dict(rows)[r["doc_id"]]
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want.get(r["doc_id"], []))
        assert r["text"] == left


def test_op8_short_line(spark):
    """One repeated sentence of nine words between lines of their own."""
    line = "all rights in this text are kept by us"
    rows = [(n, f"own words {n}\n{line}\nother words {n}") for n in range(30)]
    out = linededup.delete_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["removed"] for r in out} == {n: [1] if n else [] for n in range(30)}


def sets_of(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("where", ["odd", "small"])
def test_op9(spark, odd, where):
    path = odd[0] if where == "odd" else SMALL
    own = {i: sets_of(text, 4) for i, text in documents(path)}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in own.items():
        for x in s:
            holders[x].append(i)
    for i, s in own.items():
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(own[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = QUERIES["op9_lsh_forest"](spark, path).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {i: (len(own[i]), root(i), root(i) == i) for i in own}


@pytest.mark.parametrize("common", [0, 90])
def test_op9_recall(spark, common):
    """Planted pairs from 0.80 up in bands of similarity, alone and in a crowd: all texts share `common` words at their start."""
    rng = random.Random(7)
    new = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    opening, rows, planted, apart = new(common), [], defaultdict(list), []
    for changed, n in ((5, 183), (5, 203), (4, 203), (3, 203), (2, 203), (1, 203), (5, 178)):
        for _ in range(60):
            a = opening + new(n - common)
            b = list(a)
            for k in range(changed):
                # Words far enough from each other and from the ends to change four shingles each.
                b[common + 5 + k * (n - common - 10) // changed] = new(1)[0]
            x, y = sets_of(" ".join(a), 4), sets_of(" ".join(b), 4)
            alike = 100 * len(x & y) / len(x | y)
            (planted[int(alike) // 5 * 5] if alike >= 80 else apart).append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()}
    assert {k: sum(got[a] == got[b] == a for a, b in v) for k, v in planted.items()} == {80: 120, 85: 120, 90: 60, 95: 60}
    assert len(apart) == 60 and all(got[i] == i for p in apart for i in p)


def test_op9_hub(spark):
    """Edited copies that are like their base and not like each other: every one must be found."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 2001):
        own = list(base)
        for n, k in enumerate(rnd.sample(range(2, 78), 8)):
            own[5 * k] = f"x{i}_{n}"
        rows.append((i, " ".join(own)))
    sets = [sets_of(t, 4) for _, t in rows]
    alike = [len(s & sets[0]) / len(s | sets[0]) for s in sets]
    assert min(alike) >= 0.8 and len(sets[1] & sets[2]) / len(sets[1] | sets[2]) < 0.8
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 for i, _ in rows}


def test_op9_components(spark, tmp_path):
    """Both ways of joining links against a plain one, and that the small one leaves no trail of stages for the driver to hold."""
    from tidemark.llm.common import Scratch

    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(-40, 60)]
    pairs = chain + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(1 << 62, 7), (500, 500), (-(1 << 62), 600)]
    rng.shuffle(pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want, seen = {}, set()
    for i in sorted(near):
        todo = [i]
        while todo:
            if (j := todo.pop()) not in seen:
                seen.add(j)
                todo += near[j]
                if j != i:
                    want[j] = i
    scratch = Scratch(spark, "components")
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(3)
    for n, few in enumerate((len(pairs), 0)):
        before = spark._jsc.sc().dagScheduler().nextStageId()
        got = neardup.components(links, scratch, f"t{n}", few)
        assert {r["node"]: r["root"] for r in got.collect()} == want
        assert n or spark._jsc.sc().dagScheduler().nextStageId() - before < 12
    assert neardup.components(links.limit(0), scratch, "none").collect() == []


def test_op10(spark, odd):
    path, rows = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = defaultdict(dict)
    for r in search.search(docs, docs, 4).collect():
        got[r["query_id"]][r["rank"]] = (r["doc_id"], r["score"])
    bags = {i: Counter((t or "").encode().lower().split()) for i, t in rows}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    for q, _ in rows:
        scores = {}
        for i, b in bags.items():
            own = [w for w in bags.get(q, ()) if w in b and df[w] > 1]
            if own and i != q:
                scores[i] = sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in own)
        best = sorted(((-s, i) for i, s in scores.items()))[:4]
        assert [got[q][k][1] for k in sorted(got[q])] == pytest.approx([-s for s, _ in best], abs=2e-6), q
        if len({round(s, 5) for s, _ in best}) == len(best):
            # The last place may be shared with documents beyond it.
            assert [got[q][k][0] for k in sorted(got[q])][:-1] == [i for _, i in best][:-1], q


def test_op10_registered(spark, odd):
    """The query as registered: BM25 of all words of every 20th document."""
    path, rows = odd
    got = defaultdict(list)
    for r in sorted(QUERIES["op10_block_max_wand"](spark, path).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["score"])
    bags = {i: Counter((t or "").encode().lower().split()) for i, t in rows}
    bags = {i: b for i, b in bags.items() if b}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    asked = [q for q in bags if q % 20 == 0]
    assert max(len(bags[q]) for q in asked) > 24 and set(got) <= set(asked)
    for q in asked:
        scores = [sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in bags[q] if w in b) for i, b in bags.items() if i != q]
        assert got[q] == pytest.approx(sorted((x for x in scores if x), reverse=True)[:10], abs=2e-6), q


def test_op10_left_out(spark):
    """The query's own document holds the largest sum of its block, but is no answer that another must beat; two languages, of which one is skipped."""
    rnd = random.Random(3)
    words = [[f"{c}{n}" for n in range(400)] for c in "ab"]
    rows = [(i, " ".join(rnd.choices(words[i % 2], k=rnd.randint(20, 60)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r["query_id"]: (r["doc_id"], r["score"]) for r in search.search(docs, docs.where("doc_id % 20 < 2"), 1).collect()}
    bags = {i: Counter(t.split()) for i, t in rows}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    assert set(got) == {i for i in bags if i % 20 < 2}
    for q in got:
        scores = {i: sum(math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w in bags[q] if w in b) for i, b in bags.items() if i != q}
        assert got[q][1] == pytest.approx(max(scores.values()), abs=2e-6) and scores[got[q][0]] == pytest.approx(got[q][1], abs=2e-6), q
    kinds = search.Kinds([t for _, t in rows])
    of = [{kinds(np.unique(search.bag(t))) for i, t in rows if i % 2 == n} for n in (0, 1)]
    assert not of[0] & of[1]


def test_op10_rows_of_shards(spark, monkeypatch):
    """Many shards of longest documents do not return k rows each for a query, and give the same answers as one shard, copies included."""
    rnd = random.Random(7)
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join(rnd.choices(words, k=60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, texts[i % 360]) for i in range(400)], "doc_id bigint, text string")
    whole = [tuple(r) for r in search.search(docs.coalesce(1), docs, 4).orderBy("query_id", "rank").collect()]
    made, against = [], search._against

    def counted(*args):
        found = against(*args)
        made.append((found[0] if isinstance(found, tuple) else found).count())
        return found

    monkeypatch.setattr(search, "_against", counted)
    monkeypatch.setattr(search, "HEAD", 1.0)
    monkeypatch.setattr(search, "HEAD_BYTES", sum(map(len, texts)) // 15)
    parts = [tuple(r) for r in search.search(docs, docs, 4).orderBy("query_id", "rank").collect()]
    assert parts == whole and len(whole) == 1600
    assert sum(made) < 40 * 400, made


def test_op10_blocks_in_one_job(spark, monkeypatch):
    """Blocks of queries share a job for each turn, and the answers are those of one block."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choices([f"w{n}" for n in range(200)], k=30)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = [tuple(r) for r in search.search(docs, docs, 4).orderBy("query_id", "rank").collect()]
    saved, save = [], search.Scratch.save

    def counted(self, name, df):
        saved.append(name)
        return save(self, name, df)

    monkeypatch.setattr(search.Scratch, "save", counted)
    monkeypatch.setattr(search, "QUERY_ROWS", 600)
    assert [tuple(r) for r in search.search(docs, docs, 4).orderBy("query_id", "rank").collect()] == whole and len(whole) == 600
    # About seven blocks, three turns: one of the longest documents, two of the rest.
    assert sum(x.startswith("best") for x in saved) == 3, saved


def test_pipeline_null_and_repeated_ids(spark, odd):
    import corpus_pipeline as C

    long = " ".join(f"word{n}" for n in range(40))
    rows = [(1, long), (1, long), (2, long + " tail"), (None, long), (None, "other"), (3, None), (3, None), (1, "other text of its own " * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string")
    out = C.drop_near_duplicates(spark, docs, odd[0])
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in out.collect()))
    assert got == sorted([(1, long), (1, "other text of its own " * 3), (0, long), (0, "other"), (3, "")])


def test_pipeline(spark, odd, empty):
    import corpus_pipeline as C

    assert C.run(spark, empty).collect() == []
    path, rows = odd
    docs = C.table(spark, path, "documents")
    columns = docs.columns
    texts = dict(rows)
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = C.Scratch(spark, "t").save(name, stage(spark, docs, path))
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before), name
        if name == "line_dedup":
            gone = later_copies(list(before.items()), linededup.MIN_WORDS)
            assert all(after[i] == before[i] for i in after if i not in gone)
        if name == "near_dedup":
            assert len({tuple(sorted(sets_of(t, 5))) for t in after.values() if WORD.search(t or "")}) == sum(bool(WORD.search(t or "")) for t in after.values())
    packed = C.pack(spark, docs, path).collect()
    assert {r["doc_id"] for r in packed} == set(after) <= set(texts)
    assert neardup.near_duplicates(docs).where("not kept").isEmpty()
