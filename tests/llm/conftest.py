"""Small tables with awkward rows: nulls, empty and long texts, repeats, near copies, columns with clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = [a + b for a in ("ka", "mo", "ri", "tel", "su", "ban", "dor", "ve") for b in ("na", "los", "mi", "ter", "pu", "x", "ga", "rin")]


def texts() -> list[str | None]:
    rnd = random.Random(5)

    def prose(n: int) -> str:
        return " ".join(rnd.choice(WORDS) for _ in range(n))

    shared = "\n".join(prose(20) for _ in range(4))
    out = [None, "", "   ", "\n\n", "one", "two words", "a\tb\nc d"]
    out += [prose(rnd.randint(5, 200)) for _ in range(40)]
    base = prose(120)
    out += [base] * 5 + [base + " tail", base.upper(), base.rsplit(" ", 3)[0]]
    out += [prose(15) + "\n" + shared + "\n" + prose(15) for _ in range(4)]
    out += ["mail bob.x@site.example.org or 10.0.0.256 and 192.168.1.20.", "card 4111 1111 1111 1111 4 4111111111111111 phone +44 (0)20 7946 0958 x"]
    out += ["Ünïcode 😀 日本語テキスト ½ don't we'll\r\n  x", "repeat " * 40, "# * $ | <tag> & %", "z" * 30000, prose(9000)]
    return out


def write(base, rows: list[tuple], pages: list[tuple], labels: list[tuple]) -> str:
    ids, own = [r[0] for r in rows], [r[1] for r in rows]
    n = len(rows)
    text = pa.array(own, pa.string())
    clash = {"_text": text, "text_": text, "score": pa.nulls(n, pa.float64()), "kept": pa.nulls(n, pa.bool_()), "idx": pa.nulls(n, pa.int64()), "spans": text, "key": text, "rank": text}
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": text, "lang": pa.array(["en"] * n, pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([len(t or "") for t in own], pa.int64())}
    pq.write_table(pa.table(docs | clash), f"{base}/documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}), f"{base}/pages.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), f"{base}/labels.parquet")
    return str(base)


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    rows = list(enumerate(texts(), 20))
    body = "<html><nav>menu here</nav><article><h1>T</h1><p>Body &amp; soul  number {0}</p></article><footer>foot</footer></html>"
    pages = [(0, None, None), (1, "", ""), (2, "x", "plain"), *((n, "https://a.example/p", body.format(n)) for n in range(3, 12))]
    return write(tmp_path_factory.mktemp("odd"), rows, pages, [(i, i % 2, i % 2) for i, _ in rows if i % 3 == 0]), rows


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), [], [], [])
