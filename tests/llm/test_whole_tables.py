"""The registered queries that SQL cannot express against brute force over all rows of their tables."""

import hashlib
import html as markup
import math
import re
from collections import Counter

import duckdb
import pytest

from larkspur.llm import line_dedup, queries, token_counts

SMALL = "/root/testdata/sf0.001"
ENDS = "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section nav header footer title body head html pre blockquote".split()


def read(table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SMALL}/{table}.parquet'").fetchall()


def sha1(x):
    return "sha1:" + hashlib.sha1(x.encode()).hexdigest()


def plain(page):
    """A page's text by walking through it tag by tag."""
    out, at = [], 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        low = page[start : start + 8].lower()
        silent = next((n for n in ("script", "style") if low.startswith(f"<{n}")), None)
        if silent or low.startswith("<!--"):
            end = page.lower().find(f"</{silent}>" if silent else "-->", start)
            at = len(page) if end < 0 else end + len(f"</{silent}>" if silent else "-->")
            continue
        end = page.find(">", start)
        name = re.match(r"</?([a-z0-9]+)", page[start : end + 1].lower())
        out.append("\n" if name and name[1] in ENDS else "")
        at = end + 1
    text = markup.unescape("".join(out)).replace("\xa0", " ")
    return "\n".join(x for x in (re.sub("[ \t\f\r]+", " ", line).strip(" ") for line in text.split("\n")) if x)


def test_warc(spark):
    got = {(r.page_id, r.type): r for r in queries.op7_warc(spark, SMALL).collect()}
    pages = read("pages", "page_id, url, html")
    assert len(got) == 2 * len(pages)
    for i, url, page in pages:
        text, about = got[i, "conversion"], got[i, "metadata"]
        assert (text.block_digest, text.content_length) == (sha1(plain(page)), len(plain(page).encode()))
        assert text.payload_digest == about.payload_digest == sha1(page) and text.target_uri == url == about.target_uri
        assert text.refers_to == about.refers_to and text.concurrent_to == about.record_id and about.concurrent_to == text.record_id
        assert text.source_status == "200" and text.source_headers == f"Content-Type: text/html; charset=utf-8; Content-Length: {len(page.encode())}" == about.source_headers
    assert len({r.record_id for r in got.values()} | {r.refers_to for r in got.values()}) == 3 * len(pages)


def test_line_dedup(spark):
    pages = [(i, re.sub("^[a-z]+://([^/?#:]*).*", r"\1", url).lower(), plain(page)) for i, url, page in read("pages", "page_id, url, html")]
    on = Counter((host, line) for _, host, text in pages for line in set(text.split("\n")) - {""})
    size = Counter(host for _, host, _ in pages)
    common = {k for k, n in on.items() if n >= line_dedup.MIN_REPEATS and n / size[k[0]] > line_dedup.RATIO}
    got = {r.page_id: r for r in queries.op9_line_dedup(spark, SMALL).collect()}
    for i, host, text in pages:
        kept = [x for x in text.split("\n") if (host, x) not in common]
        assert (got[i].host, got[i].n_dropped) == (host, len(text.split("\n")) - len(kept))
        assert got[i].text_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def words(text):
    return [x for x in re.split("[ \t\n\x0b\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]


def test_lm_score(spark):
    docs = {i: words(t) for i, t in read("documents", "doc_id, text")}
    one, two = Counter(w for x in docs.values() for w in x), Counter(p for x in docs.values() for p in zip(x, x[1:], strict=False))
    for r in queries.op10_lm_score(spark, SMALL).collect():
        own = docs[r.doc_id]
        mine, pairs = Counter(own), Counter(zip(own, own[1:], strict=False))
        rest, logs, back = max(sum(one.values()) - len(own), 1), [], 0
        for k, x in enumerate(own):
            pair = (own[k - 1], x) if k else None
            if k and two[pair] > pairs[pair]:
                logs.append(math.log((two[pair] - pairs[pair]) / (one[pair[0]] - mine[pair[0]])))
                continue
            back += 1
            c = one[x] - mine[x]
            logs.append(math.log((0.4 if k else 1.0) * c / rest if c else 0.16 / rest))
        assert (r.n_words, r.n_backoff) == (len(own), back) and r.log_score == pytest.approx(sum(logs), abs=1e-6)


def test_token_counts(spark):
    own = token_counts.vocabulary(queries.PIECES)
    known = {}

    def best(word):
        if word not in known:
            x = token_counts.START + word.encode()
            score = [(0.0, 0)] + [(math.inf, 0)] * len(x)
            for j in range(1, len(x) + 1):
                for i in range(max(0, j - own.longest), j):
                    cost = own.cost.get(x[i:j], own.byte_cost if j - i == 1 else math.inf)
                    score[j] = min(score[j], (round(score[i][0] + cost, 6), score[i][1] + 1))
            known[word] = score[-1][1]
        return known[word]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op8_token_counts(spark, SMALL).collect()}
    for i, text in read("documents", "doc_id, text"):
        own_words = [x for x in re.split("[ \t\n\x0b\f\r]+", text or "") if x]
        assert got[i] == (len(own_words), sum(map(best, own_words)))
