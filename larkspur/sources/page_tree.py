"""The posting in a page without structured data: the element that holds most text, or the state that a page streams to its scripts.

A page is read once, tag by tag, with a stack of the elements that are open. Text counts for every open element, so an element's text
is all that stands in it; spans of the page's text, not copies, are kept until the longest is known. What scripts, styles, templates and comments hold is no text. White space is
collapsed to single spaces. An end tag closes the elements above the one it names, and nothing where none is open; elements that are never closed
end with the page.

As a browser's extension would, classes and ids that speak of a job's description are looked at first; if the longest of those has less than `LEAST`
characters, then containers in general, then every div and section. Texts of `MOST` characters and more are passed over.

A page that streams its state pushes pieces of a text of rows; one row names the row that holds the description, and that row begins with its length
in hexadecimal digits. Lengths count characters, as the pieces' reader does.

Nulls and pages without text have no posting text. Pages may be of any length; repeated rows are read each; ties go to the element that opens first.
"""

from __future__ import annotations

import html as markup
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Texts shorter than this are no description, texts as long as this are the page itself.
LEAST, MOST = 200, 50_000
# Elements that have no end tag, and elements whose content is no text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template", "noscript"}
# What names a description (level 0) or a container (level 1): elements, whole attributes or classes, and parts of attributes.
ELEMENTS = ["main", "article"]
WHOLE = [
    {"class": ["jobs-description__content", "jobs-description-content__text", "jobs-box__html-content", "jobs-description", "article__content__view", "section__content"], "data-automation-id": ["jobPostingDescription"]},
    {"role": ["main"], "class": ["job", "posting", "opening", "description", "phs-jobs-content"], "id": ["content", "job-description"]},
]
PARTS = [
    {"class": ["jobs-description"]},
    {"data-testid": ["job", "description"], "class": ["job-description", "JobDescription", "job-detail", "JobDetail"], "id": ["job-description", "JobDescription"]},
]
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z][A-Za-z0-9_:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_PUSH = re.compile(r"__next_f\.push\(\[1,(\"(?:[^\"\\]|\\.)*\")\]\)")
_REF = re.compile(r"\"(?:job_description|jobDescription)\":\"\$(\w+)\"")


def rank(name: str, attributes: str) -> int | None:
    """How much an element speaks of a description: 0 most, 2 least, nothing for elements that are passed over."""
    said = {m[1].lower(): markup.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    for level in (0, 1):
        whole = any(w in (said.get(a, "").split() if a == "class" else [said.get(a)]) for a, words in WHOLE[level].items() for w in words)
        if whole or (level and name in ELEMENTS) or any(w in said.get(a, "") for a, words in PARTS[level].items() for w in words):
            return level
    return 2 if name in ("div", "section") else None


def elements(page: str) -> tuple[list[str], list[tuple[int | None, int, int]]]:
    """The page's pieces of text, and of each element its rank and the pieces it holds, in the order of their start tags."""
    pieces: list[str] = []
    found: list[list] = []
    open_: list[tuple[str, int]] = []
    at, silent = 0, ""
    for tag in _TAG.finditer(page):
        if not silent and tag.start() > at:
            pieces.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if silent:
            if tag[1] and name == silent:
                silent = ""
            continue
        if not name:
            continue
        if tag[1]:
            if any(n == name for n, _ in open_):
                while True:
                    n, k = open_.pop()
                    found[k][2] = len(pieces)
                    if n == name:
                        break
        elif name in SILENT:
            silent = "" if tag[3].endswith("/") else name
        else:
            found.append([rank(name, tag[3] or ""), len(pieces), len(pieces)])
            if name not in VOID and not tag[3].endswith("/"):
                open_.append((name, len(found) - 1))
    if not silent and at < len(page):
        pieces.append(page[at:])
    for _, k in open_:
        found[k][2] = len(pieces)
    return pieces, [tuple(x) for x in found]


def _plain(text: str) -> str:
    return " ".join(markup.unescape(text).split())


def longest_text(page: str) -> str | None:
    """The text of the element that is most likely the description."""
    pieces, found = elements(page)
    plain = [_plain(p) for p in pieces]
    sizes = [0]
    for p in plain:
        sizes.append(sizes[-1] + (len(p) + 1 if p else 0))
    for level in range(3):
        spans = [(sizes[b] - sizes[a] - 1, -k, a, b) for k, (r, a, b) in enumerate(found) if r == level and 0 < sizes[b] - sizes[a] - 1 < MOST]
        if spans and (level or max(spans)[0] >= LEAST):
            _, _, a, b = max(spans)
            return " ".join(p for p in plain[a:b] if p)
    return " ".join(p for p in plain if p) or None


def streamed_text(page: str) -> str | None:
    """The description in the state that a page streams to its scripts."""
    parts = []
    for push in _PUSH.finditer(page):
        try:
            parts.append(json.loads(push[1]))
        except ValueError:
            continue
    state = "".join(parts)
    ref = _REF.search(state)
    row = ref and re.search(rf"(?:^|\n){ref[1]}:T([0-9a-f]+),", state)
    if not row:
        return None
    pieces, _ = elements(state[row.end() : row.end() + int(row[1], 16)])
    text = " ".join(p for p in map(_plain, pieces) if p)
    return text if len(text) >= LEAST else None


#: Pages whose texts a worker holds at a time.
PAGES = 100


def read_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is pages, with their texts in place of these; a few pages are handed on at a time, however many come in a batch."""
    kind = pa.struct([("streamed", pa.string()), ("longest", pa.string())])
    for whole in batches:
        for start in range(0, whole.num_rows, PAGES):
            batch = whole.slice(start, PAGES)
            texts = (x.as_py() or "" for x in batch.columns[-1])
            found = pa.array([{"streamed": streamed_text(t), "longest": longest_text(t)} for t in texts], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names)


def posting_texts(pages: DataFrame, *, html: str = "html", out: str = "posting") -> DataFrame:
    """pages with a struct of streamed (the description of a page's streamed state) and longest (the text of the likeliest element)."""
    kept = [c for c in pages.columns if c != out]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), f"`{out}` struct<streamed:string,longest:string>"])
    own = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`").cast("string").alias("_html"))
    return own.mapInArrow(lambda batches: read_batches(batches, [*kept, out]), kinds)
