"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier trained on their votes decides.

Four base kinds (email, ip, card, phone) are found by rule and always reported. Further candidates are
looser forms: numbers without a country code, addresses with spelled-out signs, other identifiers,
names behind a form of address. Regex labelers judge the form, gazetteer labelers the words around a
candidate and its parts, context labelers what stands beside it; each votes yes, no or abstains. What gazetteers
know by themselves is short; names, places, top-level names and further cue words come as a table of any
length up to a checked size.
Expectation-maximisation over the counts of vote patterns of all documents estimates how reliable each
labeler is on each kind (rare kinds lean on the estimate for all kinds). A logistic classifier over the
votes and over features that no labeler sees, of the form (digits, separators, words) and the context
(what stands before and behind), is fitted to the resulting probabilities, and decides on every
candidate that isn't a base span.

Texts are read once and never shuffled: candidates are written without them, as (kind, place, votes,
traits), and both the estimation and the verdicts go on from that table. Votes and traits are of bounded
sets of values, so what comes to the driver does not grow with the documents.

Spans are in code points. Null and empty texts have no spans, an empty table gives an empty result, equal
rows get equal spans, and other columns are ignored. Where candidates overlap, base spans come first, then
the stricter kinds, then the leftmost. The time for a text grows with its length times the logarithm of
the number of its candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import Scratch, saved, unused

from .spans import Span, Taken, ordered

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "ssn", "iban", "ipv6", "name"]
KEEP = 0.5
ITERATIONS = 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser candidates.
_LOOSE = {
    "email": re.compile(r"(?i)(?<![\w.])[a-z0-9][a-z0-9._%+-]{0,63}(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s(?:at|@)\s)[a-z0-9-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s|\.)[a-z0-9-]{2,24}){1,4}(?![\w])"),
    "phone": re.compile(r"(?<![\w+.-])(?:00[1-9][0-9 ().-]{7,18}[0-9]|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,4})?)(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ipv6": re.compile(r"(?i)(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])"),
    "name": re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? (?:[A-ZÀ-Þ][\w'-]{1,30})(?: [A-ZÀ-Þ][\w'-]{1,30}){0,2}"),
}
_SPELLED = re.compile(r"(?i)[\[({@]|\sdot\s")
_MARKED = re.compile(r"[\[({@]")
#: The stricter forms first.
_ORDER = ["email", "iban", "ipv6", "ssn", "card", "phone", "name"]
#: What a text must contain for a looser pattern to be worth trying.
_NEEDS = {"email": re.compile(r"(?i)\bat\b|@"), "name": re.compile(r"(?:Mr|Ms|Dr|Prof|Herr|Frau|Mons|Madame|Mme|Señor|Sra?)"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}"), "ipv6": re.compile(r"(?i)[0-9a-f]:[0-9a-f]{1,4}:")}

#: Words that speak for or against a kind within some characters before a candidate.
CUES = {
    "email": "email e-mail mail contact write correo courriel contacto kontakt adresse",
    "phone": "phone tel telephone mobile call fax cell whatsapp telefon handy anrufen téléphone portable teléfono móvil llame",
    "card": "card visa mastercard amex credit debit payment karte kreditkarte carte tarjeta crédito",
    "ssn": "ssn social security insurance taxpayer",
    "iban": "iban account bank konto compte cuenta transfer",
    "ipv6": "ip ipv6 host address server login",
    "ip": "ip host address server login",
    "name": "name contact dear patient customer sincerely regards",
}
AGAINST = "version release build order invoice isbn issn page section chapter figure ratio price total item id ref code no nr version commit line"
TOP_LEVEL = "com org net edu gov io co info biz de fr es uk eu us ca ch at it nl example"
#: Bytes of gazetteers that are broadcast at most.
MOST_BYTES = 32 << 20
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


@dataclass(frozen=True)
class Gazetteer:
    """What the gazetteer labelers know, in lower case: words that speak for each kind or against all, top-level names of domains, people's names, places."""

    cues: dict[str, frozenset[str]]
    against: frozenset[str]
    top: frozenset[str]
    names: frozenset[str] = frozenset()
    places: frozenset[str] = frozenset()

    def with_lists(self, lists: dict[str, set[str]]) -> Gazetteer:
        """This one and what lists add: `top`, `against`, `name`, `place`, and `cue:` with a kind behind it."""
        more = lambda own, name: own | frozenset(lists.get(name, ()))
        return Gazetteer({k: more(v, f"cue:{k}") for k, v in self.cues.items()}, more(self.against, "against"), more(self.top, "top"), more(self.names, "name"), more(self.places, "place"))


KNOWN = Gazetteer({k: frozenset(v.split()) for k, v in CUES.items()}, frozenset(AGAINST.split()), frozenset(TOP_LEVEL.split()))


def gazetteer(lists: DataFrame | None) -> Gazetteer:
    """The gazetteer with the entries of a table (list, entry) beside its own; null and empty entries are none. A table of more than MOST_BYTES is refused."""
    if lists is None:
        return KNOWN
    rows = lists.select("list", F.lower(F.trim("entry")).alias("entry")).where(F.length("entry") > 0).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("entry")), F.lit(0))).first()[0]
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of gazetteers, more than {MOST_BYTES}")
    found: dict[str, set[str]] = {}
    for r in rows.collect():
        found.setdefault(r["list"], set()).add(r["entry"])
    return KNOWN.with_lists(found)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans: leftmost, not overlapping within a kind, without those that fail their check."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return ordered(out, KINDS)


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates that meet no base span and none before them."""
    taken = Taken(base)
    out: list[Span] = []
    digits = bool(_DIGIT.search(text))
    for kind in _ORDER:
        pattern = _LOOSE[kind]
        need = _NEEDS.get(kind)
        if kind != "name" and kind != "email" and not digits or need is not None and not need.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "email" and not _SPELLED.search(m[0]):
                continue
            if taken.take(a, b):
                out.append((kind, a, b))
    return out


def _iban(x: str) -> bool:
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def votes(text: str, span: Span, known: Gazetteer = KNOWN) -> tuple[int, ...]:
    """The labelers' votes: 1 yes, -1 no, 0 abstains."""
    kind, a, b = span
    found = text[a:b]
    digits = [c for c in found if "0" <= c <= "9"]
    before = text[max(0, a - 48) : a]
    words = [w.lower() for w in _WORD.findall(before)][-6:]
    # regex: the form
    if kind in ("email", "ip", "ipv6"):
        form = 1 if kind != "email" or _MARKED.search(found) else 0  # words alone, as in "noon at river dot left", tell nothing
    elif kind == "card":
        form = 1 if luhn("".join(digits)) else -1
    elif kind == "iban":
        form = 1 if _iban(found) else -1
    elif kind == "ssn":
        form = -1 if found[:3] in ("000", "666") or found[0] == "9" or found[4:6] == "00" or found[7:] == "0000" else 1
    elif kind == "phone":
        form = 1 if 9 <= len(digits) <= 15 else -1
    else:
        form = 1 if " " in found[found.index(" ") + 1 :] else 0
    # gazetteer: words that go with the kind, and known parts
    cue = 1 if any(w in known.cues[kind] for w in words) else 0
    part = 0
    if kind == "email":
        part = 1 if re.split(r"\W+|\sdot\s", found.rstrip("])} "))[-1].lower() in known.top else -1
    elif kind == "phone":
        part = 1 if found[0] in "+(" or found[:2] == "00" else 0
    elif kind == "card":
        part = 1 if digits[:1] and digits[0] in "3456" else -1
    elif kind == "name" and (known.names or known.places):
        own = [w.lower() for w in _WORD.findall(found)[1:]]
        part = 1 if any(w in known.names for w in own) else -1 if any(w in known.places for w in own) else 0
    # context: what stands beside it
    near = -1 if any(w in known.against for w in words[-2:]) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    edge = -1 if left and left in "$€£#=/_" or right and right in "%€/_=" else 1 if (not left or left in " \n\t(:,;<\"'") and (not right or right in " \n\t).,;>\"'!?") else 0
    shape = -1 if len(set(digits)) == 1 and len(digits) > 4 else 0
    return form, cue, part, near, edge, shape


LABELERS = ["form", "cue", "part", "near", "edge", "shape"]
TRAITS = ["digits", "marks", "words", "left", "right"]
_SIDES = {"": "edge", " ": "space", "\n": "edge", "\t": "space", "(": "open", "<": "open", "[": "open", '"': "open", "'": "open", ":": "colon", "=": "colon", ".": "stop", ",": "stop", ";": "stop", "!": "stop", "?": "stop", ")": "close", ">": "close", "]": "close"}


def traits(text: str, span: Span) -> tuple[str, ...]:
    """Features of form and context that no labeler looks at, each of a few values."""
    _, a, b = span
    found = text[a:b]
    n = sum("0" <= c <= "9" for c in found)
    marks = {c for c in found if not c.isalnum()}
    return (
        "none" if not n else "few" if n < 7 else "short" if n < 9 else "number" if n < 13 else "long",
        "none" if not marks else {" ": "space", "-": "dash", ".": "dot", "/": "slash", ":": "colon"}.get(next(iter(marks)), "other") if len(marks) == 1 else "mixed",
        str(min(len(found.split()), 4)),
        _SIDES.get(text[a - 1 : a] if a else "", "other"),
        _SIDES.get(text[b : b + 1], "other"),
    )


#: What a labeler is thought to say at first of right candidates and of wrong ones. That it abstains tells something as well:
#: a labeler that only ever says yes would else tell nothing.
SAYS = {True: {1: 0.5, 0: 0.4, -1: 0.1}, False: {1: 0.2, 0: 0.4, -1: 0.4}}
START = {f"{name}={v}": math.log(SAYS[True][v] / SAYS[False][v]) for name in LABELERS for v in (1, 0, -1)}
#: Votes that are imagined beside those cast, of all kinds and then of each; no estimate is below the least.
IMAGINED, LEAST = 10, 0.02
#: A candidate as it is counted: kind, whether it is a base span, votes, traits.
Pattern = tuple[str, bool, tuple[int, ...], tuple[str, ...]]


def _features(kind: str, cast: tuple[int, ...], seen: tuple[str, ...]) -> list[str]:
    """Features of the classifier."""
    votes_cast = [f"{name}={v}" for name, v in zip(LABELERS, cast, strict=True)]
    return ["bias", f"kind={kind}", *votes_cast, *(f"{kind}.{f}" for f in votes_cast), *(f"{kind}.{name}={v}" for name, v in zip(TRAITS, seen, strict=True))]


def expectation_maximisation(patterns: dict[Pattern, int], iterations: int = ITERATIONS) -> dict[Pattern, float]:
    """The probability of each pattern being personal data, by its kind and votes."""
    counts: dict[tuple, int] = {}
    for (kind, base, cast, _), n in patterns.items():
        counts[kind, base, cast] = counts.get((kind, base, cast), 0) + n
    says = {(side, kind, name): dict(SAYS[side]) for side in SAYS for kind in KINDS for name in LABELERS}
    prior: dict[str, float] = dict.fromkeys(KINDS, 0.5)
    p: dict[tuple, float] = {}

    def estimated(own: dict[int, float], lean: dict[int, float]) -> dict[int, float]:
        total = sum(own.values()) + IMAGINED
        return {v: max((own[v] + IMAGINED * lean[v]) / total, LEAST) for v in lean}

    for _ in range(iterations):
        for kind, base, cast in counts:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for name, v in zip(LABELERS, cast, strict=True):
                odds += math.log(says[True, kind, name][v] / says[False, kind, name][v])
            p[kind, base, cast] = 1.0 if base else 1 / (1 + math.exp(-odds))
        for k, name in enumerate(LABELERS):
            for side in SAYS:
                seen = {kind: dict.fromkeys((1, 0, -1), 0.0) for kind in KINDS}
                for x, n in counts.items():
                    seen[x[0]][x[2][k]] += n * (p[x] if side else 1 - p[x])
                overall = estimated({v: sum(of[v] for of in seen.values()) for v in (1, 0, -1)}, SAYS[side])
                for kind, own in seen.items():
                    says[side, kind, name] = estimated(own, overall)
            for kind in KINDS:
                right, wrong = says[True, kind, name], says[False, kind, name]
                for v in (1, -1):  # a yes never speaks against a candidate, a no never for it
                    if (right[v] - wrong[v]) * v < 0:
                        right[v] = wrong[v] = (right[v] + wrong[v]) / 2
        for kind in KINDS:
            own = [(x, n) for x, n in counts.items() if x[0] == kind and not x[1]]
            prior[kind] = min(max((5 + sum(n * p[x] for x, n in own)) / (10 + sum(n for _, n in own)), 0.1), 0.9)
    return {x: p[x[:3]] for x in patterns}


def train(patterns: dict[Pattern, int], target: dict[Pattern, float], steps: int = 300, rate: float = 5.0, decay: float = 1e-3) -> dict[str, float]:
    """A logistic classifier fitted to the probabilities; each pattern weighs the logarithm of its count.

    Weights are drawn to where they start, which is what votes no document cast keep.
    """
    rows = sorted(patterns, key=str)
    names = sorted({*START, *(f for x in rows for f in _features(x[0], x[2], x[3]))})
    place = {name: k for k, name in enumerate(names)}
    start = np.array([START.get(name, 0.0) for name in names])
    if not rows:
        return dict(zip(names, start.tolist(), strict=True))
    at = [[place[f] for f in _features(x[0], x[2], x[3])] for x in rows]
    row, column = np.repeat(np.arange(len(rows)), [len(x) for x in at]), np.concatenate(at)
    y, weight = np.array([target[x] for x in rows]), np.log1p([patterns[x] for x in rows])
    weights = start.copy()
    for _ in range(steps):
        total = np.bincount(row, weights[column], len(rows))
        error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) * weight / weight.sum()
        weights -= rate * (np.bincount(column, error[row], len(names)) + decay * (weights - start))
    return dict(zip(names, weights.tolist(), strict=True))


def score(weights: dict[str, float], features: list[str]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in features)))))


_SPOTTED = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spotted(documents: DataFrame, doc_id: str, text: str, known: Gazetteer = KNOWN) -> DataFrame:
    """doc_id, base and loose: the candidates, with their votes and traits as one string."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    names = [doc_id, unused("base", [doc_id]), unused("loose", [doc_id])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for x in batch.column(1):
                t = x.as_py() or ""
                base = base_spans(t)
                for found, spans in zip(out, (base, loose_spans(t, base)), strict=True):
                    found.append([{"kind": s[0], "start": s[1], "end": s[2], "pattern": ",".join(map(str, (*votes(t, s, shared.value), *traits(t, s))))} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _SPOTTED) for x in out)], names)

    own = documents.select(F.col(doc_id), F.col(text).cast("string"))
    span = "array<struct<kind:string,start:long,end:long,pattern:string>>"
    return own.mapInArrow(run, f"`{doc_id}` {own.schema[0].dataType.simpleString()}, {names[1]} {span}, {names[2]} {span}")


def _pattern(x: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
    parts = x.split(",")
    return tuple(map(int, parts[: len(LABELERS)])), tuple(parts[len(LABELERS) :])


def fit(candidates: DataFrame) -> dict[str, float]:
    """The classifier's weights, from all candidates."""
    _, base, loose = candidates.columns
    each = [candidates.select(F.explode(c).alias("s"), F.lit(c == base).alias("base")) for c in (base, loose)]
    rows = each[0].unionByName(each[1]).groupBy("s.kind", "base", "s.pattern").agg(F.count("*").alias("n")).collect()
    patterns = {(r["kind"], r["base"], *_pattern(r["pattern"])): r["n"] for r in rows}  # thousands: votes are of kind and form, traits of five short sets
    return train(patterns, expectation_maximisation(patterns))


def find(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None, gazetteers: DataFrame | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end). weights: of a classifier fitted before; gazetteers: a table (list, entry) of what the labelers know besides (`gazetteer`)."""
    with Scratch(documents.sparkSession) as scratch:
        candidates = scratch.save(spotted(documents, doc_id, text, gazetteer(gazetteers)))
        return saved(_judged(candidates, fit(candidates) if weights is None else weights))


def _judged(candidates: DataFrame, model: dict[str, float]) -> DataFrame:
    doc_id = candidates.columns[0]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], bool] = {}

        def right(kind: str, pattern: str) -> bool:
            if (kind, pattern) not in known:
                known[kind, pattern] = score(model, _features(kind, *_pattern(pattern))) >= KEEP
            return known[kind, pattern]

        pack = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            bases, alls = [], []
            for base, loose in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                base = [(s["kind"], s["start"], s["end"]) for s in base]
                more = [(s["kind"], s["start"], s["end"]) for s in loose if right(s["kind"], s["pattern"])]
                bases.append(pack(base))
                alls.append(pack(ordered([*base, *more], KINDS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _SPANS), pa.array(alls, _SPANS)], [doc_id, "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return candidates.mapInArrow(judged, f"`{doc_id}` {candidates.schema[0].dataType.simpleString()}, base {span}, spans {span}")


def mask(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, a, b in ordered(spans, KINDS):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def listed(spans: str):
    """A column of spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc_id: str = "doc_id", kinds: list[str] = BASE) -> DataFrame:
    """Counts of base spans by kind, the hash of their list, and the list of all spans."""
    kind_list = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kind_list) - F.size(F.array_remove(kind_list, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(F.col(doc_id), *counts, F.sha2(F.encode(listed("base"), "utf-8"), 256).alias("base_sha256"), listed("spans").alias("spans"))
