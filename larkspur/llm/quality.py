"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good or bad or abstains. Expectation-maximisation over the counts of vote patterns
(three votes and nine rules: 19,683 patterns at most, however many documents) estimates how often each rule votes good
on good and on bad documents, and the share of good ones. A document's verdict is the posterior
probability of being good; nothing has to pass all rules. Two hard rules stay: too few words, and too
many words in repeated windows.

Features are computed inside the row, with no shuffle; only the pattern counts are, as partial sums.
Null and blank texts have no words, fail the hard rule and are not kept. Equal rows are judged alike,
a posterior of just 0.5 keeps the document, empty tables give empty results, and other columns never
matter and stay as they are, whatever their names. Texts of any length are judged whole, in time that
grows with the length (times its logarithm where windows repeat).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import saved

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 12
#: A document is kept from this posterior on.
KEEP = 0.5
SPACE = "[ \\x09-\\x0D]"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_stops", "n_marks"]
#: Where estimation starts: a bad document passes most rules, as each rule knows one sort of it.
START = {"prior": 0.8, "good": 0.97, "bad": 0.7}
#: Estimates are held in these bounds.
GOOD_RANGE, BAD_RANGE, PRIOR_RANGE = (0.5, 0.99), (0.01, 0.95), (0.5, 0.99)


def word_list(text: Column) -> Column:
    """The runs of anything but white space (space and \\x09-\\x0D)."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def free_prefix(columns: list[str]) -> str:
    """A prefix that none of the columns begins with."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def with_features(df: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """df with a struct column, the prefix and `features`. No column of df may begin with the prefix."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words, hashes, grams, marks, lines = (F.col(f"{prefix}{x}") for x in ("words", "hashes", "grams", "marks", "lines"))
    df = df.withColumns({f"{prefix}words": word_list(own), f"{prefix}lines": F.filter(F.split(own, "\n"), lambda x: F.rlike(x, F.lit("[^ \\x09-\\x0D]")))})
    df = df.withColumns({f"{prefix}hashes": F.transform(words, lambda w: F.xxhash64(w))})
    gram = F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))))
    df = df.withColumn(f"{prefix}grams", F.coalesce(gram, F.array().cast("array<bigint>")))
    # Only a text with a repeated window sorts its windows with their places.
    repeated = F.size(F.array_distinct(grams)) < F.size(grams)
    placed = F.when(repeated, F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn(f"{prefix}marks", placed)
    twice = F.filter(marks, lambda x, i: F.coalesce(F.get(marks, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(marks, i + 1)["g"] == x["g"], F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["at"])).alias("n"), p.alias("at")),
        lambda s: s["n"],
    )
    without = lambda chars: F.length(own) - F.length(F.translate(own, chars, ""))
    letters = F.regexp_replace(own, "[^A-Za-z]+", "")
    values = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": without("#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_letters": F.length(letters).cast("long"),
        "n_upper": F.length(F.regexp_replace(letters, "[a-z]+", "")).cast("long"),
        "n_distinct": F.size(F.array_distinct(hashes)).cast("long"),
        "n_stops": F.regexp_count(own, F.lit("[.!?](?=[ \\x09-\\x0D]|$)")).cast("long"),
        "n_marks": F.regexp_count(own, F.lit("[#*$%&|<>]+")).cast("long"),
    }
    return df.withColumn(f"{prefix}features", F.struct(*(values[c].alias(c) for c in FEATURES))).drop(*(f"{prefix}{x}" for x in ("words", "hashes", "grams", "marks", "lines")))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def rules(f: dict[str, Column]) -> dict[str, Column]:
    """The rules' votes: 1 good, 0 bad, null abstains."""
    n = f["n_words"]
    return {
        "length": _vote(n >= 50, n < MIN_WORDS),
        "word_length": _vote((f["word_chars"] >= 3 * n) & (f["word_chars"] <= 9 * n), (f["word_chars"] < 2 * n) | (f["word_chars"] > 15 * n)),
        "symbols": _vote(f["n_symbols"] * 50 <= n, f["n_symbols"] * 5 > n),
        "marks": _vote(f["n_marks"] * 50 <= n, f["n_marks"] * 5 > n),
        "dup_lines": _vote(f["n_dup_lines"] == 0, f["n_dup_lines"] * 100 > f["n_lines"] * 30),
        "repeats": _vote(f["n_repeat_words"] * 20 <= n, f["n_repeat_words"] * 100 > n * MAX_REPEAT_PERCENT),
        "upper": _vote(f["n_upper"] * 5 <= f["n_letters"], f["n_upper"] * 2 > f["n_letters"]),
        "vocabulary": _vote(f["n_distinct"] * 4 >= n, f["n_distinct"] * 100 < n * 15),
        "sentences": _vote((f["n_stops"] * 60 >= n) & (f["n_stops"] * 2 <= n), (f["n_stops"] * 150 < n) & (n >= 40)),
    }


RULES = ["length", "word_length", "symbols", "marks", "dup_lines", "repeats", "upper", "vocabulary", "sentences"]


def failed(f: dict[str, Column]) -> Column:
    """The hard rule."""
    return (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT)


def _fields(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}features.{c}") for c in FEATURES}


def _log_odds(votes: dict[str, Column], model: dict) -> Column:
    total = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, vote in votes.items():
        g, b = model["good"][name], model["bad"][name]
        total = total + F.when(vote == 1, math.log(g / b)).when(vote == 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return total


def posterior(votes: dict[str, Column], model: dict) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes, model)))


def fit(featured: DataFrame, prefix: str = "q_", iterations: int = ITERATIONS) -> dict:
    """Expectation-maximisation over all documents' vote patterns, whose counts alone come to the driver."""
    votes = [v.cast("int").alias(k) for k, v in rules(_fields(prefix)).items()]
    patterns = [(tuple(r[k] for k in RULES), r["n"]) for r in featured.select(*votes).groupBy(*RULES).agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in patterns)
    model = {"prior": START["prior"], "good": dict.fromkeys(RULES, START["good"]), "bad": dict.fromkeys(RULES, START["bad"])}
    within = lambda x, low, high: min(max(x, low), high)
    for _ in range(iterations if total else 0):
        seen = {side: [[1.0, 2.0] for _ in RULES] for side in ("good", "bad")}
        share = 0.0
        for pattern, n in sorted(patterns, key=str):
            odds = math.log(model["prior"] / (1 - model["prior"]))
            for name, vote in zip(RULES, pattern, strict=True):
                if vote is not None:
                    g, b = model["good"][name], model["bad"][name]
                    odds += math.log(g / b) if vote else math.log((1 - g) / (1 - b))
            p = 1 / (1 + math.exp(-odds))
            share += n * p
            for side, weight in (("good", n * p), ("bad", n * (1 - p))):
                for sums, vote in zip(seen[side], pattern, strict=True):
                    if vote is not None:
                        sums[0] += weight * vote
                        sums[1] += weight
        model = {"prior": within(share / total, *PRIOR_RANGE)} | {side: {k: within(a / b, *limits) for k, (a, b) in zip(RULES, seen[side], strict=True)} for side, limits in (("good", GOOD_RANGE), ("bad", BAD_RANGE))}
    return model


def judged(featured: DataFrame, model: dict, prefix: str = "q_") -> DataFrame:
    """featured with the posterior and the verdict, the prefix and `posterior` and `kept`."""
    f = _fields(prefix)
    p = posterior(rules(f), model)
    return featured.withColumn(f"{prefix}posterior", p).withColumn(f"{prefix}kept", ~failed(f) & (F.col(f"{prefix}posterior") >= KEEP))


def assess(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the features, base_failed, quality (the posterior) and kept."""
    prefix = free_prefix([doc_id, text])
    featured = saved(with_features(documents.select(F.col(doc_id), F.col(text)), text, prefix).select(F.col(doc_id), f"{prefix}features"))
    out = judged(featured, fit(featured, prefix), prefix)
    return out.select(F.col(doc_id), *(f"{prefix}features.{c}" for c in FEATURES[:5]), failed(_fields(prefix)).alias("base_failed"), F.col(f"{prefix}posterior").alias("quality"), F.col(f"{prefix}kept").alias("kept"))


def keep(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """documents that are judged good; all columns are kept. Features are written once beside the rows, as inlining them into every rule would compute them many times."""
    prefix = free_prefix(documents.columns)
    featured = saved(with_features(documents, text, prefix))
    return judged(featured, fit(featured, prefix), prefix).where(f"{prefix}kept").select(*(F.col(f"`{c}`") for c in documents.columns))
