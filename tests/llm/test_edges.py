"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and columns whose names clash with its own."""

import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, decontaminate, line_dedup, lm_score, near_dedup, pii, quality, queries, secret_scan, token_counts, warc

PROSE = "The board of the small town met again. It spoke of roads, schools and water, and of what the winter had cost. Nobody left early, which is rare. At the end a vote was held, and seven of nine were for it."
LONG = " ".join(f"word{k % 977} and{k % 131}" for k in range(60_000))
NAMES = ["q_words", "Q_kept", "q_features", "found", "so_far", "base", "spans", "loose", "gone", "component_id", "own_id", "keys", "lines", "kept_lines", "n_gone", "made", "block", "record_id", "payload", "salt", "n_words", "_own"]
ROWS = [(1, PROSE), (2, None), (3, ""), (4, " \n\t "), (5, PROSE), (5, PROSE), (6, LONG), (None, PROSE + " More."), (7, "x" * 300_000), (8, "東京 é 🙂 " * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") == 5, F.lit(None)).otherwise(F.lit("s")), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in NAMES}).persist()


def others(df):
    return sorted(tuple(str(r[c]) for c in NAMES) for r in df.select(NAMES).collect())


def ids(df):
    return sorted(str(r.doc_id) for r in df.select("doc_id").collect())


def test_quality(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and {"2", "3", "4"}.isdisjoint(ids(kept)) and set(others(kept)) <= set(others(docs))
    assert quality.keep(docs.limit(0)).count() == 0
    got = quality.assess(docs)
    assert got.count() == len(ROWS) and {r.kept for r in got.where("doc_id = 5").collect()} == {r.kept for r in got.where("doc_id = 1").collect()}


def test_line_dedup(docs):
    cleaned = line_dedup.clean(docs, page_id="doc_id", host="source", report="n_dropped")
    assert cleaned.columns == [*docs.columns, "n_dropped"] and others(cleaned) == others(docs)
    # the line that the rows of id 5 share stands on two pages of their host; both lose it
    assert {(r.doc_id, r.text, r.n_dropped) for r in cleaned.where("doc_id < 6").collect()} >= {(2, None, 0), (3, "", 0), (4, " \n\t ", 0), (5, "", 1)}
    assert line_dedup.clean(docs.limit(0), page_id="doc_id", host="source").count() == 0


def test_near_dedup(docs):
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and ids(kept) == sorted(["1", "2", "3", "4", "6", "7", "8", "None"])
    named = near_dedup.near_duplicates(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))))
    assert {(r.doc_id, r.component_id) for r in named.collect()} >= {("d1", "d1"), ("d5", "d1"), (None, None), ("d2", "d2")}
    assert near_dedup.deduplicate(docs.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, PROSE), (2, None), (3, "--"), (4, "word5 and5 word6"), (None, "東京")], "item_id long, text string")
    whole = decontaminate.find(docs, items, out="result")
    blocks = decontaminate.find(docs, items, out="result", block_bytes=64)
    read = lambda df: sorted((str(r.doc_id), r.result.n_words, r.result.n_hit, tuple(map(tuple, r.result.spans)), tuple(r.result["items"])) for r in df.collect())
    assert read(whole) == read(blocks) and others(whole) == others(docs)
    kept = decontaminate.drop(docs, items)
    assert kept.columns == docs.columns and ids(kept) == ["2", "3", "4", "6", "7"]
    with pytest.raises(ValueError):
        decontaminate.find(docs, items)
    assert ids(decontaminate.drop(docs, items.limit(0))) == ids(docs) and decontaminate.drop(docs.limit(0), items).count() == 0
    assert sorted(r.text for r in decontaminate.redact(docs, items).where("doc_id in (1, 5) or doc_id is null").collect()) == [".", ".", ".", ". More."]


def test_bpe(docs):
    back = bpe.decode(bpe.encode(docs, queries.BYTE_BPE, public_tokenizers.PATTERN), queries.BYTE_BPE, public_tokenizers.PATTERN)
    assert others(back) == others(docs) and all(r.decoded == (r.text or "") and (len(r.ids) > 0) == bool(r.text) for r in back.collect())
    again = bpe.encode(back.withColumnRenamed("ids", "IDS"), queries.BYTE_BPE, public_tokenizers.PATTERN)
    assert [c.lower() for c in again.columns].count("ids") == 1
    assert bpe.encode(docs.limit(0), queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("operator", [pii, secret_scan])
def test_spans(spark, docs, operator):
    assert {(len(r.base), len(r.spans)) for r in operator.find(docs).collect()} == {(0, 0)} and operator.find(docs).count() == len(ROWS)
    many = "mail a@b.example or tel. 030 1234567, password = hunter2222, secret key Zk3v9QxT7LmR2pWd8YbN4cHs; " * 4000
    copies = spark.createDataFrame([(1, many), (1, many), (2, many[:98])], "doc_id long, text string")
    got = [[(s.kind, s.start, s.end) for s in r.spans] for r in operator.find(copies).orderBy("doc_id").collect()]
    assert got[0] == got[1] and len(got[0]) >= 4000 and len(got[2]) >= 1 and operator.find(copies.limit(0)).count() == 0


def test_warc(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"), *NAMES)
    made = warc.derive(warc.responses(pages))
    assert made.count() == 2 * len(ROWS) and set(warc.COLUMNS) <= set(made.columns)
    assert {r.record_id_ for r in made.select("record_id_").collect()} == {r.record_id for r in docs.select("record_id").collect()}
    records = made.where("page_id = 5").select(warc.COLUMNS).distinct()
    assert records.count() == 2 and warc.derive(warc.responses(pages.limit(0))).count() == 0
    raw = "HTTP/1.1 404 Not Found\r\nServer: x\r\nX-Long: a\r\n\tb\r\n\r\n<p>a</p>\r\n\r\n<p>b"
    own = spark.createDataFrame([("r1", "u", "2024-01-01T00:00:00Z", raw), (None, None, None, "<p>bare"), ("r3", "u", None, None), ("r4", "u", None, "HTTP/1.0 204 No Content")], "record_id string, target_uri string, date string, block string")
    got = {(r.refers_to, r.type): r for r in warc.derive(own).collect()}
    text = got["r1", "conversion"]
    assert (text.source_status, text.source_headers, text.block, text.date) == ("404", "Server: x; X-Long: a; b", "a\nb", "2024-01-01T00:00:00Z")
    assert text.payload_digest == got["r1", "metadata"].payload_digest != got["r4", "metadata"].payload_digest
    assert "source-headers: Server: x; X-Long: a; b\r\n" in got["r1", "metadata"].block and got["r4", "conversion"].block == "" == got["r3", "conversion"].block
    assert got[None, "conversion"].block == "bare" and got[None, "conversion"].source_headers is None
    hard = spark.createDataFrame([("<script>" * 50_000,), ("<" * 300_000,), ("a<!-- b",), ("a &lt; b < c",)], "t string")
    assert [r.t for r in hard.select(warc.plain_text(F.col("t")).alias("t")).collect()] == ["", "<" * 300_000, "a", "a < b < c"]


def test_counts_and_scores(spark, docs, monkeypatch):
    n = {(str(r.doc_id), r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, queries.PIECES).collect()}
    assert {("2", 0, 0), ("3", 0, 0), ("4", 0, 0)} <= n and len({x for x in n if x[0] in "15"}) == 2
    assert token_counts.count_tokens(docs.limit(0), queries.PIECES).count() == 0
    scored = lm_score.score(docs)
    rows = sorted((str(r.doc_id), r.n_words, r.n_backoff, r.mean_log_score) for r in scored.collect())
    assert [r for r in rows if r[0] in "234"] == [("2", 0, 0, None), ("3", 0, 0, None), ("4", 0, 0, None)] and lm_score.score(docs.limit(0)).count() == 0
    fives = [r for r in rows if r[0] == "5"]
    assert len(fives) == 2 and fives[0] == fives[1]
    monkeypatch.setattr(lm_score, "HOT_ROWS", 1)
    assert sorted((str(r.doc_id), r.n_words, r.n_backoff, r.mean_log_score) for r in lm_score.score(docs).collect()) == rows


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    own = docs.drop("lines") if name == "bpe" else docs
    out = stage(spark, own, "/root/testdata/sf0.001")
    assert set(own.columns) <= set(out.columns) and out.count() <= len(ROWS)
    assert set(map(str, out.select("q_words").collect())) <= set(map(str, own.select("q_words").collect()))
    assert name == "bpe" or out.columns == own.columns
    assert stage(spark, own.limit(0), "/root/testdata/sf0.001").count() == 0
    if name == "bpe":
        assert all(r.round_trip for r in out.collect())
        assert corpus_pipeline.encode(spark, own.withColumn("round_trip", F.lit(1)), "").count() == len(ROWS)


def test_personal_data_is_found_and_the_rest_left(spark):
    draw = random.Random(3)
    number = lambda n: "".join(draw.choices("0123456789", k=n))
    word = lambda: "".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randrange(3, 9)))
    right = [
        lambda: ("Call tel. ", f"030 {number(7)}", " today."), lambda: ("phone: ", f"({number(3)}) {number(3)}-{number(4)}", ", please"), lambda: ("write mail to ", f"{word()} [at] {word()} [dot] com", " soon"),
        lambda: ("her ssn ", f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}", "."), lambda: ("Dear ", f"Mrs {word().title()} {word().title()}", ","), lambda: ("login from ip ", ":".join(f"{draw.randrange(16, 65535):x}" for _ in range(8)), "."),
    ]
    wrong = [
        lambda: ("order ", f"030 {number(7)}", "."), lambda: ("version ", f"{number(3)}-{number(2)}-{number(4)}", "."), lambda: ("invoice no ", f"{number(3)} {number(3)} {number(4)}", "."), lambda: ("total =", f"0{number(3)} {number(5)}", "%"),
        lambda: ("they met at ", "noon at river dot", " and left"),
    ]
    rows, planted = [], {}
    for k in range(600):
        before, found, after = (right if k % 2 else wrong)[draw.randrange(5)]()
        lead = " ".join(word() for _ in range(20)) + ". "
        rows.append((k, lead + before + found + after))
        if k % 2:
            planted[k] = (len(lead + before), len(lead + before + found))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(any(a < planted[k][1] and b > planted[k][0] for a, b in got[k]) for k in planted)
    false = sum(len(got[k]) for k in got if k not in planted)
    assert hit / len(planted) >= 0.9 and false / 300 <= 0.1, (hit / len(planted), false / 300)


def test_cues_that_no_list_holds(spark):
    """Right and wrong candidates among words that no gazetteer knows: the form, and what stands beside it, must tell. And what a table of gazetteers adds."""
    draw = random.Random(11)
    number = lambda n: "".join(draw.choices("0123456789", k=n))
    word = lambda: "".join(draw.choices("abcdefghijklmnoprstuvw", k=draw.randrange(4, 9)))
    right = [lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{word()} [at] {word()} [dot] org", lambda: f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}", lambda: ":".join(f"{draw.randrange(16, 65535):x}" for _ in range(8)), lambda: f"Mrs {word().title()} {word().title()}"]
    wrong = [lambda: f"={number(3)} {number(3)} {number(4)}%", lambda: f"#{number(3)}-{number(2)}-0000", lambda: f"{word()} at {word()} dot {word()}", lambda: f"€0{number(3)} {number(5)}", lambda: f"9{number(2)}-00-{number(4)}"]
    rows, planted = [], {}
    for k in range(400):
        lead = " ".join(word() for _ in range(12)) + " "
        found = (right if k % 2 else wrong)[draw.randrange(5)]()
        rows.append((k, lead + found + ", " + word()))
        if k % 2:
            planted[k] = (len(lead), len(lead + found))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda **more: {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find(docs, **more).collect()}
    got = spans()
    hit = sum(any(a < planted[k][1] and b > planted[k][0] for a, b in got[k]) for k in planted) / len(planted)
    false = sum(len(got[k]) for k in got if k not in planted) / 200
    assert hit >= 0.9 and false <= 0.1, (hit, false)
    lists = spark.createDataFrame([("name", "Anna"), ("place", " Springfield "), ("top", "zz"), ("cue:phone", "zvonite"), ("cue:none", "x"), ("name", None), ("name", ""), (None, "y")], "list string, entry string")
    known = pii.gazetteer(lists)
    assert known.names == {"anna"} and known.places == {"springfield"} and "zz" in known.top and "zvonite" in known.cues["phone"]
    assert pii.gazetteer(None) == pii.gazetteer(lists.limit(0)) == pii.KNOWN
    part = lambda text, kind: pii.votes(text, (kind, 0, len(text)), known)[pii.LABELERS.index("part")]
    assert (part("Mrs Anna Springfield", "name"), part("Mr Springfield", "name"), part("Mr Other", "name"), part("a [at] b [dot] zz", "email")) == (1, -1, 0, 1)
    assert pii.find(docs, gazetteers=lists).count() == 400
