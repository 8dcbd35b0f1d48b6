"""Stores, ledgers, streams, gates, phrases, pages and corpora: against loops, on odd rows, and when something fails."""

import random
from html.parser import HTMLParser
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.operators import answers, dedupe, filters, phrases, windows
from larkspur.plans.state_queries import questions
from larkspur.session import table
from larkspur.sources import files, page_tree, paged, payloads
from larkspur.sources.store import Conflict, Store, migrate, upsert
from larkspur.streaming import limits, replay, seen

SMALL = "/root/testdata/sf0.001"
JOBS = "id long, dedupe_key string, url string, company string, status string, applied_at string, branch string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# Stores


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        store.read()
    first = store.write(spark.createDataFrame([(1, "a")], "id long, x string"))
    bad = spark.range(3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise("y").alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.write(bad)
    assert store.latest() == first and rows(store.read()) == [(1, "a")]
    store.write(spark.createDataFrame([(2, "b")], "id long, x string"), append=True)
    with pytest.raises(Conflict):
        store.write(spark.createDataFrame([(3, "c")], "id long, x string"), base=first)
    assert rows(store.read()) == [(1, "a"), (2, "b")] and rows(store.read(first)) == [(1, "a")]
    (tmp_path / "s" / "versions" / "000000000003").write_text('{"number": 3, "par')  # a manifest that was cut short
    assert store.latest().number == 2
    assert store.compact().number == 4 and len(store.latest().parts) == 1 and rows(store.read()) == [(1, "a"), (2, "b")]
    store.clean(keep=1)
    assert len(list(Path(tmp_path / "s" / "data").iterdir())) == 1 and rows(store.read()) == [(1, "a"), (2, "b")]
    store.write(spark.createDataFrame([], "id long, x string"))
    assert rows(store.read()) == []


def test_ids_are_never_given_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame([(1, "a", "u1", "A", "applied", "2024", None)], JOBS), last_id=7)  # 2 to 7 were deleted since
    new = "dedupe_key string, url string, company string, pos long"
    upsert(store, spark.createDataFrame([("b", "u2", "B", 2), (None, "u3", None, 1), ("b", "u2", "B2", 3), ("a", "u9", None, 4)], new))
    upsert(store, spark.createDataFrame([("b", "u2", "B3", 1), ("c", None, "C", 2)], new))
    upsert(store, spark.createDataFrame([], new))
    got = {r.id: (r.dedupe_key, r.url, r.company, r.status) for r in store.read().collect()}
    assert got == {1: ("a", "u9", "A", "applied"), 8: (None, "u3", None, "discovered"), 9: ("b", "u2", "B3", "discovered"), 10: ("c", None, "C", "discovered")}
    assert store.latest().last_id == 10


def test_migration(spark, tmp_path):
    """A closed row under an old key and its double under the new one become one; two rows of state both stay; no address, no new key."""
    store = Store(spark, str(tmp_path / "s"))
    kind = "id long, dedupe_key string, url string, status string, ats_platform string"
    lever = lambda k: f"https://jobs.lever.co/acme/0000000{k}-1111-2222-3333-444455556666"
    store.write(spark.createDataFrame([(1, lever(1), lever(1) + "?source=x", "closed", "Lever"), (2, "lever:00000001", lever(1), "ranked", "lever"), (3, lever(2), lever(2), "applied", "lever"), (4, "lever:00000002", lever(2), "closed", "lever"), (5, "own", None, "ranked", None), (6, None, None, "ranked", "AshbyHQ"), (7, None, lever(3), "ranked", "lever"), (8, None, lever(3), "ranked", "lever")], kind))
    version = migrate(store)
    assert {(r.id, r.dedupe_key, r.status, r.ats_platform) for r in store.read().collect()} == {(1, "lever:00000001", "closed", "lever"), (3, "lever:00000002", "applied", "lever"), (4, "lever:00000002", "closed", "lever"), (5, "own", "ranked", None), (6, None, "ranked", "ashby"), (7, "lever:00000003", "ranked", "lever")}
    assert migrate(store) == version and migrate(store, rule=3).number == version.number + 1


# Streams


def test_seen_sink(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    sink = seen.SeenSink(store, "k", ["at"])
    batch = lambda *data: spark.createDataFrame(data, "k string, at long, x string")
    sink(batch(("a", 2, "later"), ("a", 1, "first"), (None, 1, "null"), ("", 1, "empty")), 0)
    sink(batch(("b", 1, "b"), ("a", 0, "again")), 1)
    sink(batch(("c", 1, "replayed with other rows")), 1)
    sink(spark.createDataFrame([], "k string, at long, x string"), 2)
    assert rows(store.read()) == [("a", 1, "first"), ("b", 1, "b")] and store.latest().marks == {"batch:seen": 2}


def test_stream_decides_as_the_loop_does(spark):
    """Windows that change, a state that is forgotten and comes again, null amounts and a null key."""
    limits.stateful(spark)
    rng = random.Random(5)
    data = sorted((rng.randrange(0, 4 * 86_400), k, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1.0])) for k in range(300))
    events = spark.createDataFrame([(k, s, key, a) for s, k, key, a in data], "event_id long, s long, user_id long, amount double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "amount")
    got = {r.event_id: (r.value, r.within) for r in replay.result(limits.decided(replay.in_order(events, "ts", 3), "user_id", F.col("amount"), limit=2, size=3600)).collect()}
    state, expected = {}, {}
    for s, k, key, a in data:
        window, value = state.get(key, (None, 0.0))
        value = (value if window == s // 3600 else 0.0) + (a or 0.0)
        state[key] = (s // 3600, value)
        expected[k] = (value, value <= 2)
    assert got == expected


def test_running_by_ranges(spark):
    """A key that is null, one that holds most rows, and ties."""
    rng = random.Random(3)
    data = [(k, rng.choice(["hot"] * 8 + [None, "b"]), rng.randrange(0, 9000) // 60 * 60, rng.choice([None, 1, 2])) for k in range(500)]
    events = spark.createDataFrame(data, "event_id long, k string, s long, a long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.value for r in windows.running(events, F.col("a"), ["k"]).collect()}
    sums, expected = {}, {}
    for i, k, s, a in sorted(data, key=lambda r: (r[2], r[0])):
        sums[k, s // 3600] = expected[i] = sums.get((k, s // 3600), 0) + (a or 0)
    assert got == expected and windows.running(events.limit(0), F.col("a")).count() == 0


# Gates


def by_loop(asked, turns, requests, dollars, dollars_all):
    held, hours, days, everyone, out = {}, {}, {}, {}, {}
    for q in sorted(asked, key=lambda q: (q.at is not None, q.at, q.pos)):
        second = int(q.at.timestamp()) if q.at else 0
        hour, day, cost = second // 3600, second // 86_400, q.cost_usd or 0.0
        if held.get((q.code, q.session_id), 0) >= turns:
            out[q.pos] = "limit"
            continue
        hours[q.code, hour] = hours.get((q.code, hour), 0) + 1
        if hours[q.code, hour] > requests:
            out[q.pos] = "rate"
            continue
        held[q.code, q.session_id] = held.get((q.code, q.session_id), 0) + 1
        if days.get((q.code, day), 0.0) >= dollars or everyone.get(day, 0.0) >= dollars_all:
            out[q.pos] = "budget"
            continue
        days[q.code, day], everyone[day] = days.get((q.code, day), 0.0) + cost, everyone.get(day, 0.0) + cost
        out[q.pos] = "answered"
    return out


@pytest.mark.parametrize(("folder", "limit"), [("/root/testdata/sf0.01", (8, 20, 5.0, 25.0)), ("/root/testdata/sf0.01", (3, 9, 1.0, 3.0)), (SMALL, (1, 1, 0.0, 0.5))])
def test_gates_over_conversations(spark, folder, limit):
    import os
    import time

    os.environ["TZ"] = "UTC"
    time.tzset()
    asked = questions(spark, folder)
    turns, requests, dollars, dollars_all = limit
    got = {r.pos: r.outcome for r in answers.gated(asked, turns=turns, requests=requests, dollars=dollars, dollars_all=dollars_all).collect()}
    expected = by_loop(asked.collect(), *limit)
    assert got == expected and len(set(got.values())) > 1


def test_gates_on_odd_rows(spark):
    kind = "code string, session_id string, at timestamp, pos long, cost_usd double, outcome string"
    odd = spark.createDataFrame([(None, None, None, 1, None, "x"), (None, None, None, 2, None, "x"), ("a", None, None, 3, 9.0, "x"), ("a", None, None, 4, 9.0, "x")], kind)
    assert rows(answers.gated(odd, turns=1, dollars=5.0).select("pos", "outcome")) == [(1, "answered"), (2, "limit"), (3, "answered"), (4, "limit")]
    assert answers.gated(odd.limit(0)).columns == odd.columns


# Phrases


def test_fifty_thousand_phrases(spark):
    """Over all documents as trying each phrase on each row does."""
    documents = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ÄPFEL und Birnen")], "doc_id long, text string"))
    words = sorted({w for r in documents.limit(60).collect() for w in (r.text or "").split()})
    rng = random.Random(1)
    listed = [(k, rng.choice(words) + " " + rng.choice(words)) for k in range(50_000)] + [(50_000, "äpfel"), (50_001, None), (50_002, "")]
    got = {r.doc_id: r.phrase for r in phrases.match(documents, spark.createDataFrame(listed, "pos long, phrase string"), text="text").collect()}
    for r in documents.collect():
        low = (r.text or "").lower()
        assert got[r.doc_id] == next((p for _, p in listed if p and p.lower() in low), None)
    short = [(k, p) for k, p in enumerate(["the", "Ou", "e", "-x", "und"])]
    own = {r.doc_id: r.phrase for r in phrases.match(documents, spark.createDataFrame(short, "pos long, phrase string"), text="text", whole=True).collect()}
    assert own == {r.doc_id: r.p for r in documents.select("doc_id", filters.matched_phrase(F.col("text"), [p for _, p in short]).alias("p")).collect()}
    with pytest.raises(ValueError, match="bytes of phrases"):
        phrases.match(documents, spark.createDataFrame(short, "pos long, phrase string"), text="text", most_bytes=3)
    assert phrases.match(documents, spark.createDataFrame([], "pos long, phrase string"), text="text").where("phrase IS NOT NULL").count() == 0


def test_phrases_in_blocks(spark, monkeypatch):
    """Blocks of a few hundred bytes, of which a worker holds one at a time, give what trying each phrase gives; the list is in no order."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abÄ ", k=n))
    listed = [(k, word(rng.randrange(3, 9))) for k in range(700)]
    rng.shuffle(listed)
    texts = [(k, rng.choice([None, "", word(4), word(12), word(40), "zz"])) for k in range(3_000)]
    monkeypatch.setattr(phrases, "GATHERED", 500)
    found = phrases.match(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(listed, "pos long, phrase string"), text="text", block_bytes=300)
    order = [p for _, p in sorted(listed)]
    assert {r.id: (r.text, r.phrase) for r in found.collect()} == {k: (t, next((p for p in order if t and p.lower() in t.lower()), None)) for k, t in texts}


def test_null_keys_are_one_key(spark):
    incoming = spark.createDataFrame([(None, 1, "a"), (None, 2, "a"), ("", 3, "a"), ("k", 4, "w"), ("k", 5, "a"), ("k", 6, None), ("s", 7, "a")], "dedupe_key string, pos long, company string")
    got = dedupe.label_incoming(incoming, spark.createDataFrame([("s",)], "dedupe_key string"), spark.createDataFrame([(" W ",)], "company string"))
    assert sorted((r.pos, r.outcome) for r in got.collect()) == [(1, "fresh"), (2, "duplicate"), (3, "fresh"), (4, "watched"), (5, "fresh"), (6, "duplicate"), (7, "seen")]


# Pages


def test_paged_source(spark, tmp_path):
    page = lambda n, total: f'{{"jobPostings": [{", ".join(["{}"] * n)}], "total": {total}}}'
    pages = [(1, 20 * k, page(20, 45 if not k else 0)) for k in range(4)] + [(2, 20 * k, page(20, 0)) for k in range(12)] + [(3, 0, "no json"), (3, 20, page(1, 0)), (4, 20, page(2, 0)), (5, 0, page(0, 100)), (5, 20, page(20, 0))]
    paged.capture(spark.createDataFrame(pages, "target_id long, offset long, payload string"), str(tmp_path / "p"))
    (tmp_path / "p" / "other").mkdir()
    got = paged.read(spark, f"file://{tmp_path}/p", targets_per_partition=2)
    assert sorted((r.target_id, r.page) for r in got.collect()) == [(1, 0), (1, 1), (1, 2), *((2, k) for k in range(10)), (3, 0), (3, 1), (4, 1), (5, 0), (5, 1)]
    assert got.rdd.getNumPartitions() == 30
    (tmp_path / "none").mkdir()
    assert paged.read(spark, str(tmp_path / "none")).count() == 0
    named = got.select("target_id", F.lit("h").alias("host"), F.lit("s").alias("site"), F.lit(None).cast("string").alias("lang"), "page", "payload")
    assert payloads.workday(named.where("target_id = 5")).count() == 0  # ended by its empty first page


class Walk(HTMLParser):
    """Every element with its rank and all text in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.open, self.text, self.silent = [], [], [], ""

    def handle_starttag(self, tag, attrs):
        if self.silent:
            return
        if tag in page_tree.SILENT:
            self.silent = tag
            return
        self.found.append((page_tree.rank(tag, " ".join(f'{k}="{v}"' for k, v in attrs)), []))
        if tag not in page_tree.VOID:
            self.open.append((tag, self.found[-1][1]))

    def handle_endtag(self, tag):
        if self.silent:
            self.silent = "" if tag == self.silent else self.silent
        elif any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self.silent:
            for own in (self.text, *(x for _, x in self.open)):
                own.append(data)


def likeliest(html):
    walk = Walk()
    walk.feed(html)
    walk.close()
    plain = lambda x: " ".join(" ".join(p.split()) for p in x if p.split())
    for level in range(3):
        own = [(len(plain(x)), -k, plain(x)) for k, (r, x) in enumerate(walk.found) if r == level and 0 < len(plain(x)) < page_tree.MOST]
        if own and (level or max(own)[0] >= page_tree.LEAST):
            return max(own)[2]
    return plain(walk.text) or None


def test_page_tree_over_all_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html")
    got = page_tree.posting_texts(pages).collect()
    assert len(got) == pages.count() and all(r.posting.longest == likeliest(r.html) for r in got)


ODD_PAGES = [None, "", "plain &amp; text", "<div>a<p>b</div>c", "<section><div class='x job-description'>" + "long " * 50 + "</div>" + "longer " * 90 + "</section>", "<div class=jobs-description>short</div><main>" + "m" * 30 + "</main>", "<div>" + "x" * 60_000 + "</div><div>y</div>", "<!-- <div>no</div> --><script>var a = '<div>no</div>'</script><div>yes<br>two</div>", "</p></div><div>open <b>ends", "<div><div><div>deep</div></div></div>"]


def test_odd_pages(spark):
    got = page_tree.posting_texts(spark.createDataFrame(list(enumerate(ODD_PAGES)), "posting long, html string").withColumn("_x", F.lit(1)), out="found")
    assert {r.posting: r.found.longest for r in got.collect()} == {k: likeliest(p or "") for k, p in enumerate(ODD_PAGES)}


# Variants and corpora


def test_shapes_have_a_common_one(spark):
    sent = spark.createDataFrame([(1, '[{"a": 1}, {"a": "x"}, {"b": 2}]'), (2, "broken"), (3, None), (4, "[]")], "target_id long, payload string")
    assert rows(payloads.shapes(sent, "$.a")) == [("BIGINT", 1, None), ("STRING", 1, None), (None, 2, "VARIANT")]
    assert payloads.shapes(sent.limit(0), "$.a").count() == 0


def test_corpus_reload(spark, tmp_path):
    notes, store = tmp_path / "notes", Store(spark, str(tmp_path / "store"))
    notes.mkdir()
    (notes / "a b.md").write_text("---\ntitle: T\n---\nbody")
    (notes / "c.txt").write_text("plain")
    (notes / "d.bin").write_text("none")
    told = lambda check=None: sorted((r.path.rsplit("/", 1)[1].replace("%20", " "), r.change) for r in files.reload(store, str(notes), check).collect())
    assert told() == [("a b.md", "added"), ("c.txt", "added")] and told() == []
    number = store.latest().number
    (notes / "c.txt").write_text("changed")
    (notes / "a b.md").unlink()
    (notes / "e.md").write_text("new")

    def refuse(docs):
        if docs.where(F.col("body").contains("new")).count():
            raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        told(refuse)
    assert store.latest().number == number and store.read().where("body = 'plain'").count() == 1
    assert told() == [("a b.md", "gone"), ("c.txt", "changed"), ("e.md", "added")]
    assert sorted(r.body for r in store.read().collect()) == ["changed", "new"]


def test_many_adjustments(spark):
    """A company's own name wins over parts of it, the first listed part over others; names that are null or blank."""
    from larkspur.operators import views

    rng = random.Random(9)
    name = lambda n: "".join(rng.choices("abcd ", k=n)).strip()
    listed = [(k, f" {name(rng.randrange(2, 7)).title()} ", float(k % 11 - 5)) for k in range(12_000)] + [(12_001, None, 9.0), (12_002, "", 8.0)]
    asked = [(k, rng.choice([None, "", name(5), name(30), f" {name(12).upper()}"])) for k in range(400)]
    got = {r.id: r.adjustment for r in views.company_adjustment(spark.createDataFrame(asked, "id long, company string").withColumn("adjustment", F.lit(1)), spark.createDataFrame(listed, "pos long, name string, points double")).collect()}
    low = [(n.strip().lower(), p) for _, n, p in listed if n is not None]
    for k, company in asked:
        own = (company or "").strip().lower()
        exact = [p for n, p in low if n == own]
        part = [p for n, p in low if n and n in own]
        assert got[k] == (exact + part + [0.0])[0], (k, company)


def test_site_that_answers(spark):
    from larkspur.functions import urls

    url = "https://a.wd1.myworkdayjobs.com/Ext/job/x_R-1"
    live = lambda *sites: F.array(*(F.struct(F.lit("a.wd1.myworkdayjobs.com").alias("host"), F.lit(lang).cast("string").alias("lang"), F.lit(site).alias("site")) for lang, site in sites))
    row = spark.createDataFrame([(url, None)], "url string, landing string")
    found = lambda *sites: row.select(urls.resolved_site(urls.site_candidates(F.col("url"), F.col("landing")), live(*sites)).alias("s")).first().s
    assert found((None, "Ext"), ("Ext", "job"))["site"] == "Ext" and found(("Ext", "job")).lang == "Ext" and found((None, "Other")) is None
    assert row.select(F.size(urls.site_candidates(F.lit(None).cast("string"), F.col("landing"))).alias("n")).first().n == 0
