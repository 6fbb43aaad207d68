"""Small literal cases that the given tables don't have."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores, text, urls
from tidemark.functions.dates import duration
from tidemark.operators import claims, dedupe, events, model_track, page_dates, passages, transcripts
from tidemark.sources import tables
from tidemark.streaming import logs


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [("“It’s — fine”", "\"it's - fine\""), ("a b\t\nc", "a b c"), ("ﬁne ①", "fine 1"), ("  Ünïcode ", "ünïcode"), ("", "")],
)
def test_normalized(spark, raw, want):
    assert one(spark, text.normalized(F.col("t")), t=raw) == want


def test_quote_too_long(spark):
    assert one(spark, text.quote_too_long(F.col("t")), t="w " * 51) is True
    assert one(spark, text.quote_too_long(F.col("t")), t="w " * 50) is False
    assert one(spark, text.quote_too_long(F.col("t")), t="字" * 121) is True
    assert one(spark, text.quote_too_long(F.col("t")), t="字" * 120) is False


@pytest.mark.parametrize(
    "answer, want",
    [
        ('Sure:\n```json\n[{"a": 1}, 2]\n```', ['{"a": 1}', "2"]), ('x [ {"a":1} ] y', ['{"a":1}']), ("no json", None), ('```\n{"a":1}\n```', None),
        ("[broken", None)
    ],
)
def test_recovered_array(spark, answer, want):
    got = one(spark, text.recovered_array(F.col("t")), t=answer)
    assert (None if got is None else [x.replace(" ", "") for x in got]) == (None if want is None else [x.replace(" ", "") for x in want])


def test_validated_claims_reject_with_a_reason(spark):
    docs = spark.createDataFrame([(1, "We said “pause now” today.", 3)], "doc_id long, document_text string, source_tier int")
    answer = '[{"supporting_text":"pause now","axis_scores":[{"axis":"y","score":3,"strength":0}],"hedged":false},{"supporting_text":"never said","axis_scores":[]},{"supporting_text":"today","axis_scores":[{"axis":"Q","score":1}]}, 7]'
    rows = claims.validated(spark.createDataFrame([(1, answer)], "doc_id long, response string"), docs)
    got = {r.quote: (r.reject_reason, [(s.axis, s.score, s.strength) for s in r.scores or []]) for r in rows.collect()}
    assert got["pause now"] == (None, [("Y", 2, 0.7)]) and got["never said"][0] == "unverbatim" and got["today"][0] == "shape" and got[""][0] == "shape"
    assert claims.statistics(rows).first().kept == 1


def test_clamp(spark):
    df = spark.createDataFrame([(5, 3, False), (-5, 4, False), (3, 9, True), (-2, 1, True)], "s int, t int, h boolean")
    assert [r.x for r in df.select(scores.clamp(F.col("s"), F.col("t"), F.col("h")).alias("x")).collect()] == [2, 0, 1, -1]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://a.example/x/?utm_source=q&b=1&c=#frag", "http://a.example/x?b=1"), ("https://a.example", "https://a.example/"),
        ("https://a.example/x;v=1?q=a%20b&fbclid=z", "https://a.example/x?q=a+b"),
        ("https://a.example:8/y//", "https://a.example:8/y"),
        ("https://a.example/?utm%5Fsource=q&%55TM_x=1&ref%5furl=z&utm%=3", "https://a.example/?utm%25=3"),
        ("https://a.example/?d=50%&e=%zz%20%41&f%5Fg=%C3%A9+%2B", "https://a.example/?d=50%25&e=%25zz+A&f_g=%C3%A9+%2B"),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


def test_article_links(spark):
    html = '<a href="/a/../b">1</a><a href="c.pdf">2</a><a href="//h.example/d/">3</a><a href="#x">4</a><a href="https://other.example/e">5</a><a href="/b?utm_x=1">6</a><a href="/tag/q">7</a>'
    assert one(spark, urls.article_links(F.col("h"), F.col("u")), h=html, u="https://h.example/z") == ["https://h.example/b", "https://h.example/d"]


PAGES = [
    (1, "https://h.example/2021/05/17/x", "<p>none</p>", None, (date(2021, 5, 17), "day", "url", "high", "")),
    (2, "https://h.example/x", "<h1>T</h1><p>October 2024</p>", None, (date(2024, 10, 1), "month", "dateline", "high", "")),
    (
        3, "https://h.example/x", '<script>{"datePublished": "2015-01-02"}</script><p>March 3, 2020</p>', None,
        (date(2020, 3, 3), "day", "dateline", "low", "conflicts with jsonld (2015-01-02) by 1887d")
    ),
    (
        4, "https://h.example/x", '<time datetime="2020-03-10T08:00:00Z">x</time><p>March 3, 2020</p>', None,
        (date(2020, 3, 3), "day", "dateline", "high", "corroborated by time_tag")
    ),
    (5, "https://h.example/x", "<p>nothing</p>", None, (None, "quarter", "none", "none", "")),
    (
        6, "https://h.example/x", "<p>August 2, 2024</p>", None,
        (date(2024, 8, 2), "day", "dateline", "low", "resolves to current month, likely site furniture")
    ),
    (7, "https://h.example/x", "<p>2020-02-03</p>", date(2020, 2, 1), (date(2020, 2, 1), "day", "feed", "high", "corroborated by dateline")),
    (
        8, "https://h.example/x", '<meta property="article:published_time" content="2019-07-08">' + "<p>" + "x " * 400 + "July 2019</p>", None,
        (date(2019, 7, 8), "day", "meta", "high", "corroborated by body")
    ),
    (
        9, "https://h.example/x", '<script>"datePublished": "1901-01-01" "datePublished": "2018-01-02"</script>', None,
        (date(2018, 1, 2), "day", "jsonld", "medium", "")
    ),
]


def test_page_dates(spark):
    df = spark.createDataFrame([p[:4] for p in PAGES], "page_id int, url string, html string, feed_date date")
    got = {r.page_id: (r.d, r.precision, r.date_source, r.date_confidence, r.date_note) for r in page_dates.resolved(df, "2024-08-15").collect()}
    assert got == {p[0]: p[4] for p in PAGES}


def test_passages_skip_what_a_hit_covers(spark):
    body = "We need a pause. Safety first. Calm. Calm again. Scaling laws hold! And AGI? End."
    got = [(r.place, r.axes, r.passage) for r in passages.passages(spark.createDataFrame([(1, body)], "doc_id int, text string")).orderBy("place").collect()]
    assert got == [(0, "Y", "We need a pause. Safety first."), (1, "S", "Calm again. Scaling laws hold! And AGI?")]
    many = " ".join(f"pause {i}. a. b." for i in range(60))
    assert passages.passages(spark.createDataFrame([(1, many)], "doc_id int, text string")).count() == 40


def test_guest_speech(spark):
    body = "\n".join(["Ann Host 00:00:01", "Hello.", "Bo Guest 00:00:09", "I think so.", "(00:10) skip"] * 4)
    rows = transcripts.lines(spark.createDataFrame([(1, 0, body)], "doc int, ord int, body string"))
    got = transcripts.guest_speech(rows, spark.createDataFrame([(1, "Robert Guest")], "doc int, guest string")).first()
    assert (got.label, got.speech, got.words) == ("Bo Guest", "\n".join(["I think so."] * 4), 12)


def test_episode_guests(spark):
    titles = spark.createDataFrame(
        [(1, "#12 – Kai Fu Lee on things"), (2, "The Lee of war"), (3, "Madonnaesque"), (4, "About Kai Fu Lee")], "episode int, title string"
    )
    people = spark.createDataFrame([("k", "Kai Fu Lee", 1), ("m", "Madonna", 2)], "person_id string, display_name string, ord int")
    assert {r.episode: r.person_id for r in transcripts.episode_guests(titles, people).collect()} == {1: "k", 3: "m"}


def test_two_key_dedupe(spark):
    rows = spark.createDataFrame(
        [(1, "d1", "u1"), (2, "d2", "u1"), (3, "d2", "u3"), (4, "d3", "u3"), (5, "d3", "u4")], "ord int, doc string, url string"
    )
    assert sorted(r.ord for r in dedupe.first_by_two_keys(rows, "doc", "url", "ord").collect()) == [1, 3, 5]


def test_licences(spark):
    df = spark.createDataFrame(
        [("CC BY-SA 4.0",), ("CC BY-NC 4.0",), ("CC BY-ND",), ("",), (None,), ("Public domain",), ("Fair use",), ("CC0",), ("all rights",)],
        "l string"
    )
    assert [
        r.x for r in df.select(events.usable_licence(F.col("l")).alias("x")).collect()
    ] == [True, False, False, False, False, True, False, True, False]


def test_licence_tokens_are_plain_substrings(spark):
    # "public domain" holds no refused token, but "licence" holds "nc": substrings, not words
    assert one(spark, events.usable_licence(F.col("l")), l="attribution licence") is False


def test_duration(spark):
    df = spark.createDataFrame([(0.5,), (12.0,), (90.0,), (700.0,), (2880.0,)], "m double")
    assert [r.x for r in df.select(duration(F.col("m")).alias("x")).collect()] == ["30 sec", "12 min", "1.5 hr", "12 hr", "2.0 days"]


def test_names(spark):
    assert one(spark, text.display_name(F.col("v"), F.lit(""), F.lit(None).cast("string")), v="m-4_XHigh") == "m-4"
    assert one(spark, text.display_name(F.col("v"), F.lit("Group"), F.lit("Name")), v="m-4_16k") == "Group"
    assert one(spark, text.slug(F.col("v")), v="A (b) C!") == "a-b-c"


def test_dated_rows(spark):
    rows = spark.createDataFrame([("2020-01-01",), ("2016-12-31",), ("2020-1-1",), (None,)], "d string")
    assert [r.d for r in model_track.dated(rows, "d").collect()] == ["2020-01-01"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    assert tables.csv(spark, str(tmp_path / "a.csv")).first().y == "two\nlines"
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>t</title><link>https://h.example/a?utm_x=1</link><pubDate>Tue, 04 Mar 2025 10:00:00 +0000</pubDate></item><item><title>u</title><link>https://h.example/b</link><updated>2024-02-03T00:00:00Z</updated></item></channel></rss>"
    )
    items = tables.feed_items(spark, str(tmp_path / "f.xml"))
    assert {r.title: r.d for r in items.collect()} == {"t": date(2025, 3, 4), "u": date(2024, 2, 3)}
    assert {
        r.url: r.d for r in tables.feed_map(items.withColumn("ord", F.lit(1))).collect()
    } == {"https://h.example/a": date(2025, 3, 4), "https://h.example/b": date(2024, 2, 3)}
    (tmp_path / "l.jsonl").write_text('{"canonical_url":"u","status":500,"seq":1}\n{"canonical_url":"u","status":200,"seq":2}\n')
    assert tables.fetch_log(spark, str(tmp_path / "l.jsonl")).first().status == 200
    pages = spark.createDataFrame([(1, "<p>")], "page_id int, html string")
    tables.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 1
    tables.write_nested(pages.select("page_id", F.array("html").alias("h")), str(tmp_path / "nested"))
    assert spark.read.json(str(tmp_path / "nested")).first().h == ["<p>"]


def test_streams_end_where_batches_do(spark, tmp_path):
    schema = "canonical_url string, status int, seq long, fetched_at timestamp"
    source, target = str(tmp_path / "log"), str(tmp_path / "table")
    for part in ([("u", 500, 1), ("v", 200, 2)], [("u", 200, 3)]):
        spark.createDataFrame(
            part, "canonical_url string, status int, seq long"
        ).withColumn("fetched_at", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").json(source)
        logs.replay(spark.readStream.schema(schema).json(source), target, str(tmp_path / "c1")).awaitTermination()
        logs.insert_or_ignore(
            spark.readStream.schema(schema).json(source), "canonical_url", "seq", str(tmp_path / "kept"), str(tmp_path / "c2")
        ).awaitTermination()
    assert {r.canonical_url: r.status for r in logs.latest(spark, target).collect()} == {"u": 200, "v": 200}
    assert {r.canonical_url: r.seq for r in logs.held(spark, str(tmp_path / "kept")).collect()} == {"u": 1, "v": 2}
    counted = logs.hourly(
        spark.readStream.schema(schema).json(source)
    ).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert {(r.status, r.n) for r in spark.table("hours").collect()} == {(500, 1), (200, 2)}


def test_streams_of_many_batches(spark, tmp_path):
    """Batch by batch against the whole: the last record, and the first, of each URL; old versions of parts are deleted."""
    import random

    rng, source, target = random.Random(4), str(tmp_path / "log"), str(tmp_path / "table")
    schema, rows = "canonical_url string, status int, seq long", []
    for k in range(6):
        part = [(f"u{rng.randrange(40)}", rng.choice([200, 404, 500]), 100 * k + j) for j in range(25)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)
        logs.replay(spark.readStream.schema(schema).json(source), target, str(tmp_path / "c1")).awaitTermination()
        logs.insert_or_ignore(
            spark.readStream.schema(schema).json(source), "canonical_url", "seq", str(tmp_path / "kept"), str(tmp_path / "c2")
        ).awaitTermination()
    assert {r.canonical_url: (r.status, r.seq) for r in logs.latest(spark, target).collect()} == {u: (status, seq) for u, status, seq in rows}
    assert {r.canonical_url: r.seq for r in logs.held(spark, str(tmp_path / "kept")).collect()} == {u: seq for u, _, seq in reversed(rows)}
    assert all(len(v) <= logs.RUNS for v in logs._Manifests(spark, target).before().values())


@pytest.mark.parametrize(
    "answer, want", [('```\n{"a": "1"}\n```', "1"), ('so {"a": "2"} it is', "2"), ('[{"a": "3"}]', None), ("{broken", None), ("none", None)]
)
def test_recovered_object(spark, answer, want):
    assert one(spark, F.get_json_object(text.recovered_object(F.col("t")), "$.a"), t=answer) == want


def test_two_keys_against_insertion_in_order(spark):
    import random

    rng = random.Random(8)
    rows = [(k, rng.choice([None, *range(40)]), rng.choice([None, *"abcdefghijklmnopqrstuvwxyz"])) for k in range(300)]
    seen_a, seen_b, want = set(), set(), []
    for k, a, b in rows:
        if (a is None or a not in seen_a) and (b is None or b not in seen_b):
            want.append(k)
            seen_a.add(a)
            seen_b.add(b)
    got = dedupe.first_by_two_keys(spark.createDataFrame(rows, "ord int, a int, b string"), "a", "b", "ord")
    assert sorted(r.ord for r in got.collect()) == want


def test_guests_with_long_and_one_word_names(spark):
    people = spark.createDataFrame(
        [("p1", "Al", 1), ("p2", "Alexandra " + "x" * 80, 2), ("p3", "Bo Li", 3)], "person_id string, display_name string, ord int"
    )
    titles = [(1, "#12 - Alexandra " + "X" * 80 + " returns"), (2, "Bo Linden on food"), (3, "About Bo Li"), (4, "alfred"), (5, "17: bo li")]
    got = transcripts.episode_guests(spark.createDataFrame(titles, "episode int, title string"), people)
    assert sorted((r.episode, r.person_id) for r in got.collect()) == [(1, "p1"), (2, "p3"), (4, "p1"), (5, "p3")]


def test_positions_of_some_months_are_those_of_all(spark):
    from tidemark.operators.positions import positions

    own = [("p", "X", f"c{k}", k // 2, date(2020 + k % 5, 1 + k % 12, 1 + k % 28), k % 7 - 3, 1.0, 0.8, 1 + k % 3) for k in range(60)]
    df = spark.createDataFrame(
        own, "person_id string, axis string, claim_id string, doc_id int, d date, score int, strength double, confidence double, tier int"
    )
    everything = {r.month_end: r for r in positions(df).collect()}
    some = positions(df, ends=("2022-02-01", "2022-04-30")).collect()
    assert {r.month_end for r in some} == {date(2022, 2, 28), date(2022, 3, 31), date(2022, 4, 30)}
    assert all(r == everything[r.month_end] for r in some)
    assert positions(df, at="2022-03-31").first() == everything[date(2022, 3, 31)]


def test_typed_rows(spark):
    rows = spark.createDataFrame(
        [("2021-01-01", "1.5"), ("2016-12-31", "1"), ("2021-01", "1"), (None, "1"), ("2020-02-02", "n/a")], "d string, x string"
    )
    assert sorted((str(r.d), r.x) for r in model_track.typed(rows, ("x",)).collect() if r.x) == [("2021-01-01", 1.5)]
    assert model_track.typed(rows, ("x",)).count() == 2
