"""Chains, parts, prefix maxima, tries: what holds at any size."""

import pytest


def test_long_chain_of_two_keys(spark):
    """Each row clashes with the next: the first, third, ... stay; with no limit of rounds."""
    from pyspark.sql import functions as F

    from tidemark.operators.dedupe import first_by_two_keys

    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("ord"), F.floor(F.col("id") / 2).alias("a"), F.floor((F.col("id") + 1) / 2).alias("b"))
    got = first_by_two_keys(rows, "a", "b", "ord").select(F.count("*"), F.sum(F.col("ord") % 2), F.count_distinct("a"), F.count_distinct("b")).first()
    assert tuple(got) == (n // 2, 0, n // 2, n // 2)


def test_two_keys_of_random_rows(spark):
    import random

    from tidemark.operators.dedupe import first_by_two_keys

    rng = random.Random(2)
    rows = [(k, rng.choice([None, *range(60)]), rng.choice([None, *"abcdefghijklmnopqrstuvwxyzäöü"])) for k in range(500)]
    a, b, want = set(), set(), []
    for k, x, y in rows:
        if (x is None or x not in a) and (y is None or y not in b):
            want.append(k)
            a.add(x)
            b.add(y)
    for rounds in (1, 2):
        got = first_by_two_keys(spark.createDataFrame(rows, "ord long, a int, b string"), "a", "b", "ord", rounds=rounds)
        assert sorted(r.ord for r in got.collect()) == want


def test_export_of_a_person_with_very_many_claims(spark):
    """Written in parts of bounded size by several tasks, and read back in order."""
    from pyspark.sql import functions as F

    from tidemark.operators import claims as C

    n = 5000
    own = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "other").otherwise("hot").alias("person_id"), F.col("id").alias("doc_id"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("d"),
        F.format_string("c%05d", "id").alias("claim_id"), *[F.lit("x").alias(c) for c in C.CLAIM_FIELDS.values() if c not in ("claim_id", "date", "hedged", "human_reviewed")],
        F.lit(None).cast("boolean").alias("hedged"), F.lit(True).alias("human_reviewed"),
    )
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("high").alias("date_confidence"), *[F.lit("y").alias(c) for c in C.SOURCE_FIELDS.values()])
    parts = C.exported(own, docs, per_part=100)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # tasks this small would be put together
    try:
        rows = sorted(parts.withColumn("p", F.spark_partition_id()).collect(), key=lambda r: (r.person_id, r.part))
    finally:
        spark.conf.unset(merging)
    hot = [r for r in rows if r.person_id == "hot"]
    assert [r.part for r in hot] == list(range(len(hot))) and all(len(r.claims) == 100 for r in hot[:-1]) and len({r.p for r in hot}) > 1
    import json

    back = [json.loads(c) for r in hot for c in r.claims]
    assert [(x["date"], x["id"]) for x in back] == sorted(((x["date"], x["id"]) for x in back), key=lambda x: (-int(x[0].replace("-", "")), x[1]))
    assert len(back) == own.where("person_id = 'hot'").count()


def test_records_of_a_hot_year(spark):
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from tidemark.operators import model_track as M

    import random

    rng = random.Random(4)
    rows = [(k, date(2023, 1, 1) + timedelta(days=rng.randrange(60)), rng.choice((0.1, 0.5, 0.7, rng.random()))) for k in range(3000)]
    best, want = None, []
    for k, d, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if best is None or v > best:
            want.append(k)
            best = v
    df = spark.createDataFrame(rows, "ord long, d date, v double")
    assert sorted(r.ord for r in M.records(df, "v").collect()) == sorted(want)
    keyed = df.withColumn("k", F.when(F.col("ord") % 2 == 0, "x"))
    got = {r.ord for r in M.records(keyed, "v", ["k"]).collect()}
    for own in ([r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]):
        best = None
        for k, _, v in sorted(own, key=lambda r: (r[1], r[0])):
            assert (k in got) == (best is None or v > best)
            best = v if best is None else max(best, v)


def test_guests_by_a_trie_of_names(spark):
    from tidemark.operators.transcripts import episode_guests, is_guest
    from pyspark.sql import functions as F

    people = [("a", "Ann Lee", 1), ("b", "Ann", 2), ("c", "Ann Lee Smith", 0), ("d", "Bo", 3), ("e", None, 4), ("f", "Ann  Double", 5), ("g", "", 6)]
    titles = ["Ann Lee on things", "#12: Ann Leeson", "Annie", "annual ann", "Bo", "#3 – Bob the builder", "Ann Lee Smith & co", "ann lee smithers", None, "", "Ann  Double talk", "12 Ann"]
    e = spark.createDataFrame(list(enumerate(titles)), "episode int, title string")
    p = spark.createDataFrame(people, "person_id string, display_name string, ord int")
    want = {r.episode: r.who for r in e.join(p.where("display_name <> ''"), is_guest(F.col("title"), F.col("display_name"))).groupBy("episode").agg(F.min_by("person_id", "ord").alias("who")).collect()}
    assert {r.episode: r.person_id for r in episode_guests(e, p).collect()} == want and len(want) == 10


def test_blog_posts(spark):
    from datetime import date

    from tidemark.operators.documents import blog_posts

    body = lambda t: f"<html><title>T</title><p>{t}</p></html>"
    pages = [
        (0, "https://b.example/", '<a href="/one">1</a><a href="/two">2</a><a href="/cjk">3</a><a href="/short">4</a><a href="/none">5</a>', None),
        (1, "https://b.example/one", body("Written in 2019. " + "word " * 130), None), (2, "https://b.example/two", body("In 2019 " + "word " * 130), date(2021, 3, 4)),
        (3, "https://b.example/cjk", body("字" * 900), None), (4, "https://b.example/short", body("word " * 100), None), (5, "https://b.example/none", body("word " * 130), None),
    ]
    seeds = [("https://b.example/", "p", 1, True, 0)]
    out = blog_posts(spark.createDataFrame(pages, "page_id long, url string, html string, date date"), spark.createDataFrame(seeds, "url string, person_id string, tier int, authored_by_subject boolean, ord long"))
    got = {r.page_id: (r.publication_date, r.date_precision, r.date_source, r.source_type) for r in out.collect()}
    assert got == {1: (date(2019, 7, 1), "quarter", "year", "essay"), 2: (date(2021, 3, 4), "day", "meta", "essay"), 5: (None, "quarter", "", "essay")}


def test_a_killed_batch_runs_again(spark, tmp_path, monkeypatch):
    """Batches that die after their files and before their manifest leave the table as it was; run again they are whole. Folders read for a batch stay few."""
    import random

    from tidemark.streaming import logs

    monkeypatch.setattr(logs, "RUNS", 3)
    monkeypatch.setattr(logs, "SHARDS", 4)
    rng, rows, target, read = random.Random(3), [], str(tmp_path / "table"), []
    own_read = logs._Manifests.read
    monkeypatch.setattr(logs._Manifests, "read", lambda self, folders, schema: read.append(len(folders)) or own_read(self, folders, schema))

    class Stream:  # hands its batches to foreachBatch one by one
        def __getattr__(self, name):
            return lambda *a, **k: self

        def foreachBatch(self, f):
            self.f = f
            return self

    def runs(make):
        stream = Stream()
        make(type("Log", (), {"writeStream": stream})())
        return stream.f

    insert = runs(lambda log: logs.insert_or_ignore(log, "canonical_url", "seq", target, "c"))
    commit = logs._Manifests.commit
    for k in range(10):
        part = [(f"u{rng.randrange(30)}", 100 * k + j) for j in range(12)]
        batch = spark.createDataFrame(part, "canonical_url string, seq long")
        before = logs.held(spark, target)
        n = before.count() if before is not None else 0
        if k % 3 == 1:

            def dies(self, number, parts):
                raise KeyboardInterrupt

            monkeypatch.setattr(logs._Manifests, "commit", dies)
            with pytest.raises(KeyboardInterrupt):
                insert(batch, k)
            monkeypatch.setattr(logs._Manifests, "commit", commit)
            assert (logs.held(spark, target).count() if n else 0) == n
        insert(batch, k)
        rows += part
    want = {}
    for u, seq in rows:
        want.setdefault(u, seq)
    assert {r.canonical_url: r.seq for r in logs.held(spark, target).collect()} == want and logs.held(spark, target).count() == len(want)
    assert max(read) <= logs.RUNS * logs.SHARDS and len(logs._Manifests(spark, target).numbers()) == logs._Manifests.KEPT


def test_two_keys_give_whole_rows(spark):
    """Columns that are no keys come along in their order; rows without a key clash with none."""
    from tidemark.operators.dedupe import first_by_two_keys

    rows = [("t0", 1, "a", "u"), ("t1", 2, "a", "v"), (None, 3, None, "v"), ("t3", 4, None, None), ("t4", 5, "b", "v"), ("t5", 6, None, None)]
    got = first_by_two_keys(spark.createDataFrame(rows, "text string, n int, x string, y string"), "x", "y", "n")
    assert got.columns == ["text", "n", "x", "y"] and sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [rows[k] for k in (0, 2, 3, 5)]


def test_guests_meet_names_by_equality(spark):
    """Names of one word each: titles meet them by their beginnings of a name's length, not all by all."""
    from pyspark.sql import functions as F

    from tidemark.operators.transcripts import episode_guests

    people = spark.range(500).select(F.concat(F.lit("p"), "id").alias("person_id"), F.concat(F.lit("Name#"), "id").alias("display_name"), F.col("id").alias("ord"))
    titles = spark.range(500).select(F.col("id").alias("episode"), F.concat(F.lit("#7 - Name#"), "id", F.lit(": more")).alias("title"))
    got = episode_guests(titles, people)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "StartsWith" not in plan  # one plan from titles to guests, no rounds in between
    # the person with the lowest number whose name begins the title: one of its digits' beginnings
    assert {r.episode: r.person_id for r in got.collect()} == {k: f"p{min(int(str(k)[:n]) for n in range(1, len(str(k)) + 1))}" for k in range(500)}


def test_streamed_files_come_in_order(spark):
    """A stream takes files by the time that they were written, so the files of later ranges must be later."""
    import glob
    import os

    import duckdb

    from tidemark.plans.q_pages import _streamed

    _, path = _streamed(spark.range(0, 60000, 1, 8).selectExpr("59999 - id k", "repeat('x', int(50 - id / 1200)) t"), "k", 6)
    files = sorted(glob.glob(f"{path.removeprefix('file://')}/in/*.parquet"), key=lambda f: os.stat(f).st_mtime_ns)
    ranges = [duckdb.execute(f"select min(k), max(k), count(*) from '{f}'").fetchone() for f in files]
    assert len(ranges) == 6 and ranges == sorted(ranges) and sum(r[2] for r in ranges) == 60000
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_points_shuffle_no_scores_by_benchmark(spark):
    """Scores collapse to a row for each version and benchmark before they meet anything: what is joined or sorted by benchmark is as long as the versions are many."""
    from tidemark.operators import model_track as M

    scores = spark.range(60000).selectExpr(
        "concat('b', id % 2) benchmark", "concat('v', id % 6, if(id % 4 < 2, '_high', '_low')) model_version", "'Org, Other' organization",
        "date_add(date'2016-12-01', int(id % 300)) d", "if(id % 11 = 0, null, (id % 997) / 9970d * if(id % 2 = 0, 100, 1)) raw", "lpad(id * 7919 % 60000, 5, '0') ord"
    )
    specs = spark.createDataFrame([("b0", True, 0.0, 1.0), ("b1", True, 0.0, 1.0)], "benchmark string, has_file boolean, baseline double, ceiling double")
    models = spark.createDataFrame([("v1_high", "", "Open weights", 1)], "model_version string, model_group string, accessibility string, ord long")
    labs = spark.createDataFrame([("other", "lab")], "match string, lab string")
    got = M.points(scores, specs, models, labs)
    assert "Range" not in got._jdf.queryExecution().executedPlan().toString()  # the scores are read once, for the rows that are left of them
    want = {}
    for r in scores.where("raw is not null and d >= '2017-01-01'").collect():
        s = round(r.raw * (0.01 if r.benchmark == "b0" else 1.0), 4)
        key, order = (r.benchmark, r.model_version.split("_")[0]), (-s, r.ord)
        want[key] = min(want.get(key, order), order)
    assert {(r.benchmark, r.model): (-r.s, r.ord) for r in got.collect()} == want
    assert got.where("lab <> 'lab'").count() == 0


def test_passages_tag_each_sentence_once(spark):
    """What a sentence's terms cost is paid once, and documents without a hit, empty or null still leave no row."""
    from tidemark.operators import passages as P

    docs = spark.createDataFrame([(1, "Zebra one. Two. Three zebra."), (2, "None."), (3, ""), (4, None)], "doc_id long, text string")
    got = P.passages(docs, {"X": "zebra"})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") + got._jdf.queryExecution().optimizedPlan().toString().count("rlike") == 1
    assert [tuple(r) for r in got.collect()] == [(1, 0, "X", "Zebra one. Two."), (1, 1, "X", "Two. Three zebra.")]
