"""Queries on pages, dates, passages, transcripts, events and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.functions.dates import effective, year_fallback
from tidemark.operators import documents as D
from tidemark.operators import events as E
from tidemark.operators import dedupe, page_dates, passages, transcripts, views
from tidemark.plans import sql_pages as Q
from tidemark.plans.derived import view, with_sql
from tidemark.sources import tables
from tidemark.streaming import logs

AS_OF = "2024-08-15"
#: Terms that the test documents' words have; the default terms are English.
TERMS = {"X": r"\bthe\b", "Y": r"tion\b", "Z": "eau"}


#: The same for RE2, whose word ends know ASCII letters only.
SQL_TERMS = {"X": r"(?:^|[^\p{L}\p{N}_])the(?:[^\p{L}\p{N}_]|$)", "Y": r"tion(?:[^\p{L}\p{N}_]|$)", "Z": "eau"}


def fed(s: SparkSession, d: str) -> DataFrame:
    """Dated pages, every tenth with a feed's date."""
    return page_dates.with_feed_dates(view(s, d, "t_datedpages"), feeds(s, d))


def feeds(s: SparkSession, d: str) -> DataFrame:
    return tables.feed_map(
        view(s, d, "t_datedpages").where("page_id % 10 = 0").select(
            F.col("url").alias("link"), F.lit("2021-03-04").cast("date").alias("d"), F.col("page_id").alias("ord")
        )
    )


def dated(s: SparkSession, d: str) -> DataFrame:
    return page_dates.resolved(fed(s, d), AS_OF)


def redated(s: SparkSession, d: str) -> DataFrame:
    """Documents of dated pages, with the source that the documents' table has."""
    pages = view(s, d, "t_datedpages")
    said = view(s, d, "t_docs").select("doc_id", "date_source", "date_confidence", "publication_date")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("canonical_url")).join(said, "doc_id")
    return page_dates.redated(docs, pages.select(F.col("page_id").alias("doc_id"), "html"), feeds(s, d), AS_OF)


def dated_links(s: SparkSession, d: str, later: int) -> DataFrame:
    """A feed of all dated pages, or of every second one with other dates."""
    pages = view(s, d, "t_datedpages")
    return (pages.where("page_id % 2 = 0") if later else pages).select(
        F.col("url").alias("link"), F.date_add(F.lit("2021-01-01").cast("date"), F.col("page_id").cast("int") + 1000 * later).alias("d"),
        F.col("page_id").alias("ord")
    )


def feed_items(s: SparkSession, d: str) -> DataFrame:
    """Pages written as RSS and as Atom, and read back; a host has a file for each 1,000 page ids, so no host is one row."""
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    day = F.date_add(F.lit("2021-01-01").cast("date"), F.col("page_id").cast("int"))
    mail = F.concat(F.lit("Tue, "), F.date_format(day, "dd MMM yyyy"), F.lit(" 10:00:00 GMT"))
    rss = F.concat(
        F.lit("<item><title>p"), F.col("page_id"), F.lit("</title><link>"), url, F.lit('</link><enclosure url="https://a.example/'), F.col("page_id"),
        F.lit('.mp3" type="audio/mpeg"/><pubDate>'), mail, F.lit("</pubDate></item>")
    )
    atom = F.concat(
        F.lit("<entry><title>p"), F.col("page_id"), F.lit('</title><link rel="enclosure" href="https://a.example/'), F.col("page_id"),
        F.lit('.mp3"/><link rel="alternate" href="'), url, F.lit('"/>'),
        F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<published>"), day.cast("string"), F.lit("T08:00:00Z</published>"))),
        F.lit("<updated>"), F.date_add(day, 1).cast("string"), F.lit("T08:00:00Z</updated></entry>"),
    )
    out = None
    for k, (text, tag) in enumerate(((atom, "entry"), (rss, "item"))):
        path = tables.scratch(s, "feed")
        own = view(s, d, "pages").where(F.col("page_id") % 2 == k).groupBy(U.host(F.col("url")).alias("h"), F.floor(F.col("page_id") / 1000).alias("part")).agg(
            F.array_join(F.array_sort(F.collect_list(text)), "").alias("items")
        )
        own.select(F.concat(F.lit("<feed>"), "items", F.lit("</feed>")).alias("value"), F.md5(F.concat_ws(" ", "part", "h")).alias("feed")).write.partitionBy("feed").text(path)
        own = tables.feed_items(s, path, tag)
        out = own if out is None else out.unionByName(own)
    return out


def podcasts(s: SparkSession, d: str) -> DataFrame:
    """Conversations as episodes: the guest is named in the title, the text is on the page or on its sibling."""
    own = guests(s, d)
    people = own.select(F.col("guest").alias("display_name")).distinct().select(
        "display_name", F.concat(F.lit("p-"), F.lower(F.replace("display_name", F.lit(" "), F.lit("-")))).alias("person_id"),
        F.when(F.col("display_name") == "assistant", 0).otherwise(1).alias("ord")
    )
    url = lambda c: F.concat(F.lit("https://casts.example/c/"), c.cast("string"))
    entries = own.select(
        F.col("doc").alias("episode"), F.lit(0).alias("feed"), F.col("doc").alias("pos"),
        F.concat(F.lit("#"), F.col("doc"), F.lit(" - "), F.col("guest"), F.lit(" on things")).alias("title"),
        F.concat(url(F.col("doc")), F.lit("?utm_source=feed")).alias("link"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc") % 1000).cast("int")).alias("d"),
    )
    said = view(s, d, "t_transcript")
    texts = said.select(
        F.when(F.col("conv_id") % 3 == 0, F.concat(url(F.col("conv_id")), F.lit("-transcript"))).otherwise(url(F.col("conv_id"))).alias("url"),
        F.col("turn").alias("ord"), "body"
    )
    return transcripts.podcast_documents(entries, people, texts, 2, 40)


def crawled(s: SparkSession, d: str) -> DataFrame:
    """Each host has an index page that links to its pages; a host whose first page has an even number names that page itself."""
    pages = view(s, d, "pages")
    own = pages.withColumn("h", U.host(F.col("url"))).groupBy("h").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("all")
    )
    links = F.array_join(F.transform("all", lambda x: F.concat(F.lit('<a href="'), x["url"], F.lit('">x</a>'))), "")
    article = F.col("first.page_id") % 2 == 0
    index_url = F.concat(F.lit("https://"), F.col("h"), F.lit("/"))
    index = own.where(~article).select((-1 - F.col("first.page_id")).alias("page_id"), index_url.alias("url"), links.alias("html"))
    seeds = own.select(
        F.when(article, F.col("first.url")).otherwise(index_url).alias("url"), F.when(article, "article").otherwise("index").alias("kind"),
        F.concat(F.lit("p"), F.col("first.page_id").cast("string")).alias("person_id"), F.lit("talk").alias("source_type"),
        F.lit(1).alias("tier"), F.lit("en").alias("language"), F.lit(True).alias("authored_by_subject"),
        F.when(F.col("first.page_id") % 3 == 0, F.lit("2021-05-01").cast("date")).alias("date"), F.col("first.page_id").alias("ord"),
    )
    return D.crawled(pages.select("page_id", "url", "html").unionByName(index), seeds)


def _streamed(rows: DataFrame, by: str, batches: int) -> tuple[DataFrame, str]:
    """``rows`` written as so many files, in the order of ``by``, and read as a stream of one file a batch; and a folder for what becomes of it."""
    s = rows.sparkSession
    path = tables.scratch(s, "stream")
    rows.repartitionByRange(batches, by).withColumn("batch", F.spark_partition_id()).write.partitionBy("batch").parquet(f"{path}/cut")
    cut = s.read.parquet(f"{path}/cut")
    for k in range(batches):  # one after another, as a stream takes the files by the time that each was written
        cut.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), path


def streamed_log(s: SparkSession, d: str) -> DataFrame:
    """The fetch log as a stream of batches, replayed to the last record of each URL."""
    log, path = _streamed(view(s, d, "t_fetchlog"), "seq", 6)
    logs.replay(log, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return logs.latest(s, f"{path}/table").drop("shard")


def streamed_inserts(s: SparkSession, d: str) -> DataFrame:
    """Documents as a stream of batches: of each URL the first stays."""
    rows, path = _streamed(view(s, d, "t_docs").select("doc_id", "canonical_url", "person_id", "title"), "doc_id", 6)
    logs.insert_or_ignore(rows, "canonical_url", "doc_id", f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return logs.held(s, f"{path}/table").drop("shard")


def blogs(s: SparkSession, d: str) -> DataFrame:
    """Each host's index page links to its pages; every seventh page says in Chinese what it says, every third has a date, and every fifth begins with a year."""
    pages = view(s, d, "t_blogpages")
    own = pages.withColumn("h", U.host(F.col("url"))).groupBy("h", F.floor(F.col("page_id") / 500).alias("part")).agg(F.min("page_id").alias("ord"), F.collect_list("url").alias("all"))
    # an index page for each 500 ids, so that none is as long as the host is large
    links = F.array_join(F.transform("all", lambda x: F.concat(F.lit('<a href="'), x, F.lit('">x</a>'))), "")
    index = own.select((-1 - F.col("ord")).alias("page_id"), F.concat(F.lit("https://"), "h", F.lit("/index/"), F.col("part").cast("string")).alias("url"), links.alias("html"), F.lit(None).cast("date").alias("date"))
    seeds = own.select(
        F.concat(F.lit("https://"), "h", F.lit("/index/"), F.col("part").cast("string")).alias("url"), F.lit("p").alias("person_id"), F.lit(1).alias("tier"), F.lit(True).alias("authored_by_subject"), "ord"
    )
    return D.blog_posts(pages.select("page_id", "url", "html", "date").unionByName(index), seeds, per_page=1_000_000)


def log(s: SparkSession, d: str) -> DataFrame:
    return tables.replayed(
        view(s, d, "t_fetchlog").withColumn("ok", F.col("status") == 200).withColumn("error", F.when(F.col("seq") % 11 == 0, "robots.txt"))
    )


def spoken(s: SparkSession, d: str) -> DataFrame:
    return transcripts.lines(view(s, d, "t_transcript").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "body"))


def guests(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "conversations").select(F.col("conv_id").alias("doc")).distinct().withColumn(
        "guest", F.when(F.col("doc") % 2 == 0, "assistant").otherwise("The User")
    )


def episodes(s: SparkSession, d: str) -> DataFrame:
    """Episodes of orders: every third has its person's name at the start, after a number for some, the others only mention it."""
    name = F.format_string("Customer#%09d", F.col("o_custkey"))
    title = F.when(
        F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), F.col("o_orderkey").cast("string"), F.lit(" - "), name, F.lit(" on things"))
    ).when(F.col("o_orderkey") % 3 == 1, F.concat(name, F.lit(": more"))).otherwise(F.concat(F.lit("About "), name))
    return view(s, d, "orders").select(
        F.col("o_orderkey").alias("episode"), title.alias("title"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("person_id"),
        F.to_date(F.expr("o_orderdate + interval 276 month")).alias("d")
    )


def people(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("person_id"),
        F.format_string("Customer#%09d", F.col("c_custkey")).alias("display_name"), F.col("c_custkey").alias("ord")
    )


def waiting(s: SparkSession, d: str) -> DataFrame:
    docs = view(s, d, "t_docs").where("date_source = 'rss'")
    own = episodes(s, d).select(
        "person_id", "d",
        F.concat(
            F.lit("https://h"), (F.substring("person_id", 2, 9).cast("int") % 20).cast("string"), F.lit(".example/a/"),
            (F.col("episode") % 900).cast("string"), F.lit("?utm_source=x")
        ).alias("audio_url"),
        F.lit(1).alias("feed"), F.col("episode").alias("pos")
    )
    return transcripts.backlog(own.withColumn("d", F.trunc("d", "MM")), docs)


def seeded(s: SparkSession, d: str) -> DataFrame:
    seeds = view(s, d, "pages").groupBy(U.host(F.col("url")).alias("h")).agg(F.min("page_id").alias("k")).select(
        F.concat(F.lit("https://"), F.col("h"), F.lit("/")).alias("url"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("person_id"),
        F.lit(1).alias("tier"), F.lit("en").alias("language"), F.lit(True).alias("authored_by_subject"),
        F.when(F.col("k") % 2 == 0, F.lit("2021-05-01").cast("date")).alias("date")
    )
    return D.documents(view(s, d, "pages"), seeds)


def timeline(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "events").select(
        F.col("event_id"), F.to_date("ts").alias("d"), F.col("event_type").alias("category"),
        F.concat(F.lit("  a\n"), "event_type", F.lit("\t b ")).alias("summary"), (F.col("event_id") % 2 == 0).alias("verified")
    )


VISIBLE = r"trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<(script)\b.*?</script>|<(style)\b.*?</style>|<(noscript)\b.*?</noscript>|<(svg)\b.*?</svg>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '')"
LOG = "lg as (select canonical_url, arg_max(status, seq) status, arg_max(seq, seq) seq, arg_max(bytes, seq) bytes from t_fetchlog group by 1), ok as (select *, status = 200 live, seq % 11 = 0 robots from lg)"
OUTCOME = "case when status = 200 then 'live' when status = 403 or robots then 'blocked' when status = 404 then 'dead' else 'unreachable' end"

def _cjk(text: str) -> str:
    return f"length(regexp_replace({text}, '[^一-鿿぀-ヿ]', '', 'g'))"


def _words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '[\\s\\x{{00a0}}]+'), lambda w: w <> ''))"


QUERIES = {
    "dat4_page_dates": lambda s, d: dated(s, d).select("page_id", "d", "precision", "date_source", "date_confidence", "date_note"),
    "j3_feed_dates": lambda s, d: fed(s, d).select("page_id", "feed_date"),
    "job3_redated": lambda s, d: page_dates.breakdown(redated(s, d)),
    "dat6_year_fallback": lambda s, d: view(s, d, "documents").select(
        "doc_id",
        year_fallback(
            F.when(F.col("doc_id") % 3 == 0, F.lit("2022-01-01").cast("date")),
            F.concat(F.lit("in "), (F.col("doc_id") % 1000 + 1500).cast("string"), F.lit(" "), F.col("text"))
        ).alias("d")
    ),
    "prj2_effective_date": lambda s, d: view(s, d, "t_docs").select(
        "doc_id", effective(F.when(F.col("doc_id") % 2 == 0, F.lit("2020-02-02").cast("date")), F.col("publication_date")).alias("d")
    ),
    "str5_visible_text": lambda s, d: view(s, d, "pages").select("page_id", F.md5(X.visible_text(F.col("html"))).alias("md5")),
    "str6_sentences": lambda s, d: view(s, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence")),
    "str7_axis_tags": lambda s, d: view(s, d, "documents").select("doc_id", X.axis_tags(F.col("text"), TERMS).alias("axes")),
    "str8_passages": lambda s, d: passages.passages(view(s, d, "documents"), TERMS).select("doc_id", "place", "axes", F.md5("passage").alias("md5")),
    "str8_passages_default_terms": lambda s, d: passages.passages(
        view(s, d, "documents").select("doc_id", F.concat(F.lit("We should pause. Scaling laws hold. Nothing here. "), F.col("text")).alias("text"))
    ).groupBy("axes").agg(F.count("*").alias("n")),
    "str9_canonical_urls": lambda s, d: view(s, d, "pages").select(
        "page_id", U.canonical(F.concat("url", F.when(F.contains("url", F.lit("?")), "&utm_campaign=z&blank=").otherwise("?utm_x=1"))).alias("url")
    ),
    "str9_encoded_names": lambda s, d: view(s, d, "pages").select(
        "page_id", U.canonical(F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit(Q.ENCODED))).alias("url")
    ),
    "str10_hosts": lambda s, d: E.hosts(view(s, d, "pages"), "url"),
    "str11_article_links": lambda s, d: view(s, d, "pages").select(
        "page_id", F.array_join(U.article_links(F.col("html"), F.col("url")), " ").alias("links")
    ),
    "str12_feed_candidates": lambda s, d: view(s, d, "pages").select(
        "page_id",
        F.array_join(
            U.feed_candidates(F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/own.xml">'), F.col("html")), F.col("url")), " "
        ).alias("feeds")
    ),
    "win10_first_links": lambda s, d: D.articles(view(s, d, "pages").withColumn("html", F.regexp_replace("html", 'href="/', 'href="/a/'))),
    "job4_documents": lambda s, d: seeded(s, d).select(
        "person_id", "canonical_url", "date_source", "publication_date", F.md5("title").alias("title"), F.md5("text").alias("text")
    ),
    "dat4_structured_dates": lambda s, d: page_dates.resolved(view(s, d, "t_markedpages").withColumn("feed_date", F.lit(None).cast("date")), AS_OF).select(
        "page_id", "d", "precision", "date_source", "date_confidence"
    ),
    "str3_chinese_and_other": lambda s, d: view(s, d, "t_blogpages").select(
        "page_id", X.cjk_count(F.col("body")).alias("cjk"), X.long_enough(F.col("body")).alias("long_enough"),
        *[X.quote_too_long(F.substring("body", 1, n)).alias(f"too_long_{n}") for n in (60, 120, 121, 400)],
    ),
    "stm1_replayed_stream": streamed_log,
    "stm2_inserted_stream": streamed_inserts,
    "job4_blog_posts": lambda s, d: blogs(s, d).select("page_id", "source_url", "publication_date", "date_precision", "date_source", "source_type"),
    "job4_crawled": lambda s, d: crawled(s, d).select(
        "person_id", "canonical_url", "source_type", "date_source", "publication_date", F.md5("title").alias("title"), F.md5("text").alias("text")
    ),
    "k2_pages_by_two_keys": lambda s, d: dedupe.first_by_two_keys(
        view(s, d, "pages").select(U.host(F.col("url")).alias("h"), F.get(F.split("url", "/"), 4).alias("n"), "page_id"), "h", "n", "page_id"
    ),
    "src5_feed_items": lambda s, d: feed_items(s, d),
    "job5_podcast_documents": lambda s, d: podcasts(s, d).select("episode", "person_id", "url", "label", F.md5("speech").alias("md5"), "words", "d"),
    "fil6_long_enough": lambda s, d: view(s, d, "documents").select("doc_id", X.long_enough(F.col("text")).alias("keep")),
    "src7_hashed_pages": lambda s, d: tables.hashed_pages(view(s, d, "pages")).select("page_id", "content_hash", "shard"),
    "job14_feed_map": lambda s, d: tables.feed_map(tables.union_of_feeds(*[dated_links(s, d, k) for k in (0, 1)])),
    "src6_replayed_log": lambda s, d: log(s, d).select("canonical_url", "status", "seq"),
    "job9_verified_events": lambda s, d: E.verified(view(s, d, "t_eventsrc"), log(s, d)).select(
        "timeline_id", "live", "blocked", "dead", "verified", F.array_join("dead_sources", " ").alias("dead_sources")
    ),
    "agg23_host_totals": lambda s, d: E.host_totals(view(s, d, "t_fetchlog")),
    "agg24_reachability": lambda s, d: E.reachability(view(s, d, "t_eventsrc").select(F.col("source").alias("canonical_url")), log(s, d)),
    "fil7_timeline": lambda s, d: E.timeline(timeline(s, d)).select("event_id", "summary"),
    "fil8_categories": lambda s, d: E.in_categories(timeline(s, d), ("purchase", "error")).groupBy("category").agg(F.count("*").alias("n")),
    "fil9_kinds": lambda s, d: E.persons(view(s, d, "t_people")).select("person_id"),
    "fil9_portrayed": lambda s, d: E.portrayed(view(s, d, "t_people")).select("person_id"),
    "fil10_licences": lambda s, d: view(s, d, "part").select(
        "p_partkey",
        E.usable_licence(
            F.when(F.col("p_size") % 5 == 0, "CC BY-SA 4.0").when(F.col("p_size") % 5 == 1, "CC BY-NC 2.0").when(
                F.col("p_size") % 5 == 2, "Public domain"
            ).when(F.col("p_size") % 5 == 3, "")
        ).alias("usable")
    ),
    "fil11_live_seeds": lambda s, d: tables.seeds(_registry(s, d)).select("person_id", "place", "url", "tier", "language"),
    "fil16_events_of_month": lambda s, d: views.events_of_month(timeline(s, d), "2024-01").select("event_id", "d"),
    "str13_speaker_labels": lambda s, d: transcripts.speaker_labels(spoken(s, d), 2).select("doc", "label", "n"),
    "win6_turns": lambda s, d: transcripts.turns(spoken(s, d), 2).groupBy("doc", "speaker").agg(F.count("*").alias("n")),
    "job5_guest_speech": lambda s, d: transcripts.guest_speech(spoken(s, d), guests(s, d), 2).select(
        "doc", "label", F.md5("speech").alias("md5"), "words"
    ),
    "str15_first_usable": lambda s, d: transcripts.first_usable(
        view(s, d, "lineitem").select(
            F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") * 10).cast("int").alias("words")
        )
    ),
    "j7_episode_guests": lambda s, d: transcripts.episode_guests(episodes(s, d).select("episode", "title"), people(s, d)),
    "win9_first_per_person": lambda s, d: transcripts.first_per_person(
        episodes(s, d).withColumn("feed", F.lit(1)).withColumn("pos", F.col("episode"))
    ).select("person_id", "episode"),
    "job6_backlog": lambda s, d: waiting(s, d).select("person_id", "d", "canonical_url", "pos"),
    "prj1_flat_rows": lambda s, d: tables.flat(
        view(s, d, "t_docs").select("doc_id", "publication_date", F.array("collector", "title").alias("tags"))
    ),
}


def _registry(s: SparkSession, d: str) -> DataFrame:
    seed = lambda url, status, tier, lang: F.struct(url.alias("url"), F.lit("index").alias("kind"), status.alias("status"), F.lit(None).cast("string").alias("source_type"), tier.alias("tier"), lang.alias("language"), F.lit(None).cast("boolean").alias("authored_by_subject"), F.lit(None).cast("string").alias("date"))
    k = F.col("s_suppkey")
    url = lambda x: F.concat(F.lit(f"https://{x}.example/"), k.cast("string"))
    none = F.lit(None).cast("string")
    return view(s, d, "supplier").select(
        F.concat(F.lit("p"), k.cast("string")).alias("person_id"), F.when(k % 2 == 0, 2).alias("tier"), F.when(k % 3 == 0, "fr").alias("language"),
        F.lit(None).cast("boolean").alias("authored_by_subject"),
        F.array(
            seed(url("a"), F.when(k % 5 == 0, "dead"), F.lit(None).cast("int"), none), seed(url("b"), none, F.lit(3), F.lit("de"))
        ).alias("seeds"),
    )


def _transcript(body: str) -> str:
    """Lines, labels of at least two, and turns in SQL."""
    return with_sql(body, "t_transcript", more=r"""
        raw as (select conv_id doc, turn ord, unnest(string_split(body, chr(10))) line, generate_subscripts(string_split(body, chr(10)), 1) pos from t_transcript),
        ln as (select doc, ord, pos, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') line from raw where trim(line) <> ''),
        lb as (select *, regexp_replace(line, '\s+\(?\d{1,2}:\d{2}(:\d{2})?\)?$', '') label from ln),
        lc as (select doc, label, count(*) n from lb where length(label) > 3 and length(label) < 40 and length(label) - length(replace(label, ' ', '')) <= 3 and regexp_matches(line, '^\p{Lu}') and not regexp_matches(label, '[.?!:]$') and not regexp_matches(line, '^\(?\d{1,2}:\d{2}') group by 1, 2 having count(*) >= 2),
        tn as (select l.*, c.label is not null is_label, last_value(c.label ignore nulls) over (partition by l.doc order by ord, pos rows between unbounded preceding and current row) speaker from lb l left join lc c using (doc, label)),
        sp as (select * from tn where not is_label)""")


ORACLE = {
    "prj2_effective_date": with_sql(
        "select doc_id, case when doc_id % 2 = 0 then date '2020-02-02' else publication_date end d from t_docs", "t_docs"
    ),
    "dat6_year_fallback": r"select doc_id, case when doc_id % 3 = 0 then date '2022-01-01' when (doc_id % 1000 + 1500) between 2000 and 2029 then make_date(cast(doc_id % 1000 + 1500 as int), 7, 1) when regexp_extract(substr(concat('in ', doc_id % 1000 + 1500, ' ', text), 1, 400), '\b(20[0-2][0-9])\b', 1) <> '' then make_date(cast(regexp_extract(substr(concat('in ', doc_id % 1000 + 1500, ' ', text), 1, 400), '\b(20[0-2][0-9])\b', 1) as int), 7, 1) end d from documents",
    "str5_visible_text": f"select page_id, md5({VISIBLE}) md5 from pages",
    "str6_sentences": f"select doc_id, cast(k - 1 as integer) place, sentence from (select doc_id, unnest(s) sentence, generate_subscripts(s, 1) k from (select doc_id, {SENTENCES} s from documents))",
    "str7_axis_tags": r"select doc_id, concat(case when regexp_matches(text, '(?i)\bthe\b') then 'X' else '' end, case when regexp_matches(text, '(?i)tion\b') then 'Y' else '' end, case when regexp_matches(text, '(?i)eau') then 'Z' else '' end) axes from documents",
    "str10_hosts": "select split_part(url, '/', 3) host, count(*) items from pages group by 1",
    "src7_hashed_pages": "select page_id, sha256(html) content_hash, substr(sha256(html), 1, 2) shard from pages",
    "fil6_long_enough": r"select doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 120 keep from documents",
    "src6_replayed_log": with_sql("select canonical_url, status, seq from lg", "t_fetchlog", more=LOG),
    "job9_verified_events": with_sql(f"""select timeline_id, count(case when o = 'live' then 1 end) live, count(case when o = 'blocked' then 1 end) blocked, count(case when o in ('dead', 'unreachable') then 1 end) dead, count(case when o = 'live' then 1 end) >= 1 and count(case when o in ('live', 'blocked') then 1 end) >= 2 verified,
        coalesce(array_to_string(list_sort(list(distinct source) filter (where o in ('dead', 'unreachable'))), ' '), '') dead_sources from (select timeline_id, source, {OUTCOME} o from t_eventsrc left join ok on source = canonical_url) group by 1""", "t_fetchlog", "t_eventsrc", more=LOG),
    "agg23_host_totals": with_sql("select count(*) items, count(distinct split_part(canonical_url, '/', 3)) hosts from t_fetchlog", "t_fetchlog"),
    "agg24_reachability": with_sql(
        "select count(case when live then 1 end) reachable, count(*) total, round_even(coalesce(sum(case when live then bytes end), 0.0), 2) bytes from t_eventsrc left join ok on source = canonical_url",
        "t_fetchlog", "t_eventsrc", more=LOG
    ),
    "fil7_timeline": "select event_id, concat('a ', event_type, ' b') summary from events where event_id % 2 = 0",
    "fil8_categories": "select event_type category, count(*) n from events where event_type in ('purchase', 'error') group by 1",
    "fil9_kinds": with_sql("select person_id from t_people where coalesce(entity_kind, 'person') = 'person'", "t_people"),
    "fil9_portrayed": with_sql("select person_id from t_people where coalesce(entity_kind, 'person') <> 'public'", "t_people"),
    "fil10_licences": "select p_partkey, p_size % 5 in (0, 2) usable from part",
    "fil11_live_seeds": "select concat('p', s_suppkey) person_id, 0 place, concat('https://a.example/', s_suppkey) url, case when s_suppkey % 2 = 0 then 2 else 1 end tier, case when s_suppkey % 3 = 0 then 'fr' else 'en' end \"language\" from supplier where s_suppkey % 5 <> 0 union all select concat('p', s_suppkey), 1, concat('https://b.example/', s_suppkey), 3, 'de' from supplier",
    "fil16_events_of_month": "select event_id, cast(ts as date) d from events where strftime(ts, '%Y-%m') = '2024-01' order by cast(ts as date), event_id limit 2",
    "str13_speaker_labels": _transcript("select doc, label, n from lc"),
    "win6_turns": _transcript("select doc, speaker, count(*) n from sp group by 1, 2"),
    "str15_first_usable": "select l_orderkey episode, l_linenumber ord, cast(l_quantity * 10 as int) words from lineitem where cast(l_quantity * 10 as int) >= 400 qualify row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) = 1",
    "j7_episode_guests": "select o_orderkey episode, concat('p', o_custkey) person_id from orders where o_orderkey % 3 <> 2 and o_custkey in (select c_custkey from customer)",
    "win9_first_per_person": "select person_id, episode from (select concat('p', o_custkey) person_id, o_orderkey episode, row_number() over (partition by o_custkey order by o_orderkey) n from orders) where n <= 8",
    "job6_backlog": with_sql("select * from e where canonical_url not in (select canonical_url from dd) and not exists (select 1 from dd where dd.person_id = e.person_id and dd.publication_date = e.d and (collector like 'podcasts%' or collector like 'audio%'))", "t_docs", more="""
        dd as (select * from t_docs where date_source = 'rss'), e as (select concat('p', o_custkey) person_id, cast(date_trunc('month', o_orderdate + interval '276' month) as date) d, concat('https://h', o_custkey % 20, '.example/a/', o_orderkey % 900) canonical_url, o_orderkey pos from orders)"""),
    "prj1_flat_rows": with_sql(
        "select doc_id, strftime(publication_date, '%Y-%m-%d') publication_date, concat('[\"', collector, '\",\"', title, '\"]') tags from t_docs",
        "t_docs"
    ),
    "job5_guest_speech": _transcript(Q.GUEST_SPEECH + "select doc, label, md5(speech) md5, words from said"),
    "job5_podcast_documents": _transcript(Q.GUEST_SPEECH + Q.PODCASTS),
    "str8_passages": Q.passages(SQL_TERMS, "text", "select doc_id, place, axes, md5(passage) md5 from passage", SENTENCES),
    "str8_passages_default_terms": Q.passages(
        X.AXIS_TERMS, "concat('We should pause. Scaling laws hold. Nothing here. ', text)", "select axes, count(*) n from passage group by 1",
        SENTENCES
    ),
    "str9_canonical_urls": f"select page_id, {Q.canonical(Q.TRACKED_URL)} url from pages",
    "str9_encoded_names": f"select page_id, {Q.canonical(Q.ENCODED_URL)} url from pages",
    "str11_article_links": Q.LINKS.format(html="html") + "select page_id, coalesce(string_agg(u, ' ' order by k), '') links from pages left join first_ using (page_id) group by 1",
    "win10_first_links": Q.LINKS.format(html="replace(html, 'href=\"/', 'href=\"/a/')") + Q.FIRST_LINKS,
    "str12_feed_candidates": Q.FEEDS,
    "j3_feed_dates": with_sql("select page_id, feed feed_date from fed", "t_datedpages", more=Q.FED),
    "dat4_page_dates": with_sql(
        "select page_id, d, \"precision\", date_source, date_confidence, date_note from dated", "t_datedpages", more=Q.dated(VISIBLE, AS_OF)
    ),
    "job3_redated": with_sql(Q.REDATED, "t_datedpages", "t_docs", more=Q.dated(VISIBLE, AS_OF)),
    "job14_feed_map": with_sql(
        f"select {Q.canonical('url')} url, arg_max(d, o) d from (select url, page_id o, date '2021-01-01' + cast(page_id as int) d from t_datedpages union all select url, 1000000000 + page_id, date '2021-01-01' + cast(page_id as int) + 1000 from t_datedpages where page_id % 2 = 0) group by 1",
        "t_datedpages"
    ),
    "src5_feed_items": "select concat('p', page_id) title, url link, concat('https://a.example/', page_id, '.mp3') audio, date '2021-01-01' + cast(page_id as int) + case when page_id % 4 = 0 then 1 else 0 end d from pages",
    "k2_pages_by_two_keys": f"with recursive {Q.by_two_keys('select page_id, ' + Q.HOST + chr(32) + 'a, ' + 'string_split(url, chr(47))[5] b from pages')} select a h, b n, page_id from kept",
    "job4_documents": Q.documents(VISIBLE, Q.SEEDED),
    "dat4_structured_dates": with_sql("""select page_id, case k when 'jsonld' then cast(odate + interval 276 month as date) when 'time_tag' then cast(odate + interval 288 month as date) end d, case when k is not null then 'day' else 'quarter' end "precision",
        coalesce(k, 'none') date_source, case when k is null then 'none' else 'medium' end date_confidence from (select *, case when page_id % 3 = 0 and page_id % 12 <> 0 then 'jsonld' when page_id % 2 = 0 then 'time_tag' end k from t_markedpages)""", "t_markedpages"),
    "str3_chinese_and_other": with_sql(f"""select page_id, cast({_cjk('body')} as integer) cjk, {_words('body')} >= 120 or length(regexp_replace(body, '[^一-鿿]', '', 'g')) >= 400 long_enough,
        """ + ", ".join(f"case when {_cjk(f'substr(body, 1, {n})')} > 0 then {_cjk(f'substr(body, 1, {n})')} > 120 else {_words(f'substr(body, 1, {n})')} > 50 end too_long_{n}" for n in (60, 120, 121, 400)) + " from t_blogpages", "t_blogpages"),
    "stm1_replayed_stream": with_sql("select canonical_url, arg_max(seq, seq) seq, arg_max(status, seq) status, arg_max(fetched_at, seq) fetched_at, arg_max(bytes, seq) bytes from t_fetchlog group by 1", "t_fetchlog"),
    "stm2_inserted_stream": with_sql("select min(doc_id) doc_id, canonical_url, arg_min(person_id, doc_id) person_id, arg_min(title, doc_id) title from t_docs group by 2", "t_docs"),
    "job4_blog_posts": with_sql("""select page_id, url source_url, coalesce("date", make_date(y, 7, 1)) publication_date, case when "date" is null then 'quarter' else 'day' end date_precision,
        case when "date" is not null then 'meta' when y is not null then 'year' else '' end date_source, 'essay' source_type
        from (select *, try_cast(nullif(regexp_extract(substr(body, 1, 400), '\\b(20[0-2][0-9])\\b', 1), '') as bigint) y from (select distinct on (url) * from t_blogpages order by url, page_id))
        where len(regexp_split_to_array(trim(regexp_replace(body, '\\s+', ' ', 'g')), ' ')) >= 120""", "t_blogpages"),
    "job4_crawled": Q.documents(VISIBLE, Q.CRAWLED, ", source_type"),
}
