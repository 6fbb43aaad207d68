"""Transcripts into what the guest said, and episodes into a backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import squeezed_ends, word_count
from tidemark.functions.urls import canonical

# A time at the start of a line, and one after a speaker's name.
TIME = r"^\(?\d{1,2}:\d{2}(?::\d{2})?\)?\s*[-–—]?\s*"
TRAILING_TIME = r"\s+\(?\d{1,2}:\d{2}(?::\d{2})?\)?$"


def label(line: Column) -> Column:
    return squeezed_ends(F.regexp_replace(line, TRAILING_TIME, ""))


def may_be_label(line: Column) -> Column:
    """Short, few words, begins with a capital, ends no sentence, is no time."""
    own = label(line)
    first = F.substring(line, 1, 1)
    return (F.length(own) > 3) & (F.length(own) < 40) & (
        F.length(own) - F.length(F.replace(own, F.lit(" "), F.lit(""))) <= 3
    ) & first.rlike(r"^\p{Lu}") & ~own.rlike(r"[.?!:]$") & ~line.rlike(TIME)


def lines(texts: DataFrame) -> DataFrame:
    """``texts`` (doc, ord, body) as their lines that aren't blank: doc, ord, pos, line."""
    cut = F.posexplode(F.split("body", "\n"))
    return texts.select("doc", "ord", cut.alias("pos", "raw")).withColumn("line", squeezed_ends(F.col("raw"))).where("line <> ''").drop("raw")


def speaker_labels(rows: DataFrame, least: int = 4) -> DataFrame:
    """Labels that stand ``least`` times in a document, with how often and where first."""
    return rows.where(may_be_label(F.col("line"))).groupBy("doc", label(F.col("line")).alias("label")).agg(
        F.count("*").alias("n"), F.min(F.struct("ord", "pos")).alias("first")
    ).where(F.col("n") >= least)


def turns(rows: DataFrame, least: int = 4) -> DataFrame:
    """Each line with the speaker whose label came last; label lines go."""
    labels = speaker_labels(rows, least).select("doc", "label")
    marked = rows.withColumn("own", label(F.col("line"))).join(
        labels.withColumnRenamed("label", "own").withColumn("is_label", F.lit(True)), ["doc", "own"], "left"
    )
    spoken = F.last(F.when(F.col("is_label"), F.col("own")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("ord", "pos"))
    return marked.withColumn("speaker", spoken).where(F.col("is_label").isNull()).select("doc", "ord", "pos", "speaker", "line")


def guest_label(labels: DataFrame, guests: DataFrame) -> DataFrame:
    """The label of each document's guest (doc, guest): the whole name in any case, else one that holds the surname; the first to appear."""
    rows = labels.join(guests, "doc")
    surname = F.lower(F.element_at(F.split("guest", r"\s+"), -1))
    rank = F.when(F.lower("label") == F.lower("guest"), 0).when(F.contains(F.lower("label"), surname), 1)
    return rows.withColumn("rank", rank).where("rank is not null").groupBy("doc").agg(F.min_by("label", F.struct("rank", "first")).alias("label"))


def guest_speech(rows: DataFrame, guests: DataFrame, least: int = 4) -> DataFrame:
    """What the guest says in each document, and in how many words."""
    who = guest_label(speaker_labels(rows, least), guests)
    own = turns(rows, least).join(who, "doc").where((F.col("speaker") == F.col("label")) & ~F.col("line").rlike(TIME))
    said = own.groupBy("doc", "label").agg(F.array_sort(F.collect_list(F.struct("ord", "pos", "line"))).alias("l"))
    return said.select(
        "doc", "label", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("speech")
    ).withColumn("words", word_count(F.col("speech")))


def first_usable(candidates: DataFrame, least_words: int = 400) -> DataFrame:
    """Of each episode's candidate pages (episode, ord, words) the first with enough of the guest's words."""
    return candidates.where(F.col("words") >= least_words).groupBy("episode").agg(
        F.min(F.struct("ord", *[c for c in candidates.columns if c not in ("episode", "ord")])).alias("c")
    ).select("episode", "c.*")


# Fixed value: an episode's number before its title.
EPISODE_NUMBER = r"^#?\d+\s*[-–—:]?\s*"


def _without_number(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, EPISODE_NUMBER, "")))


def is_guest(title: Column, name: Column) -> Column:
    """The whole name stands at the beginning, or right after an episode number."""
    return F.startswith(_without_number(title), F.lower(name))


def episode_guests(episodes: DataFrame, people: DataFrame) -> DataFrame:
    """Episodes (episode, title) with the first person (person_id, display_name, ord) who is their guest.

    A guest's name begins the title, so it equals the title's beginning of its length: a title meets names by its beginnings of the lengths that names have,
    which are as many rows a title as there are different lengths up to its own, however many names share a word or a length.
    """
    head = _without_number(F.col("title"))
    names = people.select("person_id", "ord", F.lower("display_name").alias("name")).where("name <> ''")
    lengths = names.select(F.length("name").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths"))
    titles = episodes.select("episode", head.alias("head")).crossJoin(F.broadcast(lengths))
    begins = titles.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("head")))).select("episode", F.expr("substring(head, 1, n)").alias("name"))
    return begins.join(names, "name").groupBy("episode").agg(F.min_by("person_id", "ord").alias("person_id"))


def podcast_documents(entries: DataFrame, people: DataFrame, texts: DataFrame, least: int = 4, least_words: int = 400, most: int = 8) -> DataFrame:
    """Feed entries into documents of what their guests say: feed → guest → labels → first usable page → at most ``most`` for each person.

    Entries (episode, feed, pos, title, link, d), people (person_id, display_name, ord), texts (url, ord, body: a page's text). Of an episode's page
    and its ``-transcript`` sibling the first counts whose guest says ``least_words`` words.
    """
    own = entries.where("link is not null").join(
        episode_guests(entries.select("episode", "title"), people), "episode"
    ).join(people.select("person_id", "display_name"), "person_id")
    clean = F.split(canonical(F.col("link")), r"\?")[0]
    tried = own.withColumn(
        "url",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("at"), clean.alias("url")),
                F.struct(F.lit(1).alias("at"), F.concat(F.rtrim(clean, F.lit("/")), F.lit("-transcript")).alias("url"))
            )
        )
    )
    tried = tried.select("episode", "display_name", F.col("url.at").alias("at"), F.col("url.url").alias("url")).join(texts, "url")
    doc = F.concat_ws(":", F.col("episode").cast("string"), F.col("at").cast("string"))
    rows = lines(tried.select(doc.alias("doc"), "ord", "body"))
    guests = tried.select(doc.alias("doc"), F.col("display_name").alias("guest")).distinct()
    where = tried.select(doc.alias("doc"), "episode", F.col("at").alias("ord"), "url").distinct()
    said = guest_speech(rows, guests, least).join(where, "doc").select("episode", "ord", "url", "label", "speech", "words")
    usable = own.drop("display_name").join(first_usable(said, least_words).drop("ord"), "episode").where("d is not null")
    return first_per_person(usable, most).withColumn("title", F.substring("title", 1, 300)).drop("n")


def first_per_person(usable: DataFrame, most: int = 8) -> DataFrame:
    """At most ``most`` usable episodes of a person, in feed order."""
    own = Window.partitionBy("person_id").orderBy("feed", "pos")
    return usable.withColumn("n", F.row_number().over(own)).where(F.col("n") <= most)


def backlog(episodes: DataFrame, docs: DataFrame, most: int | None = None) -> DataFrame:
    """Episodes (person_id, audio_url, d, feed, pos) that are held neither by audio URL nor, from a podcast or audio collector, by person and day."""
    key = F.split(canonical(F.col("audio_url")), r"\?")[0]
    held = docs.where(
        F.col("collector").like("podcasts%") | F.col("collector").like("audio%")
    ).select("person_id", F.col("publication_date").alias("d")).distinct()
    left = episodes.withColumn("canonical_url", key).join(
        docs.select("canonical_url").distinct(), "canonical_url", "left_anti"
    ).join(held, ["person_id", "d"], "left_anti")
    return left.orderBy("feed", "pos").limit(most) if most else left
