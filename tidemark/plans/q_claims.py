"""Queries on quotes, claims and their documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import cjk_count, display_name, recovered_array, recovered_object, slug, windows
from tidemark.operators import claims as C
from tidemark.operators import dedupe, page_dates, views
from tidemark.plans.derived import view, with_sql
from tidemark.sources import tables

SCORE = "array<struct<axis:string,score:string,strength:string,confidence:string>>"


def _scores():
    """Two scores for each quote: one in the lower case with a half, no strength or none given; one of no axis."""
    axis = F.lower(F.substring(F.lit("XYZWS"), (F.col("item_id") % 5 + 1).cast("int"), F.lit(1)))
    own = F.struct(
        axis.alias("axis"), ((F.col("item_id") % 9) - 4 + 0.5).cast("string").alias("score"),
        F.when(F.col("item_id") % 3 == 0, "0").otherwise("0.9").alias("strength"), F.lit(None).cast("string").alias("confidence")
    )
    other = F.struct(F.lit("Q").alias("axis"), F.lit("1").alias("score"), F.lit("1").alias("strength"), F.lit("1").alias("confidence"))
    return F.when(F.col("item_id") % 11 == 0, F.array(other)).otherwise(F.array(own, other)).cast(SCORE)


def answers(s: SparkSession, d: str) -> DataFrame:
    """Model answers: prose around a fenced array of one item."""
    item = F.to_json(
        F.array(F.struct(F.col("quote").alias("supporting_text"), F.lit("c").alias("normalized_claim"), _scores().alias("axis_scores"), "hedged"))
    )
    return view(s, d, "t_quotes").select("doc_id", F.concat(F.lit("Here you are:\n```json\n"), item, F.lit("\n```\nDone.")).alias("response"))


def source(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "documents").select("doc_id", F.col("text").alias("document_text"), (F.col("doc_id") % 5).cast("int").alias("source_tier"))


def validated(s: SparkSession, d: str) -> DataFrame:
    return C.validated(answers(s, d), source(s, d))


def records(s: SparkSession, d: str) -> DataFrame:
    # every ninth record names a document that isn't there
    return view(s, d, "t_quotes").select(
        F.when(F.col("doc_id") % 9 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id"), "quote", "hedged",
        F.when(F.col("item_id") % 11 == 0, _scores()).otherwise(F.slice(_scores(), 1, 1)).alias("axis_scores")
    )


def docs(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "t_docs")


def _rules(s: SparkSession, d: str) -> DataFrame:
    own = view(s, d, "t_claims")
    quote = F.when(F.col("doc_id") % 5 == 0, "  ").when(F.col("doc_id") % 5 == 1, F.repeat(F.lit("word "), 51)).otherwise("said so")
    return C.refused(
        own.select(
            "claim_id", quote.alias("quote"), (F.col("score") + F.when(F.col("doc_id") % 7 == 0, 2).otherwise(0)).alias("score"),
            (F.col("tier") - 1).alias("n_sources"), (F.col("tier") + F.col("doc_id") % 3).alias("importance")
        )
    )


def _existing(s: SparkSession, d: str) -> DataFrame:
    """Claims that a store holds already: those of the hedged quotes."""
    held = view(s, d, "t_quotes").where("hedged")
    return held.select(C.claim_id(F.col("doc_id"), F.col("quote")).alias("claim_id")).distinct()


def _answer():
    """Answers with an array in a fence or in prose, with an object only, or with none."""
    item = F.col("item_id").cast("string")
    return (
        F.when(
            F.col("item_id") % 4 == 0, F.concat(F.lit('So:\n```json\n["a'), item, F.lit('", {"b": 1}]\n```\nDone [sic].'))
        ).when(F.col("item_id") % 4 == 1, F.concat(F.lit('I think ["a'), item, F.lit('"] it is.')))
        .when(F.col("item_id") % 4 == 2, F.concat(F.lit('```\n{"item": "'), item, F.lit('"}\n```'))).otherwise("No idea } or { so.")
    )


def long_answers(s: SparkSession, d: str) -> DataFrame:
    """One quote of each document, said again in other words at length."""
    own = view(s, d, "documents").select(
        "doc_id",
        F.to_json(
            F.array(F.struct(F.substring("text", 5, 80).alias("supporting_text"), F.repeat(F.concat(F.lit("claim "), F.col("doc_id").cast("string"), F.lit(" ")), 60).alias("normalized_claim"), F.array().cast(SCORE).alias("axis_scores")))
        ).alias("response")
    )
    return own


CLAIM = "id string, date string, precision string, quote string, claim string, topics array<string>, scores array<struct<axis:string,score:int,strength:double,confidence:double>>, hedged boolean, timeline_years double, reviewed boolean, extractor string, source struct<url:string,title:string,publisher:string,type:string,tier:int,language:string>"


def exported(s: SparkSession, d: str) -> DataFrame:
    """The export of claims, written as JSON lines, read back and laid flat."""
    score = F.struct("axis", "score", F.col("strength").cast("double").alias("strength"), F.col("confidence").cast("double").alias("confidence"))
    own = view(s, d, "t_claims").select(
        "person_id", "doc_id", "claim_id", "d", F.lit("day").alias("date_precision"),
        F.concat(F.lit("said \"so\" in "), "claim_id").alias("supporting_text"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("c")).alias("normalized_claim"), F.array("axis").alias("topics"), F.array(score).alias("axis_scores"),
        F.when(F.col("doc_id") % 2 == 0, F.col("score") > 0).alias("hedged"), F.lit(None).cast("double").alias("timeline_years"),
        F.lit(None).cast("boolean").alias("human_reviewed"), F.lit("m").alias("extractor_model"),
    )
    about = view(s, d, "t_docs").select(
        "doc_id", "canonical_url", "title", F.lit("h").alias("publisher"), F.col("collector").alias("source_type"), "source_tier",
        F.lit("en").alias("language"), "date_confidence"
    )
    path = tables.scratch(s, "claims")
    tables.write_nested(C.exported(own, about), path)
    rows = s.read.schema("person_id string, part int, claims array<string>").json(path).select(
        "person_id", "part", F.posexplode("claims").alias("at", "c")
    ).withColumn("place", F.col("part") * C.PER_PART + F.col("at")).withColumn("c", F.from_json("c", CLAIM))
    return rows.select(
        "person_id", "place", "c.id", "c.date", "c.precision", "c.quote", "c.claim", F.col("c.topics")[0].alias("topic"),
        F.col("c.scores")[0]["score"].alias("score"), F.bround(F.col("c.scores")[0]["strength"], 4).alias("strength"), "c.hedged", "c.timeline_years",
        "c.reviewed", "c.extractor",
        "c.source.url", "c.source.title", "c.source.publisher", "c.source.type", "c.source.tier", "c.source.language",
    )


FLAT = "regexp_replace({}, '[\\s\\x{{00a0}}]+', ' ', 'g')"
NORM = "lower(trim(regexp_replace(translate({}, '’‘“”—–' || chr(160), '''''\"\"-- '), '\\s+', ' ', 'g')))"
CHECKED = f"""
q as (select *, {NORM.format('quote')} nq, {NORM.format('document_text')} nd, regexp_replace(regexp_replace(quote, '^\\s+', ''), '\\s+$', '') cut from t_quotes),
ck as (select *, case when cut = '' or not contains(nd, nq) then 'unverbatim' when len(string_split(trim(regexp_replace(cut, '\\s+', ' ', 'g')), ' ')) > 50 then 'shape' end reason,
       case tier when 1 then 3 when 2 then 3 when 3 then 2 when 4 then 0 else 3 end cap from q),
v as (select *, case when reason is null and item_id % 11 = 0 then 'shape' else reason end final, round_even(item_id % 9 - 4 + 0.5, 0) rnd, trunc(item_id % 9 - 4 + 0.5) cutoff from ck),
sc as (select *, greatest(-cap, least(cap, rnd)) c1, greatest(-cap, least(cap, cutoff)) c2 from v)
"""
CJK = "cast(length(text) - length(regexp_replace(text, '[一-鿿぀-ヿ]', '', 'g')) as integer)"

QUERIES = {
    "arr1_scored_rows": lambda s, d: C.scored_rows(
        view(s, d, "t_claims").select(
            "claim_id",
            F.array(
                F.struct(
                    "axis", "score", F.when(F.col("doc_id") % 2 == 0, F.col("strength")).alias("strength"),
                    F.lit(None).cast("double").alias("confidence")
                )
            ).alias("axis_scores")
        )
    ),
    "str18_slugs": lambda s, d: view(s, d, "part").select("p_partkey", slug(F.concat(F.lit("("), "p_name", F.lit(") #1!"))).alias("slug")),
    "str17_display_names": lambda s, d: view(s, d, "t_models").select(
        "ord", display_name(F.col("model_version"), F.col("model_group"), F.lit("")).alias("name")
    ),
    "job1_validated_claims": lambda s, d: validated(s, d).select(
        "doc_id", "claim_id", "reject_reason", F.get("scores", 0)["axis"].alias("axis"), F.get("scores", 0)["score"].alias("score"),
        F.get("scores", 0)["strength"].alias("strength"), F.get("scores", 0)["confidence"].alias("confidence")),
    "agg11_extraction_statistics": lambda s, d: C.statistics(validated(s, d)),
    "job2_ingested_claims": lambda s, d: C.ingested(records(s, d), source(s, d)).select(
        "doc_id", "claim_id", "reject_reason", F.get("scores", 0)["score"].alias("score"), F.get("scores", 0)["strength"].alias("strength"),
        F.get("scores", 0)["confidence"].alias("confidence")
    ),
    "j14_verbatim": lambda s, d: C.with_documents(
        view(s, d, "t_quotes").select("doc_id", "item_id", "quote"), source(s, d)
    ).select("doc_id", "item_id", "reject_reason"),
    "prj3_refused_rows": lambda s, d: _rules(s, d).groupBy("reject_reason").agg(F.count("*").alias("n")),
    "str4_windows": lambda s, d: view(s, d, "documents").select("doc_id", F.explode(windows(F.col("text"))).alias("w")).select(
        "doc_id", "w.start", F.length("w.chunk").alias("n"), F.md5("w.chunk").alias("md5")
    ),
    "str2_cjk_count": lambda s, d: view(s, d, "documents").select("doc_id", cjk_count(F.col("text")).alias("n")),
    "str20_cut_claims": lambda s, d: C.validated(long_answers(s, d), source(s, d)).select("doc_id", "normalized_claim"),
    "src3_trusted_claims": lambda s, d: C.of_trusted_documents(
        view(s, d, "t_claims"), docs(s, d).select("doc_id", "date_confidence", "canonical_url")
    ).groupBy("person_id", "axis").agg(F.count("*").alias("n"), F.count_distinct("canonical_url").alias("urls")),
    "agg10_claims_by_person": lambda s, d: C.by_person(view(s, d, "t_claims")).select("person_id", "n", "axes"),
    "snk2_claims_nested": lambda s, d: exported(s, d),
    "srt3_people_by_claims": lambda s, d: C.people_by_claims(view(s, d, "t_claims")).select("person_id", "n", "axes"),
    "job1_saved_claims": lambda s, d: C.saved(validated(s, d), _existing(s, d)).select("doc_id", "claim_id"),
    "job2_saved_claims": lambda s, d: C.saved(C.ingested(records(s, d), source(s, d)), _existing(s, d)).select("doc_id", "claim_id"),
    "jsn1_recovered": lambda s, d: view(s, d, "t_quotes").select(
        "doc_id", "item_id", F.get(recovered_array(_answer()), 0).alias("first"),
        F.get_json_object(recovered_object(_answer()), "$.item").alias("item")
    ),
    "agg21_totals": lambda s, d: views.totals(view(s, d, "t_claims")),
    "src2_documents": lambda s, d: tables.documents(
        docs(s, d), trusted=True, authored=True, collector="audio"
    ).select("doc_id", "person_id", "publication_date", "source_tier"),
    "srt1_newest_documents": lambda s, d: tables.documents(docs(s, d), trusted=True, newest=20).select("doc_id", "publication_date"),
    "fil3_person_filter": lambda s, d: tables.documents(docs(s, d), person="p7").select("doc_id", "canonical_url"),
    "k2_first_by_two_keys": lambda s, d: dedupe.first_by_two_keys(
        docs(s, d).select((F.col("doc_id") % 4000).alias("hash"), "canonical_url", F.col("doc_id").alias("ord")), "hash", "canonical_url", "ord"
    ),
    "snk4_new_rows": lambda s, d: C.new_rows(
        docs(s, d).select("canonical_url", "doc_id"), docs(s, d).where("doc_id % 7 = 0").select("canonical_url").distinct(), "canonical_url", "doc_id"
    ),
    "agg8_confidence_breakdown": lambda s, d: page_dates.breakdown(docs(s, d)),
    "agg9_clustered": lambda s, d: page_dates.clustered(docs(s, d)).groupBy("date_confidence", "date_source").agg(F.count("*").alias("n")),
    "snk5_updated_dates": lambda s, d: page_dates.updated(
        docs(s, d),
        docs(s, d).where("doc_id % 2 = 0").select(
            "doc_id", F.date_add("publication_date", 3).alias("d"), F.lit("meta").alias("date_source"), F.lit("medium").alias("date_confidence")
        )
    ).select("doc_id", "publication_date", "date_source", "date_confidence"),
    "j15_person_cards": lambda s, d: views.person_cards(
        view(s, d, "t_people"), view(s, d, "t_claims").where("score > 0").withColumn("value", F.col("score")),
        view(s, d, "t_people").where("headline").select("person_id", F.lit("cc by").alias("licence")), view(s, d, "t_claims")
    ),
}

TD = "t_docs"
ORACLE = {
    "arr1_scored_rows": with_sql(
        "select claim_id, axis, score, case when doc_id % 2 = 0 then strength else 1.0 end strength, cast(1 as double) confidence from t_claims",
        "t_claims"
    ),
    "str18_slugs": "select p_partkey, trim(regexp_replace(lower(concat('(', p_name, ') #1!')), '[^a-z0-9]+', '-', 'g'), '-') slug from part",
    "str17_display_names": with_sql(
        "select ord, case when model_group <> '' then model_group else regexp_replace(model_version, '_high$', '') end \"name\" from t_models",
        "t_models"
    ),
    "job1_validated_claims": with_sql("""select doc_id, case when final is null then substr(sha1(concat(doc_id, '|', nq)), 1, 24) end claim_id, final reject_reason, case when item_id % 11 <> 0 then substr('XYZWS', cast(item_id % 5 + 1 as int), 1) end axis,
        cast(case when item_id % 11 <> 0 then case when hedged then greatest(-1, least(1, c1)) else c1 end end as integer) score, cast(case when item_id % 11 <> 0 then case when item_id % 3 = 0 then 0.7 else 0.9 end end as double) strength, cast(case when item_id % 11 <> 0 then 0.7 end as double) confidence from sc""", "t_quotes", more=CHECKED),
    "agg11_extraction_statistics": with_sql(
        "select count(*) returned, count(case when final = 'unverbatim' then 1 end) rejected_unverbatim, count(case when final = 'shape' then 1 end) rejected_shape, count(case when final is null then 1 end) kept, round_even(100.0 * count(case when final = 'unverbatim' then 1 end) / count(*), 1) unverbatim_percent from sc",
        "t_quotes", more=CHECKED
    ),
    "job2_ingested_claims": with_sql("""select case when doc_id % 9 = 0 then -doc_id - 1 else doc_id end doc_id, case when doc_id % 9 <> 0 and reason is null and item_id % 11 <> 0 then substr(sha1(concat(doc_id, '|', nq)), 1, 24) end claim_id,
        case when doc_id % 9 = 0 then 'unknown document' when reason is not null then reason when item_id % 11 = 0 then 'bad score' end reject_reason, cast(case when item_id % 11 <> 0 then case when hedged then greatest(-1, least(1, k)) else k end end as integer) score,
        cast(case when item_id % 11 <> 0 then case when item_id % 3 = 0 then 0.0 else 0.9 end end as double) strength, cast(case when item_id % 11 <> 0 then 0.8 end as double) confidence from (select *, case when doc_id % 9 = 0 then greatest(-3, least(3, cutoff)) else c2 end k from sc)""", "t_quotes", more=CHECKED),
    "j14_verbatim": with_sql("select doc_id, item_id, reason reject_reason from ck", "t_quotes", more=CHECKED),
    "prj3_refused_rows": with_sql("""select case when doc_id % 5 = 0 then 'no quote' when doc_id % 5 = 1 then 'quote too long' when not (score + case when doc_id % 7 = 0 then 2 else 0 end between -3 and 3) then 'score out of range' when tier - 1 < 2 then 'too few sources'
        when not (tier + doc_id % 3 between 1 and 5) then 'importance out of range' end reject_reason, count(*) n from t_claims group by 1""", "t_claims"),
    "str4_windows": """select doc_id, cast(i as integer) "start", cast(length(c) as integer) n, md5(c) md5 from (select doc_id, i, substr(text, i + 1, 5000) c from documents, unnest(generate_series(0, greatest(1, length(text)) - 1, 4500)) u(i)) where len(list_filter(regexp_split_to_array(c, '\\s+'), lambda x: x <> '')) > 60""",
    "str2_cjk_count": f"select doc_id, {CJK} n from documents",
    "src3_trusted_claims": with_sql(
        "select c.person_id, axis, count(*) n, count(distinct canonical_url) urls from t_claims c join t_docs d using (doc_id) where date_confidence in ('high', 'medium') group by 1, 2",
        "t_claims", TD
    ),
    "agg10_claims_by_person": with_sql(
        "select person_id, count(*) n, array_to_string(list_sort(list_distinct(list(axis))), '') axes from t_claims group by 1", "t_claims"
    ),
    "agg21_totals": with_sql("select count(*) claims, count(distinct person_id) people from t_claims", "t_claims"),
    "src2_documents": with_sql(
        "select doc_id, person_id, publication_date, source_tier from t_docs where date_confidence in ('high', 'medium') and authored_by_subject and collector like 'audio%'",
        TD
    ),
    "srt1_newest_documents": with_sql(
        "select doc_id, publication_date from t_docs where date_confidence in ('high', 'medium') order by publication_date desc, doc_id limit 20", TD
    ),
    "fil3_person_filter": with_sql("select doc_id, canonical_url from t_docs where person_id = 'p7'", TD),
    "snk4_new_rows": with_sql(
        "select canonical_url, min(doc_id) doc_id from t_docs where canonical_url not in (select canonical_url from t_docs where doc_id % 7 = 0) group by 1",
        TD
    ),
    "agg8_confidence_breakdown": with_sql("select date_confidence, date_source, count(*) n from t_docs group by 1, 2", TD),
    "agg9_clustered": with_sql(
        "select case when coalesce(date_source, '') <> 'url' and n >= 4 then 'low' else date_confidence end date_confidence, date_source, count(*) n from (select *, count(case when coalesce(date_source, '') <> 'url' then 1 end) over (partition by split_part(canonical_url, '/', 3), publication_date) n from t_docs) group by 1, 2",
        TD
    ),
    "snk5_updated_dates": with_sql(
        "select doc_id, case when f then publication_date + 3 else publication_date end publication_date, case when f then 'meta' else date_source end date_source, case when f then 'medium' else date_confidence end date_confidence from (select *, doc_id % 2 = 0 and coalesce(date_source, '') not in ('rss', 'seed') f from t_docs)",
        TD
    ),
    "j15_person_cards": with_sql(
        "select person_id, display_name, coalesce(np, 0) n_positions, case when headline then 'cc by' end licence, coalesce(nc, 0) n_claims from t_people left join (select person_id, count(case when score > 0 then 1 end) np, count(*) nc from t_claims group by 1) using (person_id)",
        "t_claims", "t_people"
    ),
    "snk2_claims_nested": with_sql("""select person_id, cast(row_number() over (partition by person_id order by d desc, claim_id) - 1 as integer) place, claim_id id, strftime(d, '%Y-%m-%d') "date", 'day' "precision", concat('said "so" in ', claim_id) quote, case when doc_id % 3 = 0 then 'c' end claim,
        axis topic, score, round_even(cast(strength as double), 4) strength, coalesce(doc_id % 2 = 0 and score > 0, false) hedged, cast(null as double) timeline_years, false reviewed, 'm' extractor, canonical_url url, title, 'h' publisher, collector "type", source_tier tier, 'en' "language"
        from t_claims c join (select doc_id, canonical_url, title, collector, source_tier, date_confidence from t_docs) t using (doc_id) where date_confidence in ('high', 'medium')""", "t_claims", TD),
    "srt3_people_by_claims": with_sql(
        "select person_id, count(*) n, array_to_string(list_sort(list_distinct(list(axis))), '') axes from t_claims group by 1 order by n desc, person_id",
        "t_claims"
    ),
    "job1_saved_claims": with_sql(
        "select distinct doc_id, substr(sha1(concat(doc_id, '|', nq)), 1, 24) claim_id from sc where final is null and not hedged", "t_quotes",
        more=CHECKED
    ),
    "job2_saved_claims": with_sql(
        "select distinct doc_id, substr(sha1(concat(doc_id, '|', nq)), 1, 24) claim_id from sc where doc_id % 9 <> 0 and reason is null and item_id % 11 <> 0 and not hedged",
        "t_quotes", more=CHECKED
    ),
    "jsn1_recovered": with_sql(
        "select doc_id, item_id, case when item_id % 4 < 2 then concat('a', item_id) end \"first\", case when item_id % 4 = 2 then cast(item_id as varchar) end item from t_quotes",
        "t_quotes"
    ),
    "str20_cut_claims": "select doc_id, substr(repeat(concat('claim ', doc_id, ' '), 60), 1, 400) normalized_claim from documents",
}
