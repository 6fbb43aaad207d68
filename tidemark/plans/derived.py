"""Tables in the shapes the operators take, derived by SQL from the given tables.

The same text runs on Spark and on DuckDB, so each query's oracle begins with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations")

#: A month's name, of an order's date and so much.
_MONTH = "rtrim(substr('January   February  March     April     May       June      July      August    September October   November  December  ', cast(month(cast(o.o_orderdate + {} as date)) as int) * 10 - 9, 10))"

SQL: dict[str, str] = {
    # claims: one document has one person, one date, one tier
    "t_claims": """
        select concat('p', cast(o_custkey as string)) person_id, substr('XYZWS', cast(l_linenumber % 5 as int) + 1, 1) axis,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) claim_id, l_orderkey doc_id,
               cast(o_orderdate + interval '276' month as date) d, cast(l_quantity as int) % 7 - 3 score, 1 - l_discount strength, 1 - l_tax confidence,
               cast(substr(o_orderpriority, 1, 1) as int) tier
        from lineitem join orders on l_orderkey = o_orderkey""",
    "t_people": """
        select concat('p', cast(c_custkey as string)) person_id, c_name display_name, c_mktsegment role, c_custkey % 3 = 0 headline,
               case when c_custkey % 10 = 0 then 'policy' when c_custkey % 10 = 1 then 'public' when c_custkey % 10 = 2 then null else 'person' end entity_kind,
               case when c_custkey % 10 = 0 then 'XY' when c_custkey % 10 = 1 then 'YWZ' else 'XYZWS' end axes
        from customer""",
    "t_docs": """
        select o_orderkey doc_id, concat('p', cast(o_custkey as string)) person_id, concat('https://h', cast(o_custkey % 20 as string), '.example/a/', cast(o_orderkey % 900 as string)) canonical_url,
               cast(date_trunc('month', o_orderdate) + interval '276' month as date) publication_date,
               case o_orderkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'none' end date_confidence,
               case o_orderkey % 5 when 0 then 'rss' when 1 then 'seed' when 2 then 'url' when 3 then 'meta' else null end date_source,
               o_orderkey % 3 <> 0 authored_by_subject, case o_orderkey % 3 when 0 then 'podcasts_v1' when 1 then 'audio_v1' else 'crawl_v1' end collector,
               cast(substr(o_orderpriority, 1, 1) as int) source_tier, o_orderpriority title
        from orders""",
    "t_scores": """
        select p_brand benchmark, concat(p_name, case when l_linenumber % 2 = 0 then '_high' else '_low' end) model_version, concat(s_name, ', ', n_name) organization,
               cast(o_orderdate + interval '276' month as date) d, l_quantity / 50.0 * case when p_size % 2 = 0 then 100 else 1 end raw,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string)) ord
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    # benchmark specs: whether the spec names a file, chance baseline and ceiling
    "t_specs": "select p_brand benchmark, max(p_size) % 3 <> 0 has_file, min(p_size) / 200.0 baseline, 0.75 ceiling from part group by p_brand",
    "t_models": "select distinct concat(p_name, '_high') model_version, case when p_size % 4 = 0 then p_type else '' end model_group, case when p_size % 3 = 0 then 'Open weights (free)' when p_size % 3 = 1 then 'API access' else '' end accessibility, p_partkey ord from part",
    "t_labs": "select lower(n_name) match, concat('lab', cast(n_regionkey as string)) lab from nation where n_nationkey % 2 = 0",
    "t_releases": """
        select o_orderkey ord, concat('m', cast(o_custkey % 97 as string)) model, n_name organization, cast(o_orderdate + interval '276' month as date) d, concat(c_mktsegment, ', ', o_orderpriority, ' ,') domain,
               o_totalprice params, case o_orderkey % 4 when 0 then 'Checked' when 1 then ' true ' when 2 then '' else 'no' end frontier, case o_orderkey % 3 when 0 then 'https://x.example/' else 'see notes' end link
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "t_fetchlog": """
        select event_id seq, concat('https://h', cast(user_id % 20 as string), '.example/', cast(event_id % 500 as string)) canonical_url,
               case event_type when 'error' then 404 when 'signup' then 403 when 'view' then 500 else 200 end status, ts fetched_at, value bytes from events""",
    "t_eventsrc": """
        select r.event_id timeline_id, concat('https://h', cast(r.user_id % 20 as string), '.example/', cast((r.event_id + s.i * 7) % 500 as string)) source
        from events r cross join (select 0 i union all select 1 union all select 2) s where r.event_type = 'purchase'""",
    # blog pages of one paragraph, none like another: every seventh in Chinese, every third with a date, every fifth beginning with a year
    "t_blogpages": """
        select page_id, url, body, concat('<html><p id="', cast(page_id as string), '">', body, '</p></html>') html, case when page_id % 3 = 0 then cast('2021-05-01' as date) end date
        from (select doc_id page_id, concat('https://blog', cast(doc_id % 20 as string), '.example/posts/', cast(doc_id as string)) url,
              case when doc_id % 7 = 0 then repeat('\u6587\u7ae0', 300) else concat(case when doc_id % 5 = 0 then concat('in ', cast(2010 + doc_id % 12 as string), ' ') else '' end, translate(text, '<>&', '   ')) end body
              from documents where text is not null) d""",
    "t_quotes": """
        select d.doc_id, b.item_id, case when d.doc_id % 2 = 0 then substr(d.text, 5, 80) else b.text end quote, d.text document_text, cast(d.doc_id % 5 as int) tier, d.doc_id % 7 = 0 hedged
        from documents d join benchmark b on d.doc_id % 40 = b.item_id % 40""",
    # pages that say a date in a meta tag, some in their URL, and some in a line of text: near the meta tag's, far off, or a month only
    "t_datedpages": f"""
        select p.page_id, concat(p.url, case when p.page_id % 3 = 0 then concat('/', cast(year(o.o_orderdate) + 23 as string), '/05/17/') else '' end) url,
               concat('<meta property="article:published_time" content="', cast(cast(o.o_orderdate + interval '276' month as date) as string), '">',
                      case p.page_id % 5 when 1 then concat('<p>Posted ', {_MONTH.format("interval '276' month + interval '20' day")}, ' ', cast(day(cast(o.o_orderdate + interval '276' month + interval '20' day as date)) as string), ', ', cast(year(cast(o.o_orderdate + interval '276' month + interval '20' day as date)) as string), '</p>')
                                         when 2 then concat('<p>Posted ', {_MONTH.format("interval '300' month")}, ' 3, ', cast(year(o.o_orderdate) + 25 as string), '</p>')
                                         when 3 then concat('<p>', {_MONTH.format("interval '276' month")}, ' ', cast(year(o.o_orderdate) + 23 as string), '</p>') else '' end, p.html) html
        from pages p join orders o on p.page_id = o.o_orderkey""",
    # pages that say their date as structured data: every third in JSON-LD (of these each fourth one that can't be read), every second in a time tag
    "t_markedpages": """
        select p.page_id, p.url, o.o_orderdate odate, concat(
                 case when p.page_id % 12 = 0 then '<script type="application/ld+json">{"@type": "Article", "datePublished": "soon after"}</script>'
                      when p.page_id % 3 = 0 then concat('<script type="application/ld+json">{"datePublished": "', cast(cast(o.o_orderdate + interval '276' month as date) as string), 'T08:00:00Z"}</script>') else '' end,
                 case when p.page_id % 2 = 0 then concat('<time class="t" datetime="', cast(cast(o.o_orderdate + interval '288' month as date) as string), ' 10:30">then</time>') else '' end, p.html) html
        from pages p join orders o on p.page_id = o.o_orderkey""",
    # transcript lines: a label line before each turn's lines
    "t_transcript": "select conv_id, turn, concat(upper(substr(role, 1, 1)), substr(role, 2), case when turn % 2 = 0 then ' 00:01:07' else '' end, chr(10), text) body from conversations where text is not null and role is not null",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for base in BASE:
        if re.search(rf"\b{base}\b", SQL[name]):
            spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(SQL[name])


def with_sql(body: str, *names: str, more: str = "") -> str:
    """An oracle: the derived tables as common table expressions, then ``body``."""
    parts = [f"{n} as ({SQL[n]})" for n in names] + ([more] if more else [])
    return f"with {', '.join(parts)} {body}" if parts else body
