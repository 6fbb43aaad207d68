"""Parts of the oracles of queries on pages: URLs, links, dates, passages, documents."""

from __future__ import annotations

from tidemark.functions.urls import FEED_PATHS, SKIPPED, TRACKING
from tidemark.operators.page_dates import ISO_DAY, META, MONTH_YEAR, URL_DATE

HOST = "split_part(url, '/', 3)"
ROOT = "array_to_string(string_split(url, '/')[1:3], '/')"
TRACKED_URL = "concat(url, case when contains(url, '?') then '&utm_campaign=z&blank=' else '?utm_x=1' end)"
#: Parameters whose names are percent-encoded, some of which track.
ENCODED = "utm%5Fsource=a&%67clid=b&q%2Dr=%C3%A9&ref%5Furl=c&s=50%25"
ENCODED_URL = f"concat(url, case when contains(url, '?') then '&' else '?' end, '{ENCODED}')"


def canonical(u: str) -> str:
    bare = f"split_part({u}, '#', 1)"
    path = f"regexp_replace(split_part({bare}, '?', 1), ';[^/]*$', '')"
    base = rf"regexp_extract({path}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1)"
    rest = f"rtrim(substr({path}, length({base}) + 1), '/')"
    kept = f"contains(x, '=') and regexp_replace(x, '^[^=]*=', '') <> '' and not regexp_matches(lower(url_decode(split_part(x, '=', 1))), '^({'|'.join(TRACKING)})')"
    pairs = rf"list_filter(string_split(regexp_replace({bare}, '^[^?]*\?', ''), '&'), lambda x: {kept})"
    again = f"list_transform({pairs}, lambda x: concat(url_encode(url_decode(split_part(x, '=', 1))), '=', url_encode(url_decode(regexp_replace(x, '^[^=]*=', '')))))"
    query = f"case when contains({bare}, '?') and len({pairs}) > 0 then concat('?', array_to_string({again}, '&')) else '' end"
    return f"concat(lower(regexp_extract({base}, '^([^:]*)', 1)), regexp_extract({base}, '^[^:]*(:.*)$', 1), case when {rest} = '' then '/' else {rest} end, {query})"


_SKIPPED = SKIPPED.replace("'", "''").replace("{", "{{").replace("}", "}}")
#: Links of pages in order, each URL once; the test pages' links are paths.
LINKS = f"""with h as (select page_id, url, unnest(regexp_extract_all({{html}}, '(?i)href=["'']([^"'']+)["'']', 1)) h, generate_subscripts(regexp_extract_all({{html}}, '(?i)href=["'']([^"'']+)["'']', 1), 1) k from pages),
l as (select page_id, k, {canonical(f"concat({ROOT}, h)")} u, url from h where not starts_with(h, '#') and not regexp_matches(h, '{_SKIPPED}')),
first_ as (select page_id, u, min(k) k from l where rtrim(u, '/') <> rtrim(url, '/') group by 1, 2)
"""
FIRST_LINKS = ", r as (select page_id, u, row_number() over (partition by page_id order by k) - 1 place from first_) select arg_min(page_id, page_id * 1000 + place) page_id, cast(min(page_id * 1000 + place) % 1000 as integer) place, u url from r where place < 40 group by u"
FEEDS = f"select page_id, concat_ws(' ', concat({ROOT}, '/own.xml'), {', '.join(f'concat({ROOT}, {chr(39)}{p}{chr(39)})' for p in FEED_PATHS)}) feeds from pages"
FED = f"""cu as (select *, {canonical("url")} cu from t_datedpages), fd as (select distinct cu from cu where page_id % 10 = 0),
fed as (select cu.*, case when fd.cu is not null then date '2021-03-04' end feed from cu left join fd using (cu))"""


def _words(text: str) -> str:
    """A date in words as a struct of day and precision."""
    part = [f"regexp_extract({text}, '{MONTH_YEAR}', {k})" for k in range(4)]
    day = f"case when {part[2]} = '' then '1' else regexp_extract({part[2]}, '([0-9]+)', 1) end"
    return f"case when {part[0]} <> '' then {{'d': cast(try_strptime(concat({part[1]}, ' ', {day}, ', ', {part[3]}), '%B %d, %Y') as date), 'p': case when {part[2]} = '' then 'month' else 'day' end}} end"


def dated(visible: str, as_of: str) -> str:
    url = [f"regexp_extract(url, '{URL_DATE}', {k})" for k in range(4)]
    meta = META.replace("'", "''")
    one = "{{'rank': {}, 'd': {}, 'p': {}, 's': '{}'}}".format
    listed = [
        one(0, "feed", "'day'", "feed"),
        one(
            1,
            f"case when {url[1]} <> '' then try_cast(concat({url[1]}, '-', lpad({url[2]}, 2, '0'), '-', case when {url[3]} = '' then '01' else lpad({url[3]}, 2, '0') end) as date) end",
            f"case when {url[3]} = '' then 'month' else 'day' end", "url"
        ),
        one(
            2, f"case when wl is not null then wl.d else try_cast(regexp_extract(substr(txt, 1, 700), '{ISO_DAY}', 1) as date) end",
            "coalesce(wl.p, 'day')", "dateline"
        ),
        one(5, f"try_cast(regexp_extract(html, '{meta}', 1) as date)", "'day'", "meta"),
        one(6, "wb.d", "wb.p", "body"),
    ]
    return f"""{FED},
tx as (select *, {visible} txt from fed),
wd as (select *, {_words("substr(txt, 1, 700)")} wl, {_words("substr(txt, 1, 6000)")} wb from tx),
cand as (select page_id, c, case when c.s in ('dateline', 'body') then 't' else 's' end fam from (select page_id, unnest([{", ".join(listed)}]) c from wd) where c.d is not null),
best as (select page_id, arg_min(c, c.rank) b, arg_min(fam, c.rank) bf from cand group by 1),
other as (select page_id, min(gap) gap, arg_min(c.s, gap * 10 + c.rank) src, arg_min(c, c.rank) o from (select *, abs(date_diff('day', b.d, c.d)) gap from cand join best using (page_id) where fam <> bf) group by 1),
j as (select wd.page_id, b, gap, src, o, case when b.p = 'month' then cast(date_trunc('month', b.d) as date) else b.d end d, case b.rank when 0 then 'high' when 1 then 'high' when 2 then 'high' when 6 then 'low' else 'medium' end base,
      case when gap <= 45 then concat('corroborated by ', src) when gap > 400 then concat('conflicts with ', o.s, ' (', o.d, ') by ', gap, 'd') else '' end note from wd left join best using (page_id) left join other using (page_id)),
k as (select *, coalesce(date_trunc('month', d) = date_trunc('month', date '{as_of}') and not coalesce(gap <= 45, false) and b.s not in ('url', 'feed'), false) fu from j),
dated as (select page_id, d, coalesce(b.p, 'quarter') "precision", coalesce(b.s, 'none') date_source, case when b is null then 'none' when fu then 'low' when gap <= 45 then 'high' when gap > 400 and base = 'high' then 'low' else base end date_confidence,
      case when fu then concat(note, case when note = '' then '' else '; ' end, 'resolves to current month, likely site furniture') else note end date_note from k)"""


REDATED = f"""
, al as (select t.page_id, {canonical("t.url")} cu, t.url, case when o.date_source in ('rss', 'seed') then o.publication_date else g.d end d, case when o.date_source in ('rss', 'seed') then o.date_source else g.date_source end date_source,
        case when o.date_source in ('rss', 'seed') then o.date_confidence else g.date_confidence end date_confidence from t_datedpages t join t_docs o on o.doc_id = t.page_id join dated g on g.page_id = t.page_id)
select case when d is not null and date_source is distinct from 'url' and n >= 4 then 'low' else date_confidence end date_confidence, date_source, count(*) n
from (select *, count(case when date_source is distinct from 'url' then 1 end) over (partition by split_part(url, '/', 3), d) n from al) group by 1, 2"""


def passages(terms: dict[str, str], text: str, body: str, sentences: str) -> str:
    """Sentences with a tag; of a run of neighbours every second counts, with one sentence either side, 40 in a document."""
    tags = ", ".join(f"case when regexp_matches(s, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{a}' else '' end" for a, p in terms.items())
    return f"""with d as (select doc_id, {text} as text from documents), sn as (select doc_id, {sentences} l from d),
t as (select doc_id, l, i, concat({tags}) axes from (select doc_id, l, unnest(l) s, generate_subscripts(l, 1) i from sn)),
g as (select *, i - row_number() over (partition by doc_id order by i) run from t where axes <> ''),
r as (select *, row_number() over (partition by doc_id, run order by i) nth from g),
p as (select *, row_number() over (partition by doc_id order by i) - 1 place from r where nth % 2 = 1),
passage as (select doc_id, cast(place as integer) place, axes, array_to_string(l[greatest(1, i - 1):i + 1], ' ') passage from p where place < 40) {body}"""


#: What guests say: the label that is the guest's name or holds the last part of it, first of whole names, then of its place.
GUEST_SPEECH = r"""
, gs as (select distinct conv_id doc, case when conv_id % 2 = 0 then 'assistant' else 'The User' end guest from conversations),
fl as (select doc, label, min(ord * 100000 + pos) spot from lb join (select distinct doc, label from lc) using (doc, label) group by 1, 2),
gl as (select doc, arg_min(label, case when lower(label) = lower(guest) then 0 else 1 end * 1000000000000 + spot) label from fl join gs using (doc) where contains(lower(label), lower(regexp_extract(guest, '(\S+)$', 1))) group by 1),
said as (select doc, sp.speaker as label, string_agg(line, chr(10) order by ord, pos) speech, cast(sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''))) as integer) words
         from sp join gl on gl.doc = sp.doc and gl.label = sp.speaker where not regexp_matches(line, '^\(?\d{1,2}:\d{2}(?::\d{2})?\)?\s*[-–—]?\s*') group by sp.doc, sp.speaker)
""".replace("sp join gl on gl.doc = sp.doc", "(select doc as d0, ord, pos, speaker, line from sp) sp join gl on gl.doc = sp.d0").replace("select doc, sp.speaker as label", "select sp.d0 as doc, sp.speaker as label").replace("group by sp.doc", "group by sp.d0")
PODCASTS = """
, us as (select doc episode, case when guest = 'assistant' then 'p-assistant' else 'p-the-user' end person_id, concat('https://casts.example/c/', doc, case when doc % 3 = 0 then '-transcript' else '' end) url, label, md5(speech) md5, words, date '2020-01-01' + cast(doc % 1000 as integer) d
         from said join gs using (doc) where words >= 40)
select * from us qualify row_number() over (partition by person_id order by episode) <= 8"""


def by_two_keys(rows: str) -> str:
    """``rows`` (page_id, a, b) inserted in order, those that break a key ignored: as ``kept``. Goes after ``with recursive``."""
    return f"""src as ({rows}), num as (select *, row_number() over (order by page_id) i from src),
ins as (select cast(0 as bigint) i, [cast('' as varchar)] as ha, [cast('' as varchar)] as hb, cast(null as bigint) as page_id
        union all select num.i, case when ok then list_append(ha, a) else ha end, case when ok then list_append(hb, b) else hb end, case when ok then num.page_id end
        from (select ins.*, num.i as ni, not list_contains(ha, num.a) and not list_contains(hb, num.b) ok from ins join num on num.i = ins.i + 1) r join num on num.i = r.ni),
kept as (select num.* from num join ins on ins.page_id = num.page_id)"""


#: Pages of seeded hosts, as rows (page_id, url, html, person_id, date).
SEEDED = f"""hs as (select {HOST} h, min(page_id) k from pages group by 1), want as (select p.page_id, p.url, p.html, concat('p', k) person_id, case when k % 2 = 0 then date '2021-05-01' end dt, 'essay' source_type from pages p join hs on h = {HOST})"""
#: Pages that their host's index page links to among its first 40, or that are seeds themselves.
CRAWLED = f"""hs as (select {HOST} h, min(page_id) k from pages group by 1),
ln as (select page_id, url, k, {canonical("url")} cu from pages join hs on h = {HOST} where k % 2 = 1),
lk as (select cu, min(page_id) spot, k from ln where rtrim(cu, '/') <> concat('https://', {HOST}) group by cu, k), lf as (select cu, k from lk qualify row_number() over (partition by k order by spot) <= 40),
sd as (select cu, k from lf union all select {canonical("url")}, k from pages join hs on page_id = k where k % 2 = 0), sm as (select cu, min(k) k from sd group by 1),
want as (select p.page_id, p.url, p.html, concat('p', k) person_id, case when k % 3 = 0 then date '2021-05-01' end dt, 'talk' source_type from pages p join sm on cu = {canonical("p.url")})"""


def documents(visible: str, want: str, more: str = "") -> str:
    return f"""with recursive {want}, tx as (select *, {visible} txt, {canonical("url")} cu from want), lo as (select * from tx where len(list_filter(regexp_split_to_array(txt, '\\s+'), lambda x: x <> '')) >= 120),
{by_two_keys("select page_id, sha256(html) a, cu b from lo")}
select person_id, cu canonical_url{more}, case when dt is null then '' else 'seed' end date_source, dt publication_date, md5(substr(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), 1, 300)) title, md5(txt) "text" from lo join kept using (page_id)"""
