"""Queries over pages: titles, dates, marked paragraphs, addresses, listings. Test pages lack many marks, so some get them put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.operators import html
from corpusloom.plans.text_queries import _PLAIN
from corpusloom.registry import query
from corpusloom.session import table


def _first(col: str, patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '{p}', 1), '')" for p in patterns) + ")"


def _cases(key: str, marks: list[str]) -> str:
    """SQL: the page with the mark of its number before it."""
    return f"case page_id % {len(marks) + 1} " + " ".join(f"when {i} then '{m}'" for i, m in enumerate(marks)) + f" else '' end || {key}"


def marked(spark, sf_dir, marks: list[str]):
    """pages whose html has the mark of its number before it."""
    k = F.col("page_id") % (len(marks) + 1)
    mark = F.lit("")
    for i, m in enumerate(marks):
        mark = F.when(k == i, m).otherwise(mark)
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(mark, "html"))


_YEARS = [
    '<meta property="article:published_time" content="2024-03-05T10:00:00Z">', '<meta content="2023-07-01" name="pubdate">', '<time datetime="2022-01-09">x</time>',
    '<script type="application/ld+json">{"datePublished": "2025-02-03"}</script>', "<p>Publicat 15 mar. 2022</p>", '<link rel="canonical" href="https://x.example/2026/01/15/a">', '<meta name="date" content="05.04.2023"><time datetime="1999-01-01">',
]


def _year(col: str, p: str) -> str:
    y = f"try_cast(nullif(regexp_extract({col}, '{p}', 1), '') as int)"
    return f"case when {y} between 2022 and 2026 then {y} end"


@query(f"""with h as (select page_id, {_cases("html", _YEARS)} as h from pages), s as (select page_id, {", ".join(f"{_first('h', p)} as s{i}" for i, p in enumerate(html.DATE_SOURCES))}, lower(substr({_PLAIN.format("h")}, 1, 3000)) as t, {_first("h", html.CANONICAL)} as c from h)
select page_id, coalesce({", ".join(_year(f"s{i}", y) for i in range(len(html.DATE_SOURCES)) for y in html.YEARS)}, {_year("t", html.TEXT_DATE)}, {_year("c", html.ADDRESS_DATE)}) as year from s""")
def publication_year(spark, sf_dir):
    """The year of a page by the first source that has one."""
    return marked(spark, sf_dir, _YEARS).select("page_id", html.publication_year(F.col("html")).alias("year"))


_LABELS = ["<p>Data actualizarii: 25.03.2026 14:32 Data publicarii: 25.03.2026 09:15</p>", '<meta property="article:published_time" content="2024-03-05T10:00:00Z"><meta content="2024-03-06T11:30:00+00:00" property="article:modified_time">', "<p>Data publicării:  99.99.2026 09:15</p>"]


def _labelled(label: str, field: str) -> str:
    by_label = f"try_strptime(regexp_replace(regexp_extract(t, '{label}', 1), '\\s+', ' ', 'g'), '%d.%m.%Y %H:%M')"
    return f"strftime(coalesce({by_label}, try_strptime(replace(substr({_first('h', html.attribute('meta', 'property', field, 'content'))}, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')), '%Y-%m-%d %H:%M')"


@query(f"""with h as (select page_id, {_cases("html", _LABELS)} as h from pages), t as (select page_id, h, {_PLAIN.format("h")} as t from h)
select page_id, {_labelled(P.PUBLISHED, "article:published_time")} as published, {_labelled(P.UPDATED, "article:modified_time")} as updated from t""")
def labelled_dates(spark, sf_dir):
    """Publication and update by labels in the text, else by meta elements."""
    h = F.col("html")
    at = lambda label, field: F.date_format(html.labelled_date(h, label, field), "yyyy-MM-dd HH:mm")
    return marked(spark, sf_dir, _LABELS).select("page_id", at(P.PUBLISHED, "article:published_time").alias("published"), at(P.UPDATED, "article:modified_time").alias("updated"))


@query(rf"""with h as (select page_id, url, case page_id % 4 when 0 then html || '<h1 class="x responsiveTitle">Chosen &amp; <b>late</b></h1>' when 1 then '<meta property="og:title" content=" From meta ">' || regexp_replace(html, '(?is)<h1[^>]*>(.*?)</h1>', '', 'g') when 2 then regexp_replace(html, '(?is)<h1[^>]*>(.*?)</h1>', '', 'g') else html end as h from pages)
select page_id, coalesce(nullif({_PLAIN.format("regexp_extract(h, '(?is)<h1[^>]*class=" + '"[^"]*responsiveTitle[^"]*"' + "[^>]*>(.*?)</h1>', 1)")}, ''), nullif({_PLAIN.format("regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), nullif(trim(regexp_extract(h, '(?i)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1)), ''), url) as title from h""")
def page_titles(spark, sf_dir):
    """Titles by class, first heading, meta element or listing (here the address)."""
    k, h, bare = F.col("page_id") % 4, F.col("html"), F.regexp_replace("html", "(?is)<h1[^>]*>(.*?)</h1>", "")
    put = F.when(k == 0, F.concat(h, F.lit('<h1 class="x responsiveTitle">Chosen &amp; <b>late</b></h1>'))).when(k == 1, F.concat(F.lit('<meta property="og:title" content=" From meta ">'), bare)).when(k == 2, bare).otherwise(h)
    p = table(spark, sf_dir, "pages").withColumn("html", put)
    return p.select("page_id", html.page_title(h, F.col("url"), "responsiveTitle").alias("title"))


@query(f"""select page_id, array_to_string(list_filter(list_transform(regexp_extract_all(h, '(?is)<p[^>]*\\sid="p-[^"]*"[^>]*>(.*?)</p>', 1), lambda x: {_PLAIN.format("x")}), lambda x: x <> ''), ' ') as body from (select page_id, case when page_id % 2 = 0 then replace(html, '<p>', '<p id="p-1">') else html end as h from pages)""")
def marked_paragraphs(spark, sf_dir):
    """Paragraphs with an id of the article's own, joined."""
    h = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<p>"), F.lit('<p id="p-1">'))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").withColumn("html", h).select("page_id", html.marked_paragraphs(F.col("html")).alias("body"))


_SOURCES = list(P.ARTICLES_OF)
_NOT = " or ".join(f"contains(lower(u), '{x}')" for x in P.NO_ARTICLES)
_IS = " or ".join(f"(contains(lower(u), '{s}') and regexp_matches(lower(u), '{p}'))" for s, p in P.ARTICLES_OF.items())


@query(rf"""with l as (select page_id, (unnest(generate_series(1, len(h))) - 1)::int as pos, unnest(h) as href from (select page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) as h from pages)),
u as (select page_id, pos, 'https://' || case page_id % 3 when 0 then '{_SOURCES[0]}' when 1 then '{_SOURCES[1]}' else '{_SOURCES[2]}' end || case when pos % 2 = 0 then '/stiri' || href || '-' || (100000 + page_id) || case when pos % 4 = 0 then '.html' else '/' end || '?utm=1' else href end as u from l),
c as (select page_id, pos, regexp_replace(regexp_replace(regexp_replace(u, '\?.*$', ''), '/+$', ''), '^(https?://)([^./]+\.[^./]+)(/|$)', '\1www.\2\3') as u from u)
select page_id, min(pos) as pos, u as href from c where ({_IS}) and not ({_NOT}) group by page_id, u""")
def article_links(spark, sf_dir):
    """Addresses of articles on listing pages, made canonical and each once per page (sources put in)."""
    k, pos, href = F.col("page_id") % 3, F.col("pos"), F.col("href")
    host = F.when(k == 0, _SOURCES[0]).when(k == 1, _SOURCES[1]).otherwise(_SOURCES[2])
    path = F.when(pos % 2 == 0, F.concat(F.lit("/stiri"), href, F.lit("-"), (F.col("page_id") + 100000).cast("string"), F.when(pos % 4 == 0, ".html").otherwise("/"), F.lit("?utm=1"))).otherwise(href)
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("pos", "href"))
    u = links.select("page_id", "pos", html.canonical(F.concat(F.lit("https://"), host, path)).alias("href")).where(html.is_article(href))
    return u.groupBy("page_id", "href").agg(F.min("pos").alias("pos")).select("page_id", "pos", "href")


@query("""with p as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as listing, page_id as page, case when page_id % 11 <> 0 then strftime(date '2024-01-01' + (page_id * 37 % 400)::int, '%Y-%m-%d') end as probe from pages),
o as (select *, coalesce((probe < '2024-07-01')::int, 0) as old from p), e as (select *, case when old + lag(old, 1, 0) over (partition by listing order by page) = 2 then page end as ends from o)
select listing, page, probe from (select *, min(ends) over (partition by listing) as last from e) where last is null or page <= last""")
def listing_cutoff(spark, sf_dir):
    """Pages of each listing until two in a row are older than a cutoff (the pages of a host are its listing, dates are put in)."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 400).cast("int")), "yyyy-MM-dd")
    p = html.url_parts(table(spark, sf_dir, "pages")).select(F.col("host").alias("listing"), F.col("page_id").alias("page"), F.when(F.col("page_id") % 11 != 0, day).alias("probe"))
    return html.listing_cutoff(p, "2024-07-01")


@query("""with h as (select page_id, case when page_id % 2 = 0 then '<meta name="keywords" content="a, bc ,d"><meta content="Stiri" property="article:section">' else '' end || html as h from pages)
select page_id, coalesce(array_to_string(list_transform(string_split(nullif(regexp_extract(h, '(?i)<meta[^>]*name="keywords"[^>]*content="([^"]*)"', 1), ''), ','), lambda x: trim(x)), '|'), '') as tags, nullif(regexp_extract(h, '(?i)<meta[^>]*content="([^"]*)"[^>]*property="article:section"', 1), '') as section from h""")
def page_tags(spark, sf_dir):
    """Keywords and section of pages, by meta elements."""
    m = F.when(F.col("page_id") % 2 == 0, '<meta name="keywords" content="a, bc ,d"><meta content="Stiri" property="article:section">').otherwise("")
    h = F.concat(m, "html")
    tags = F.array_join(F.transform(F.split(html.first_of(h, html.attribute("meta", "name", "keywords", "content")), ","), lambda x: F.trim(x)), "|")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(tags, F.lit("")).alias("tags"), html.first_of(h, html.attribute("meta", "property", "article:section", "content")).alias("section"))
