"""HTML to columns with built-in regular expressions, for pages of regular markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import patterns as P
from corpusloom.functions.text import squeeze

NO_TEXT = ("script", "style", "nav", "aside", "figure", "form", "iframe", "footer")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def plain(h: Column) -> Column:
    """Tags to blanks, the common entities decoded, white space squeezed."""
    t = F.regexp_replace(h, "<[^>]+>", " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return squeeze(t)


def title(h: Column) -> Column:
    """First h1, else og:title, else the title element."""
    found = [plain(F.regexp_extract(h, p, 1)) for p in (r"(?s)<h1[^>]*>(.*?)</h1>", r'(?i)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', r"(?is)<title[^>]*>(.*?)</title>")]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], F.lit(""))


def visible_text(h: Column) -> Column:
    for t in NO_TEXT:
        h = F.regexp_replace(h, rf"(?is)<{t}[^>]*>.*?</{t}>", " ")
    return plain(h)


def paragraphs(h: Column, over: int = 60) -> Column:
    """Texts of the paragraphs that are longer than `over`."""
    return F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"(?s)<p[^>]*>(.*?)</p>")), plain), lambda x: F.length(x) > over)


def quoted(h: Column, over: int = 50) -> Column:
    return F.array_join(F.filter(F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<(?:em|i)>(.*?)</(?:em|i)>")), plain), lambda x: F.length(x) > over), " | ")


def body(h: Column, containers: list[str], over: int = 200) -> Column:
    """Text of the first container (element names) with enough text, else of the page."""
    tries = [visible_text(F.regexp_extract(h, rf"(?is)<{c}[^>]*>(.*?)</{c}>", 1)) for c in containers]
    return F.coalesce(*[F.when(F.length(t) > over, t) for t in tries], visible_text(h))


def url_parts(pages: DataFrame) -> DataFrame:
    u = F.col("url")
    return pages.withColumns(
        {
            "host": F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1), "num": F.regexp_extract(u, "/([0-9]+)", 1), "section": F.regexp_extract(u, "^[a-z]+://[^/]*/([^/?#]*)", 1),
            "canonical": F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/$", ""), "is_article": u.rlike("/[0-9]+"),
        }
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): links in page order, each address once per page."""
    h = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("pos", "href"))
    return h.groupBy("page_id", "href").agg(F.min("pos").alias("pos")).select("page_id", "pos", "href")


def meta(pages: DataFrame, first: int = 2022, last: int = 2026) -> DataFrame:
    """Publication date by fallbacks (meta, time element, JSON-LD, any ISO date), language, author and year (-1 if out of range)."""
    h = F.col("html")
    tries = [r'(?i)property="article:published_time"[^>]*content="(\d{4}-\d{2}-\d{2})', r'(?i)<time[^>]*datetime="(\d{4}-\d{2}-\d{2})', r'"datePublished"\s*:\s*"(\d{4}-\d{2}-\d{2})', r"(20[0-9]{2}-[0-9]{2}-[0-9]{2})"]
    iso = F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in tries])
    year = F.substring(iso, 1, 4).try_cast("int")
    return pages.withColumns({"iso": iso, "lang": F.nullif(F.regexp_extract(h, '(?i)<html[^>]*lang="([^"]+)"', 1), F.lit("")), "author": F.nullif(F.regexp_extract(h, r'(?i)name="author"[^>]*content="([^"]*)"', 1), F.lit("")), "year": F.coalesce(F.when(year.between(first, last), year), F.lit(-1))})


def validity(title_: Column, n: Column) -> Column:
    return F.when(F.length(title_) < 10, "short title").when(n < 64, "too short").when(n > 2000, "too long").otherwise("ok")


def attribute(element: str, key: str, value: str, wanted: str) -> list[str]:
    """Patterns (group 1) for `wanted` of an element whose attribute `key` has a value, in either order of the two."""
    return [rf'(?i)<{element}[^>]*\s{key}="{value}"[^>]*\s{wanted}="([^"]*)"', rf'(?i)<{element}[^>]*\s{wanted}="([^"]*)"[^>]*\s{key}="{value}"']


def first_of(h: Column, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that finds something, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(h, p, 1), F.lit("")) for p in patterns])


def page_title(h: Column, listing: Column, css: str) -> Column:
    """The h1 of a class, else the first h1, else og:title, else the title that the listing gave."""
    h1 = [rf'(?is)<h1[^>]*\sclass="(?:[^"]*\s)?{css}(?:\s[^"]*)?"[^>]*>(.*?)</h1>', r"(?is)<h1[^>]*>(.*?)</h1>"]
    found = [plain(F.regexp_extract(h, p, 1)) for p in h1] + [F.trim(first_of(h, attribute("meta", "property", "og:title", "content")))]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found], listing)


#: Where a publication date may stand, in order of trust: patterns whose group 1 is a date.
DATE_SOURCES = [
    attribute("meta", "property", "article:published_time", "content"), *[attribute("meta", "name", n.replace(".", r"\."), "content") for n in P.DATE_FIELDS],
    [r'(?i)<time[^>]*\sdatetime="([^"]*)"'], [r'"datePublished"\s*:\s*"([^"]+)"'],
]
YEARS = (r"^(\d{4})[-/]\d{2}[-/]\d{2}", r"^\d{2}\.\d{2}\.(\d{4})")
TEXT_DATE = rf"(?:^|[^\p{{L}}\p{{N}}_])\d{{1,2}}\s+(?:{'|'.join([*P.MONTHS, *P.SHORT_MONTHS])})\.?\s+(\d{{4}})"
CANONICAL = attribute("link", "rel", "canonical", "href")
ADDRESS_DATE = r"/(20\d{2})[-/]\d{1,2}[-/]"


def publication_year(h: Column, first: int = 2022, last: int = 2026, zone: int = 3000) -> Column:
    """Year of publication: by meta elements, time element, JSON-LD, a date in the first characters of the text, or the canonical address; null without one."""

    year = lambda t, p: F.regexp_extract(t, p, 1).try_cast("int")
    tries = [year(x, y) for x in (first_of(h, s) for s in DATE_SOURCES) for y in YEARS]
    tries += [year(F.lower(F.substring(plain(h), 1, zone)), TEXT_DATE), year(first_of(h, CANONICAL), ADDRESS_DATE)]
    return F.get(F.filter(F.array(*tries), lambda y: y.between(first, last)), F.lit(0))


def labelled_date(h: Column, label: str, field: str) -> Column:
    """Timestamp after a label in the text ('05.03.2024 10:20'), else of a meta element, else null."""
    by_label = F.try_to_timestamp(F.regexp_replace(F.regexp_extract(plain(h), label, 1), r"\s+", " "), F.lit("dd.MM.yyyy HH:mm"))
    iso = F.replace(F.substring(first_of(h, attribute("meta", "property", field, "content")), 1, 19), F.lit("T"), F.lit(" "))
    return F.coalesce(by_label, F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm:ss")))


def marked_paragraphs(h: Column, prefix: str = "p-") -> Column:
    """Texts of the paragraphs whose id begins with a prefix, joined by blanks."""
    found = F.regexp_extract_all(h, F.lit(rf'(?is)<p[^>]*\sid="{prefix}[^"]*"[^>]*>(.*?)</p>'))
    return F.array_join(F.filter(F.transform(found, plain), lambda x: x != ""), " ")


def canonical(u: Column) -> Column:
    """An address without query and closing slash, with www. where the host has none."""
    u = F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/+$", "")
    return F.regexp_replace(u, r"^(https?://)([^./]+\.[^./]+)(/|$)", "$1www.$2$3")


def is_article(u: Column) -> Column:
    """Whether an address of a known source is an article, by that source's rule; listings, media and pages about the site aren't."""
    low = F.lower(u)
    by_source = [F.contains(low, F.lit(s)) & low.rlike(p) for s, p in P.ARTICLES_OF.items()]
    return F.greatest(*by_source) & ~F.exists(F.array(*map(F.lit, P.NO_ARTICLES)), lambda x: F.contains(low, x))


def listing_cutoff(pages: DataFrame, cutoff: str, patience: int = 2) -> DataFrame:
    """Rows (listing, page, probe) up to the page that ends the `patience`th page in a row older than the cutoff; without a probe a page isn't old."""
    w = Window.partitionBy("listing").orderBy("page")
    old = F.coalesce((F.col("probe") < cutoff).cast("int"), F.lit(0))
    ends = F.when(F.sum(old).over(w.rowsBetween(1 - patience, 0)) == patience, F.col("page"))
    out = pages.withColumn("_ends", ends).withColumn("_end", F.min("_ends").over(Window.partitionBy("listing")))
    return out.where(F.coalesce(F.col("page") <= F.col("_end"), F.lit(True))).drop("_ends", "_end")
