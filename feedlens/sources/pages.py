"""Review extraction from raw web pages, as batch jobs over a page table.

Both are native expressions (regex extraction, ``from_json``, ``explode``)
applied per page; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens.operators.parallel import spread
from feedlens.sources.markup import attribute, blocks_of, element_text, first_element, has_class, nested, tag_events

# Defaults for a review block without title or paragraph.
NO_TITLE = "No Title"
NO_CONTENT = "No Content"

REVIEWS_JSON = T.StructType([T.StructField("props", T.StructType([
    T.StructField("pageProps", T.StructType([T.StructField("reviews", T.ArrayType(T.StructType([
        T.StructField("dates", T.StructType([T.StructField("publishedDate", T.StringType())])),
        T.StructField("rating", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("consumer", T.StructType([T.StructField("countryCode", T.StringType())])),
    ])))]))]))])


def html_text(fragment: Column) -> Column:
    """Visible text of an HTML fragment: tags dropped, the five basic entities decoded."""
    t = F.regexp_replace(fragment, r"<[^>]*>", "")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def page_title_text(pages: DataFrame) -> DataFrame:
    """S13 + P8 over plain pages: one row per paragraph block (``block`` counts from 0) with the page's title.

    Defaults where a page has no title or no paragraph; text = title + ' ' + paragraph.
    """
    pages = spread(pages.select("page_id", "html"))
    title = F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", title.alias("t"), F.posexplode(
        F.when(F.size(blocks) > 0, blocks).otherwise(F.array(F.lit(None).cast("string")))).alias("block", "p"))
    t, c = F.coalesce(html_text(F.col("t")), F.lit(NO_TITLE)), F.coalesce(html_text(F.col("p")), F.lit(NO_CONTENT))
    return rows.select("page_id", F.col("block").cast("bigint").alias("block"), t.alias("title"), c.alias("content"),
                       F.concat_ws(" ", t, c).alias("text"))


# Class names of a review's header (rating, time) and content block on the review site.
HEADER_CLASS = "styles_reviewHeader__iU9Px"
CONTENT_CLASS = "styles_reviewContent__0Q2Tg"


def review_blocks(pages: DataFrame, company_col: str = "company", key: tuple[str, ...] = ("company", "page")) -> DataFrame:
    """Every review block of a page; the n-th header belongs to the n-th content block.

    A page is cut into tag events and texts (``sources.markup``); a block is all that
    stands between a ``div`` whose class list has the block's class and that div's own closing
    tag, however many divs are nested in it. Title: the first ``h2`` of the content, text: its
    first ``p``, each with the texts of all its descendants; they default when the block lacks them.
    A block without a whole rating or without a time is left out. More than 3 stars are
    positive, fewer negative, 3 neutral.

    ``key`` identifies a page: its events are ordered in one exchange on the key, no more than a
    page in one window. A block inside a block of its own class takes its texts from the outer one.
    Null and empty pages, and pages without blocks, give no rows.
    """
    events = nested(tag_events(spread(pages.select(*dict.fromkeys([*key, company_col]), "html")), list(dict.fromkeys([*key, company_col]))), list(key))
    for kind, name in (("head", HEADER_CLASS), ("body", CONTENT_CLASS)):
        events = blocks_of(events, list(key), kind, (F.col("name") == "div") & has_class("tag", name))
    member = F.array_compact(F.array(*[F.when(F.col(kind).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("nth"))) for kind in ("head", "body")]))
    rows = events.withColumn("m", F.explode(member))
    kept = F.struct("pos", "until", "name", "opens", "tag")
    # The exchange on the key serves this grouping too.
    blocks = rows.groupBy(*key, F.col(company_col).alias("_company"), F.col("m.nth").alias("nth")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("m.kind") == kind, kept))).alias(kind) for kind in ("head", "body")])
    stars = attribute(F.get("head", 0)["tag"], "data-service-review-rating", decode=False).try_cast("int")
    date = F.nullif(attribute(first_element("head", "time")["tag"], "datetime"), F.lit(""))
    text = F.concat_ws(" ", F.coalesce(element_text("body", "h2"), F.lit(NO_TITLE)), F.coalesce(element_text("body", "p"), F.lit(NO_CONTENT)))
    out = blocks.filter(F.size("body") > 0).select(F.col("_company").alias("company"), text.alias("text"), stars.alias("stars"), date.alias("date"))
    return out.filter(F.col("stars").isNotNull() & F.col("date").isNotNull()).select(
        "company", "text", "stars", "date",
        F.when(F.col("stars") > 3, "positive").when(F.col("stars") < 3, "negative").otherwise("neutral").alias("sentiment"))


def _escaped(text: Column, style: Column) -> Column:
    """``text`` as HTML; ``style`` (0 to 3) chooses among named, decimal and hexadecimal references, and which letters become some."""
    named = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\u00e9", "&eacute;"), ("\u00fc", "&uuml"), ("\u00df", "&szlig;")]
    decimal = [("&", "&#38;"), ("<", "&#60;"), (">", "&#62;"), ("e", "&#101;"), ("\u00f1", "&#241;")]
    hexadecimal = [("&", "&#x26;"), ("<", "&#X3c;"), (">", "&#x3E;"), ("a", "&#x61;"), ("\u00e4", "&#xE4;")]

    def by(pairs: list[tuple[str, str]]) -> Column:
        out = text
        for ch, ref in pairs:
            out = F.replace(out, F.lit(ch), F.lit(ref))
        return out

    return F.when(style == 1, by(named)).when(style == 2, by(decimal)).when(style == 3, by(hexadecimal)).otherwise(by(named[:3]))


def block_pages(rows: DataFrame, page: Column, style: Column | None = None) -> DataFrame:
    """Review pages with one header and content block per row of ``page``; two-star reviews lack a title.

    ``style`` (0 to 3, default 0 for all) varies the markup as sites do: further classes in the class list,
    divs nested around the time and the title, other quotes and case, tags inside the title, comments
    and scripts that hold tags, other character references.
    """
    style = F.lit(0) if style is None else style
    title = F.substring_index(F.col("text"), " ", 3)
    rest = F.expr("substr(text, length(substring_index(text, ' ', 3)) + 2)")
    rating, time = F.coalesce(F.col("stars").cast("string"), F.lit("none")), F.col("date")
    body = F.concat(
        F.when(F.col("stars") == 2, F.lit("")).otherwise(F.concat(
            F.when(style == 1, F.lit('<div class="title"><h2 class="t1"><span>')).when(style == 2, F.lit("<DIV><DIV><H2>")).otherwise(F.lit("<h2>")),
            _escaped(title, style),
            F.when(style == 1, F.lit("</span></h2></div>")).when(style == 2, F.lit("</H2></DIV><br/></DIV >")).otherwise(F.lit("</h2>")))),
        F.when(style == 3, F.lit("<!-- <p>no text</p></div> --><p data-x='a > b'>")).otherwise(F.lit("<p>")),
        _escaped(F.when(F.col("stars") == 2, F.col("text")).otherwise(rest), style), F.lit("</p>"),
        F.when(style == 1, F.lit("<div><p>Reply</p><div>of the shop</div></div>")).otherwise(F.lit("")))
    block = F.concat(
        F.when(style == 1, F.concat(F.lit(f'<div class="paper {HEADER_CLASS}\n wide" data-service-review-rating="'), rating,
                                    F.lit('"><div class="stars"><img alt="</div>"></div><div><div><time class="x" datetime="'), time, F.lit('">then</time></div></div></div>')))
        .when(style == 2, F.concat(F.lit(f"<DIV title='class=\"none\"' CLASS='{HEADER_CLASS}' data-service-review-rating="), rating,
                                   F.lit("><div>by <b>a user</b></div><TIME dateTime='"), time, F.lit("'>then</TIME></DIV>")))
        .otherwise(F.concat(F.lit(f'<div class="{HEADER_CLASS}" data-service-review-rating="'), rating,
                            F.lit('"><time datetime="'), time, F.lit('">then</time></div>'))),
        F.when(style == 1, F.lit(f'<div class="x {CONTENT_CLASS}">')).when(style == 2, F.lit(f"<Div id=c class='{CONTENT_CLASS} y'>"))
        .when(style == 3, F.lit(f'<script>"<div class={CONTENT_CLASS}>"</script><div class="{CONTENT_CLASS}">')).otherwise(F.lit(f'<div class="{CONTENT_CLASS}">')),
        body, F.lit("</div>"))
    block = F.concat(F.when(style == 1, F.lit('<article><div class="card"><div>')).otherwise(F.lit("")), block,
                     F.when(style == 1, F.lit("</div></div></article>")).when(style == 3, F.lit("</div>")).otherwise(F.lit("")))
    html = F.concat(F.lit(f'<html><body><p>Reviews</p><div class="not-{CONTENT_CLASS}"><p>none</p></div>'),
                    F.array_join(F.sort_array(F.collect_list("b")), ""), F.lit("</body></html>"))
    return rows.select("company", page.alias("page"), block.alias("b")).groupBy("company", "page").agg(html.alias("html"))


def last_script(html: str) -> Column:
    """Content of a page's last script; NULL without one."""
    return F.try_element_at(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)), F.lit(-1))


def page_json_reviews(pages: DataFrame, company_col: str = "company") -> DataFrame:
    """The last ``<script>`` of a page holds JSON; one row per review in it.

    Rows keep their date even when the rating does not parse (stars NULL);
    text = title + ' ' + text with missing parts as ''; location from the
    consumer's country code, 'N/A' when absent.
    """
    doc = F.from_json(last_script("html"), REVIEWS_JSON)
    r = pages.select(company_col, F.explode(doc["props"]["pageProps"]["reviews"]).alias("r"))
    return r.select(
        F.col("r.dates.publishedDate").alias("date"),
        F.col("r.rating").try_cast("int").alias("stars"),
        F.concat(F.coalesce("r.title", F.lit("")), F.lit(" "), F.coalesce("r.text", F.lit(""))).alias("text"),
        F.coalesce("r.consumer.countryCode", F.lit("N/A")).alias("tp_location"),
        F.lit("trustpilot").alias("source"),
        F.col(company_col).alias("company"))


def review_pages(rows: DataFrame, page: Column) -> DataFrame:
    """Review pages in the shape the JSON job reads: the reviews of each ``page`` in one script."""
    title = F.substring_index(F.col("text"), " ", 3)
    rest = F.expr("substr(text, length(substring_index(text, ' ', 3)) + 2)")
    review = F.struct(
        F.struct(F.col("date").alias("publishedDate")).alias("dates"),
        F.col("stars").cast("string").alias("rating"),
        title.alias("title"), rest.alias("text"),
        F.when(F.col("location").isNotNull(), F.struct(F.col("location").alias("countryCode"))).alias("consumer"))
    payload = F.to_json(F.struct(F.struct(F.struct(F.collect_list("r").alias("reviews")).alias("pageProps"))
                                 .alias("props")))
    html = F.concat(F.lit("<html><head><script>var x = 1;</script></head><body><p>"), F.col("company"),
                    F.lit("</p><script type=\"application/json\">"), payload, F.lit("</script></body></html>"))
    return rows.select("company", page.alias("page"), review.alias("r")).groupBy("company", "page").agg(html.alias("html")).drop("page")
