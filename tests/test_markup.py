"""Review blocks of pages written by hand, against the standard library's parser as the model."""

import html
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from feedlens.sources import markup as MK
from feedlens.sources.pages import CONTENT_CLASS, HEADER_CLASS, review_blocks

SITE = f"""<!DOCTYPE html><html><head><title>x</title><script>var a = '<div class="{CONTENT_CLASS}">';</script></head><body>
<div class="styles_wrapper"><article><div class="card">
 <div class="styles_reviewHeader__iU9Px" data-service-review-rating="5"><div class="star-rating"><img alt="Rated 5 > 4"></div>
  <div class="typography"><div><time datetime="2024-01-05T10:00:00.000Z" class="">Jan 5</time></div></div></div>
 <div aria-hidden="false" class="styles_reviewContent__0Q2Tg"><div class="inner"><a href="/r/1"><h2 class="h">Great &amp; <b>fast</b></h2></a></div>
  <p class="body">It&#39;s caf&eacute; &#x1F600; &lt;ok&gt;<br>second line</p><div><p>Reply</p></div></div>
</div></article>
<article><div class="{HEADER_CLASS} other" data-service-review-rating='1'><time datetime='2024-01-04'></time></div>
 <div class="a b {CONTENT_CLASS}"><div></div></div></article>
<article><div class="{HEADER_CLASS}" data-service-review-rating="x"><time datetime="2024-01-03"></time></div>
 <div class="{CONTENT_CLASS}"><h2>no stars</h2></div></article>
<article><div class="{HEADER_CLASS}" data-service-review-rating="3"></div><div class="{CONTENT_CLASS}"><p>no time</p></div></article>
<article><div class="{HEADER_CLASS}" data-service-review-rating="3"><time datetime="2024-01-02"></div></div>
 <div class={CONTENT_CLASS}><h2>T</h2><div><p>open</div><span>rest</span></div></article>
<div class="{HEADER_CLASS}-not">none</div></div></body></html>"""


class Model(HTMLParser):
    """Blocks of one class: (attributes, events inside) in the order in which they begin."""

    def __init__(self, name):
        super().__init__(convert_charrefs=True)
        self.name, self.stack, self.blocks, self.open = name, [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img"):
            return
        self.stack.append(tag)
        attrs = dict(attrs)
        if self.open is None and tag == "div" and self.name in (attrs.get("class") or "").split():
            self.open = (len(self.stack), [])
            self.blocks.append((attrs, self.open[1]))
        elif self.open is not None:
            self.open[1].append(("open", tag, attrs, len(self.stack)))

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
            if self.open is not None:
                self.open[1].append(("depth", None, None, len(self.stack)))
                if len(self.stack) < self.open[0]:
                    self.open = None

    def handle_data(self, data):
        if self.open is not None and self.stack[-1] not in ("script", "style"):
            self.open[1].append(("text", data, None, len(self.stack)))


def element(events, tag):
    for i, (kind, what, attrs, depth) in enumerate(events):
        if kind == "open" and what == tag:
            text = ""
            for k, w, _, d in events[i + 1:]:
                if k == "depth" and d < depth:
                    break
                text += w if k == "text" else ""
            return attrs, text
    return None


def model(page):
    found = []
    for name in (HEADER_CLASS, CONTENT_CLASS):
        p = Model(name)
        p.feed(page)
        p.close()
        found.append(p.blocks)
    rows = []
    for (attrs, head), (_, body) in zip(*found):
        stars, time = attrs.get("data-service-review-rating"), element(head, "time")
        if not (stars or "").isdigit() or not time or not time[0].get("datetime"):
            continue
        title, text = element(body, "h2"), element(body, "p")
        rows.append((f"{title[1] if title else 'No Title'} {text[1] if text else 'No Content'}", int(stars), time[0]["datetime"]))
    return sorted(rows)


def blocks(spark, pages):
    df = spark.createDataFrame([("c", i, p) for i, p in enumerate(pages)], "company string, page int, html string")
    return sorted((r.text, r.stars, r.date) for r in review_blocks(df).collect())


def test_page_nested_as_on_the_site(spark):
    want = model(SITE)
    assert ("Great & fast It's café 😀 <ok>second line", 5, "2024-01-05T10:00:00.000Z") in want and len(want) == 3
    assert blocks(spark, [SITE]) == want


def test_null_empty_and_plain_pages(spark):
    assert blocks(spark, [None, "", "<p>nothing", "<<<>>", f'<div class="{CONTENT_CLASS}"><p>alone</p></div>']) == []


def random_page(rng):
    out = []
    for i in range(rng.randrange(1, 6)):
        nest = lambda x: "".join(["<div class='n'>"] * (k := rng.randrange(3))) + x + "</div>" * k  # noqa: E731, B023
        words = " ".join(rng.choices(["a", "&amp;", "&notit;", "&copy", "&#8364;", "&#x20ac;", "&", "x;", "&unknown;", "<b>b</b>", "<br>", "ü"], k=4))
        head = nest(f"<span>by</span><time datetime=\"2024-01-0{i + 1}\">t</time>") if rng.random() < 0.9 else ""
        body = (nest(f"<h2>{words} {i}</h2>") if rng.random() < 0.7 else "") + rng.choice(["<!-- </div> -->", "", "<div>x</div>"]) + (
            nest(f"<p>{words}</p><p>more</p>") if rng.random() < 0.8 else "")
        cls = rng.choice(['class="{}"', "class='b {} c'", 'id=q CLASS="{}\ta"'])
        out.append(rng.choice(["", "</div>", "<div>stray</div>", "<p>out"]) + f"<DIV {cls.format(HEADER_CLASS)} data-service-review-rating={rng.randrange(1, 6)}>{head}</DIV>"
                   + f"<div {cls.format(CONTENT_CLASS)}>{body}</div>")
    return "<html><body>" + "\n".join(out) + "</body></html>"


def test_random_pages_equal_the_parser(spark):
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(60)]
    assert blocks(spark, pages) == sorted(r for p in pages for r in model(p))


def test_character_references(spark):
    names = [f"&{n}" for n in html.entities.html5][:2300]
    odd = ["&#0;", "&#128;", "&#x9f;", "&#xD800;", "&#1114112;", "&#65", "&#x41 z", "&ampx", "&notin;", "&notit;", "&nosuch;", "&", "&;", "a&b", "&#;", "", None, "&#129;"]
    texts = [*names, *odd]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", MK.unescaped(F.col("t")).alias("u")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else html.unescape(t)), t


def test_attributes(spark):
    tags = ["<div class='a b'>", '<div data-x="class=\'q\'" class="r">', "<div class=s>", "<div CLASS = \"t\">", "<div class>", "<div>", "<img alt='x' class=\"u&amp;v\" />"]
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r.c for r in df.select(MK.attribute(F.col("t"), "class").alias("c")).collect()] == ["a b", "r", "s", "t", "", None, "u&v"]


def test_one_exchange_orders_the_events(spark):
    df = spark.createDataFrame([("c", 1, SITE)], "company string, page int, html string")
    plan = review_blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
