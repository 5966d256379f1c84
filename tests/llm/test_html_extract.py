"""Pages built from known articles: what comes out is the article, whatever surrounds it."""

import html
import random

import pytest
from pyspark.sql import functions as F

from strandweave.llm import html_extract as hx
from strandweave.llm import queries

SF = "/root/testdata/sf0.001"


def sentence(rng, low=8, high=30):
    return " ".join(rng.choice(["river", "stone", "über", "naïve", "c&d", "x<y", "“q”", "walks", "the", "of"])
                    for _ in range(rng.randint(low, high))) + "."


def escaped(rng, text):
    """References of several kinds, and white space that must be folded."""
    out = html.escape(text, quote=False)
    out = out.replace("ü", rng.choice(["&uuml;", "&#252;", "&#xFC;", "ü"])).replace("“", "&ldquo;")
    return out.replace(" ", rng.choice([" ", "\n   ", "\t", "  "]), 2)


def article(rng, paragraphs=None):
    blocks = [sentence(rng, 3, 7).rstrip(".")] + [sentence(rng) for _ in range(paragraphs or rng.randint(2, 6))]
    return blocks


def links(rng, n=6):
    return "".join(f'<li><a href="/{k}">{rng.choice(["Home", "News", "Contact us today"])} {k}</a></li>' for k in range(n))


def soup(rng, blocks, k):
    """No telling tags at all: numbered ids, generic classes, unclosed paragraphs."""
    body = "".join(f"<p>{escaped(rng, b)}" for b in blocks[1:])
    return (f'<html><head><title>t {k}</title><style>p{{}}</style></head><body class="page has-sidebar">'
            f'<div id="top-{k}"><ul>{links(rng)}</ul></div>'
            f'<div class="wrap"><div id="post-{k}"><h1>{escaped(rng, blocks[0])}</h1>{body}</div>'
            f'<div class="sidebar-2"><p>{sentence(rng)}</p></div></div>'
            f'<div class="cookie-notice"><p>We value your privacy and use cookies on this site.</p></div>'
            f'<div class="footer">&copy; 2020</div></body></html>')


def marked(rng, blocks, k):
    """Tags of the newer kind, with comments and a form inside the article."""
    body = "".join(f"<section><p>{escaped(rng, b)}</p></section>" for b in blocks[1:])
    return (f'<!doctype html><HTML><BODY><header><h1>Site name</h1><nav><a href=/>Home</a></nav></header>'
            f'<main><ARTICLE CLASS="entry comments-open"><header><h1>{escaped(rng, blocks[0])}</h1><p>By someone, today</p></header>{body}'
            f'<aside>Also read this long text about other things, dear reader.</aside>'
            f'<form><label>Mail</label><input name=q><button>Send it</button></form>'
            f'<section id="comments"><article><p>{sentence(rng, 30, 60)}</p></article><div><p>{sentence(rng, 30, 60)}</p></div></section>'
            f'<footer>Filed under things</footer></ARTICLE></main><script>if (a<b) document.write("<p>no</p>")</script>'
            f'<!-- <p>not this</p> --><footer><p>{sentence(rng)}</p></footer></BODY></HTML>')


def tabled(rng, blocks, k):
    """A layout table with unclosed cells and an advert."""
    body = "".join(f"<div>{escaped(rng, b)}</div>" for b in blocks[1:])
    return (f'<body><table><tr><td class=left><ul>{links(rng)}</ul><td class=content><h2>{escaped(rng, blocks[0])}</h2>{body}'
            f'<div class="ad-slot banner">{sentence(rng)}</div><td class=right><a href=x>{sentence(rng)}</a></table>')


@pytest.mark.parametrize("template", [soup, marked, tabled])
def test_articles_come_out_whole(spark, template):
    rng = random.Random(11)
    wanted, rows = {}, []
    for k in range(40):
        blocks = article(rng)
        wanted[k] = "\n".join(blocks)
        rows.append((k, f"https://User@Site-{k % 2}.example.com:8080/a/{k}?q=1", template(rng, blocks, k)))
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    found = {r["page_id"]: r for r in got.collect()}
    for k, text in wanted.items():
        assert found[k]["text"] == text
        assert found[k]["n_chars"] == len(text)
        assert found[k]["url"] == rows[k][1]


def side_heavy(rng, blocks, side):
    """Nothing but the host's other pages tells which of two plain boxes is the article."""
    body = "".join(f"<p>{html.escape(b)}</p>" for b in blocks)
    return f'<body><div class="k1">{body}</div><div class="k2"><p>{html.escape(side)}</p></div></body>'


def test_a_short_article_follows_its_host(spark):
    rng = random.Random(12)
    rows, wanted = [], {}
    for k in range(60):
        short = k < 6
        blocks = ["Tiny note here, that is all of it."] if short else [sentence(rng, 40, 60) for _ in range(6)]
        side = " ".join(sentence(rng, 20, 25) for _ in range(5)) if short else "Sign up here for more of this kind."
        wanted[k] = "\n".join(blocks)
        rows.append((k, f"http://one.example/{k}", side_heavy(rng, blocks, side)))
    alone = hx.Page(rows[0][2])
    assert alone.text(alone.best()) != wanted[0]
    found = {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: found[k] for k in wanted if k < 6} == {k: wanted[k] for k in wanted if k < 6}


def test_votes_per_host_by_hand(spark):
    """The grouped votes and winners against a plain count."""
    rng = random.Random(13)
    rows = [(k, f"http://h{min(k % 7, 3)}.example/{k}", rng.choice([soup, marked, tabled])(rng, article(rng), k)) for k in range(90)]
    rows += [(100, None, "<p>no host at all, but a text.</p>"), (101, "http://h1.example/", None), (102, "relative/path", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    plain = {}
    for _, url, source in rows[:90]:
        votes = plain.setdefault(url.split("/")[2], {})
        best = hx.Page(source).best()
        votes[best] = votes.get(best, 0) + 1
    got = {r["host"]: (r["pages"], r["paths"]) for r in hx.winners(hx.host_votes(pages)).collect()}
    assert got == {h: (sum(v.values()), v) for h, v in plain.items()}
    want = {k: (lambda p: p.text(p.agreed(plain[url.split("/")[2]])))(hx.Page(source)) for k, url, source in rows[:90]}
    found = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    assert found == {**want, 100: "no host at all, but a text.", 101: "", 102: "x"}


def test_rare_hosts_take_the_join(spark, monkeypatch):
    """With no host common enough for the broadcast, and with all of them, results are the same."""
    rng = random.Random(14)
    rows = [(k, f"http://h{k % 5}.example/{k}", soup(rng, article(rng), k)) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    both = []
    for share in (2000, 1):
        monkeypatch.setattr(hx, "HOT_SHARE", share)
        both.append(sorted(tuple(r) for r in hx.extract(pages).collect()))
    assert both[0] == both[1] and len(both[0]) == 60


ODD = [
    ("", ""), (None, ""), ("just words & more", "just words & more"), ("a < b and c > d", "a < b and c > d"),
    ("<p>cut off in a tag <a href='x", "cut off in a tag"), ("<p>open comment <!-- never closed", "open comment"),
    ("<p>one</p>\n\n<p> two  words here </p>", "one\ntwo words here"), ("<script>only this", ""),
    ("<p>a&amp;lt;b &AMP &copy2 &#0; &#x41; &nosuch; &lt;p&gt;</p>", "a&lt;b & ©2 � A &nosuch; <p>"),
    ("<p>a<br>b<b>c</b>d<img src=x>e</p>", "a bcde"), ("<a href='/'>only a link in the page</a>", "only a link in the page"),
    ("<div title='a>b' class=\"x y\">quoted > signs.</div>", "quoted > signs."), ("<p title=it's>plain isn't quoted</p><p>more</p>", "plain isn't quoted\nmore"),
    ("</div></p></article>stray ends", "stray ends"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<<p>>x</p>", "<\n>x"),
    ("\x00<p>nul\x00</p>", "\x00\nnul\x00"), ("<article>😀 é</article>", "😀 é"),
]


def test_odd_pages(spark):
    rows = [(k, "http://odd.example/", source) for k, (source, _) in enumerate(ODD)]
    rows += [(None, None, "<p>no id</p>"), (0, "http://odd.example/", ""), (2, "x", "just words & more")]
    # One page per call: what a page says must not hang on the others here.
    for k, (source, text) in enumerate(ODD):
        page = hx.Page(source or "")
        assert page.text(page.best()) == text, (k, source)
    got = hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["page_id"] is None] == ["no id"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_deep_and_long_pages():
    """Deep nesting, stray tags and one very long page take time in proportion to their length."""
    deep = "<div>" * 50_000 + "<p>bottom of it all, at last.</p>" + "</section>" * 50_000
    page = hx.Page(deep)
    assert page.text(page.best()) == "bottom of it all, at last."
    long = "<article>" + "".join(f"<p>paragraph {k} of a page that goes on.</p>" for k in range(60_000)) + "</article><nav>x</nav>"
    page = hx.Page(long)
    assert page.text(page.best()).count("\n") == 59_999
    assert hx.Page("<p>" + "<a x='" * 20_000).best() == "body"


def test_extra_columns_and_empty_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(tuple(r) for r in hx.extract(pages).collect())
    for name in ("host", "path", "paths", "votes", "pages", "text", "n_chars"):
        pages = pages.withColumn(name, F.lit("x"))
    assert sorted(tuple(r) for r in hx.extract(pages).collect()) == want
    assert hx.extract(pages.where("false")).count() == 0


def test_given_pages_against_their_article_tag(spark):
    """Every given page holds its article in one element; cut it out by hand."""
    import re

    got = {r["page_id"]: r["text"] for r in queries.op13_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
