"""Main text: layouts with known articles, and the supplied pages."""

import re
from html import unescape

from lumenwatch.llm import html_text

NOISE_TOP = '<nav><ul><li><a href="/">Home</a></li></ul></nav><header class="site-header"><p>Slogan of the site goes here</p></header>'
NOISE_END = (
    '<aside class="sidebar-2"><p>Most read stories of the week are listed here</p></aside><div id="comments"><p>A long reader comment that says quite a lot.</p></div>'
    '<form><p>Subscribe now</p><input></form><div class="cookie-notice">We use cookies</div><footer><p>&copy; all rights</p></footer>'
)


def page(body, tail=NOISE_END):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{NOISE_TOP}{body}{tail}</body></html>"


def test_layouts():
    want = "Head & line\nFirst part of the text.\nSecond part, with a link inside it.\nitem one\nitem two"
    inner = "<h1>Head &amp; line</h1><p>First\n part <b>of</b> the text.<p>Second part, with <a href='x>y'>a link</a> inside it.<ul><li>item one<li>item two</ul>"
    for body in (
        f"<article>{inner}</article>",
        f'<DIV CLASS="post-12 entry">{inner}</DIV>',
        f'<main><section class="a">{inner}<div class="ad">Buy this now</div></section></main>',
        f"<div><div class=content>{inner}<!-- <p>no</p> --><script>x<1</script><div class='share-buttons'>share</div></div></div>",
    ):
        assert html_text.extract(page(body)) == want
    assert html_text.extract(page(f"<article>{inner}", "")) == want


def test_text_around_the_largest_container_stays():
    lead, body, end = "Lead of the story.", "The body goes on for long. " * 30, "One more word at the end."
    links = '<div class="top"><ul><li><a href="/a">Section a of the site</a><li><a href="/b">Section b of the site</a></ul></div>'
    want = f"Head\n{lead}\n{body.strip()}\n{end}"
    parts = f'<div class="lead"><p>{lead}</p></div><div class="body"><p>{body}</p></div><section class="end"><p>{end}</p></section>'
    for inner in (
        f"<article><h1>Head</h1>{parts}</article>",
        f'<main><h1>Head</h1><div class="content">{parts}</div></main>',
        f'<div class="wrap"><h1>Head</h1>{parts}</div>',
        f"<h1>Head</h1>{parts}",
        f"<h1>Head</h1><article>{parts}</article>",
        f'<article class="a"><h1>Head</h1><p>{lead}</p></article><article class="b"><p>{body}</p></article><article class="c"><p>{end}</p></article>',
    ):
        assert html_text.extract(page(inner)) == html_text.extract(page(links + inner)) == want


def test_wrappers_with_names_of_boilerplate():
    text = "Head\nThe story of the page.\nIt has two parts."
    inner = "<h1>Head</h1><p>The story of the page.</p><p>It has two parts.</p>"
    side = '<div class="sidebar"><article class="teaser"><h2>Teaser</h2></article></div>'
    replies = '<div id="comments"><article class="comment-body"><p>' + "A comment goes on. " * 30 + "</p></article></div>"
    for start, end in (('<div class="layout has-sidebar">', "</div>"), ('<div id="comments-open">', "</div>"), ('<form id="aspnetForm">', "</form>")):
        for body in (f"<article>{inner}</article>", f"<main>{inner}</main>", f'<div class="post">{inner * 3}</div>'):
            want = "\n".join([text] * body.count("<h1>"))
            assert html_text.extract(page(f"{start}{body}{end}")) == want
            assert html_text.extract(page(f"{start}{NOISE_END}{body}{end}", "")) == want
            assert html_text.extract(page(f"<main>{start}{body}{end}</main>")) == want
            assert html_text.extract(f"{start}<div class='nav-main'>{body}</div>{end}") == want
        assert html_text.extract(page(f"{start}<article>{inner}</article>{side}{replies}{end}")) == text
    assert html_text.extract(page(f"<article>{inner}</article>{side}{replies}")) == text
    assert html_text.extract(page('<article><p>Short.</p></article><div class="ad">A long text of an advert here.</div>')) == "Short."
    assert html_text.extract('<div class="comments"><p>Only</p></div><div class="share"><p>this</p></div>') == "Only\nthis"


def test_names_inside_an_article_are_hints():
    story = "The story goes on for a while. " * 8
    for body, want in (
        (f'<article><h1>H</h1><section id="social-history"><p>{story}</p></section></article>', f"H\n{story.strip()}"),
        (f'<article><h1>H</h1><p>{story}</p><section class="alert-systems"><p>{story}</p></section></article>', f"H\n{story.strip()}\n{story.strip()}"),
        (f'<article><h1>H</h1><p>{story}</p><p class="alert-text">Mind this.</p></article>', f"H\n{story.strip()}\nMind this."),
        (f'<div class="post"><div class="post-header"><h1>H</h1></div><div class="post-body"><p>{story}</p></div></div>', f"H\n{story.strip()}"),
        (f"<article><h1>H</h1><p>Take <math><mi>x</mi><annotation>x</annotation></math> now. {story}</p></article>", f"H\nTake x now. {story.strip()}"),
        (f'<article><h1>H</h1><p>{story}</p><div class="dfp-slot">Buy a car</div><div class="social-links">Post it</div></article>', f"H\n{story.strip()}"),
    ):
        assert html_text.extract(page(body)) == want


def test_text_outside_an_article_needs_a_reason():
    story = "<h1>H</h1><p>" + "A short story. " * 8 + "</p>"
    want = "H\n" + ("A short story. " * 8).strip()
    reactions = '<section class="reader-voices"><p>I think this is quite right, and more people should say it.</p><p>No, not at all.</p></section>'
    river = '<div class="river">' + "".join(f'<div class="tease"><h3>Teaser {i}</h3><p>What else has happened today in town number {i}.</p></div>' for i in range(12)) + "</div>"
    banner = '<div class="top"><p>Welcome to the paper of the whole region</p></div>'
    for home in ("article", "main"):
        for before, after in (("", reactions), ("", river), (river, ""), (banner, ""), (banner + river, reactions)):
            assert html_text.extract(page(f"{before}<{home}>{story}</{home}>{after}")) == want
    assert html_text.extract(page(f"<h1>Top</h1>{banner}<article>{story}</article>")) == f"Top\n{want}"
    teasers = "".join(f'<article class="tease"><h3>Teaser {i}</h3><p>What has happened in town {i}.</p></article>' for i in range(3))
    assert want.split("\n")[1] in html_text.extract(page(f'<div class="story">{story * 3}</div>{teasers}'))


def test_a_tie_of_votes_and_repeated_rows(spark):
    one, two = ("<div class='%s'><p>%s</p></div>" % (c, "Some words of a story. " * 9) for c in "ab")
    rows = [(1, "http://t.example/1", page(one)), (2, "http://t.example/2", page(two)), (2, "http://t.example/2", page(two)), (1, "http://t.example/1", page(one))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    (won,) = html_text.host_paths(pages).collect()
    assert won.votes == 2 and "div.b" in won.path
    out = html_text.main_text(pages).collect()
    assert sorted(r.page_id for r in out) == [1, 1, 2, 2] and {r.text for r in out} == {("Some words of a story. " * 9).strip()}


def test_supplied_pages_equal_a_plain_reading_of_their_articles(spark):
    """The supplied pages have one bare article each, of a heading and paragraphs."""
    folder = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in html_text.op4_html_extraction(spark, folder).collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", "", html[r.page_id].split("<article>")[1].split("</article>")[0])
        body = re.sub(r'(?s)<div class="(?:ad|comments|share|related|cookie)[^>]*>.*?</div>', "", body)
        parts = re.split(r"</?(?:h1|h2|p|div|ul|li|section|table|tr|td|pre|blockquote)\b[^>]*>", re.sub(r"<br\s*/?>", " ", body))
        want = "\n".join(t for p in parts if (t := " ".join(unescape(re.sub(r"<[^>]+>", "", p)).split())))
        assert r.text == want


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html></html>") == ""
    assert html_text.extract("just words  here") == "just words here"
    assert html_text.extract("<p>a &lt; b < c &nbsp; d &#233;") == "a < b < c d é"
    assert html_text.extract("<div title=\"a > b\">x</div>") == "x"
    assert html_text.extract("<p>" * 3000 + "deep" + "<div>" * 500 + "x" * 200_000).endswith("x" * 200_000)


def test_host_consensus_beats_a_misleading_page(spark):
    inner = "<p>" + "Some words of the story. " * 12 + "</p>"
    odd = '<div class="box"><p>' + "Loud teaser text that is long. " * 20 + "</p></div>"
    rows = [(i, f"https://h.example/{i}", page(f'<div class="story-{i}">{inner}</div>')) for i in range(6)]
    rows += [(9, "https://h.example/9", page(f'<div class="story-9">{inner}</div>{odd}')), (10, None, page(odd)), (11, "x", None), (9, "https://h.example/9", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'p' AS path", "1 AS text")
    out = {(r.page_id, r.n_chars > 0): r for r in html_text.main_text(pages).collect()}
    assert out[9, True].text == out[0, True].text and "Loud" in out[10, True].text
    assert out[9, False].text == out[11, False].text == ""
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_supplied_pages_keep_their_articles(spark):
    rows = html_text.op4_html_extraction(spark, "/root/testdata/sf0.001").collect()
    html = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(html)
    for r in rows:
        body = html[r.page_id].split("<article>")[1].split("</article>")[0]
        assert r.n_chars == len(r.text) and r.text.count("\n") <= body.count("<p>") + 1
        assert "track(" not in r.text and "<p>" not in r.text and "&middot;" not in r.text
