import html
import re

from rasterloom.llm.html_text import extract_text, main_text, regions

P = "<p>A first paragraph with quite a few words in it, long enough to be text.</p><p>Short.</p><p>A last paragraph, which also has its share of words &amp; marks.</p>"
WANT = "A first paragraph with quite a few words in it, long enough to be text. Short. A last paragraph, which also has its share of words & marks."


def test_article_on_the_test_pages(spark):
    from rasterloom.llm.queries import op5_html_text

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?=/?(?:p|h1|br)\b)[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)


def test_parts_that_are_no_article():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><a href=x>Home</a> Site name</header>
      <nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav><div class="cookie-notice">We use cookies on this site, and so on.</div>
      <article><h1>Title &mdash; here</h1>{P}<div class="ad">Buy this now, it is very cheap and very good, really.</div><aside>Related things</aside>
      <form><input name=q><button>Send</button></form><script>var a="<p>no</p>";</script>
      <section id="comments"><h2>3 comments</h2><p>I disagree with this article in many ways, as ever.</p></section></article>
      <div class="sidebar"><p>Most read stories of the week in a list, with long titles.</p></div><footer><p>&copy; 2024 Somebody, all rights reserved.</p></footer></body></html>"""
    assert main_text(page) == "Title — here " + WANT


def test_without_article_the_distribution_decides():
    page = f"<body><div><a href=a>Home</a></div><div><a href=b>News</a></div><div id=x><h2>Title</h2>{P}</div><div><a href=c>Imprint</a></div><div class=comments><p>{'word ' * 80}</p></div></body>"
    assert main_text(page) == "Title " + WANT


def test_open_heads_and_deep_nesting():
    assert main_text(f"<html><head><meta charset=x><title>t</title><article>{P}</article>") == WANT
    assert main_text("<svg>" * 3000 + "<div>" * 20_000 + P + "</section>" * 20_000) == WANT
    assert main_text(f"<article><div class='article-header'><h1>Title</h1></div>{P}<ol class=commentlist><li>no, said a reader of this page</ol></article>") == "Title " + WANT


def test_inline_markup_and_space():
    assert main_text("<article><p>one<b>two</b> \n\t three<br>four&nbsp;five<i> </i>six</p><ul><li>a<li>b</ul></article>") == "onetwo three four five six a b"


def test_broken_markup_and_empty_rows(spark):
    for page in (None, "", " ", "<", "<p", "<!-- open", "<article>", "<script>x", "</p></div>", "<p class='x>never closed", "&amp", "\x00<p>x</p>"):
        assert isinstance(main_text(page), str)
    assert main_text("<p>x &lt; y &amp;amp; z</p>") == "x < y &amp; z"
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "<p>hi</p>", "t"), (2, None, "<p>" + "long " * 50_000, "t")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, len(r.text)) for r in extract_text(pages).collect())
    assert got == [(1, 0), (1, 2), (2, 249_999)]
    assert extract_text(pages.limit(0)).count() == 0


def test_surge_and_dive():
    assert regions([0, 5, 0, 0, 5, 0, 0, 0, 9], 1) == [(1, 5), (8, 9)]
    assert regions([], 1) == [] and regions([0, 0], 1) == []


def test_text_on_both_sides_of_a_block_of_links_stays():
    links = "".join(f"<div><a href={i}>Story number {i}</a></div>" for i in range(5))
    page = f"<body><div><a href=a>Home</a></div><div id=x><h2>Title</h2>{P}{links}<h2>More</h2>{P}{links}{P}</div></body>"
    assert main_text(page) == f"Title {WANT} More {WANT} {WANT}"


def test_sections_of_an_article_are_not_taken_for_asides_by_name():
    page = f"<article>{P}<h2 id=related-work>Related work</h2><section id=discussion>{P}</section><div class=commentary>{P}</div><p class=notice>Note.</p><div class='ads'>Buy</div></article>"
    assert main_text(page) == f"{WANT} Related work {WANT} {WANT} Note."


def test_articles_without_markup_of_their_own():
    assert main_text(f"<body><div class='social-policy'>{P}</div><div class=ad>Buy</div></body>") == WANT
    assert main_text(f"<body><div class='notices-about-tax'>{P}</div></body>") == WANT
    assert main_text(f"<body><div class=cookies>{P}</div></body>") == WANT  # nothing else is left
    assert main_text(f"<body><div class=ad>Buy this now</div><div id=x>{P}</div><div class='user-comments'><p>{'no ' * 300}</p></div></body>") == WANT
    adverts = "".join(f"<div class=ad>Advert number {i}, with some words</div>" for i in range(4))
    assert main_text(f"<body><div>{P}{adverts}{P}<p>End.</p></div></body>") == f"{WANT} {WANT} End."
    teaser = "<article><p>Read this next.</p></article>"
    assert WANT in main_text(f"<body>{teaser}<div id=content>{P}{P}</div></body>")


def test_windows_decide_where_no_markup_does(monkeypatch):
    """Labelled pages without ``<article>``: text between surge and dive against all lines that are no aside."""
    import random

    from rasterloom.llm import html_text as m

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    right = {True: 0, False: 0}
    for _ in range(60):
        body = [" ".join(word() for _ in range(r.randrange(12, 60))) for _ in range(r.randrange(3, 9))]
        links = lambda: "".join(f"<div><a href=x>{word()} {word()}</a></div>" for _ in range(3))
        junk = lambda: "".join(f"{links()}<div>{word()}</div>" for _ in range(3)) + links()
        page = f"<body>{junk()}<div>{''.join(f'<p>{x}</p>' for x in body)}</div>{junk()}</body>"
        want = " ".join(body)
        right[True] += m.main_text(page) == want
        with monkeypatch.context() as off:
            off.setattr(m, "regions", lambda weights, surge: [(0, len(weights))] if weights else [])
            right[False] += m.main_text(page) == want
    assert right[True] >= 55 and right[False] == 0
