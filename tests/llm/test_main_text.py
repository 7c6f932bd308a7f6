import html as escapes
import random
import re

from cohortry.llm.main_text import extracted, main_text, stretches
from tests.conftest import SMALL

LONG = "<p>" + "A sentence of the article with a number of words. " * 3 + "</p>"
LONG_TEXT = ("A sentence of the article with a number of words. " * 3).strip()


def by_article_element(page):
    """Headings and paragraphs between the article tags, read another way."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inside)
    texts = [re.sub(r"\s+", " ", escapes.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    expected = {r["page_id"]: by_article_element(r["html"]) for r in pages.collect()}
    rows = extracted(pages, ["page_id", "url"]).collect()
    assert {r["page_id"]: r["text"] for r in rows} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_boilerplate_goes_and_short_paragraphs_stay():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body>
      <header><h1>Site</h1></header><div class="top-menu"><ul><li><a href="/">Home</a></li></ul></div>
      <div id="cookie-notice">We use cookies and more of them than you would think of</div>
      <div class="sidebar"><p>{"Popular posts of the week. " * 20}</p></div>
      <div id="content"><h1>Title &amp; more</h1>{LONG}<p>Short.</p>
      <div class="advert">Buy this now</div><form><label>Mail</label><input></form>{LONG}<p>End&nbsp;x.</p></div>
      <section class="comments"><p>{"A reader says a great deal here. " * 30}</p></section>
      <script>var p = "<p>no</p>";</script><footer>&copy; Site</footer></body></html>"""
    assert main_text(page) == f"Title & more\n{LONG_TEXT}\nShort.\n{LONG_TEXT}\nEnd x."


def test_pages_without_an_article_element():
    page = f"<body><p>Skip</p><h1>Head</h1>{LONG}{LONG}<p>Tail</p><footer>c</footer>"
    assert main_text(page) == f"Head\n{LONG_TEXT}\n{LONG_TEXT}\nTail"


def test_the_box_holds_every_line_of_the_stretches():
    page = f'<div class="post"><h1>Title</h1><div class="lead"><p>intro</p></div><div class="text">{LONG}{LONG}</div></div>'
    assert main_text(page) == f"Title\nintro\n{LONG_TEXT}\n{LONG_TEXT}"
    gap = "".join(f"<p><a href='/{i}'>link {i}</a></p>" for i in range(4))
    page = f"<div><div>{LONG}{LONG}</div><div>{gap}</div><div>{LONG}</div></div>"
    assert main_text(page).count(LONG_TEXT) == 3


def test_names_that_only_mention_boilerplate():
    page = f'<div class="header">Site</div><div class="content with-sidebar has-menu"><h1>T</h1>{LONG}{LONG}</div>'
    assert main_text(page) == f"T\n{LONG_TEXT}\n{LONG_TEXT}"
    page = f'<article><header class="entry-header"><h1>T</h1></header>{LONG}{LONG}</article>'
    assert main_text(page) == f"T\n{LONG_TEXT}\n{LONG_TEXT}"


def test_names_that_articles_use_too():
    """Inside an article such names need lines that are silent as well."""
    price = '<div class="share-price"><p>Shares rose by 3 %.</p></div>'
    legal = f'<section class="legal">{LONG}</section>'
    page = f"<article><h1>T</h1>{LONG}{price}{legal}<p>x <math><mi>E</mi><mo>=</mo><mi>m</mi></math></p></article>"
    assert main_text(page) == f"T\n{LONG_TEXT}\nShares rose by 3 %.\n{LONG_TEXT}\nx E=m"
    links = "".join(f'<a href="/{i}">Share on network number {i}</a> ' for i in range(9))
    page = f'<article><h1>T</h1>{LONG}<div class="social">{links}</div><div class="share-buttons">Share</div></article>'
    assert main_text(page) == f"T\n{LONG_TEXT}"
    page = f'<article><h1>T</h1>{LONG}</article><div class="legal">{LONG}</div><div class="search-box">Find</div>'
    assert main_text(page) == f"T\n{LONG_TEXT}"
    page = f'<article><h1>T</h1>{LONG}<div class="comments">{LONG}{LONG}</div></article>'
    assert main_text(page) == f"T\n{LONG_TEXT}"


def brute_stretches(weights, window, surge, dive):
    """Where block sums rise above ``surge``, up to where they fall to ``dive``."""
    blocks = [sum(weights[i : i + window]) for i in range(len(weights))]
    found, i = [], 0
    while i < len(blocks):
        if blocks[i] > surge:
            end = next((j for j in range(i + 1, len(blocks)) if blocks[j] <= dive), len(blocks))
            found.append((i, end))
            i = end
        i += 1
    return found


def test_stretches_match_brute_force():
    draw = random.Random(6)
    for _ in range(500):
        weights = [draw.choice([0, 0, 0, 5, 40, 200]) for _ in range(draw.randint(0, 30))]
        window, surge = draw.randint(1, 4), draw.choice([10, 80, 150])
        assert stretches(weights, window, surge, 0) == brute_stretches(weights, window, surge, 0)


def test_link_lists_carry_no_weight():
    links = "".join(f"<li><a href='/{i}'>A long link text that is no article {i}</a></li>" for i in range(30))
    assert main_text(f"<div><ul>{links}</ul></div><div>{LONG}{LONG}</div>") == f"{LONG_TEXT}\n{LONG_TEXT}"


def test_white_space_breaks_and_references():
    page = f"<article>{LONG}<p>a<br>b \n\t c&lt;d&#233;&#x41;&hellip;</p><p>x<b>y</b>z</p></article>"
    assert main_text(page).split("\n")[1:] == ["a b c<déA…", "xyz"]


def test_broken_and_extreme_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- x") == ""
    assert main_text("plain < text & more") == "plain < text & more"
    assert main_text("<div>" * 20_000 + "deep" + "</span>" * 20_000) == "deep"
    assert len(main_text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1
    assert main_text('<a href="x>' * 3_000 + "y") is not None
    assert main_text("<article><p>Only short.</p></article>") == "Only short."


def test_frames(spark):
    frame = spark.createDataFrame(
        [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "t")],
        "page_id long, url string, html string, text string",
    )
    rows = extracted(frame, ["page_id", "url"]).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("", 0), ("x", 1)]
    assert extracted(frame.where("false"), ["page_id", "url"]).count() == 0
