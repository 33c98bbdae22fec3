from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from helpers import rows
from towline.llm.html_tree import extract, main_blocks, main_text

PARAS = ["One long first paragraph, with commas, and words enough to score.", "A second &amp; longer one, which goes on, and on, for a while.", "Short."]
TEXT = [html.unescape(p) for p in PARAS]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
SIDE = "<p>Other text, with commas, that is long enough to be scored, too.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='post-content'>{BODY}</div><div class='sidebar'>{SIDE}</div></body>",
        f"<nav><a href=x>menu</a></nav><article>{BODY}</article><footer>{SIDE}</footer>",
        f"<header><h1>Site</h1>{SIDE}</header><main><article>{BODY}<section class='comments'>{SIDE}{SIDE}{SIDE}</section></article></main>",
        f"<article>{BODY}</article><section id=comments><article class=comment>{SIDE}{SIDE}{SIDE}{SIDE}{SIDE}</article></section>",
        f"<div id=cookie-notice>{SIDE}{SIDE}</div><div><div>{BODY}</div><aside>{SIDE}</aside></div>",
        f"<div><p>{'<p>'.join(PARAS)}<form>{SIDE}<input></form><script>x('</p>')</script><style>p{{}}</style></div>",
        f"<article><div class='ad'>{SIDE}</div>{BODY}<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>",
        f"<div role=navigation>{SIDE}</div><td>{BODY}</td>",
        f"<article>{BODY}<div hidden>{SIDE}</div><p style='display: none'>x</p><!-- <p>no</p> --></article>",
    ],
)
def test_only_the_article(page):
    assert main_blocks(page) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        f"<article><section id='discussion'>{BODY}</section></article>",
        f"<article><div class='notice-of-meeting'>{BODY}</div></article>",
        f"<main><section id=Related_work><div class=social-history>{BODY}</div></section></main>",
        "<article>" + "".join(f"<p id='comment-on-{k}' class=notice>{p}</p>" for k, p in enumerate(PARAS)) + "</article>",
        f"<article>{BODY}<div class='related-posts'><a href=1>One other post of this site, which is long enough, and more</a> x</div>"
        "<div class='share-buttons'>Share</div></article>",
    ],
)
def test_names_of_sections_inside_an_article(page):
    assert main_blocks(page) == TEXT


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
@pytest.mark.parametrize(
    "other",
    [
        f"<div class='comment-list'>{SIDE}{SIDE}{SIDE}</div>",
        f"<section class='comments-area' id='user-comments'>{SIDE}{SIDE}</section>",
        f"<div class='ad-slot'>{SIDE}</div>",
        f"<div class='newsletter-box'>{SIDE}{SIDE}</div>",
        f"<div class='sidebar-left'>{SIDE}{SIDE}</div>",
        f"<p class='advert'>{SIDE[3:]}",
        f"<p class='sponsored'>{SIDE[3:]}",
        "<h3 class='newsletter'>Get our letter, every week, with all that is new and of note</h3>",
        f"<div id=commentThread><div>{SIDE}</div></div>",
        f"<ul class='breadcrumb-trail'><li>{SIDE}</ul>",
        f"<div class='cookie-message'>{SIDE}</div>",
        f"<div class='google-ads'>{SIDE}</div><div id='ad_2'>{SIDE}</div>",
        f"<div class='discussion'><div><span class='user'>A</span>{SIDE}</div><div><span class='user'>B</span>{SIDE}</div></div>",
        f"<section id='respond'><ol><li><time>today</time>{SIDE}<li><time>now</time>{SIDE}</ol></section>",
        "<div class='notice'>The shop of this site is closed on Mondays, Tuesdays and on all holidays, from now on, until further word</div>",
    ],
)
def test_comments_adverts_and_sidebars_inside_an_article(around, other):
    assert main_blocks(f"<body>{around.format(BODY + other)}</body>") == TEXT
    assert main_blocks(f"<body>{around.format(other + BODY)}</body>") == TEXT


def test_names_that_sections_bear_are_kept_at_any_length():
    page = "<article><p>{}</p><section id='notice'><h2>Notice</h2><p>Yes.</p></section><section class='ad-hoc-groups'><p>No.</p></section></article>"
    assert main_blocks(page.format(PARAS[0])) == [TEXT[0], "Notice", "Yes.", "No."]


def test_headings_and_articles_side_by_side():
    page = f"<main><h1>Title</h1><p>lead</p><article><h2 id='Related_work'>One</h2>{BODY}</article><article>part two</article><nav>menu</nav></main>"
    assert main_blocks(page) == ["Title", "lead", "One", *TEXT, "part two"]
    assert main_blocks("<article>a</article><article>b</article>") == ["a", "b"]


def test_blocks_and_white_space():
    page = "<article><h1>Ti\n tle&nbsp;</h1>bare <b>bold\t</b>text<br>next<br><br>new<ul><li>x<li>y &lt;z&gt;</ul><table><tr><td>1<td>2</table></article>"
    assert main_blocks(page) == ["Ti tle", "bare bold text next", "new", "x", "y <z>", "1", "2"]


def test_pages_of_the_corpus(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = rows(extract(pages), "html", "text", "n_chars")
    assert len(out) == pages.count()
    for source, text, n in out:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n".join(b for b in blocks if b) and n == len(text)


def test_broken_empty_and_deep_pages_and_columns(spark):
    deep = "<div>" * 30000 + "deep" + "</div>" * 30000
    pages = [None, "", "<", "<p", "<p>a", "</p></b>", '<a "' * 2000, "<script>never closed", "<b>" * 3000 + "t", "just text", deep]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    df = df.union(df.where("page_id = 4")).withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "extra": F.lit(2)})
    out = rows(extract(df).orderBy("page_id"), "text", "n_chars", "extra")
    assert [t for t, _, _ in out] == ["", "", "<", "", "a", "a", "", "", "", "t", "just text", "deep"]
    assert all(n == len(t) and e == 2 for t, n, e in out)
    assert extract(df.limit(0)).count() == 0
    assert main_text(None) == ""
