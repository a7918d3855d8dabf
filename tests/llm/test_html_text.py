"""Main text of pages of several layouts."""

import pytest

from tidelog.llm import html_text

STORY = ["A headline of the story", "The first paragraph of the story goes on for a while, as paragraphs do.", "The second & last one – with a short end.", "Short one."]


def blocks(tag="p"):
    return f"<h1>{STORY[0]}</h1>" + "".join(f"<{tag}>{x.replace('&', '&amp;')}</{tag}>" for x in STORY[1:])


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(8)) + "</ul>"
LAYOUTS = {
    "article": f"<nav>{MENU}</nav><div class=ad>Buy our excellent products today and save a lot of money.</div><article>{blocks()}</article><footer>&copy; 2020 A house of stories, all rights reserved.</footer>",
    "div": f"<div id=header>{MENU}</div><div id=content>{blocks()}</div><div class='sidebar'><p>Other stories that you may like to read as well, some of them long.</p></div><div id='footer'>About us and our terms</div>",
    "main": f"<header><h2>The site</h2>{MENU}</header><main>{blocks()}</main><aside><p>An aside of a few words that are not of the story.</p></aside>",
    "comments": f"<article>{blocks()}</article><section id=comments><h2>Comments</h2><p>I have read this story and found it very good indeed, thank you.</p><p>So have I.</p></section>",
    "inner comments": f"<article>{blocks()}<div class='comment-list'><p>I have read this story and found it very good indeed.</p></div></article>",
    "notice": f"<div class='cookie-notice'><p>We use cookies to make this site better for all of its readers.</p><button>Accept</button></div><article>{blocks()}</article>",
    "form": f"<article>{blocks()}<form><label>Your address</label><input name=a><button>Subscribe</button></form></article>",
    "advert inside": f"<article><h1>{STORY[0]}</h1><p>{STORY[1]}</p><div class='advert'>Buy this thing now for little money</div><p>{STORY[2].replace('&', '&#38;')}</p><p>{STORY[3]}</p></article>",
    "open tags": f"<article><h1>{STORY[0]}</h1><p>{STORY[1]}<p>{STORY[2]}<p>{STORY[3]}</article><footer>End</footer>",
    "scripts": f"<script>var a = '<p>no</p>'; if (a < b) f();</script><style>p {{ color: red }}</style><article>{blocks()}<script>g()</script><!-- <p>no</p> --></article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page = f"<!DOCTYPE html><html><head><title>The site</title></head><body>{LAYOUTS[name]}</body></html>"
    assert html_text.main_text(page) == "\n".join(STORY)


def test_white_space_and_references():
    page = "<article><p>  One\n\t two&nbsp;three <b>four</b>five &eacute;&#233;&#xe9; &lt;p&gt;<br>six </p>\n<p> </p><p>&amp;amp;</p></article>"
    assert html_text.main_text(page) == "One two three fourfive ééé <p> six\n&amp;"


@pytest.mark.parametrize("page", ["", " ", "<", "<html>", "<p></p>", "<script>x", "<!--", "</p></div>", "<nav>a</nav>", "&", "\x00"])
def test_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_plain_text_and_broken_markup():
    assert html_text.main_text("Only some words") == "Only some words"
    assert html_text.main_text("<div><p>Some words that were cut off <b>in the") == "Some words that were cut off in the"


def test_a_very_long_page():
    paragraphs = [f"Paragraph number {i} of a story that goes on and on." for i in range(20_000)]
    assert html_text.main_text("<article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article>") == "\n".join(paragraphs)


def test_deep_nesting():
    import time

    start = time.perf_counter()
    for n, tag in ((100_000, "div"), (50_000, "span class=x"), (50_000, "form")):
        assert html_text.main_text(f"<{tag}>" * n + "<p>Down here.</p>" + f"</{tag.split()[0]}>" * n) == "Down here."
    assert html_text.main_text("<div>" * 50_000 + "<p>Down here.</p>" + "</b></section>" * 50_000) == "Down here."
    assert time.perf_counter() - start < 60


LONG = [f"Paragraph {k} of the article goes on for quite a while, so that nobody can take it for a menu or a notice of any kind." for k in range(4)]
ARTICLE = "".join(f"<p>{x}</p>" for x in LONG)
#: Pages whose names or broken markup look like noise around the article.
WRAPPED = {
    "form": f"<form action=/x>{MENU.replace('ul>', 'nav>')}<div>{ARTICLE}</div><input name=state></form>",
    "form and article": f"<form><nav>{MENU}</nav><article>{ARTICLE}</article></form>",
    "comments-open": f'<nav>{MENU}</nav><div id="content" class="comments-open">{ARTICLE}</div>',
    "share-enabled": f'<nav>{MENU}</nav><div class="post share-enabled">{ARTICLE}</div>',
    "search-page": f'<div class="main search-page">{ARTICLE}</div><footer>The end of the page</footer>',
    "comment-open": f'<article class="post comment-open">{ARTICLE}</article>',
    "hidden-print": f'<div class="post-body hidden-print">{ARTICLE}</div>',
    "modal": f'<div class="modal"><article>{ARTICLE}</article></div>',
    "open aside": f"<aside><p>Some few words aside.</p><article>{ARTICLE}</article>",
    "open nav": f"<nav><a href=/a>One</a> <a href=/b>Two</a><article>{ARTICLE}</article><footer>The end</footer>",
    "open form": f"<form><input name=q><div id=content>{ARTICLE}</div>",
    "open button": f"<div><button>Press</div><article>{ARTICLE}</article>",
    "open head": f"<head><title>The title</title><div id=content>{ARTICLE}</div>",
    "beside": f'<div id=content><p>{LONG[0]}</p><article><p>{LONG[1]}</p><p>{LONG[2]}</p></article><p>{LONG[3]}</p></div><div class="sidebar"><p>{LONG[0]}</p></div>',
    "siblings": f"<ul class=menu><li><a href=/a>One</a></ul><div><div><p>{LONG[0]}</p></div><div><p>{LONG[1]}</p><p>{LONG[2]}</p><p>{LONG[3]}</p></div></div><footer>End</footer>",
    "unmarked menu": f"<div>{MENU}</div><div><div><p>{LONG[0]}</p></div><div><p>{LONG[1]}</p><p>{LONG[2]}</p></div><p>{LONG[3]}</p></div>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_noise_needs_more_than_a_name(name):
    page = f"<html><body>{WRAPPED[name]}</body></html>"
    assert html_text.main_text(page) == "\n".join(LONG)


def test_comments_longer_than_the_article():
    comments = "".join(f"<div class=comment><p>{x} I think so too, and more than that.</p></div>" for x in LONG * 3)
    for article in (f"<article>{blocks()}</article>", f"<div id=content>{blocks()}</div>"):
        assert html_text.main_text(f"<body>{article}<section id=comments><h2>All comments</h2>{comments}</section></body>") == "\n".join(STORY)


def test_a_notice_alone_is_no_main_text():
    assert html_text.main_text(f"<nav>{MENU}</nav><div class='cookie-notice'><p>We use cookies.</p></div><footer>End</footer>") == ""


def test_inline_noise_leaves_the_block_whole():
    page = "<article><p>Before it <span class=ad>buy this</span> and <button>Press</button>after it, the text of the block goes on.</p></article>"
    assert html_text.main_text(page) == "Before it and after it, the text of the block goes on."


def test_pages_built_at_random(rng, prose):
    """Pages built around a known text, in random wrappers with noise around and inside, give that text."""
    for _ in range(200):
        text = [prose(rng.choice([3, 30, 80])) for _ in range(rng.randrange(2, 9))] + [prose(60)]
        noise = [f"<nav>{MENU}</nav>", f"<div class=ad-slot>{prose(8)}</div>", f"<aside><p>{prose(9)}</p></aside>", f"<form><label>{prose(3)}</label><input></form>", f"<script>{prose(9)}</script>", f"<!-- {prose(9)} -->"]
        inner = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<h2>{}</h2>", "<ul><li>{}</li></ul>"]).format(t.replace(" ", rng.choice([" ", "\n ", " <b>"]), 1)) + rng.choice([*noise, "", "", "", ""]) for t in text)
        tag = rng.choice(["article", "main"])
        page = f"<{tag}>{inner}</{tag}>"
        for _ in range(rng.randrange(4)):
            page = "<div class=wrap>" + rng.choice([*noise, ""]) + page + rng.choice([*noise, ""]) + "</div>"
        page = f"<html><head><title>x</title></head><body><header>{MENU}</header>{page}<footer>{prose(9)}</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(text), page


def test_smoothing_keeps_the_mass():
    x = html_text.np.array([0.0, 0, 0, 10, 0, 0, 0])
    s = html_text.smoothed(x)
    assert s.sum() == pytest.approx(10) and s.argmax() == 3 and len(s) == len(x)


def test_table(spark):
    rows = [(1, "u", f"<article>{blocks()}</article>", "x"), (1, "u", f"<article>{blocks()}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    story = "\n".join(STORY)
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "u", story, len(story)), (1, "u", story, len(story)), (2, None, "", 0), (None, "v", "", 0)], out.schema).collect()))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
