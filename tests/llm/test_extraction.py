"""Main text of pages: the given layout against a regular expression, other layouts against what they were made from."""

import html
import random
import re

import pytest

from conftest import SMALL
from resight.llm import extraction
from resight.llm.extraction import main_text
from resight.llm.queries import QUERIES


def brute(source):
    """Heading and paragraphs of the one `article` of a given page."""
    inside = re.search(r"<article>(.*?)</article>", source or "", re.DOTALL)
    parts = re.split(r"</?(?:h1|p|br)>", inside[1] if inside else "")
    texts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts)
    return "\n".join(t for t in texts if t)


def test_query(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    want = {(r["page_id"], r["url"], brute(r["html"]), len(brute(r["html"]))) for r in pages}
    assert {tuple(r) for r in QUERIES["op13_tag_path_ratios"](spark, SMALL).collect()} == want


def prose(draw, sentences):
    return " ".join(" ".join(draw.choice(["river", "stone", "walked", "under", "the", "a", "north"]) for _ in range(draw.randint(6, 14))).capitalize()
                    + draw.choice([".", ", then more.", "!"]) for _ in range(sentences))


MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul>"
COMMENT = '<div class="comment"><b>reader</b><p>I think so too, really. It is a long comment, with marks, in two sentences.</p></div>'
LAYOUTS = {
    "article": "<body><header><a href='/'>Site</a> Daily</header><nav>{menu}</nav><main><article><header><h1>{title}</h1></header>{body}</article></main>"
               "<aside><p>{side}</p></aside><footer>All rights reserved, 2020.</footer>",
    "divs": "<body><div id=top>{menu}</div><div id=wrap><div class=x1><h1>{title}</h1>{body}</div><div class=x2>{menu}</div></div>"
            "<div class='footer-legal'><p>{side}</p></div>",
    "section": "<body><div role=navigation>{menu}</div><section><h1>{title}</h1>{body}</section><section id=comments>{comments}</section>"
               "<div class='cookie-banner'><p>We use cookies, as all do. Accept?</p><button>Yes</button></div>",
    "flat": "<body><h1>{title}</h1>{body}<form><p>Your mail, please:</p><input><label>Mail</label></form><div class='ad'>{side}</div>",
    "table": "<body><table><tr><td>{menu}</td><td><h1>{title}</h1>{body}</td></tr></table><noscript>No script, no page.</noscript>",
    "main": "<body class='has-sidebar no-comments'><div class=skip-link>Skip</div><main><h1>{title}</h1><div class=entry>{body}</div></main>"
            "<div class=sidebar><p>{side}</p></div><div hidden><p>{side}</p></div><div style='display: none'>{side}</div>",
    "wrapped": "<body><div class='menu-layout'><main><h1>{title}</h1>{body}</main></div><template><p>{side}</p></template>",
    "form": "<body><form id=aspnet><div>{menu}</div><div><h1>{title}</h1>{body}</div></form>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_layouts(layout):
    for seed in range(20):
        draw = random.Random(seed)
        paragraphs = [prose(draw, draw.randint(2, 6)) for _ in range(draw.randint(3, 9))]
        paragraphs[1] = "Short one."
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        source = "<!doctype html><title>{title} | Site</title><script>if (a < b) track('<p>no</p>')</script>" + LAYOUTS[layout]
        page = source.format(title="On stones & rivers", body=body, menu=MENU, side=prose(draw, 1), comments=COMMENT * 3)
        page = page.replace("stones & rivers", "stones &amp; rivers")
        assert main_text(page) == "\n".join(["On stones & rivers", *paragraphs]), (layout, seed)


def test_rich_articles():
    page = ("<article><h1>Title</h1><p>One <i>two</i><!-- x -->three, four &lt;b&gt;.<br>five&nbsp;&nbsp;six &copy &#x41;&#66;\n seven.</p>"
            "<h2>Part</h2><ul><li>first, point<li>second <a href=x>point</a></ul><blockquote>Said so.</blockquote><div class=share-buttons>Share!</div>"
            "<figure><img alt=no><figcaption>A figure.</figcaption></figure><pre>x = 1\n  y</pre><p>end < here & there <3</article>")
    assert main_text(page).split("\n") == ["Title", "One twothree, four <b>. five six © AB seven.", "Part", "first, point", "second point",
                                           "Said so.", "A figure.", "x = 1 y", "end < here & there <3"]


def test_articles_without_a_name():
    """Headings, short lists and short paragraphs among long ones, in plain divisions beside junk of no name."""
    draw = random.Random(3)
    want = ["Title", prose(draw, 3), "Part", prose(draw, 4), "one", "two", prose(draw, 3), "Last", prose(draw, 2), "three", "four"]
    tags = ["h1", "p", "h2", "p", "li", "li", "p", "h3", "p", "li", "li"]
    body = "".join(f"<{t}>{w}</{t}>" if t != "li" else f"{'<ul>' if tags[i - 1] != t else ''}<li>{w}{'</ul>' if tags[i + 1 : i + 2] != [t] else ''}"
                   for i, (t, w) in enumerate(zip(tags, want)))
    page = f"<body><div class=q1><div>{MENU}</div><span>Menu</span></div><div class=q2><div class=q3>{body}</div></div><div class=q4>Made by us.</div>"
    assert main_text(page).split("\n") == want


@pytest.mark.parametrize("page, want", [
    ("", ""), ("   ", ""), ("plain text.", "plain text."), ("<p>", ""), ("<p>a", "a"), ("<p>a, b.<p", "a, b."), ("<p>a.<!-- open", "a."),
    ("<p>a.<script>open <p>b", "a."), ("</p></div>x.", "x."), ("<p title='open>a b", "a b"), ("<div><p>a.</div><p>b.", "a.\nb."),
    ("<nav>only</nav>", ""), ("<b><p>a.</b>b.", "a.b."), ("<?x?><![CDATA[y]]><p>a.</>b.", "a.b."), ("<p>a &am b &quo c", "a &am b &quo c"),
    ("<p>\x00\x1fa.", "\x00 a."), ("<a href=/>only a link</a>", ""),
])
def test_broken_markup(page, want):
    assert main_text(page) == want


def test_long_pages():
    deep = "<div>" * 20000 + "text, deep." + "</div>" * 20000
    assert main_text(deep) == "text, deep."
    many = "<article>" + "".join(f"<p>Line {i}, of many.</p>" for i in range(50000)) + "</article>"
    assert main_text(many).count("\n") == 49999
    assert main_text("<p>" + "word, " * 300000).count("word") == 300000
    assert main_text("<b>x<div>" * 20000).count("x") == 20000
    assert main_text("<" * 50000 + "<a '" * 20000).count("<") >= 1


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a, b.</p>", "y"), (2, "v", "", None), (3, "v", "<p>é日.</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted(map(tuple, extraction.extract_pages(df).collect()), key=repr)
    want = [(1, "u", "", 0), (1, "u", "", 0), (None, None, "a, b.", 5), (2, "v", "", 0), (3, "v", "é日.", 3)]
    assert got == sorted(want, key=repr) and extraction.extract_pages(df.limit(0)).count() == 0
