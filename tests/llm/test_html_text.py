import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestream.llm import html_text as H

W = tuple(H.PRIOR)


def test_text_of_a_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><header><a href="/">Site name</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
    <div class="cookie-notice">We use cookies, please accept them all.</div>
    <article><h1>A &amp; B</h1><p>First &lt;para&gt; has <b>bold</b>\n and   <a href="x>y">a link</a>.<p>Short.
    <div class="ad">Buy now, it is cheap, really cheap, so buy now.</div><!-- <p>hidden comment</p> -->
    <p>Second&nbsp;one, with a &#x41; &eacute; and a < b.</p><form><input><label>Mail, please give it.</label><button>Send</button></form>
    <section id="comments"><p>A reader, who had a lot to say about all of this.</p></section></article>
    <aside><p>Related story, with a long teaser text, that goes on and on.</p></aside>
    <footer>&copy; Someone. All rights reserved.</footer></body></html>"""
    assert H.main_text(page, W) == "A & B\nFirst <para> has bold and a link.\nShort.\nSecond one, with a A é and a < b."


def test_page_without_semantic_elements():
    words = "Plain words make up this paragraph, and it goes on for a while, as articles do. " * 3
    menu = "".join(f'<td><a href="/{i}">Link {i}</a></td>' for i in range(8))
    page = f"<body><table><tr>{menu}</tr></table><div><p>{words}</p><p>{words}</p><p>Yes.</p><p>{words}</p></div><table><tr>{menu}</tr></table>"
    text = " ".join(words.split())
    assert H.main_text(page, W) == f"{text}\n{text}\nYes.\n{text}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</", "<!--", "<!-- x", "<script>x", "<p><a href='", "</>x", "<a<a<a<a", "&#xZ; &", "<nav>x</nav>"])
def test_broken_pages(page):
    assert isinstance(H.main_text(page, W), str)


def test_pages_that_break_off():
    assert H.main_text("<article><p>Words of the article, which end he", W) == "Words of the article, which end he"
    assert H.main_text("<article><p>Words of the article, all.</p><p clas", W) == "Words of the article, all."


@pytest.mark.parametrize(
    "tag",
    [
        """<img alt="John's dog">""", """<img alt='5" disk'>""", "<img alt=John's>", """<img title = "a>b's" alt='c>"d'>""",
        """<img alt="Bob's" title="Ann's" x='"'/>""", "<img it's>", "<img a='b'c=\"d's\">", "<img alt=>", """<img alt="x>""",
    ],
)
def test_quote_signs_in_tags(tag):
    """A quote sign opens a value only where a value starts."""
    rest = "First sentence, which is John&#39;s. A second sentence, that isn't short."
    page = f"<article><p>{tag}{rest}</p><p>Third, and it's the last.</p></article>"
    assert H.main_text(page, W) == rest.replace("&#39;", "'") + "\nThird, and it's the last."


@pytest.mark.parametrize(
    "attribute",
    [
        'href="/hidden-gems"', 'title="hidden cost"', 'data-hidden="false"', "data-style='display:none'", "title='style=display:none'",
        'data-class="ad sidebar"', 'title=" class=ad "', "data-x=hidden", "x-hidden", "hidden-x", 'title="aria-hidden=true"',
        'data-x="a>b" title="role=navigation id=footer"',
    ],
)
def test_only_whole_attribute_names_count(attribute):
    page = f"<article><p>First words, here.</p><div {attribute}><p>See <a {attribute}>the gems</a>, all of them.</p></div></article>"
    assert H.main_text(page, W) == "First words, here.\nSee the gems, all of them."
    assert H._marks("div", " " + attribute) == (0, False)


def test_marking_attributes():
    for attributes in (" hidden", " HIDDEN=''", " x=1 hidden", " x='y'hidden", ' style = "a:b; display : none"', " aria-hidden=true", "/hidden"):
        assert H._marks("div", attributes) == (0, True)
    assert H._marks("div", " title='x' CLASS=ad") == H._marks("div", ' role="navigation"') == (H.SIDE, False)


def test_long_quoted_values():
    value = "{'a': '<p>No text, of course.</p>'} " * 400
    assert H.main_text(f'<article><p data-props="{value}">Words, all of them.</p></article>', W) == "Words, all of them."


@pytest.mark.parametrize(
    "element",
    [
        '<svg width="3"/>', "<svg viewBox='0 0 1 1' />", "<math/>", "<svg>", "<iframe src=x />", "<iframe>", "<button>", "<button class=x>",
        "<select>", "<noscript>", "<template>", "<title>", "<svg><title>no</title><svg/><path d='>'/></svg>", "<svg><svg>no</svg>no</svg>",
        "<button>no</button>", "<template><template>no</template>no</template>", "<math><mi>no</mi></math>",
        "<button x='<button>'>no</button>", "<button>no<!-- <button> -->no</button>", "<svg>no<!-- <svg> </svg> -->no</svg>",
    ],
)
@pytest.mark.parametrize("later", ["", "<svg><text>no</text></svg><button>no</button><iframe>no</iframe><math>no</math>"])
def test_elements_that_never_close(element, later):
    """Only what stands between an element's own tags is left out."""
    page = f"<article><p>First words, here.</p>{element}<p>Second words, there.</p>{later}<p>Third words, too.</p></article>"
    assert H.main_text(page, W) == "First words, here.\nSecond words, there.\nThird words, too."


def test_scripts_that_never_close():
    for tag in ("script", "style", "textarea"):
        assert H.main_text(f"<article><p>First words, here.</p><{tag}>var x = 'no';<p>No, no.</p>", W) == "First words, here."
    page = "<title>The <title> element</title><article><p>First words, here.</p></article>"
    assert H.main_text(page, W) == "First words, here."


def test_cut_equals_enumeration():
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        for _ in range(60):
            terminal = [rng.uniform(-3, 3) for _ in range(n)]
            edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

            def cost(side):
                miss = sum(max(0, t) for t, s in zip(terminal, side) if not s) + sum(max(0, -t) for t, s in zip(terminal, side) if s)
                return miss + sum(c for a, b, c in edges if side[a] != side[b])

            best = min(cost(s) for s in itertools.product([True, False], repeat=n))
            assert abs(cost(H.min_cut(terminal, edges)) - best) < 1e-6


def test_cut_on_a_long_chain():
    rng = random.Random(1)
    terminal = [rng.choice([-1.0, 1.0]) for _ in range(20_000)]
    H.min_cut(terminal, [(k, k + 1, 0.7) for k in range(len(terminal) - 1)])


def test_very_long_and_hostile_pages():
    long = "<article>" + "<p>Some words, here.</p>" * 30_000
    assert H.main_text(long, W).count("\n") == 29_999
    H.main_text("<a " * 50_000, W)
    H.main_text('<a b="' * 20_000, W)
    H.main_text("<div>" * 5_000 + "x", W)


def test_training_moves_from_the_prior():
    page = "<nav><p>" + "long words, in a menu. " * 9 + "</p></nav><article><p>a</p><p>b</p></article>"
    weights = H.train([page] * 3)
    assert weights != W and H.train([]) == W
    assert H.main_text(page, weights) == "a\nb"


def test_frame_edge_cases(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article>x y z</article>"), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(7))
    got = H.extract(pages, W)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, "x y z"), (1, ""), (1, ""), (2, "")]
    assert H.sample(pages.limit(0)) == [] and H.extract(pages.limit(0), W).count() == 0


def test_query_on_whole_table(spark, sf):
    """Every page's article, taken apart by a pattern for this layout."""
    got = {r.page_id: r for r in H.op5_html_text(spark, sf).collect()}
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(x for x in lines if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
