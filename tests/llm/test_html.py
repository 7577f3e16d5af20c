import html as codec
import re

import pytest

from tabulens.llm import html

SPACE = r"[\x20\x09-\x0D]+"


def test_query_against_the_marked_article(spark, sf_dir):
    """The pages of the tables mark their article; cutting it out is the plain way."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html.op5_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [re.sub(SPACE, " ", codec.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"<(?:/?p|/?h1|br)>", article)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "Some long text, with commas, and stops. It goes on &amp; on; there is more of it here."
CASES = {
    "": "",
    "plain &lt;text&gt; only": "plain <text> only",
    "<p>a<b>b</b>c</p>\n\t<p> d  e</p>": "abc d e",
    "<!-- x": "",
    "<script>var t='<p>';</script><style>p{}</style><p>kept": "kept",
    f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<br>x</article><footer>c</footer>": f"T {codec.unescape(LONG)} x",
    f"<article><p>{LONG}<div class='ad'>Buy!</div><form>Name</form><div id=comments><p>I agree.</div></article>": codec.unescape(LONG),
    f"<body class='has-sidebar'><header>Site</header><div class=post><h2>T</h2><p>{LONG}<p>{LONG}</div><ul class=menu><li>A<li>B</ul>": "T " + " ".join([codec.unescape(LONG)] * 2),
    f"<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{LONG}<p>{LONG}": " ".join([codec.unescape(LONG)] * 2),
    f"<div class='page-sidebar'><article><p>{LONG}</article></div>": codec.unescape(LONG),
    "<main><p>one</p><aside>no</aside><p>two</p></main><div>out</div>": "one two",
    "<article>a&nbsp;b&am c &#233;&#x1F600;</article>": "a\xa0b&am c é😀",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert html.main_text(page) == CASES[page]


def test_table(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "y"), (None, "<p>z", "u", "w"), (None, "<p>z", "u", "w"), (3, "<p>" + "a b, " * 100_000, "u", "w")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    got = sorted((r.page_id or 0, r.text) for r in html.extract_text(df).collect())
    assert got == [(0, "z"), (0, "z"), (1, ""), (2, ""), (3, ("a b, " * 100_000).strip())]
    assert html.extract_text(df.limit(0)).collect() == []


def test_deep_and_broken_pages():
    assert html.main_text("<div>" * 20_000 + "x") == "x"
    assert html.main_text("</p></div><b><i>x</b></i> <a href=\"y") is not None


CARD = "<article class=card><h3><a href=x>Other story</a></h3><p>A short teaser.</article>"


@pytest.mark.parametrize("before, after", [(0, 4), (3, 0), (1, 6)])
def test_cards_beside_a_main_text(before, after):
    """Articles that are cards do not take the place of the text in a div."""
    text = codec.unescape(LONG)
    page = f"<body>{CARD * before}<div class=post><h1>T</h1>{f'<p>{LONG}' * 5}</div><div>{CARD * after}</div>"
    got = html.main_text(page)
    assert got.count(text) == 5 and "teaser" not in got and "Other" not in got


def test_an_article_beside_other_text():
    """The article's short lines stay, what stands around it goes; posts one after the other all stay."""
    article = f"<article><h2>T</h2><p>{LONG}<p>x<p>{LONG}</article>"
    want = f"T {codec.unescape(LONG)} x {codec.unescape(LONG)}"
    assert html.main_text(f"<div>Welcome to this site.</div>{article}<div>See you soon.</div>") == want
    assert html.main_text(f"<div>Welcome to this site.</div>{article * 8}<div>See you soon.</div>") == " ".join([want] * 8)


CONTROLS = "<label>Search</label><input><button>Go</button><select><option>All</select>"


@pytest.mark.parametrize("wrapper", ["form", "fieldset", "dialog", "object", "div role=dialog", "div role=form", "div aria-hidden=true"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_a_page_in_a_wrapper(wrapper, inner):
    """A form around the whole page: its text stays, around an article or not, and its controls go."""
    controls = CONTROLS if wrapper in ("form", "fieldset") else CONTROLS.replace("<label>Search</label>", "")
    page = f"<body><{wrapper}>{controls}<div><{inner}><p>{LONG}<p>{LONG}</{inner}></div></{wrapper.split()[0]}>"
    assert html.main_text(page) == " ".join([codec.unescape(LONG)] * 2)


def test_a_form_beside_the_text():
    assert html.main_text(f"<div><p>{LONG}<p>{LONG}</div><form><p>Write to us, please.</form>") == " ".join([codec.unescape(LONG)] * 2)


FIVE = " ".join([codec.unescape(LONG)] * 5)


@pytest.mark.parametrize("opening", ["div class='sidebar-layout'", "div class='header-fixed'", "div id='comments-open'", "div class=widget", "section class='page related'"])
@pytest.mark.parametrize("around", ["{}", "<main>{}</main>", "<div>{}</div>", "<nav><a href=x>Home</a></nav>{}<footer>c</footer>"])
def test_names_around_a_page_are_not_its_end(opening, around):
    page = around.format(f"<{opening}><div>{f'<p>{LONG}' * 5}</div></{opening.split()[0]}>")
    assert html.main_text(page) == FIVE


def test_names_of_parts_of_an_article():
    """A title in an article's header and a section on related work stay; adverts and comments go, short or long."""
    text = f"<p>{LONG}" * 5
    page = f"<article><div class='article-header'><h1>Title</h1></div>{text}<section class='related-work'><p>{LONG}</section></article>"
    assert html.main_text(page) == f"Title {FIVE} {codec.unescape(LONG)}"
    for unwanted in ("<div class=ad>Buy!</div>", "<div class='ad-slot'><p>Buy this, it is good.</div>", f"<div id=comments>{'<p>I agree, by the way.' * 9}</div>", f"<div class='post-comments'>{'<p>I agree, by the way.' * 3}</div>"):
        for n in (1, 8):
            assert html.main_text(f"<article>{text * n}{unwanted}</article>") == " ".join([FIVE] * n)
            assert html.main_text(f"<div class=content>{text * n}</div>{unwanted}") == " ".join([FIVE] * n)


def brute_ratios(elements, nodes):
    """Text, signs and links per path, node by node, of nodes that HTML does not leave out."""
    found = {}
    for node in nodes:
        chain, at = [], node.element
        while at:
            chain.append(elements[at])
            at = elements[at].parent
        if any(e.out == "tag" for e in chain) or not node.text.strip():
            continue
        owner = max((i for i, e in enumerate(chain) if e.tag in html.CONTENT), default=None)
        key = (elements[node.element].path, None if owner is None else id(chain[owner]), min([1.0, *(e.weight for e in chain)]))
        size, signs = len(re.sub(SPACE, "", node.text)), sum(not (c.isalnum() or c == "_" or c.isspace()) for c in node.text)
        found.setdefault(key, []).append((size, signs, size * any(e.tag == "a" for e in chain)))
    out = []
    for each in found.values():
        n, text = len(each), sum(x[0] for x in each)
        out.append(text / n * (1 + sum(x[1] for x in each) / n) * (1 - sum(x[2] for x in each) / text))
    return out


def test_ratios_against_brute_force(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()][:60] + [*CASES]
    for page in pages:
        elements, nodes = html.parse(page)
        if nodes:
            assert html.ratios(elements, nodes, html.LASTING).fused.tolist() == pytest.approx(brute_ratios(elements, nodes))


def test_pages_of_the_tables_in_wrappers(spark, sf_dir):
    """Pages of the tables, their body put into an element of an unwanted name: the text is the same."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for i, r in enumerate(rows[::10]):
        name = html.NAMES[i % len(html.NAMES)]
        wrapped = re.sub(r"(<body[^>]*>)(.*)", rf"\1<div class='{name}-layout'>\2", r.html, flags=re.S)
        assert wrapped != r.html and html.main_text(wrapped) == html.main_text(r.html)
