"""Trees, cleaning, passages and store pages."""

import random

import pytest
from pyspark.sql import functions as F

from clauseframe.functions import clean, store
from clauseframe.functions.passages import parse_passages
from clauseframe.functions.tree import parse_html
from clauseframe.operators import html

EIGHT = "<h1>A</h1><p>intro</p><ul><li>x</li><li>y</li></ul><h2>B</h2><p>z</p><h1>C</h1><p>w</p>"


def test_context_of_eight_blocks():
    a, b, c, intro = ("A", "h1"), ("B", "h2"), ("C", "h1"), ("intro", "list_intro")
    assert parse_passages(EIGHT) == [
        ("headline", [], "A"), ("text", [a], "intro"), ("list_item", [a, intro], "x"), ("list_item", [a, intro], "y"), ("headline", [a], "B"), ("text", [a, b], "z"),
        ("headline", [a, b], "C"), ("text", [c], "w"),
    ]


def test_stack_cuts_from_the_same_tag():
    got = parse_passages("<h1>1</h1><h3>2</h3><h2>3</h2><p>x</p><h3>4</h3><p>y</p>")
    assert [t for t, _ in got[3][1]] == ["1", "2", "3"] and [t for t, _ in got[5][1]] == ["1", "4"]


def test_tables_have_headers_and_intro():
    page = "<p>Data:</p><table><tr><th colspan=2>Wide</th><th>Kind</th></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"
    got = {p: ctx for _, ctx, p in parse_passages(page)}
    assert got["Wide"] == [("Data:", "table_intro")]
    assert ("Wide", "table_column_header") in got["b"] and ("Kind", "table_column_header") in got["c"] and ("a", "table_row_header") in got["c"]
    long = " ".join(["w"] * 30)
    got = {p: ctx for _, ctx, p in parse_passages(f"<table><tr><td>{long}</td></tr><tr><td>a</td></tr></table>")}
    assert got["a"] == []


def test_furniture_goes_for_divs_only():
    page = '<body><div class="CookieBar">no</div><span class="cookie">yes</span><nav>no</nav><!-- no --><script>no</script><p>text</p></body>'
    text = clean.clean_html(page)
    assert "no" not in text.split() and "yes" in text and "text" in text


@pytest.mark.parametrize(
    ("page", "kept", "gone"),
    [
        ("<article>a</article><main>m</main>", "m", "a"), ("<article>a</article><p>p</p>", "a", "p"), ('<div class="my-Article">a</div><p>p</p>', "a", "p"),
        ('<div id="article">a</div><p>p</p>', "a", "p"), ('<div role="main">a</div><p>p</p>', "a", "p"), ("<p>p</p>", "p", "zzz"),
    ],
)
def test_main_container(page, kept, gone):
    words = clean.clean_html(page).split()
    assert kept in words and gone not in words


def test_breaks_pre_and_spaces():
    assert [p for _, _, p in parse_passages(clean.clean_html("<p>a<br>b<br>c</p>"))] == ["a", "b", "c"]
    assert [p for _, _, p in parse_passages(clean.clean_html("<pre>one\ntwo</pre>"))] == ["one", "two"]
    assert [p for _, _, p in parse_passages(clean.clean_html('<div style="white-space: pre-line">one\ntwo</div>'))] == ["one", "two"]
    assert [p for _, _, p in parse_passages(clean.clean_html("<p>a ​ b\n c <b>d</b></p>"))] == ["a b c d"]


def test_broken_markup_and_nothing():
    assert clean.clean_html(None) == "" and clean.clean_html("") == "" and clean.clean_html("<p> </p>") == ""
    assert [p for _, _, p in parse_passages("</i><p>a<p>b</div>c")] == ["a", "bc"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert "x" in clean.visible_text(deep)


def test_tree_round_trip():
    page = '<div class="a &quot;b"><p>x &lt; y</p><br></div>'
    assert parse_html(parse_html(page).html()).html() == parse_html(page).html()


def test_main_content_and_text():
    page = "<body><header>h</header><div class=content><p>main</p></div><div id=ads>ad</div></body>"
    assert clean.visible_text(clean.main_content(page)) == "main"
    assert clean.main_content("plain") == "plain"


def test_passages_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    pages = [(str(i), "<main>" + EIGHT.replace("A", f"A{i}") * rng.randrange(1, 4) + "</main>") for i in range(40)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(pages, "pkg string, html string")
    want = None
    for n in (1, 4, 17):
        got = html.passages(html.with_clean_html(df.repartition(n)), ["pkg"])
        rows = sorted((r.pkg, r.idx, r.type, r.passage, str(r.context)) for r in got.collect())
        want = want or rows
        assert rows == want
    assert {r[0] for r in want} == {str(i) for i in range(40)}


STORE = """<div class="dzkqwc"><h1><span class="AfwdI" itemprop="name">My App</span></h1><div class="Vbfug"><a href="/store/apps/dev?id=1"><span>Dev Inc</span></a></div>
<div class="TT9eCd">4.5star</div><div class="g1rdde">12.3K reviews</div><div><div class="ClM7O">1M+</div><div class="g1rdde">Downloads</div></div>
<span itemprop="contentRating"><span>PEGI 3</span></span><span class="UIuSk">Contains ads</span><img itemprop="image" alt="Icon image" src="http://x/i.png">
<div data-item-id='%.@."com.a.b"'></div><meta itemprop="price" content="0"><button aria-label="Install"><span class="VfPpkd-vQzf8d">Install</span></button></div>
<section class="HcyOxe"><meta itemprop="description" content="short"><div class="bARER">long  text</div><div><div class="TKjAsc">Updated on</div><div class="xg1aie">Jan 1, 2024</div></div>
<div><div class="TKjAsc">Available on</div><div>Phone, Tablet</div></div><div class=Uc6QCc><span class="VfPpkd-vQzf8d">#1 top free</span><span class="VfPpkd-vQzf8d">Tools</span></div></section>
<div id="developer-contacts"><a href="https://w.com"><div class="xFVDSb">Website</div></a><a href="https://w.com/p"><div class="xFVDSb">Privacy Policy</div></a><div class="pSEeg">a@b.com</div>
<div class="HhKIQc"><div>Dev GmbH</div><div>x@y.com</div><div class="mHsyY">Street 1<br>12345 Town</div><div>+49 123</div></div></div>"""


def test_store_page_has_all_columns(spark):
    from clauseframe.schemas import APP_METADATA

    got = store.parse_store_page(STORE)
    assert set(got) == set(APP_METADATA.fieldNames())
    assert got["rating"] == 4.5 and got["download_count"] == "1M+" and got["package_id"] == "com.a.b" and got["price"] == "Free" and got["available_in_country"] is True
    assert got["available_platforms"] == ["Phone", "Tablet"] and got["app_ranking"] == "#1 top free" and got["app_categories"] == ["Tools"]
    assert got["company_address"] == "Street 1, 12345 Town" and got["company_phone"] == "+49 123" and got["company_email"] == "x@y.com"
    assert store.parse_store_page(None) == {} and store.parse_store_page("<p>x</p>") == {}
    df = html.with_store_metadata(spark.createDataFrame([("a", STORE), ("b", None)], "pkg string, html string"))
    rows = {r.pkg: r for r in df.select("pkg", F.col("metadata.*")).collect()}
    assert rows["a"].app_name == "My App" and rows["b"].app_name is None
