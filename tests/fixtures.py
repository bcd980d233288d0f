"""Operators over small inputs written out here, each held against rows worked out by hand from the operators' rules.

The driver's tables have no store pages, tables, knowledge bases, prompts or provider files; these put such
inputs through the operators themselves. Expected rows are literals, never computed by the code they test.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe import schemas as S
from clauseframe.functions import language, vocab
from clauseframe.functions import text as X
from clauseframe.operators import backends, filters, html, ledger, prompts, retrieve, stages
from clauseframe.plans import pipeline
from clauseframe.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    return str(v)


def expect(columns: str, *rows: tuple):
    """Register a query whose result is these rows."""
    said = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT * FROM (VALUES {said}) AS t({columns})"
        return f

    return add


def _entries(context) -> F.Column:
    return F.array_join(F.transform(context, lambda c: F.concat(c["text"], F.lit("/"), c["type"])), "|")


def _put(spark: SparkSession, path: str, content: str | bytes) -> None:
    """A small file of a given name, in whatever store the path is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{sinks.scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- pages ---------------------------------------------------------------------------------------------------------

PARSED = [
    ("blocks", "<h1>A</h1><p>intro</p><ul><li>x</li><li>y</li></ul><h2>B</h2><p>z</p><h1>C</h1><p>w</p>"),
    ("stack", "<h1>1</h1><h3>2</h3><h2>3</h2><p>x</p><h3>4</h3><p>y</p>"),
    ("table", "<p>Data:</p><table><tr><th colspan=2>Wide</th><th>Kind</th></tr><tr><td>a</td><td>b</td><td>c</td></tr></table>"),
    ("odd", "<section>s</section><ul><li>no intro</li></ul>"), ("empty", ""), ("none", None),
]


@expect(
    "pkg, idx, type, passage, context",
    ("blocks", 0, "headline", "A", ""), ("blocks", 1, "text", "intro", "A/h1"), ("blocks", 2, "list_item", "x", "A/h1|intro/list_intro"),
    ("blocks", 3, "list_item", "y", "A/h1|intro/list_intro"), ("blocks", 4, "headline", "B", "A/h1"), ("blocks", 5, "text", "z", "A/h1|B/h2"),
    ("blocks", 6, "headline", "C", "A/h1|B/h2"), ("blocks", 7, "text", "w", "C/h1"),
    ("stack", 0, "headline", "1", ""), ("stack", 1, "headline", "2", "1/h1"), ("stack", 2, "headline", "3", "1/h1|2/h3"), ("stack", 3, "text", "x", "1/h1|2/h3|3/h2"),
    ("stack", 4, "headline", "4", "1/h1|2/h3|3/h2"), ("stack", 5, "text", "y", "1/h1|4/h3"),
    ("table", 0, "text", "Data:", ""), ("table", 1, "table_header", "Wide", "Data:/table_intro"), ("table", 2, "table_header", "Kind", "Data:/table_intro"),
    ("table", 3, "table_cell", "a", "Data:/table_intro|Wide/table_column_header"),
    ("table", 4, "table_cell", "b", "Data:/table_intro|Wide/table_column_header|a/table_row_header"),
    ("table", 5, "table_cell", "c", "Data:/table_intro|Kind/table_column_header|a/table_row_header"),
    ("odd", 0, "UNKNOWN_section", "s", ""), ("odd", 1, "list_item", "no intro", ""),
)
def fixture_passages(spark, sf_dir):
    """Context of headlines, lists and tables, dealt to several partitions."""
    pages = spark.createDataFrame(PARSED, "pkg string, cleaned_html string").repartition(3)
    return html.passages(pages, ["pkg"]).select("pkg", "idx", "type", "passage", _entries(F.col("context")).alias("context"))


CLEANED = [
    ("furniture", '<body><div class="CookieBar">no</div><span class="cookie">yes</span><nav>no</nav><!-- no --><script>no</script><p>text</p></body>'),
    ("main first", "<article>a</article><main>m</main>"), ("article", "<article>a</article><p>p</p>"), ("class", '<div class="my-Article">a</div><p>p</p>'),
    ("id", '<div id="article">a</div><p>p</p>'), ("role", '<div role="main">a</div><p>p</p>'), ("no container", "<p>p</p>"),
    ("breaks", "<p>a<br>b<br>c</p>"), ("pre", "<pre>one\ntwo</pre>"), ("style", '<div style="white-space: pre-line">one\ntwo</div>'),
    ("pre with elements", "<pre><p>one</p><p>two</p></pre>"), ("spaces", "<p>a ​ b\n c <b>d</b></p>"), ("broken", "</i><p>a<p>b</div>c"),
    ("inline", "<p>one <em>two</em> <a href=x>three</a></p>"), ("empty", "<div><p> </p><span></span></div>"), ("none", None),
    ("nested", "<div><div><div><p>deep</p></div></div></div>"), ("frames", "<iframe>no</iframe><object>no</object><noscript>no</noscript><footer>no</footer><p>yes</p>"),
]


@expect(
    "pkg, passages",
    ("furniture", "yes|text"), ("main first", "m"), ("article", "a"), ("class", "a"), ("id", "a"), ("role", "a"), ("no container", "p"), ("breaks", "a|b|c"),
    ("pre", "one|two"), ("style", "one|two"), ("pre with elements", "one|two"), ("spaces", "a b c d"), ("broken", "a|bc"), ("inline", "one two three"),
    ("empty", ""), ("none", ""), ("nested", "deep"), ("frames", "yes"),
)
def fixture_clean(spark, sf_dir):
    """Cleaning rules, seen in the passages that are left."""
    pages = spark.createDataFrame(CLEANED, "pkg string, html string")
    found = html.passages(html.with_clean_html(pages), ["pkg"]).groupBy("pkg").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "passage"))), lambda p: p["passage"]), "|").alias("passages"))
    return pages.select("pkg").join(found, "pkg", "left").select("pkg", F.coalesce("passages", F.lit("")).alias("passages"))


@expect("pkg, text", ("boxes", "main"), ("plain", "plain"), ("body", "only body"), ("none", ""))
def fixture_main_text(spark, sf_dir):
    rows = [("boxes", "<body><header>h</header><div class=content><p>main</p></div><div id=ads>ad</div></body>"), ("plain", "plain"), ("body", "<body><p>only body</p><aside>x</aside></body>"), ("none", None)]
    made = html.with_text(html.with_main_content(spark.createDataFrame(rows, "pkg string, html string")).select("pkg", "main_html"), "main_html")
    return made.select("pkg", X.normalized(F.col("text")).alias("text"))


STORE_PAGE = """<div class="dzkqwc"><h1><span class="AfwdI" itemprop="name">My App</span></h1><div class="Vbfug"><a href="/store/apps/dev?id=1"><span>Dev Inc</span></a></div>
<div class="TT9eCd">4.5star</div><div class="g1rdde">12.3K reviews</div><div><div class="ClM7O">1M+</div><div class="g1rdde">Downloads</div></div>
<span itemprop="contentRating"><span>PEGI 3</span></span><span class="UIuSk">Contains ads</span><img itemprop="image" alt="Icon image" src="http://x/i.png">
<div data-item-id='%.@."com.a.b"'></div><meta itemprop="price" content="0"><button aria-label="Install"><span class="VfPpkd-vQzf8d">Install</span></button></div>
<section class="HcyOxe"><meta itemprop="description" content="short"><div class="bARER">long  text</div><div><div class="TKjAsc">Updated on</div><div class="xg1aie">Jan 1, 2024</div></div>
<div><div class="TKjAsc">Available on</div><div>Phone, Tablet</div></div><div class=Uc6QCc><span class="VfPpkd-vQzf8d">#1 top free</span><span class="VfPpkd-vQzf8d">Tools</span></div></section>
<div id="developer-contacts"><a href="https://w.com"><div class="xFVDSb">Website</div></a><a href="https://w.com/p"><div class="xFVDSb">Privacy Policy</div></a><div class="pSEeg">a@b.com</div>
<div class="HhKIQc"><div>Dev GmbH</div><div>x@y.com</div><div class="mHsyY">Street 1<br>12345 Town</div><div>+49 123</div></div></div>"""
#: The same app where the store's class names have changed: what is found by the marks that remain.
FALLBACK_PAGE = """<div class="dzkqwc"><h1>Other</h1><a href="/store/apps/developer?id=2">Two Ltd</a><div aria-label="Rated 3.9 stars out of five">x</div>
<p>5,000+ Downloads</p><p>$2.99</p><img class="app-icon" src="https://play-lh.googleusercontent.com/j"><div data-x="open com.two.app now"></div></div>
<section class="HcyOxe"><meta itemprop="description" content="s2"></section><div id="developer-contacts"><a href="mailto:m@two.com?subject=x">mail</a></div>"""


@expect(
    "pkg, field, value",
    ("full", "app_name", "My App"), ("full", "developer", "Dev Inc"), ("full", "rating", "4.5"), ("full", "review_count", "12.3K"), ("full", "download_count", "1M+"),
    ("full", "content_rating", "PEGI 3"), ("full", "features", '["Contains ads"]'), ("full", "app_icon_url", "http://x/i.png"), ("full", "package_id", "com.a.b"),
    ("full", "price", "Free"), ("full", "install_button_text", "Install"), ("full", "available_in_country", "true"), ("full", "app_description", "long text"),
    ("full", "short_description", "short"), ("full", "last_updated", "Jan 1, 2024"), ("full", "available_platforms", '["Phone","Tablet"]'), ("full", "app_ranking", "#1 top free"),
    ("full", "app_categories", '["Tools"]'), ("full", "developer_website", "https://w.com"), ("full", "support_email", "a@b.com"), ("full", "privacy_policy_url", "https://w.com/p"),
    ("full", "company_name", "Dev GmbH"), ("full", "company_email", "x@y.com"), ("full", "company_address", "Street 1, 12345 Town"), ("full", "company_phone", "+49 123"),
    ("fallback", "app_name", "Other"), ("fallback", "developer", "Two Ltd"), ("fallback", "rating", "3.9"), ("fallback", "download_count", "5,000+"),
    ("fallback", "app_icon_url", "https://play-lh.googleusercontent.com/j"), ("fallback", "package_id", "com.two.app"), ("fallback", "price", "$2.99"),
    ("fallback", "available_in_country", "false"), ("fallback", "short_description", "s2"), ("fallback", "support_email", "m@two.com"),
)
def fixture_store_metadata(spark, sf_dir):
    """All 25 fields of a store page, and those that other marks give; a page without any gives no row here."""
    pages = spark.createDataFrame([("full", STORE_PAGE), ("fallback", FALLBACK_PAGE), ("nothing", "<p>x</p>"), ("none", None)], "pkg string, html string")
    got = html.with_store_metadata(pages)
    fields = [
        F.struct(F.lit(f.name).alias("field"), (F.to_json(v) if isinstance(f.dataType, T.ArrayType) else v.cast("string")).alias("value"))
        for f in S.APP_METADATA for v in (F.col(f"metadata.{f.name}"),)
    ]
    return got.select("pkg", F.explode(F.array(*fields)).alias("f")).select("pkg", "f.field", "f.value").where("value IS NOT NULL")


@expect("pkg, idx, type, passage", ("blocks", 0, "headline", "A"), ("blocks", 7, "text", "w"), ("table", 5, "table_cell", "c"))
def fixture_passages_in_sql(spark, sf_dir):
    """The same passages by a table function, for SQL."""
    html.register(spark)
    spark.createDataFrame(PARSED, "pkg string, cleaned_html string").createOrReplaceTempView("fixture_pages")
    return spark.sql("SELECT pkg, p.idx, p.type, p.passage FROM fixture_pages, LATERAL passages_of(cleaned_html) p WHERE p.passage IN ('A', 'w', 'c')")


@expect("name, charset, text", ("mark", "utf-8-sig", "é"), ("utf-8", "utf-8", "é ü"), ("latin", "cp1252", "café à"), ("wide", "utf-16-le", "plain"), ("russian", "cp1251", "Политика конфиденциальности"), ("japanese", "shift_jis", "これはプライバシーポリシーです"), ("korean", "euc_kr", "개인정보 처리방침입니다"), ("ascii", "utf-8", "plain"))
def fixture_charsets(spark, sf_dir):
    rows = [
        ("mark", "é".encode("utf-8-sig")), ("utf-8", "é ü".encode()), ("latin", "café à".encode("cp1252")), ("wide", "plain".encode("utf-16-le")),
        ("russian", "Политика конфиденциальности".encode("cp1251")), ("japanese", "これはプライバシーポリシーです".encode("shift_jis")), ("korean", "개인정보 처리방침입니다".encode("euc_kr")), ("ascii", b"plain"),
    ]
    return spark.createDataFrame([(n, readers.charset_of(b), readers.decode_bytes(b)) for n, b in rows], "name string, charset string, text string")


@expect("label, known, ratio", ("abcd", "bcde", 0.75), ("abcd", "zz", 0.0), ("zz", "zz", 1.0))
def fixture_similarity(spark, sf_dir):
    """Ratios of matching blocks: three letters of four in both are 2 * 3 / 8; a label that is known is like itself only."""
    rows = [(x, k, r) for x in ("abcd", "zz") for k, r in vocab.similarity_map(x, ["bcde", "zz"]).items()]
    return spark.createDataFrame(rows, "label string, known string, ratio double")


# ---- texts ---------------------------------------------------------------------------------------------------------


@expect(
    "i, url, path, pdf",
    (0, None, None, False), (1, None, None, False), (2, "https://store/x", "/x", False), (3, "https://host/x", "/x", False), (4, "http://h/x.PDF", "/x.PDF", True),
    (5, None, None, False), (6, None, None, True),
)
def fixture_urls(spark, sf_dir):
    rows = [(0, "", ""), (1, "  ", None), (2, "/x", ""), (3, "host/x", ""), (4, "http://h/x.PDF", ""), (5, "https://", ""), (6, None, "<embed type=application/pdf>")]
    df = spark.createDataFrame(rows, "i int, u string, html string").withColumn("url", X.validated_url(F.col("u"), "store"))
    return df.select("i", "url", X.url_path(F.col("url")).alias("path"), X.is_pdf(F.col("u"), F.col("html")).alias("pdf"))


@expect(
    "i, anchored, forwards, stem, shown",
    (0, True, False, "a.b", "x PLACEHOLDER y"), (1, False, True, "plain", "PLACEHOLDER"), (2, True, True, "", "none"), (3, True, False, "x", ""), (4, False, False, "y", "[..]"),
)
def fixture_text_rules(spark, sf_dir):
    """Spans that anchor, pages that forward, stems of file names, placeholders."""
    rows = [
        (0, "a PLACEHOLDER c", "x a b\nc y", "", "", "a.b.txt", "x [...] y"), (1, "c PLACEHOLDER a", "a b c", '<div class="x aXgaGb">', "", "plain", "[...]"),
        (2, "b", "a b c", "", "Click here to CONTINUE", ".hidden", "none"), (3, "(a).", "see (a).", "p", "q", "x", ""), (4, "z", "a", "", "", "y.", "[..]"),
    ]
    df = spark.createDataFrame(rows, "i int, value string, passage string, html string, text string, name string, shown string")
    return df.select(
        "i", X.spans_anchor(F.col("value"), F.col("passage")).alias("anchored"), X.forwarding_notice(F.col("html"), F.col("text")).alias("forwards"),
        X.file_stem(F.col("name")).alias("stem"), X.replace_placeholders(F.col("shown")).alias("shown"),
    )


@expect("i, query_text, embedding_text", (1, "A; b x", "A b x"), (2, "x", "x"), (3, "x", "x"))
def fixture_search_texts(spark, sf_dir):
    df = spark.createDataFrame([(1, [("A", "h1"), ("b", "p")], "x"), (2, [], "x"), (3, None, "x")], f"i int, c {X.CONTEXT_DDL}, p string")
    return df.select("i", X.query_text(F.col("c"), F.col("p")).alias("query_text"), X.embedding_text(F.col("c"), F.col("p")).alias("embedding_text"))


@expect("i, lang, kept", (0, "en", True), (1, "de", False), (2, "unknown", False), (3, "unknown", False))
def fixture_language(spark, sf_dir):
    rows = [(0, "the cat and the dog are in the house"), (1, "der Hund und die Katze sind in dem Haus"), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "i int, text string")
    kept = filters.by_language(df).select("i", F.lit(True).alias("kept"))
    return df.select("i", language.language(F.col("text"))["lang"].alias("lang")).join(kept, "i", "left").select("i", "lang", F.coalesce("kept", F.lit(False)).alias("kept"))


# ---- labels --------------------------------------------------------------------------------------------------------


def _embed(texts: list[str]) -> np.ndarray:
    """Two directions: what is about access, and all else; nothing for a text without a known word."""
    return np.array([[0.0, 0.0] if t.startswith("?") else [1.0, 0.0] if "Access" in t or t == "see it" else [0.0, 1.0] for t in texts])


@expect("label, repaired, method", ("see it", "Right to Access", "embedding"), ("anything", "Controller Name", "embedding"), ("?right to objct", "Right to Object", "ratio"))
def fixture_label_embedding(spark, sf_dir):
    """By cosine where it is close enough, the first of equals; else by matching blocks."""
    found = spark.createDataFrame([("see it",), ("anything",), ("?right to objct",), ("see it",), ("DPO Contact",), (None,)], "label string")
    return vocab.repair_table(found, embed=_embed)


@expect(
    "i, annotations, requirements",
    (1, "Right to Object=v=true|Unknown=w=NULL", "Right to Object|Unknown"), (2, "", ""), (3, "Data Categories=x=false", "Data Categories"), (4, None, None),
)
def fixture_annotation_repair(spark, sf_dir):
    """Requirements put right, Other dropped, those that are left as a sorted set."""
    kind = "array<struct<requirement:string,value:string,performed:boolean>>"
    rows = [(1, [("rigth to object", "v", True), (None, "w", None)]), (2, []), (3, [("Data Categories", "x", False), ("Other", "y", True)]), (4, None)]
    df = spark.createDataFrame(rows, f"i int, annotations {kind}")
    kept = df.withColumn("annotations", F.filter("annotations", lambda a: F.coalesce(a["requirement"], F.lit("")) != vocab.OTHER))
    fixed = vocab.correct_annotations(kept)
    line = lambda a: F.concat_ws("=", a["requirement"], a["value"], F.coalesce(a["performed"].cast("string"), F.lit("NULL")))
    return fixed.select("i", F.array_join(F.transform("annotations", line), "|").alias("annotations"), F.array_join(vocab.distinct_requirements(F.col("annotations")), "|").alias("requirements"))


@expect("requirement, label, example_id", ("access", "Right to Access", 1), ("Right to", "Right to Access", 1), ("Right to", "Right to Object", 2), ("Right to", "Right to Object", 3))
def fixture_requirement_in_label(spark, sf_dir):
    examples = spark.createDataFrame([(1, ["Right to Access"]), (2, ["Right to Object", "Data Categories"]), (3, ["Right to Object"]), (4, []), (5, None)], "example_id int, labels array<string>")
    asked = spark.createDataFrame([("access",), ("Right to",), ("nothing",), ("access",)], "requirement string")
    return retrieve.examples_for_requirements(examples, asked).select("requirement", "label", "example_id")


# ---- prompts -------------------------------------------------------------------------------------------------------

LEGAL = [("DPO Contact", ["Art. 13(1)(b)", "Art. 37"], "Name the officer."), ("Data Categories", [], None), ("Unused", ["x"], "y")]


@expect(
    "i, lines, background",
    (1, '"DPO Contact": Article 13(1)(b)\n"Nothing": GDPR', "### DPO Contact:\nGDPR References: Art. 13(1)(b), Art. 37\n\nCommentary: Name the officer."),
    (2, "(No relevant requirements predicted for this passage.)", "(No requirements provided, no legal background available.)"),
    (3, '"Data Categories": Article 14(1)(d)\n"DPO Contact": Article 13(1)(b)', "### Data Categories:\nLegal background for Data Categories not available.\n\n### DPO Contact:\nGDPR References: Art. 13(1)(b), Art. 37\n\nCommentary: Name the officer."),
    (4, '"Nothing": GDPR', "(No legal background available for these requirements.)"),
)
def fixture_background(spark, sf_dir):
    """What prompts say of labels: their articles, and what the knowledge base has."""
    rows = spark.createDataFrame([(1, ["DPO Contact", "Nothing"]), (2, []), (3, ["Data Categories", "DPO Contact"]), (4, ["Nothing"])], "i int, labels array<string>")
    base = spark.createDataFrame(LEGAL, "label string, gdpr_references array<string>, commentary string")
    text = vocab.background_text(F.col("label"), F.col("gdpr_references"), F.col("commentary"))
    made = retrieve.background(rows, base, text)
    return made.select("i", vocab.requirement_lines(F.col("labels"), vocab.article_map()).alias("lines"), "background")


@expect("i, background", (1, "### Data Retention:\nDescription: How long.\n\nUsage Guidelines: Periods only."), (2, "### Do Not Track:\nUsage Guidelines: Signals."))
def fixture_category_background(spark, sf_dir):
    rows = spark.createDataFrame([(1, ["Data Retention"]), (2, ["Do Not Track"])], "i int, labels array<string>")
    base = spark.createDataFrame([("Data Retention", "How long.", "Periods only."), ("Do Not Track", "", "Signals.")], S.CATEGORY_RECORD)
    return retrieve.background(rows, base, vocab.category_text(F.col("label"), F.col("description"), F.col("usage"))).select("i", "background")


@expect(
    "i, messages",
    (1, 'system:use "DPO Contact": Article 13(1)(b); bg|user:{"passage":"p"}|assistant:{"labels":["x"]}|user:hello'), (2, "user:file q|assistant:file a|user:bye"),
    (3, "system:only|user:file q|assistant:file a|user:again"),
)
def fixture_messages(spark, sf_dir):
    """System text with its marks filled, supplied few-shots or else those of files, then the user's message."""
    shots = "array<struct<rank:int,user:string,assistant:string>>"
    rows = [(1, "use {{RAG_LABELS}}; {{RAG_BACKGROUND}}", ["DPO Contact"], [(1, '{"passage":"p"}', '{"labels":["x"]}')], "hello"), (2, None, [], [], "bye"), (3, "only", [], None, "again")]
    df = spark.createDataFrame(rows, f"i int, system string, labels array<string>, fewshots {shots}, user string")
    system = X.fill_template(F.col("system"), vocab.requirement_lines(F.col("labels"), vocab.article_map()), F.lit("bg"))
    made = prompts.messages(system, prompts.chosen_fewshots(F.col("fewshots"), [("file q", "file a")]), F.col("user"))
    return df.select("i", F.array_join(F.transform(made, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@expect(
    "provider, kind, format",
    ("openai", "text", '{"type": "text"}'), ("openai", "json", '{"type": "json_object"}'),
    ("openai", "json_schema", '{"type": "json_schema", "json_schema": {"name": "response", "strict": true, "schema": {"type": "object"}}}'),
    ("ollama", "text", "null"), ("ollama", "json", '"json"'), ("ollama", "json_schema", '{"type": "object"}'),
    ("deepseek", "text", '{"type": "text"}'), ("deepseek", "json", '{"type": "json_object"}'), ("deepseek", "json_schema", '{"type": "json_object"}'),
    ("anthropic", "text", "null"), ("anthropic", "json", "null"), ("anthropic", "json_schema", "null"),
)
def fixture_response_format(spark, sf_dir):
    rows = [(p, k, json.dumps(prompts.response_format(p, k, {"type": "object"}))) for p in ("openai", "ollama", "deepseek", "anthropic") for k in ("text", "json", "json_schema")]
    return spark.createDataFrame(rows, "provider string, kind string, format string")


def _examples(spark) -> DataFrame:
    kind = "array<struct<requirement:string,value:string,performed:boolean>>"
    rows = [
        (0, "text", [("H", "h1")], "one [...] two", [("Right to Access", "x [...] y", True)], ["Right to Access"], [1.0, 0.0]),
        (1, "text", [], "far", [("Data Categories", "d", True)], ["Data Categories"], [0.0, 1.0]),
        (2, "list_item", [], "near", [("Data Categories", "n", False), ("Right to Access", "m", True)], ["Data Categories"], [0.8, 0.6]),
        (3, "text", [], "unlabelled", [], [], [0.6, 0.8]),
    ]
    return spark.createDataFrame(rows, f"example_id int, type string, context {X.CONTEXT_DDL}, passage string, annotations {kind}, labels array<string>, embedding array<double>")


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([("q1", [1.0, 0.0], ["Right to Access", "Data Categories"]), ("q2", [0.0, -1.0], ["DPO Contact"])], "query_id string, embedding array<double>, labels array<string>")


_SHOT0 = '{"type":"text","context":[{"text":"H","type":"h1"}],"passage":"one PLACEHOLDER two"}'
_SHOT2, _SHOT3 = '{"type":"list_item","context":[],"passage":"near"}', '{"type":"text","context":[],"passage":"unlabelled"}'


@expect(
    "query_id, rank, user, assistant",
    ("q1", 1, _SHOT0, '{"annotations":[{"requirement":"Right to Access","value":"x PLACEHOLDER y","performed":true}]}'),
    ("q1", 2, _SHOT2, '{"annotations":[{"requirement":"Data Categories","value":"n","performed":false},{"requirement":"Right to Access","value":"m","performed":true}]}'),
    ("q1", 3, _SHOT3, '{"annotations":[]}'),
)
def fixture_similar_fewshots(spark, sf_dir):
    shots = retrieve.similar_fewshots(_asked(spark), _examples(spark), 3, 0.5)
    return shots.select("query_id", F.explode("fewshots").alias("s")).select("query_id", "s.rank", "s.user", "s.assistant")


@expect("query_id, rank, user, assistant", ("q1", 1, '{"passage":"one PLACEHOLDER two"}', '{"labels":["Right to Access"]}'), ("q1", 2, '{"passage":"near"}', '{"labels":["Data Categories"]}'))
def fixture_classify_fewshots(spark, sf_dir):
    """Payloads of the other scheme."""
    shots = retrieve.similar_fewshots(_asked(spark), _examples(spark), 2, 0.5, "practices", "classify")
    return shots.select("query_id", F.explode("fewshots").alias("s")).select("query_id", "s.rank", "s.user", "s.assistant")


@expect(
    "query_id, place, assistant",
    ("q1", 0, '{"annotations":[{"requirement":"Right to Access","value":"x PLACEHOLDER y","performed":true}]}'),
    ("q1", 1, '{"annotations":[{"requirement":"Right to Access","value":"x PLACEHOLDER y","performed":true}]}'),
    ("q1", 2, '{"annotations":[{"requirement":"Data Categories","value":"n","performed":false}]}'),
    ("q1", 3, '{"annotations":[{"requirement":"Right to Access","value":"x PLACEHOLDER y","performed":true}]}'),
    ("q1", 4, '{"annotations":[{"requirement":"Data Categories","value":"n","performed":false}]}'),
)
def fixture_combined_fewshots(spark, sf_dir):
    """The most similar one, then two for each label, labels in their own order and not the alphabet's; repeats stay."""
    both = retrieve.combined_fewshots(retrieve.similar_fewshots(_asked(spark), _examples(spark), 1, 0.5), retrieve.label_fewshots(_asked(spark), _examples(spark), 2, 0.5))
    return both.select("query_id", F.posexplode("fewshots").alias("place", "s")).select("query_id", "place", "s.assistant")


@expect(
    "requirement, rank, annotation_value, confidence",
    ("Right to Access", 1, "right to request access", 0.95), ("Right to Access", 2, "request a copy of your personal data", 0.92),
    ("Data Categories", 1, "email address", 0.95), ("Data Categories", 2, "device identifiers", 0.92),
)
def fixture_curated(spark, sf_dir):
    """The curated examples of some requirements: the surest, where there are more than asked for."""
    asked = spark.createDataFrame([("Right to Access",), ("Data Categories",), ("Controller Name",)], "requirement string")
    return retrieve.curated_examples(readers.fallback_examples(spark), asked, 2, 0.8).select("requirement", "rank", "annotation_value", "confidence")


@expect("requirement, n, mean_confidence", ("Data Categories", 3, 0.9167), ("Processing Purpose", 3, 0.9133), ("Legal Basis for Processing", 3, 0.93), ("Right to Access", 3, 0.9167), ("Data Retention Period", 3, 0.9133), ("Right to Erasure", 3, 0.9167))
def fixture_curated_stats(spark, sf_dir):
    return filters.confidence_by_requirement(readers.fallback_examples(spark)).select("requirement", "n", F.round("mean_confidence", 4).alias("mean_confidence"))


# ---- stages --------------------------------------------------------------------------------------------------------


@expect("pkg, verdict", ("a", "accepted"), ("b", "unknown"), ("c", "rejected"), ("d", "rejected"))
def fixture_detect(spark, sf_dir):
    docs = spark.createDataFrame([("a", "privacy personal data"), ("b", "cookies"), ("c", "tea"), ("d", None)], "pkg string, text string")
    return stages.detect(docs, backends.lexical("detect", 2)).select("pkg", "verdict")


def _passages(spark) -> DataFrame:
    rows = [("a", 0, "text", [], "You may object."), ("a", 1, "text", [], "Nothing here."), ("b", 0, "text", [("H", "h1")], "Ask our DPO.")]
    return spark.createDataFrame(rows, f"pkg string, idx int, type string, context {X.CONTEXT_DDL}, passage string")


def _replay(spark, task: str, said: dict[str, str | None]) -> backends.Replay:
    rows = [(f"run_{task}_{k}", v, 1, 1, None) for k, v in said.items()]
    return backends.Replay(spark.createDataFrame(rows, "custom_id string, response string, in_tokens long, out_tokens long, error string"))


@expect("pkg, idx, labels", ("a", 0, "Right to Object"), ("a", 1, ""), ("b", 0, "DPO Contact|Data Categories"))
def fixture_classify(spark, sf_dir):
    """Labels put right, blank ones and Other dropped; no answer gives none."""
    said = {"a_0": '{"labels": ["right to objct", "Other", " "]}', "b_0": '```json\n["DPO contact", "Data Categories"]\n```'}
    got = stages.classify(_passages(spark), _replay(spark, "classify", said))
    return got.select("pkg", "idx", F.array_join("predicted_labels", "|").alias("labels"))


def _noted(df: DataFrame) -> DataFrame:
    return df.select("pkg", "idx", F.array_join(F.transform("annotations", lambda a: F.concat_ws("=", a["requirement"], a["value"])), "|").alias("annotations"))


@expect("pkg, idx, annotations", ("a", 0, "Right to Object=y"), ("a", 1, ""), ("b", 0, ""))
def fixture_annotate(spark, sf_dir):
    said = {"a_0": '{"annotations": [{"requirement": "Other", "value": "x", "performed": true}, {"requirement": "right to objct", "value": "y", "performed": false}]}', "b_0": "no idea"}
    return _noted(stages.annotate(_passages(spark), _replay(spark, "annotate", said)))


@expect("pkg, idx, annotations", ("a", 0, "Right to Object=object"), ("a", 1, ""), ("b", 0, "DPO Contact=DPO"))
def fixture_targeted(spark, sf_dir):
    """Only passages with labels are asked about: the answer recorded for the other one is not used."""
    one = lambda r, v: json.dumps({"annotations": [{"requirement": r, "value": v, "performed": True}]})
    said = {"a_0": one("Right to Object", "object"), "a_1": one("Data Categories", "never"), "b_0": one("DPO contact", "DPO")}
    labels = F.when(F.col("idx") == 1, F.array().cast("array<string>")).when(F.col("pkg") == "a", F.array(F.lit("Right to Object"))).otherwise(F.array(F.lit("DPO Contact")))
    return _noted(stages.targeted_annotate(_passages(spark).withColumn("labels", labels), _replay(spark, "targeted_annotate", said), "{{RAG_LABELS}}"))


@expect("pkg, idx, annotations, n_annotations, n_anchored", ("a", 0, "Right to Object=may object", 1, 1), ("a", 1, "", 0, 0), ("b", 0, "DPO Contact=the DPO", 1, 0))
def fixture_review(spark, sf_dir):
    """A second look replaces what there was; values that don't occur in their passage are counted."""
    one = lambda r, v: json.dumps({"annotations": [{"requirement": r, "value": v, "performed": True}]})
    said = {"a_0": one("Right to Object", "may object"), "b_0": one("DPO Contact", "the DPO")}
    before = F.array(F.struct(F.lit("Data Categories").alias("requirement"), F.lit("old").alias("value"), F.lit(True).alias("performed")))
    got = stages.review(_passages(spark).withColumn("annotations", before), _replay(spark, "review", said), "{{RAG_LABELS}} {{RAG_BACKGROUND}}")
    return _noted(got).join(stages.span_quality(got), ["pkg", "idx"]).select("pkg", "idx", "annotations", "n_annotations", "n_anchored")


class _Provider:
    """A provider of batches for tests: three states, then an answer to every line, the second of them broken off."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.states = iter(["validating", "in_progress", "completed"])

    def submit(self, path: str) -> str:
        lines = self.spark.read.text(path).select(F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>").alias("r"))
        last = F.element_at("r.body.messages", -1)["content"]
        cut = F.col("r.custom_id").endswith("_a_1")
        choice = F.struct(F.when(cut, "content_filter").otherwise("stop").alias("finish_reason"), F.struct(F.concat(F.lit('{"labels": ["Right to Object", "'), F.get_json_object(last, "$.type"), F.lit('"]}')).alias("content")).alias("message"))
        body = F.struct(F.array(choice).alias("choices"), F.struct(F.lit(7).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")).alias("usage"))
        made = lines.select("r.custom_id", F.struct(F.lit(200).alias("status_code"), body.alias("body")).alias("response"))
        sinks.write_jsonl(made.where("custom_id NOT LIKE '%_b_0'"), f"{self.folder}/1")  # one answer never comes, and results are of two files
        sinks.write_jsonl(made.where("custom_id LIKE '%_a_0'"), f"{self.folder}/2")
        return "batch"

    def status(self, batch: str) -> str:
        return next(self.states)

    def results(self, batch: str) -> str:
        return f"{self.folder}/*"


@expect("pkg, idx, response, error", ("a", 0, '{"labels": ["Right to Object", "text"]}', None), ("a", 1, None, "finish reason content_filter"), ("b", 0, None, "missing"))
def fixture_batch(spark, sf_dir):
    """A batch from its input lines to its answers: written, guarded, submitted, waited for, read from two files, joined."""
    folder = _folder(spark, "batch")
    backend = backends.Batch(f"{folder}/in", _Provider(spark, f"{folder}/out"), sleep=lambda _: None)
    wanted = ledger.requests(_passages(spark), "run", "classify", "gpt-4o", F.array(prompts.message("user", stages.passage_message())))
    return backend.answer(wanted).select("pkg", "idx", "response", "error")


@expect("pkg, idx, passage, annotations", ("a", 0, "Privacy", ""), ("a", 1, "We share personal data with service providers; you may withdraw your consent.", "Data Categories=personal data|Legal Basis for Processing=consent|Data Recipients=share personal data with|Right to Withdraw Consent=withdraw your consent"))
def fixture_run(spark, sf_dir):
    """A whole run over two pages with the offline rules; the page that is no policy leaves after detection."""
    rows = [("a", "<main><h1>Privacy</h1><p>We share personal data with service providers; you may withdraw your consent.</p></main>"), ("b", "<main><p>tea</p></main>")]
    made = pipeline.run(spark, spark.createDataFrame(rows, "pkg string, html string"), pipeline.Config(parallel=2))
    return _noted(made).join(made.select("pkg", "idx", "passage"), ["pkg", "idx"]).select("pkg", "idx", "passage", "annotations")


@expect("place, step, model, batch", (0, "clean", "m", False), (1, "parse", "m", False), (2, "classify", "m", True), (3, "targeted_annotate", "t", False))
def fixture_config(spark, sf_dir):
    """The stages that a configuration names, in order; arguments win over it."""
    config = pipeline.Config.from_args(["--skip-review", "--models", '{"targeted_annotate": "t"}'], '{"default_model": "m", "skip_detect": true, "skip_review": false, "batch_classify": true, "use_two_step_annotation": true, "hostname": null}')
    return spark.createDataFrame([(i, s, config.model_of(s), s in config.batch) for i, s in enumerate(config.steps())], "place int, step string, model string, batch boolean")


# ---- ledger --------------------------------------------------------------------------------------------------------


@expect("asked, key, name, encoding", ("gpt-4o", "gpt-4o", "gpt-4o-2024-11-20", "o200k_base"), ("gpt-4o-2024-11-20", "gpt-4o", "gpt-4o-2024-11-20", "o200k_base"), ("gpt-4", "gpt-4", "gpt-4", "cl100k_base"))
def fixture_models(spark, sf_dir):
    prices = ledger.price_table(spark)
    found = [ledger.model_of(prices, m).select(F.lit(m).alias("asked"), "key", "name", "encoding") for m in ("gpt-4o", "gpt-4o-2024-11-20", "gpt-4", "nobody's")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@expect("model, model_key, cost", ("gpt-4o-2024-11-20", "gpt-4o", 0.0027), ("gpt-4", "gpt-4", 0.036), ("unknown", "unknown", 0.0))
def fixture_cost_by_name(spark, sf_dir):
    """Prices of answers that name the provider's model: 600 + 400 cached + 100 tokens, 1000 + 100 tokens."""
    calls = spark.createDataFrame([("gpt-4o-2024-11-20", 1000, 400, 100), ("gpt-4", 1000, 0, 100), ("unknown", 5, 0, 5)], "model string, in_tokens long, cached_tokens long, out_tokens long")
    keyed = ledger.with_keys(calls, ledger.price_table(spark)).withColumnRenamed("model", "said").withColumnRenamed("model_key", "model")
    return ledger.with_cost(keyed, ledger.price_table(spark)).select(F.col("said").alias("model"), F.col("model").alias("model_key"), F.round("cost", 6).alias("cost"))


@expect("id, total, created, ended", ("b1", 10, "2024-01-01 00:00:00", "2024-01-01 01:00:00"), ("b2", 0, None, None))
def fixture_batch_status(spark, sf_dir):
    rows = [("b1", 1, 2, 3, 4, 0, 1704067200, "2024-01-01T01:00:00Z"), ("b2", None, None, None, None, None, None, "soon")]
    df = spark.createDataFrame(rows, "id string, processing int, succeeded int, errored int, canceled int, expired int, at long, ended string")
    show = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    return df.select("id", ledger.batch_total().alias("total"), show(ledger.epoch_time(F.col("at"))).alias("created"), show(ledger.iso_time(F.col("ended"))).alias("ended"))


@expect("custom_id, response, in_tokens, out_tokens, error", ("x", "t", 1, 2, None), ("y", None, None, None, "result errored"), ("z", None, None, None, "result missing"))
def fixture_other_provider(spark, sf_dir):
    raw = spark.createDataFrame([("x", ("succeeded", ([("t",)], (1, 2)))), ("y", ("errored", None)), ("z", None)], S.BATCH_RESPONSE_B)
    return ledger.answers_b(raw)


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@expect(
    "source, key, value",
    ("policies", "lines/0", "first"), ("policies", "lines/1", "second"), ("policies", "array/0", "only"), ("text", "mark", "é"), ("text", "latin", "é"), ("text", "plain", "é"),
    ("packages", "text", "com.a|com.b"), ("packages", "csv", "com.c|com.d"), ("legal", "DPO Contact", "first file"), ("category", "Do Not Track", "d"), ("index", "1", "DPO Contact"),
    ("index", "2", "Do Not Track"), ("files", "opp_cat_1.json", ""), ("corpus", "p1", "Right to Object"), ("vectors", "0", "[1.0,2.0]"), ("vectors", "1", "[3.0,4.0]"),
    ("prompt", "system", "say"), ("prompt", "pair 2", '{"a": 1}>[1, 2]'), ("prompt", "pair 10", "ten>NULL"), ("prompt", "schema", '{"type": "object"}'),
)
def fixture_readers(spark, sf_dir):
    """Files of every kind that the readers know, written here and read back."""
    top = _folder(spark, "readers")
    row = lambda p: json.dumps({"type": "text", "context": [], "passage": p, "annotations": []})
    matrix = io.BytesIO()
    np.save(matrix, np.array([[1.0, 2.0], [3.0, 4.0]], dtype=np.float32))
    files: dict[str, str | bytes] = {
        "jsonl/lines.jsonl": f"{row('first')}\n\nbroken\n{row('second')}\n", "json/lines.json": f"[{row('not read')}]", "json/array.json": f"[{row('only')}]", "json/.hidden.json": "[]",
        "text/mark.txt": b"\xef\xbb\xbf\xc3\xa9", "text/latin.txt": b"\xe9", "text/plain.txt": "é", "p.txt": " com.a \n\ncom.b\n", "p.csv": "com.c,1\ncom.d,2\n",
        "legal/gdpr_req_02.json": json.dumps({"label": "DPO Contact", "commentary": "second file"}), "legal/gdpr_req_01.json": json.dumps({"label": "DPO Contact", "commentary": "first file"}),
        "legal/index.json": json.dumps({"requirements_overview": [{"requirement_number": 1, "label": "DPO Contact"}]}), "category/opp_cat_1.json": json.dumps({"label": "Do Not Track", "description": "d"}),
        "category/index.json": json.dumps({"categories_overview": [{"category_number": 2, "label": "Do Not Track"}]}),
        "corpus.json": json.dumps([{"passage": "p1", "annotations": [], "labels": ["Right to Object"]}]), "m.npy": matrix.getvalue(), "meta.json": '[{"index": 0}, {"index": 1}]',
        "prompt/system.md": "say", "prompt/response_schema.json": '{"name": "x", "strict": true, "schema": {"type": "object"}}', "prompt/example_2_user.json": '{ "a": 1 }',
        "prompt/example_2_assistant.json": "[1,\n 2]", "prompt/example_10_user.txt": "ten",
    }
    for name, content in files.items():
        _put(spark, f"{top}/{name}", content)
    shown = lambda df, source, key, value: df.select(F.lit(source).alias("source"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    listed = lambda df: F.array_join(F.sort_array(F.collect_list("pkg")), "|").alias("v")
    col = F.col
    parts = [
        shown(readers.policies(spark, f"{top}/jsonl", f"{top}/json"), "policies", F.concat_ws("/", "pkg", "idx"), col("passage")), shown(readers.text_files(spark, f"{top}/text"), "text", col("pkg"), col("text")),
        *(shown(d.agg(listed(d)), "packages", F.lit(k), col("v")) for k, d in (("text", readers.package_ids(spark, f"{top}/p.txt")), ("csv", readers.package_ids(spark, f"{top}/p.csv")))),
        shown(readers.legal_records(spark, f"{top}/legal"), "legal", col("label"), col("commentary")), shown(readers.category_records(spark, f"{top}/category"), "category", col("label"), col("description")),
        shown(readers.legal_index(spark, f"{top}/legal/index.json"), "index", col("requirement_number"), col("label")), shown(readers.category_index(spark, f"{top}/category/index.json"), "index", col("category_number"), col("label")),
        shown(readers.category_files(spark, f"{top}/category"), "files", col("file"), F.lit("")), shown(readers.example_corpus(spark, f"{top}/corpus.json"), "corpus", col("passage"), F.array_join("labels", "|")),
        shown(readers.vector_index(spark, f"{top}/m.npy", f"{top}/meta.json"), "vectors", col("index"), F.to_json("embedding")),
    ]
    system, pairs, schema = prompts.load_prompts(spark, f"{top}/prompt")
    said = [("prompt", "system", system), *(("prompt", f"pair {n}", f"{u}>{'NULL' if a is None else a}") for n, (u, a) in zip((2, 10), pairs, strict=True)), ("prompt", "schema", json.dumps(schema))]
    made = spark.createDataFrame(said, "source string, key string, value string")
    for p in parts:
        made = made.unionByName(p)
    return made


@expect("sink, n", ("overwritten", 2), ("appended first", 2), ("appended again", 0), ("lines", 3), ("accepted", 1), ("rejected", 2), ("en", 3), ("quarantined", 3), ("logged twice", 3), ("index", 3), ("dimension", 2))
def fixture_sinks(spark, sf_dir):
    """What each sink leaves: a second run leaves no second copy."""
    top = _folder(spark, "sinks")
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1)], "pkg string, idx int")
    sinks.write_stage(df, f"{top}/stage")
    sinks.write_stage(df.distinct(), f"{top}/stage")
    out = [("overwritten", spark.read.parquet(f"{top}/stage").count())]
    out += [("appended first", sinks.append_stage(df, f"{top}/t", ["pkg", "idx"])), ("appended again", sinks.append_stage(df, f"{top}/t", ["pkg", "idx"]))]
    sinks.write_lines(df.select(F.to_json(F.struct("*")).alias("value")), f"{top}/lines")
    verdict = F.when(F.col("idx") == 0, "accepted").otherwise("rejected")
    sinks.write_by_verdict(df.withColumn("verdict", verdict), f"{top}/v")
    sinks.write_by_language(df.withColumn("lang_bucket", F.lit("en")), f"{top}/l")
    count = lambda path: spark.read.parquet(path).count()
    out += [("lines", spark.read.text(f"{top}/lines").count()), ("accepted", count(f"{top}/v/verdict=accepted")), ("rejected", count(f"{top}/v/verdict=rejected")), ("en", count(f"{top}/l/lang_bucket=en"))]
    sinks.quarantine(df.select("pkg", F.lit("detect").alias("stage"), F.lit("m").alias("message")), f"{top}/q")
    calls = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z"), ("3", "z")], "custom_id string, response string")
    logged = sinks.log_calls(calls, f"{top}/c") + sinks.log_calls(calls, f"{top}/c")
    index = spark.createDataFrame([(i, "annotate", [1.0, 2.0]) for i in range(3)], "example_id int, example_type string, embedding array<double>")
    sinks.write_index(index, f"{top}/index", "model")
    out += [("quarantined", count(f"{top}/q")), ("logged twice", logged), ("index", sinks.read_index(spark, f"{top}/index").count()), ("dimension", spark.read.json(f"{top}/index/info").first()["embedding_dimension"])]
    return spark.createDataFrame(out, "sink string, n long")
