"""Quality rules, URL filter, WARC and HTML extraction."""

import base64
import hashlib
import html
import re

import pytest
from compare import connect, differences
from slicesync.llm import htmltext, quality, urls, warc
from slicesync.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op2_url_filter", "op9_quality_rules"])
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_quality_of_edge_cases_agrees_with_sql(spark, edge_docs, no_docs, tmp_path):
    edge_docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id <> 3")
    rows = quality.judge(edge_docs.where("doc_id <> 3")).drop("lost_chars", "clean_text", "row")
    assert differences(rows, con, ORACLES["op9_quality_rules"]) == []
    assert quality.judge(no_docs).count() == 0
    assert quality.judge(edge_docs).count() == edge_docs.count()


@pytest.mark.parametrize("before,after", [("", "\r"), ("\t", ""), ("\t ", " \r"), ("\x0b", "\x0c")])
def test_lines_with_odd_ends_agree_with_sql(spark, tmp_path, before, after):
    """Marks, bars and exclamation marks at the limits and beside them, in lines that decide."""
    lines = [" ".join(["# # #", *(f"{c}{i}" for i in range(n))]) for n in range(9, 14) for c in "ab"]
    lines += [" ".join(["a|b", *(f"{c}{i}" for i in range(n))]) for n in range(1, 6) for c in "ab"]
    lines += [" ".join(["hey!", *(f"{c}{i}" for i in range(n))]) for n in range(1, 5) for c in "ab"]
    prose = " ".join(f"p{i}" for i in range(50))
    texts = [f"{prose}\n" + "\n".join([f"{before}{line}{after}"] * k) for line in lines for k in (2, 3, 4, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = quality.judge(docs).drop("lost_chars", "clean_text", "row")
    assert differences(rows, con, ORACLES["op9_quality_rules"]) == []
    bad = {(r.doc_id // 4) for r in quality.judge(docs).where("lost_chars > 0").collect()}
    plain = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert bad == {r.doc_id for r in quality.judge(plain).where("lost_chars > 0").collect()}
    assert 0 < len(bad) < len(lines)


def test_quality_runs_no_python(spark, edge_docs):
    plan = quality.judge(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_lines_that_fail_go(spark):
    prose = "This is a sentence of some ordinary length about nothing much at all. " * 6
    junk = "Home | About | Contact | Help"
    text = f"{prose}{'alpha beta gamma delta ' * 1}\n{junk}\n{prose[::-1]}"
    mostly = "\n".join([" ".join(f"w{i}x{j}%%%" for j in range(40)) for i in range(9)] + [prose[:70]])
    docs = spark.createDataFrame(
        [(1, text, "a", 5), (2, mostly, "b", 6), (3, None, "c", 7)], "doc_id long, text string, bad string, s int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[3].base_failed and not got[2].base_failed and not got[2].kept
    assert quality.clean(docs.where("doc_id <> 1")).count() == 0
    assert junk not in got[1].clean_text and got[1].clean_text.count("\n") == 1
    assert quality.clean(docs).columns == docs.columns


def test_labelled_documents_are_told_apart(spark, sf_dir):
    rows = QUERIES["op9_quality_rules"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert rows.where("quality = 1 AND NOT kept").count() == 0
    assert rows.where("quality = 0 AND kept").count() == 0


RULES = [urls.Rule("allow", "org", "/"), urls.Rule("block", "a.org", "/x"), urls.Rule("allow", "a.org", "/xy")]


@pytest.mark.parametrize("url,host,rule,verdict", [
    (None, "", None, "allow"), ("", "", None, "allow"), ("no scheme casino", "", None, "block"),
    ("http://A.ORG/x", "a.org", "a.org/x", "block"), ("http://s.a.org/xyz", "s.a.org", "a.org/xy", "allow"),
    ("http://ba.org/x", "ba.org", "org/", "allow"), ("http://org", "org", None, "allow"),
    ("http://t.net/win", "t.net", None, "allow"), ("http://t.net/win?free", "t.net", None, "block"),
    ("http://t.net/winner-win", "t.net", None, "block"), ("http://t.net/win/win", "t.net", None, "allow"),
    ("http://casinos.net/", "casinos.net", None, "allow"), ("x://CASINO.net#a://b/", "casino.net", None, "block"),
])
def test_url_rules_and_vocabulary(spark, url, host, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    got = urls.filter_urls(pages, RULES).first()
    assert (got.host, got.rule, got.verdict) == (host, rule, verdict)


def test_urls_of_an_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(none, RULES).count() == 0
    assert urls.filter_urls(none, (), strict=(), soft=()).count() == 0


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_of_the_table(spark, sf_dir):
    got = QUERIES["op5_warc"](spark, sf_dir).collect()
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    first = {}
    for number, payload in sorted(pages):
        first.setdefault(payload, number)
    assert sorted(tuple(r) for r in got) == sorted(
        (n, len(p), sha(p), "response" if first[p] == n else "revisit", None if first[p] == n else first[p])
        for n, p in pages)


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(i, f"http://h/{i}", "copy" if i % 3 == 0 else f"page {i} é", "k") for i in range(30)]
    rows += [(30, None, None, "k"), (31, "u\r\nv", "", "k"), (None, "n", "copy", "k"), (5, "again", "page 5 é", "k"),
             (32, "long", "x" * 3_000_000, "k")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, shard string")


def test_warc_files_roll_and_repeat(spark, odd_pages, tmp_path):
    folders = [str(tmp_path / n) for n in "ab"]
    sums = []
    for folder, parts in zip(folders, (1, 9)):
        manifest = warc.write_warc(odd_pages.repartition(parts), folder, file_bytes=900, shard_rows=7)
        sums.append(sorted((r.name, r.n_records, r.sha1) for r in manifest.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 5
    rows = warc.read_warc(spark, folders[0]).collect()
    assert len(rows) == odd_pages.count()
    by_digest = {}
    for r in rows:
        by_digest.setdefault(r.payload_digest, []).append(r)
    for group in by_digest.values():
        response = [r for r in group if r.record_type == "response"]
        assert len(response) == 1
        assert response[0].page_id == min((r.page_id for r in group if r.page_id is not None))
        assert sha(bytes(response[0].payload)) == response[0].payload_digest
        assert all(r.refers_to == response[0].page_id for r in group if r.record_type == "revisit")
        assert len({r.payload_bytes for r in group}) == 1


def test_warc_small_payloads_and_empty_tables(spark, odd_pages, tmp_path):
    warc.write_warc(odd_pages, str(tmp_path / "c"), revisit_bytes=5)
    rows = warc.read_warc(spark, str(tmp_path / "c"))
    assert rows.where("payload_bytes < 5 AND record_type = 'revisit'").count() == 0
    warc.write_warc(odd_pages.limit(0), str(tmp_path / "d"))
    assert warc.read_warc(spark, str(tmp_path / "d")).count() == 0


def test_a_file_without_manifest_is_not_read(spark, odd_pages, tmp_path):
    warc.write_warc(odd_pages, str(tmp_path / "e"))
    (tmp_path / "e" / "data" / "pages-000099-0000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == odd_pages.count()


def article(page):
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub("<(p|/p|br|h1|/h1)[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub("<[^>]*>", "", inner)).split())


def test_articles_of_the_table(spark, sf_dir):
    rows = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert rows[r.page_id].text == article(r.html) and rows[r.page_id].n_chars == len(rows[r.page_id].text)


LONG = "A sentence of the article that has enough words to be told from a menu."


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain  words &amp;\nmore", "plain words & more"), ("<p>&lt;b&gt; &#233;&nbsp;x", "<b> é x"),
    (f"<body><ul class='main-menu'><li><a>Home</a></ul><div id=content><p>{LONG}<p>Short.<p>{LONG}</div>"
     "<div class='sidebar'><p>More</div><section id='comments'><p>I agree with this very long remark.</section>",
     f"{LONG} Short. {LONG}"),
    (f"<header>H</header><main><h1>T</h1><p>{LONG}</p><aside>no</aside><form><p>no</form><p>End</main><footer>F",
     f"T {LONG} End"),
    (f"<nav><a>x</a><article>{LONG}<script>if (a < b) '</p>'</script> tail</article>", f"{LONG} tail"),
    (f"<article>one<b>two</b><br>three<div class=ad><div>x</div>y</div>{LONG}", f"onetwo three {LONG}"),
    ("<p class=ad>advert<p>" + LONG, LONG),
])
def test_pages_without_their_furniture(page, text):
    assert htmltext.main_text(page) == text


SIDE = "<div class='sidebar'><p>More of this kind</div>"


@pytest.mark.parametrize("page,text", [
    (f"<article><h2 id='related-work'>Related</h2><p>{LONG}<h2 id='Share_capital'>Capital</h2>"
     f"<p id='notice-period'>{LONG} <span class='share'>Short.</span></article>",
     f"Related {LONG} Capital {LONG} Short."),
    (f"<body><div class='has-sidebar'><p>{LONG}<p>{LONG}{SIDE}</div>", f"{LONG} {LONG}"),
    (f"<body><div id='page' class='no-comments'><p>{LONG}<p>{LONG}{SIDE}</div>", f"{LONG} {LONG}"),
    (f"<body><div class='hasSidebar'><p>{LONG}</div>", LONG),
    (f"<body><div class='sidebar-layout'><div class=header>Top of it</div><p>{LONG}<p>{LONG}{SIDE}</div>",
     f"{LONG} {LONG}"),
    (f"<body><p>{LONG}<div class='comments'><p>{LONG * 3}</div>", f"{LONG} {LONG * 3}"),
    (f"<body><article><p>{LONG}</article><div class='comments'><p>{LONG * 3}</div>", LONG),
    (f"<article><p>{LONG}<div class='related'><a href=x>One</div><p>{LONG}</article>", f"{LONG} {LONG}"),
    (f"<div class='nav'><a href=x>Home</div><p>{LONG}", LONG),
    ("<ul class='menu'><li><a>Home</a><li><a>About</a></ul>", ""),
    (f"<ul><li class='share'>x<li>{LONG}<li>{LONG}</ul>", f"{LONG} {LONG}"),
])
def test_names_are_judged_by_what_they_hold(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("left_open", ["<button>x", "<form>x", "<aside><div>x</div><p>y", "<span class=ad>x", "<p class=ad>x"])
@pytest.mark.parametrize("around", ["div", "section", "ul><li"])
def test_what_is_left_open_ends_with_its_ancestor(left_open, around):
    end = "</li></ul>" if "li" in around else f"</{around}>"
    page = f"<body><{around}>{left_open}{end}<section><p>{LONG}<p>Some <span>short</span> text.<p>{LONG}</section>"
    assert htmltext.main_text(page) == f"{LONG} Some short text. {LONG}"


@pytest.mark.parametrize("page,text", [
    (f"<div><aside><div>x</div></b></p>y</aside><p>{LONG}</div>", LONG),
    (f"<div><b><button>x</b>y</button><p>{LONG}</div>", LONG),
    (f"<ul><li><span class=ad>x<li>{LONG}</ul>", LONG),
    (f"<table><tr><td><form>x<td>{LONG}<tr><td>{LONG}</table>", f"{LONG} {LONG}"),
])
def test_end_tags_inside_what_is_dropped(page, text):
    assert htmltext.main_text(page) == text


def test_extraction_of_odd_tables(spark, odd_pages):
    rows = {r.page_id: r for r in htmltext.extract(odd_pages).collect()}
    assert rows[30].text == "" and rows[30].n_chars == 0 and rows[32].n_chars == 3_000_000
    assert htmltext.extract(odd_pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert htmltext.smoothed([5.0] * 4) == pytest.approx([5.0] * 4)
    assert 2 < htmltext.threshold([1, 2, 1, 90, 100, 95]) < 90


POST = "<p>The post has a first paragraph of some length that says what it is about.</p><p>Short end.</p>"
SAID = "The post has a first paragraph of some length that says what it is about. Short end."
NOTE = "A reader writes a comment of some length here, which is not the post."


@pytest.mark.parametrize("rest", [
    f'<div id="comments" class="comments-area"><ol class="comment-list"><li class="comment">'
    f'<article class="comment-body"><p>{NOTE}</p></article></li></ol></div>',
    f'<section class="reactions"><article><p>{NOTE}</p></article></section>',
    f'<div class="user-reviews"><p>{NOTE}</p></div>', f'<div class="responses"><div><p>{NOTE}</p></div></div>',
    f'<div class="comentarios"><p>{NOTE}</p></div>', f'<ul id="kommentare"><li>{NOTE}</li></ul>',
    f'<div class="author-box"><p>{NOTE}</p></div>', f'<article class="comment"><p>{NOTE}</p></article>',
    f'<div aria-hidden="true"><p>{NOTE}</p></div>', f'<div style="color:red; display : none"><p>{NOTE}</p></div>',
])
def test_what_stands_beside_a_post_in_main(rest):
    page = f"<html><body><main><article>{POST}</article>{rest}</main><footer>x</footer></body></html>"
    assert htmltext.main_text(page) == SAID


@pytest.mark.parametrize("name", ["reactions", "responses", "user-reviews", "comentarios", "kommentare", "comments"])
def test_comments_within_an_article(name):
    page = f'<body><article>{POST}<div class="{name}"><article><p>{NOTE}</p></article></div></article></body>'
    assert htmltext.main_text(page) == SAID
    hidden = f'<body><article>{POST}<p style="visibility:hidden">{NOTE}</p><span aria-hidden="true">x</span></article></body>'
    assert htmltext.main_text(hidden) == SAID


def test_two_articles_in_main_stay():
    page = f"<body><main><article>{POST}</article><article><p>{NOTE}</p></article></main></body>"
    assert htmltext.main_text(page) == f"{SAID} {NOTE}"


def test_a_section_by_the_name_of_its_heading_stays():
    page = f'<body><article>{POST}<section id="related"><h2>Related work</h2><p>{NOTE}</p></section></article></body>'
    assert htmltext.main_text(page) == f"{SAID} Related work {NOTE}"


def test_a_page_of_comments_has_no_other_text():
    many = "".join(f'<li class="comment"><p>{NOTE} {i}</p></li>' for i in range(9))
    page = f'<body><h1>Thread</h1><div class="comments"><ol>{many}</ol></div></body>'
    assert htmltext.main_text(page) == "Thread"
