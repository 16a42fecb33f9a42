import re
from html import unescape

from millrace.llm import html


def test_article_of_every_page(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op4_html_extraction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*(>|$)", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert r.text == " ".join(unescape(plain).split()) and r.n_chars == len(r.text)


BODY = "<p>The first paragraph has a good many words of plain text in it.</p><p>So has the second one, which goes on for a while.</p>"
TEXT = "The first paragraph has a good many words of plain text in it. So has the second one, which goes on for a while."


def page(inner):
    return f"<html><head><title>t</title><script>x='<p>no</p>'</script></head><body>{inner}</body></html>"


def test_parts_around_the_article_go():
    for noise in (
        "<header><h1>Site</h1></header>", "<nav><a href=x>Home</a></nav>", "<aside>Look at this other long text over here, please.</aside>",
        "<footer>Words of the owner of this place and his rights.</footer>", "<form>Your name <input></form>", "<style>p{}</style>",
        '<div class="cookie-notice">We use cookies to make this better for you.</div>', '<div id="comments"><p>I liked it a lot, thanks.</p></div>',
        '<ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>', '<div class="ad-box">Buy this thing now.</div>', "<!-- gone -->",
    ):
        for inner in (f"<article>{BODY}</article>", f"<div class=x1>{BODY}</div>", f"<main>{BODY}</main>"):
            assert html.main_text(page(noise + inner)) == TEXT, (noise, inner)
            assert html.main_text(page(inner + noise)) == TEXT, (noise, inner)


def test_names_of_classes():
    for name, kept in (
        ("page-header", False), ("content with-sidebar", True), ("post has-ads", True), ("article-body ad-free", True), ("siteFooter", False),
        ("comment-content", False), ("reader", True), ("gradient", True), ("leadText", True), ("entry-footer", False),
    ):
        text = html.main_text(page(f'<div><div>{BODY}</div><div class="{name}"><p>More words of some other kind stand in here.</p></div></div>'))
        assert ("other kind" in text) == kept, name


def test_links_without_a_name_are_pruned():
    links = "<div><a href=1>Read more of it</a> <a href=2>And some more</a> <a href=3>Yet more</a></div>"
    assert html.main_text(page(f"<div>{links}<div>{BODY}</div></div>")) == TEXT


def test_blocks_inline_and_references():
    assert html.main_text("<article><h1>A &amp; B</h1><p>x<b>y</b>z<br>w &eacute;&#33;<p>next</article>") == "A & B xyz w é! next"


def test_broken_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    assert html.main_text("a < b") == "a < b"
    assert html.main_text("<article><p>cut off mid <b") == "cut off mid"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert html.main_text("<b>" * 50_000 + "x</i>" * 50_000).count("x") == 50_000
    assert html.main_text("<script>never closed <p>x") == ""


def test_empty_table_and_repeats(spark):
    schema = "page_id long, url string, html string, text string"
    assert html.extract_text(spark.createDataFrame([], schema)).collect() == []
    twice = html.extract_text(spark.createDataFrame([(1, None, "<p>a</p>", "z")] * 2, schema)).collect()
    assert [tuple(r) for r in twice] == [(1, None, "a")] * 2


def test_density_decides_and_sibling_articles_stay():
    other = "<p>The second article has a good many words of plain text as well.</p><p>They go on for quite a while after that.</p>"
    OTHER = "The second article has a good many words of plain text as well. They go on for quite a while after that."
    for around in ("{}", "<main>{}</main>", "<div><div>{}</div></div>"):
        both = around.format(f"<article>{BODY}</article><article>{other}</article>")
        assert html.main_text(page(both)) == f"{TEXT} {OTHER}", around
    uneven = f"<article>{BODY}{other}{BODY}{other}</article><article>{BODY}</article>"
    assert html.main_text(page(uneven)) == " ".join([TEXT, OTHER, TEXT, OTHER, TEXT])
    # a teaser marked as an article does not win over the text of the page
    teaser = "<article><p>Read this.</p></article>"
    assert TEXT in html.main_text(page(f"{teaser}<div>{BODY}{other}</div>"))
    # below the threshold at an inner level of the path
    thin = "<div><i>a</i><i>b</i><i>c</i><i>d</i></div>"
    assert html.main_text(page(f"<div>{thin}<div>{BODY}{other}</div></div>")) == f"{TEXT} {OTHER}"


def test_linked_blocks_of_the_article_stay():
    cited = "<p><a href=1>One source of it</a>, <a href=2>another source</a></p><ul><li><a href=3>Third work</a> <a href=4>Fourth work</a></ul>"
    table = "<table><tr><td><a href=5>Fifth</a> <a href=6>Sixth</a></td></tr></table>"
    for tag in ("article", "main"):
        got = html.main_text(page(f"<{tag}>{BODY}{cited}{table}</{tag}>"))
        assert got == f"{TEXT} One source of it, another source Third work Fourth work Fifth Sixth"


def test_deep_pages_are_linear():
    import time

    for page in ("<div>" * 50_000 + "<li>x</li>" * 50_000, "<div>" * 50_000 + "<header>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<p>" + "<span>" * 50_000 + "<div>x" * 30_000):
        start = time.process_time()
        html.main_text(page)
        assert time.process_time() - start < 8


def test_names_inside_an_article_are_about_its_subject():
    kept = '<article><section class="related-work"><p>Earlier studies of rivers.</p></section><p id="copyright">Law of copying.</p><h2 id="notice">Notice</h2><p>Text.</p></article>'
    assert html.main_text(kept) == "Earlier studies of rivers. Law of copying. Notice Text."
    dropped = '<article><p>Rivers run to the sea and back.</p><div class="ad-box">Buy boats</div><div id="comments">First!</div><form>Sign up</form></article>'
    assert html.main_text(dropped) == "Rivers run to the sea and back."


def test_densities_choose_where_names_tell_nothing():
    long = "The river rises in the hills, and its water, cold and clear, runs down through the woods to the plain where the town stands. "
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
    page = (
        f'<body><div><ul>{links}</ul></div><div><div><p>{long * 3}</p><p>{long * 2}</p><p>{long}</p></div></div>'
        '<div><a href="/a">Terms</a> <a href="/b">Help</a></div></body>'
    )
    assert html.main_text(page) == " ".join([(long * 3).strip(), (long * 2).strip(), long.strip()])
