import json
import time

from archivemill.llm import op3_wrappers as op


def tree(html):
    return op.as_wrapper(op.parse(html))


def test_alignment_finds_slots_options_and_groups():
    pages = [
        "<body><h1>Shop</h1><ul><li>a</li><li>b</li></ul><p>one</p></body>",
        "<body><h1>Shop</h1><ul><li>c</li></ul><b>new</b><p>two</p></body>",
    ]
    wrapper = op.align(*map(tree, pages))
    assert op.expression(wrapper) == (
        "<#page><body><h1>Shop</h1><ul>(<li>#TEXT</li>)+</ul>(<b>new</b>)?<p>#TEXT</p></body></#page>"
    )
    pairs = tree("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")
    assert op.expression(pairs) == "<#page><dl>((<dt>#TEXT</dt><dd>#TEXT</dd>))+</dl></#page>"


def test_template_texts_go_and_the_main_element_is_found(spark):
    html = "<div class=a><span>Menu here</span></div><div class=b><p>Read this: </p><div>{}</div></div>"
    rows = [(i, f"http://h/{i}", html.format(f"text number {i} &amp; more " * 20)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in op.main_text(pages).collect()}
    assert all(found[i] == (f"text number {i} & more " * 20).strip() for i in range(40))


def test_template_texts_of_small_hosts_and_uneven_pages(spark):
    notice = "This long notice stands on every page of the host. " * 8
    html = "<article><div class=top>Top line</div><p>{0}</p><ul><li><p>Read</p><b>{0} b</b></li><li><p>Read</p><b>{0} c</b></li></ul>{1}<p>{0}, x</p></article><div>{0}</div>"
    part = f"<div class=low><span>{notice}</span></div>"
    own = [f"words {i} of their own" for i in range(8)]
    rows = [(i, "http://small/", html.format(own[i], part if i < 6 else "")) for i in range(7)]
    rows += [(7, "http://small/", "x"), (8, "http://single/", html.format(own[0], part)), (9, "http://twin/", "<p>a</p>"), (10, "http://twin/", "<p>a</p>")]
    found = {r.page_id: r.text for r in op.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    for i in range(7):
        assert found[i].split("\n") == [own[i], f"{own[i]} b", f"{own[i]} c", f"{own[i]}, x"]
    assert found[7] == "x" and found[9] == "a" and "Top line" in found[8] and notice.strip() in found[8]


def test_parts_that_are_no_article():
    html = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>Top</header><nav><a>Home</a></nav><div class="cookie-notice">Cookies</div>
    <article><header><h1>Title</h1></header><p>First &lt;b&gt;
      line<br>second <b>bold</b>.<div class="ad">Buy</div><!-- no --><form><input> go</form>
      <p>Third&nbsp;one<aside>side</aside><section id="comments"><p>nice!</p></section><p hidden>h</p></article>
    <footer>&copy; me</footer></body></html>"""
    assert op.extract(html) == "Title\nFirst <b> line\nsecond bold.\nThird one"
    assert op.extract("no tags  at\nall") == "no tags at all" and op.extract("<p>a<p>b") == "a\nb"
    assert op.extract(None) == op.extract("") == op.extract("<nav>x</nav>") == ""


def test_ids_of_sections_are_kept_and_articles_in_widgets_are_found():
    html = """<body><article><h2 id="share">Share</h2><p id="notice">Note</p><section id="related-work"><h3>Related work</h3>
    <p>Others did this.</p></section><div id="search-methods">We asked <a>one</a> base.</div>
    <div id="related-posts"><h3><a>One post</a></h3><a>Another post</a></div><div id="comment-list">nice text!</div>
    <div id="share">on x</div><div class="related-links">see</div></article></body>"""
    assert op.extract(html).split("\n") == ["Share", "Note", "Related work", "Others did this.", "We asked one base."]
    assert op.extract("<body><p>Top</p><div class='widget'><article><p>The article</p></article></div></body>") == "The article"
    teaser = "<body><p>The text of the page</p><div class='related'><article>teaser</article></div></body>"
    assert op.extract(teaser) == "The text of the page"
    assert op.extract("<body><main></main><p>The text</p></body>") == "The text"


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r for r in op.main_text(pages).collect()}
    assert len(rows) == pages.count()
    for page in pages.collect():
        article = page.html.split("<article>")[1].split("</article>")[0]
        text = rows[page.page_id].text
        assert rows[page.page_id].n_chars == len(text) and "track(" not in text
        plain = op.unescape(op.re.sub(r"<[^>]*>", "\n", article))
        assert text.split() == plain.split()


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, None, "<p>a"), (3, None, "<p>a"), (None, "http://h", "<" * 5000), (4, "http://h", "<div>" * 300 + "z")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, _host int")
    found = [(r.page_id, r.text) for r in op.main_text(pages).collect()]
    assert sorted(found, key=str) == sorted([(1, ""), (2, ""), (3, "a"), (3, "a"), (None, "<" * 5000), (4, "z")], key=str)
    assert op.main_text(pages.limit(0)).count() == 0


def test_hostile_pages_end_soon():
    deep = "<div>" * 5000 + "<nav><p>menu</p></nav>" + "in<b>si</b>de <p>last</p>" + "</div>" * 5000 + "<p>after</p>"
    pages = [
        deep, "<a " * 300_000, "<a <b" * 200_000, '<a href="x' * 100_001, "<a '\"" * 200_001, "<x><table>" + "<div>" * 50_000 + "</x>" * 50_000,
        "<p>" + "<!--" * 100_000, "<i>" * 100_000 + "word", "".join(f"<t{i}>{i}</t{i}>" for i in range(3000)),
    ]
    for page in pages:
        start = time.perf_counter()
        wrapper = op.as_wrapper(op.parse(page))
        again = op.Node.unpack(json.loads(json.dumps(op.align(wrapper, op.as_wrapper(op.parse(page + "<p>x</p>"))).pack())))
        op.main_place(again), op.varies(again), op.texts_of(op.parse(page)), op.expression(again)
        op.extract(page, {"template": [1], "main": "/div"})
        assert time.perf_counter() - start < 15, page[:20]
    words = "".join(op.extract(deep).split())
    assert words == "insidelastafter"


def test_deep_parts_keep_order_and_what_is_left_out():
    def page(n):
        inner = "one<div>two</div>three<div class='comments'>no<div>no</div>no</div><ul><li>four<li>five</ul>six<br>seven"
        return "<article>" + "<div>" * n + inner + "</div>" * n + "<p>end</p></article><p>outside</p>"

    assert op.extract(page(1000)) == op.extract(page(3)) == "one\ntwo\nthree\nfour\nfive\nsix\nseven\nend"


def test_wrappers_do_not_grow_with_pages():
    pages = [op.as_wrapper(op.parse("<p>same</p>" + "".join(f"<t{i}x{n}>w</t{i}x{n}>" for i in range(100)))) for n in range(12)]
    wrapper = pages[0]
    for page in pages[1:]:
        wrapper = op.align(wrapper, page)
    assert len(wrapper.children) == op.PARTS_KEPT and wrapper.children[0].pages == 12
