from lodestrata.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>One
  two<br>three<p>Four&nbsp;&eacute;</p><div class="comments"><p>me first</p></div></article><footer>&copy; x</footer></body></html>"""


def test_article():
    assert html.extract(PAGE) == "Head & more\nOne two three\nFour é"


def test_cut_off_and_empty():
    assert html.extract(None) == html.extract("") == ""
    assert html.extract("<article><p>a &lt b<p>c <b") == "a < b\nc"
    assert html.extract("just text") == "just text"
    assert html.extract("<article><p>x</p></article><article><p>y</p></article>") == "x\ny"
    assert html.extract("<body><p>a</p><form><input>f</form><aside>s</aside></body>") == "a"


def test_wrapper_expression():
    a = html.Wrapper.of("<ul><li>1</li><li>2</li><li>3</li></ul><p>same</p><pre>x</pre>")
    assert a.expression() == '(ul (li #)+) (p "=") (pre "=")'
    a.align(html.Wrapper.of("<ul><li>9</li></ul><hr><p>same</p><pre>y</pre>"))
    assert a.expression() == '(ul (li #)+) (hr)? (p "=") (pre #)'
    a.align(html.Wrapper.of("<p>same</p><pre>z</pre><ul class='n12 post-7'></ul>"))
    assert a.expression() == '(ul (li #)*) (hr)? (p "=") (pre #)'
    assert html.Wrapper.load(a.dump()).dump() == a.dump() and a.template() == {"p"}


def test_wrappers_add_up_in_any_order():
    pages = [PAGE.replace("One", f"One {k}").replace("Buy", f"Buy {k % 2}") + "<ul>" + "<li>z</li>" * k + "</ul>" for k in range(7)]
    def whole(order):
        parts = [html.Wrapper.of(pages[k]) for k in order]
        left, right = parts[0], parts[3]
        for x in parts[1:3]:
            left.align(x)
        for x in parts[4:]:
            right.align(x)
        left.align(right)
        return left.dump()
    assert len({whole(o) for o in ([0, 1, 2, 3, 4, 5, 6], [6, 2, 4, 0, 1, 5, 3], [3, 4, 5, 6, 0, 1, 2])}) == 1


def test_template_slots_go_where_no_article_is_marked(spark):
    page = '<html><body><div class="top">Our site</div><div class="main"><p>{0}</p></div><p class="x"><a href=1>{0} link</a></p></body></html>'
    rows = [(k, f"http://h.example/{k}", page.format(f"text {k}")) for k in range(5)] + [(9, "http://alone.example/", page.format("alone")), (10, None, None), (11, "::", "<p>z"), (11, "::", "<p>z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    for limit in (100, -1):
        got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(df, ["page_id", "url"], most_broadcast=limit).collect())
        assert got == [(k, f"text {k}", 6) for k in range(5)] + [(9, "Our site\nalone", 14), (10, "", 0), (11, "z", 1), (11, "z", 1)]
    assert html.extract_pages(df.limit(0), ["page_id"]).count() == 0


def brute(page):
    """Main text of the test pages, whose article is marked: by the standard library's parser."""
    import re
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.blocks, self.held, self.on = [], [], False

        def flush(self):
            t = " ".join("".join(self.held).split())
            self.held = []
            if t:
                self.blocks.append(t)

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "h1", "article"):
                self.flush()
            if tag == "br":
                self.held.append(" ")
            self.on = self.on or tag == "article"

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.flush()
            if tag == "article":
                self.on = False

        def handle_data(self, data):
            if self.on:
                self.held.append(data)

    p = P()
    p.feed(re.sub(r"(?s)<(script|style)>.*?</\1>", "", page))
    p.close()
    p.flush()
    return "\n".join(p.blocks)


def test_all_pages_against_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in html.op9_html_extraction(spark, sf).collect()}
    assert got == {k: brute(v) for k, v in pages.items()}


def test_wrapper_decides_on_pages_with_a_marked_article(spark):
    page = '<html><body><div class="page has-sidebar"><article><p>Text {0}</p><div class="x1"><p>Read our terms first</p></div><p>and <i>ibid.</i> more {0}</p></article></div></body></html>'
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(4)] + [(9 + k, "http://copies.example/", page.format("same")) for k in range(4)]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert [got[k] for k in range(4)] == [f"Text {k}\nand ibid. more {k}" for k in range(4)]
    # copies of one page show no template
    assert {got[9 + k] for k in range(4)} == {"Text same\nRead our terms first\nand ibid. more same"}


def test_a_marked_article_is_never_left_out():
    assert html.extract('<div class="page has-sidebar"><article><p>x</p></article></div>') == "x"
    assert html.extract('<form><div role="main" class="with sidebar"><p>x</p></div></form>') == "x"
    assert html.extract('<article><p>x</p><section class="comments"><article><p>me first</p></article></section></article>') == "x"
    assert html.extract('<article><p>x</p></article>', {"article>p"}) == "x"


def test_links_within_a_kept_block_stay():
    page = "<div><p>See the <a href=x>user <b>manual</b></a> for details</p><ul><li><a href=y>Home</a></li><li><a href=z>News</a> |</li></ul></div>"
    assert html.extract(page, html.Wrapper.of(page).template()) == "See the user manual for details"


def test_template_behind_many_tokens():
    group = "".join(f'<div class="c{j}">{{0}} {j}</div>' for j in range(700))
    pages = [group.format(k) + '<div class="last">Notice of the site</div>' for k in range(4)]
    whole = html.Wrapper.of(pages[0])
    for page in pages[1:]:
        whole.align(html.Wrapper.of(page))
    assert html.extract(pages[2], html.Wrapper.load(whole.dump()).template()) == "\n".join(f"2 {j}" for j in range(700))


def test_pages_without_article_tags(spark):
    """With the article tags taken out, the wrapper finds the same text on hosts with pages enough to infer one, however the pages lie in partitions."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "url", "regexp_replace(html, '</?article>', '') AS html")
    want = {r.page_id: brute(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {r.page_id: r.text for r in html.extract_pages(pages, ["page_id"]).collect()}
    again = {r.page_id: r.text for r in html.extract_pages(pages.repartition(9), ["page_id"]).collect()}
    assert first == again
    host = {r.page_id: html.host_of(r.url) for r in pages.collect()}
    many = {k for k in want if sum(h == host[k] for h in host.values()) >= 5}
    assert len(many) >= 100
    assert {k: first[k] for k in many} == {k: want[k] for k in many}


def test_names_of_text_elements_and_quotes():
    assert html.extract('<article><header><h1>T</h1></header><p class="social-science">a</p><math><mi>x</mi></math></article>') == "T\na\nx"
    assert html.extract('<article><p>it<a title="x>y</a> z</p><p class="c">w</p></article>') == "ity z\nw"
    assert html.extract("<p>a <b title='x>y' id=\"q\">c</b> <i title=\"") == "a c"
    assert html.extract('<p>a</p><br/><div/>b' + "<p>long " * 20_000).count("\n") == 20_001


def test_clashing_columns_and_ties(spark):
    rows = [(k, "http://h/x", f"<div><p>a {k} {k}</p></div><section><p>b {k} {k}</p></section>", "t", 5) for k in range(4)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host long"), ["page_id", "text", "_host"])
    assert got.columns == ["page_id", "_host", "text", "n_chars"]
    # neither of two equal elements holds more than half of the slot words, so both are kept
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(k, f"a {k} {k}\nb {k} {k}") for k in range(4)]


def _on_a_host(spark, *bodies):
    """The texts of pages of one host."""
    from lodestrata.llm.html import extract_pages

    rows = [(i, "http://one.example/%d" % i, body) for i, body in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in extract_pages(pages, ["page_id"]).orderBy("page_id").collect()]


def _words(i, n=40):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_constant_headings_inside_the_article_stay(spark):
    got = _on_a_host(spark, *(f"<article><h1>T{i}</h1><p>{_words(i)}</p><h2>Introduction</h2><p>{_words(i + 50)}</p></article>" for i in range(6)))
    assert got == [f"T{i}\n{_words(i)}\nIntroduction\n{_words(i + 50)}" for i in range(6)]
    got = _on_a_host(spark, *(f"<div id=c><h1>T{i}</h1><p>{_words(i)}</p><h3>Details</h3><p>{_words(i + 50)}</p></div>" for i in range(6)))
    assert got == [f"T{i}\n{_words(i)}\nDetails\n{_words(i + 50)}" for i in range(6)]


def test_a_constant_end_goes_and_a_lead_stays(spark):
    got = _on_a_host(spark, *(f"<article><h1>T{i}</h1>" + "".join(f"<p>{_words(10 * i + k)}</p>" for k in range(1 + i % 3)) + "<p>Subscribe to our mailing list today</p></article>" for i in range(6)))
    assert got == ["\n".join([f"T{i}", *(_words(10 * i + k) for k in range(1 + i % 3))]) for i in range(6)]
    got = _on_a_host(spark, *(f"<div id=c><h1>T{i}</h1><div class=lead>Short {i}</div><p>{_words(i)}</p><p>{_words(i + 20)}</p></div>" for i in range(6)))
    assert got == [f"T{i}\nShort {i}\n{_words(i)}\n{_words(i + 20)}" for i in range(6)]


def test_left_out_elements_in_a_line_do_not_part_it(spark):
    got = _on_a_host(spark, "<p>Hello <script>x()</script>world <button>go</button>again <svg><text>t</text></svg>end</p>", "<article><p>one <label>l</label>two</p></article>")
    assert got == ["Hello world again end", "one two"]


def test_names_that_only_look_like_template(spark):
    got = _on_a_host(
        spark, "<body><form action=x><div><h1>All in a form</h1><p>still text</p></div></form></body>", '<article><div class="notice-of-motion"><p>moved</p></div><ul class="related-work"><li>kept</li></ul></article>',
        '<article><p>text</p><div id="responses"><p>first!</p></div><div class="user-reviews"><p>nice</p></div><div class="comments-area"><p>no</p></div></article>',
    )
    assert got == ["All in a form\nstill text", "moved\nkept", "text"]
