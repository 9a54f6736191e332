from veilframe.llm.html_text import extract

SITE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/{i}">menu {i}</a></li></ul></nav><div class="ad">buy {i}</div><!-- <p>no</p> -->
{open}<h1>Head {i} &amp; more</h1><p>One&nbsp;two
 three <b>bold<br>x<p>Own words {i} &lt;b&gt; &eacute;<ul><li>item {i}<li>second</ul><div class="box"><p>Read our rules.</p></div>
<div class="comments"><p>first!</p></div>{close}<aside>side</aside><form><input value="q"><button>go</button></form>
<script>if (a < b) document.write("<p>no</p>")</script><footer>&copy; me</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host", "2 as uid")
    return {r.page_id: r for r in extract(df).collect()}


def test_article_and_template(spark):
    rows = [(i, f"https://a.example/{i}", SITE.format(i=f"n{chr(97 + i)}", open="<article>", close="</article>")) for i in range(8)]
    rows += [(100 + i, f"http://b.example:80/{i}", SITE.format(i=f"m{chr(97 + i)}", open="<div>", close="</div>")) for i in range(8)]
    rows += [(200, "https://c.example/", SITE.format(i="z", open="<main>", close="</main>"))]
    out = run(spark, rows)
    assert out[3].text == "Head nd & more\n\nOne two three bold x\n\nOwn words nd <b> é\n\nitem nd\n\nsecond"
    assert out[105].text == "Head mf & more\n\nOwn words mf <b> é\n\nitem mf"      # no article element: whatever recurs goes
    assert all(out[i].n_chars == len(out[i].text) and out[i].n_template > 0 for i in (3, 105))
    assert out[200].text.endswith("second\n\nRead our rules.")          # one page is no template


def test_copies_are_no_template(spark):
    page = "<body><div><p>The same text on many pages.</p><p>And more of it.</p></div></body>"
    out = run(spark, [(i, "http://h/", page) for i in range(30)])
    assert {r.text for r in out.values()} == {"The same text on many pages.\n\nAnd more of it."}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h", ""), (3, "x", "plain & simple < text"), (4, "http://h", "<p>cut &am"), (5, "http://h", '<p title="a>b">t</p><a href="'),
            (None, "http://h", "<article>" * 3000 + "deep"), (7, "http://h", "<p>" * 30000 + "long " * 100000), (8, "http://h", "<script>x"),
            (9, "http://h", "<P>up</P><BR><p>don't</p>"), (10, "http://h", "<article class=comment><p>no</p></article><p>yes</p>")]
    out = run(spark, rows)
    texts = {k: r.text[:30] for k, r in out.items()}
    assert texts == {1: "", 2: "", 3: "plain & simple < text", 4: "cut &am", 5: "t", None: "deep", 7: ("long " * 6)[:30], 8: "", 9: "up\n\ndon't", 10: "yes"}
    assert out[7].n_chars == 499999 and run(spark, []) == {}


def test_paragraph_in_many_articles_stays(spark):
    rows = [(i, "http://h/", f"<article><h1>Title {'abcdefghij'[i]}</h1><p>A passage they share.</p><p>own {'klmnopqrst'[i]}</p></article>") for i in range(10)]
    assert all("A passage they share." in r.text for r in run(spark, rows).values())


def test_head_without_end_tag(spark):
    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style>\n<script>x</script>"
    bodies = ["<body><p>own words</p>", "<p>own words</p>", "<article><p>own words</p></article>", "<br>own words", "own words", "</head><body>own words", "<head><body><p>own words"]
    out = run(spark, [(i, f"http://h{i}/", head + b) for i, b in enumerate(bodies)] + [(99, "http://h/", head)])
    assert {i: r.text for i, r in out.items()} == {i: "own words" for i in range(len(bodies))} | {99: ""}


def test_a_mark_never_cuts_the_article(spark):
    bodies = ['<div class="layout with-sidebar"><article><p>own words</p></article><div class="sidebar">more</div></div>',
              '<article class="post type-post comments-open"><p>own words</p><div class="comments"><p>said a reader, at length</p></div></article>',
              '<div id="no-js-banner-page"><p>own words</p></div><div class="menu">x</div>',
              '<div class="comments"><p>a very long thread of many comments that readers wrote</p></div><main><p>own words</p></main>',
              '<section id="comments"><article><p>a comment</p></article></section><article><p>own words</p></article>' * 1,
              '<main><div class="widget-page"><article><p>own words</p></article></div></main>']
    out = run(spark, [(i, f"http://h{i}/", f"<body>{b}</body>") for i, b in enumerate(bodies)])
    texts = {i: r.text for i, r in out.items()}
    assert {i: t for i, t in texts.items() if i != 5} == {i: "own words" for i in range(5)}


def test_header_of_an_article(spark):
    page = "<body><header>Site</header><article><header><h1>Title</h1><p>By X, 3 min</p></header><p>own words</p></article></body>"
    assert run(spark, [(1, "http://h/", page), (1, "http://h/", page)])[1].text == "Title\n\nown words"


def unmarked(i):
    """A page without article elements or telling classes."""
    own = "".join("abcdefghij"[int(d)] for d in str(i + 100))
    return (f"<body><div class=top><div>Home</div><div>News</div></div><div class=c{i % 3}><h1>About {own}</h1><p>What {own} did.</p><p>Then {own} left.</p></div>"
            f"<div class=low><p>All rights stay with us.</p><p>Read on</p></div></body>")


def brute_templates(pages, min_pages, min_share):
    """Texts of each page without the divisions that stand, whole, on enough different pages."""
    import re
    parts = [re.findall(r"<div class=\w+>(.*?)</div>(?=<div class|</body)", p) for p in pages]
    on = {}
    for i, own in enumerate(parts):
        for part in own:
            on.setdefault(part, set()).add(i)
    enough = max(min_pages, min_share * len(pages))
    left = [[part for part in own if len(on[part]) < enough] for own in parts]
    return ["\n\n".join(t for part in own for t in re.sub("<[^>]*>", "\n", part).split("\n") if t) for own in left]


def test_counts_alone_remove_menus_and_notices(spark):
    pages = [unmarked(i) for i in range(40)] + ["<body><div class=top><div>Home</div><div>News</div></div><div class=rare><p>On two pages.</p></div>" + x + "</body>" for x in
                                                  ("<div class=c1><p>one</p></div>", "<div class=c1><p>two</p></div>")]
    out = run(spark, [(i, "http://h/", p) for i, p in enumerate(pages)])
    assert [out[i].text for i in range(len(pages))] == brute_templates(pages, 5, 0.01)
    assert out[0].text.startswith("About") and out[0].n_template == 2
    alone = run(spark, [(i, f"http://h{i}/", p) for i, p in enumerate(pages)])
    assert all(r.n_template == 0 and "Home" in r.text for r in alone.values())


def test_prose_on_most_pages_of_a_host_goes(spark):
    own = lambda i: "".join("abcdefghij"[int(d)] for d in str(i + 100))
    page = lambda i: f"<article><p>What {own(i)} did at length and then some more.</p>" + "<p>A passage that some share.</p>" * (i % 4 == 0) + "<p>Follow us everywhere.</p></article>"
    out = run(spark, [(i, "http://h/", page(i)) for i in range(40)])
    assert not any("Follow us" in r.text for r in out.values())
    assert sum("A passage" in r.text for r in out.values()) == 10


def test_texts_move_only_where_many_articles_are_touched(spark, monkeypatch):
    from veilframe.llm import common
    own = lambda i: "".join("abcdefghij"[int(d)] for d in str(i + 100))
    rows = [(i, "http://h/", f"<article><p>What {own(i)} did at length and then some more.</p><p>Follow us everywhere.</p></article><div>Home</div>") for i in range(20)]
    rows += [(50 + i, "http://g/", unmarked(i)) for i in range(20)] + [(None, None, None), (3, "http://h/", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")

    def moved():
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = extract(df)
            return "hashpartitioning(uid" in out._jdf.queryExecution().executedPlan().toString(), sorted(map(repr, out.collect()))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few, there = moved()        # the session's own choice is off
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    many, same = moved()
    assert not few and many and there == same and "Follow us" not in "".join(there)
