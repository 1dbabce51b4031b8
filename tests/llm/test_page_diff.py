import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from support import SF0001
from quire.llm import page_diff as P


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    at = P.common(a, b)
    assert len(at) == lcs(a, b) and at == sorted(set(at))
    it = iter(b)
    assert all(a[i] in it for i in at)


def test_blocks_and_chrome():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><header>Site</header><!-- x <p>no</p> --><div class="top ad">Buy</div>
    <div id="cookie-notice">We use</div><article><header><h1>A&nbsp;&lt;B&gt; &amp C</h1></header><p><b>One<br>two<i> three
    <p>Four &quot;x&quot;</p><ul><li>five<li>six</ul><div class="comments"><p>reader</p></div><form><p>f</p></form>
    <table><tr><td>c1<td>c2</table><p hidden>h</p>tail</article><aside>side</aside><footer>&copy; f</footer></body>"""
    got = P.page_lines(page)
    assert [t for t, k in got if k == P.MAIN_LINE] == ["A <B> & C", "One two three", 'Four "x"', "five", "six", "c1", "c2", "tail"]
    assert not [t for t, k in got if k == P.OPEN_LINE]


def test_articles_of_all_pages(spark):
    rows = spark.read.parquet(f"{SF0001}/pages.parquet")
    want = {}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", body)
        import html
        clean = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in blocks]
        want[r.page_id] = "\n\n".join(filter(None, clean))
    got = P.main_text(rows).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_shared_lines_of_the_nearest_page_are_deleted(spark):
    page = lambda t: f"<body><p>Welcome to the site</p><p>{t}</p><p>Imprint</p></body>"
    rows = [(i, f"http://h.example/a/{i:03d}", page(f"text {i}")) for i in range(40)]
    rows += [(100, "http://one.example/x", page("alone")), (101, None, None), (102, None, ""), (None, "x", page("odd")),
             (200, "http://c.example/a", page("copy")), (201, "http://c.example/b", page("copy")), (200, "http://c.example/a", page("copy"))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, row int")
    got = P.main_text(df).collect()
    text = {}
    for r in got:
        text.setdefault(r.page_id, set()).add(r.text)
    assert len(got) == len(rows) and all(text[i] == {f"text {i}"} for i in range(40))
    assert text[100] == {"Welcome to the site\n\nalone\n\nImprint"} and text[101] == text[102] == {""}
    assert text[200] == text[201] == {"Welcome to the site\n\ncopy\n\nImprint"}
    assert P.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_very_long_pages():
    rng = random.Random(1)
    lines = [f"l{rng.randrange(3000)}" for _ in range(6000)]
    other = lines[:]
    for _ in range(500):
        other[rng.randrange(6000)] = "new"
    at = P.common(lines, other)
    assert len(at) >= 5500 and [lines[i] for i in at] == [x for x in (lines[i] for i in at)]
    assert len(P.page_lines("<p>" + "word " * 400_000 + "<p>b<c" + "<" * 2000)) >= 2


def test_a_head_without_its_end_and_formulas():
    kept = lambda page: [x for x, k in P.page_lines(page) if k != P.CHROME_LINE]
    start = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><script>1</script>"
    assert kept(start + "<body><p>one<p>two") == ["one", "two"]
    assert kept(start + "<div><p>one</div>two") == ["one", "two"] and kept(start + " bare text<p>one") == ["bare text", "one"]
    assert kept("<head><title>T</title><link rel=x></head><body>a") == ["a"] and kept("<head><title>T") == []
    formula = "<math><semantics><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='t'>E=m</annotation></semantics></math>"
    assert kept(f"<article><p>so {formula} holds</article>") == ["so E=m holds"]


def test_chrome_words_on_wrappers_do_not_drop_the_page():
    kept = lambda page: [x for x, k in P.page_lines(page) if k != P.CHROME_LINE]
    article = "<nav>menu</nav><article><h1>Title</h1><p>long text of it</p></article><aside><article>teaser</article></aside>"
    for wrap in ('<div class="site-content sidebar-right">', '<div class="no-sidebar">', '<div id="page" class="has-header">',
                 '<form action="/">', '<div style="visibility: hidden">', '<div class="widget"><div role="form">'):
        got = P.page_lines(f"<body>{wrap}{article}</div></form><footer>foot</footer>")
        assert [x for x, k in got if k == P.MAIN_LINE] == ["Title", "long text of it"], wrap
        assert [x for x, k in got if k == P.CHROME_LINE] == ["menu", "teaser", "foot"], wrap
        plain = f"<body><p>top</p>{wrap.replace('style', 'id')}<p>a long text without an article</p><div class=share>s</div></div>"
        assert P.page_lines(plain)[1] == ("a long text without an article", P.OPEN_LINE), wrap
    # inside an article: the wrapper of most of it, but not its readers' comments
    assert kept("<main><h1>T</h1><div class='content sidebar-left'><p>all the words of it</p></div></main>") == ["T", "all the words of it"]
    assert kept("<article><p>short</p><div class=comments><article>a much longer remark</article></div></article>") == ["short"]
    # teasers are not the page, whatever their element
    assert kept("<p>the text of the page itself</p><div class=related><article>a teaser</article></div>") == ["the text of the page itself"]
    assert kept("<div class=widget>" * 3000 + "<p>deep") == ["deep"]


def told(page):
    return [x for x, k in P.page_lines(page) if k != P.CHROME_LINE]


def test_attributes_are_read_as_browsers_read_them():
    assert told("<article><p data-x=it's>Kept text here</p><p>more</p><p>I don't know</p></article>") == ["Kept text here", "more", "I don't know"]
    assert told('<p title="a hidden gem">shown</p><p alt=\'x class=ad\'>too</p><p data-class=ad>three</p>') == ["shown", "too", "three"]
    assert told('<p hidden>no</p><p class="ad">no</p><p CLASS = ad>no</p><p class=a id=x>yes</p><p class=a class=ad>first counts</p>') == ["yes", "first counts"]
    assert told("<p a=b/>one</p>x<br/>y<p/>two<a href=x>link</a> end") == ["one", "x y", "twolink end"]
    assert told("one<p class=\"never closed>two") == ["one"] and told("x <!-- never closed <p>y") == ["x"]
    assert told("a < b <3 </> c<!-->d<!x>e<?y?>f") == ["a < b <3 </> cdef"]


def test_malformed_pages_take_linear_time():
    start = time.process_time()
    for page in ("<a " * 1_700_000 + '"', "<a \"" * 1_000_000, "<b>" * 200_000 + "</i>" * 200_000, "<p " + " " * 5_000_000 + ">x", "<!" * 1_000_000,
                 "<p" + " a" * 1_000_000 + ">x", "<a x=" * 500_000, "<body>" * 100_000 + "<p>x" * 100_000):
        P.page_lines(page)
    assert time.process_time() - start < 120


def test_class_words_inside_an_article_leave_it_open(spark):
    page = lambda n, own: (f"<article><h1>Title {n}</h1><p>first text of {n}</p><div class='form-of-life'><p>{own}</p></div>"  # noqa: E731
                           f"<h4 class=notice-board>Board {n}</h4><div class='search-results'>found {n}</div><p class=share-box>tell {n}</p></article>")
    lines = dict(P.page_lines(page(1, "x")))
    assert lines["x"] == lines["found 1"] == P.OPEN_LINE and lines["Board 1"] != P.CHROME_LINE and lines["tell 1"] == P.CHROME_LINE
    rows = [(i, f"http://h/a/{i}", page(i, "Share this with all your friends" if i else "said once")) for i in range(4)]
    got = {r.page_id: r for r in P.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "Title 0\n\nfirst text of 0\n\nsaid once\n\nBoard 0\n\nfound 0"
    # the neighbour with the same line tells that it is template text
    assert "Share this" not in got[2].text and got[2].n_shared == 1 and got[2].text.endswith("Board 2\n\nfound 2")


def test_copies_are_compared_with_the_next_other_page(spark):
    page = lambda t: f"<body><p>Welcome</p><p>{t}</p><p>Imprint</p></body>"
    rows = [(i, f"http://c/{i:03d}", page("copied" if 3 <= i < 30 else f"own {i}")) for i in range(33)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in P.main_text(df).collect()}
    lone = [i for i, t in got.items() if t not in ("copied", f"own {i}")]
    # at a partition's border a whole run of copies may have no other page in sight
    assert len(lone) <= 27 and all(got[i] == f"own {i}" for i in (0, 1, 31, 32))
    one = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {r.page_id: r.text for r in P.main_text(one).collect()} == {i: "copied" if 3 <= i < 30 else f"own {i}" for i in range(33)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packed_lines_come_back():
    for lines in ([], [("", 1)], [("a", 0), ("é \u2028 x", 2)]):
        assert P.unpacked(P.packed(lines)) == ([x for x, _ in lines], [k for _, k in lines])
