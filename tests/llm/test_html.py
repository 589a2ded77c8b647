"""HTML extraction: structure, differencing, edge cases."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import html_text, queries


def brute(source):
    article = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S).group(1)
    parts = [html.unescape(re.sub("<[^>]*>", " ", p)) for p in re.split(r"</?(?:p|h1)>", article)]
    clean = [re.sub(r"\s+", " ", p).strip() for p in parts]
    return "\n".join(p for p in clean if p)


def test_query_against_brute_force(spark, sf):
    sf = sf.replace("0.001", "0.01")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op7_html"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "source, want",
    [
        ("<main><p>a&nbsp;&amp;&#x41;  b<br>c</p><aside>no</aside><div class='comments'>no</div><p>d</main>tail", "a &A b c\nd"),
        ("<article><header>no</header><h2>t</h2><ul><li>x<li>y</ul><form>no<input></form><script>if(a<b){}</script></article>", "t\nx\ny"),
        ("<head><title>t</title><style>p{}</style></head><body><p>only</p><footer>f</footer>", "only"),
        ("<head><title>t</title><body><p>unclosed head</p>", "unclosed head"),
        ("<div class=cookie-notice>no</div><div id='sidebar-left'>no</div><p hidden>no</p><p>yes</p>", "yes"),
        ("plain &lt;text&gt; &amp;amp; done", "plain <text> &amp; done"),
        ("<p>one<!-- no <p>no --> two</p><![CDATA[no]]><p>thr<b>ee</b></p>", "one two\nthree"),
        ("<p title='a>b'>x</p><p>cut <a href=", "x\ncut"),
        ("", ""), (None, ""), ("<", "<"), ("a < b", "a < b"), ("<p>\n \t</p>", ""),
    ],
)
def test_structure(spark, source, want):
    df = spark.createDataFrame([(1, None, source)], "page_id long, url string, html string")
    assert html_text.extract(df).first().text == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(1500):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        keep = html_text.shared_lines(a, b)
        assert sum(keep) == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x, k in zip(a, keep) if k)


def test_shared_lines_in_halves(monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_BITS", 20)
    rng = random.Random(7)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        assert sum(html_text.shared_lines(a, b)) == lcs(a, b)


def test_hostile_pages_take_no_long_time():
    same = [7] * 5000
    assert sum(html_text.shared_lines([1, *same], [*same, 2, *same])) == 5000
    deep = "<div>" * 30000 + "x" + "</section></p>" * 30000 + "</div>" * 30000
    assert html_text.blocks(deep) == [(html_text.OPEN, "x")]


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_differencing_of_real_pages_against_brute_force(spark, sf):
    """Every line of every page: nearest path, quadratic longest common subsequence, structure as a veto."""
    frame = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    parsed = {r.page_id: (r.url, html_text.blocks(r.html)) for r in frame.collect()}
    hosts = {}
    for i, (url, found) in parsed.items():
        host, path = re.fullmatch(r"https?://([^/]*)([^?#]*).*", url).groups()
        lines = tuple(t for _, t in found)
        group = hosts.setdefault(host, {})
        group[lines] = min(group.get(lines, (path, i)), (path, i))
    want, pairs = {}, 0
    for i, (url, found) in parsed.items():
        host, path = re.fullmatch(r"https?://([^/]*)([^?#]*).*", url).groups()
        lines = tuple(t for _, t in found)
        order = sorted((p, n, ls) for ls, (p, n) in hosts[host].items())
        at = next(k for k, (_, _, ls) in enumerate(order) if ls == lines)
        near = [order[k] for k in (at - 1, at + 1) if 0 <= k < len(order)]
        near.sort(key=lambda x: -prefix(order[at][0], x[0]))  # of copies the one of the least path is compared
        n = lcs(lines, near[0][2]) if near else 0
        pairs += bool(near)
        if n <= html_text.COPY * len(lines):
            want[i] = n
    got = {r.page_id: r for r in html_text.extract(frame).collect()}
    assert pairs > 40 and sum(want.values()) > 0
    for i, n in want.items():
        kept = sum(k == html_text.MAIN for k, _ in parsed[i][1])
        assert got[i].n_lines == len(parsed[i][1]) and n - kept <= got[i].n_shared <= n
        assert got[i].text == "\n".join(t for k, t in parsed[i][1] if k == html_text.MAIN)


def test_nearest_neighbour_and_near_copies(spark):
    menu = "".join(f"<div>menu {k}</div>" for k in range(9))
    rows = [
        (1, "http://a.com/news/1", "<div>news head</div><p>one</p>"), (2, "http://a.com/news/2", "<div>news head</div><p>two</p>"),
        (3, "http://a.com/shop/1", "<div>shop head</div><p>three</p>"), (4, "http://a.com/shop/2", "<div>shop head</div><p>four</p>"),
        # nine of ten lines are shared: the page on the other side tells a template from a copy
        (11, "http://b.com/1", menu + "<p>first</p>"), (12, "http://b.com/2", menu + "<p>second</p>"), (13, "http://b.com/3", menu + "<p>third</p>"),
        (21, "http://c.com/1", menu + "<p>copy, first</p>"), (22, "http://c.com/2", menu + "<p>copy, second</p>"), (23, "http://c.com/x", "<p>else</p>"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["one", "two", "three", "four"]
    assert got[12] == "second"
    assert got[22].startswith("menu 0") and got[23] == "else"


def test_no_table_holds_texts(spark, monkeypatch):
    """The page table held all lines, which were then shuffled as well: more disk than the input."""
    held, whole = [], html_text.written
    monkeypatch.setattr(html_text, "written", lambda df, name: held.append(df.schema) or whole(df, name))
    page = lambda i: f"<div>site name</div><p>own text {i}</p><div>imprint</div>"
    rows = [(i, f"http://H{i % 2}.com/a/{i // 2}", page(i)) for i in range(12)] * 2 + [(None, None, page(1)), (None, "/x", None), (None, "/x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = sorted((r.page_id if r.page_id is not None else -1, r.text, r.n_lines, r.n_shared) for r in html_text.extract(df).collect())
    alone = "site name\nown text 1\nimprint"
    assert got == sorted([(i, f"own text {i}", 3, 2) for i in range(12)] * 2 + [(-1, alone, 3, 0), (-1, "", 0, 0), (-1, "", 0, 0)])
    assert held and not any(f.name in ("html", "lines", "text") or f.dataType.simpleString() == "binary" for schema in held for f in schema)


def test_many_copies_of_one_page(spark):
    rows = [(i, f"http://h.com/{i:04}", "<div>top</div><p>same</p>" if i % 3 else f"<div>top</div><p>own {i}</p>") for i in range(600)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 600 and all(r.text == ("same" if r.page_id % 3 else f"own {r.page_id}") for r in got)


def test_differencing(spark):
    page = lambda i: f"<div>site name</div><p>own text {i}</p><p>more {i * 7}</p><div>imprint</div>"
    rows = [(i, f"http://h.com/a/{i}?x=1", page(i)) for i in range(12)]
    rows += [(20, "http://lone.com/x", page(3)), (21, "http://copy.com/1", page(5)), (22, "http://copy.com/2", page(5)), (23, None, page(1)), (1, "http://h.com/a/1?x=1", page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "uid": F.lit(1), "lines": F.lit("l"), "host": F.lit("h"), "kinds": F.lit("k"), "salt": F.lit(2), "n_chars": F.lit(0)})
    got = {}
    for r in html_text.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i][0] == f"own text {i}\nmore {i * 7}" for i in range(12) if i != 1)
    assert len(got[1]) == 2
    assert got[20] == ["site name\nown text 3\nmore 21\nimprint"]
    assert got[21] == got[22] == ["site name\nown text 5\nmore 35\nimprint"]
    assert html_text.extract(df.limit(0)).count() == 0
