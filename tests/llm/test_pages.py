"""WARC archives and main texts of pages."""

import gzip
import html
import re
import time

import duckdb
from pyarrow import fs
from pyspark.sql import functions as F

from pagewarden.llm import style_tree, warc
from pagewarden.llm.common import run_folder
from pagewarden.llm.queries import ORACLES
from tests.llm.fixtures import sf

EDGES = [(1, "http://a/", None), (2, None, ""), (3, "http://a/x y\n", "x" * 1000), (4, "http://a/", "x" * 1000), (5, "u", "x" * 999), (6, "u", "x" * 999), (None, "u", "x" * 1000), (4, "http://a/", "x" * 1000), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000)]


def edge_pages(spark):
    return spark.createDataFrame(EDGES, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("n", "digest", "payload", "page", "removed", "host", "first")})


def test_round_trip_equals_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = con.execute(ORACLES["op7_warc"])
    names = [d[0] for d in want.description]
    got = warc.round_trip(sf(spark, "pages", "0.01")).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_chunks_and_archives(spark):
    pages = edge_pages(spark)
    for size in (7, 1000, 65_536):
        files = warc.write_archives(warc.with_roles(pages), run_folder(spark, "warc"), chunk_bytes=size)
        rows = warc.read_archives(files, chunk_bytes=size).collect()
        bodies = {}
        for r in sorted(rows, key=lambda r: r.chunk_no):
            if r.record_type == "response" and r.page_id in ("1", "2", "3", "5", "6", "7"):
                assert len(r.data) <= size and r.offset == len(bodies.get(r.page_id, b""))
                bodies[r.page_id] = bodies.get(r.page_id, b"") + r.data
                assert not r.is_last or r.digest_so_far == r.stated_digest
        assert bodies == {str(k): (t or "").encode() for k, _, t in EDGES if k in (1, 2, 5, 6, 7)}
    store, path = fs.FileSystem.from_uri(files.first().file)
    with store.open_input_stream(path, compression=None) as raw:
        assert gzip.GzipFile(fileobj=raw).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_roles_of_edges(spark):
    rows = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(edge_pages(spark)).collect()), key=str)
    assert rows == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 1000, "revisit", 4), (4, 1000, "response", None), (4, 1000, "response", None), (5, 999, "response", None), (6, 999, "response", None), (None, 1000, "revisit", 4), (7, len(EDGES[-1][2].encode()), "response", None)], key=str)
    assert warc.round_trip(edge_pages(spark).limit(0)).count() == 0


def test_articles_of_the_given_pages(spark):
    pages = sf(spark, "pages", "0.01")
    got = {r.page_id: r for r in style_tree.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_site_templates_go_and_copies_of_articles_stay(spark):
    page = "<html><body><div class=top><p>Acme <b>Times</b><p>Since 1900</div><div class=story><h2>{0}</h2><p>All about {0}</p></div><article><p>The same article</p></article></body></html>"
    rows = [(i, f"https://acme.example/{i}", page.format(f"topic {i}")) for i in range(8)] + [(100, "https://other.example/", page.format("one page")), (101, None, None), (102, "x", "plain &amp; simple")]
    got = {r.page_id: r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "topic 3\nAll about topic 3\nThe same article"
    assert got[100].startswith("Acme Times\nSince 1900\none page") and got[101] == "" and got[102] == "plain & simple"
    tree = {round(r.importance, 2) for r in style_tree.style_tree(spark.createDataFrame(rows, "page_id bigint, url string, html string").filter("html is not null")).filter("pages = 8").collect()}
    assert 0.0 in tree and max(tree) > 0.8


def test_hot_copied_page_does_not_cost_other_pages_their_text(spark):
    page = "<html><body><div class=top><p>Acme Times</div><div class=content><p>{}</p></div></body></html>"
    rows = [(i, f"https://acme.example/{i}", page.format("the copied story" if i % 4 else f"story {i}")) for i in range(400)]
    got = {r.page_id: r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "the copied story" if i % 4 else f"story {i}" for i in range(400)}


def plain_importance(pages, presentation=0.1):
    """Importance of each style node from the nodes of the distinct pages of a host."""
    import math
    from collections import Counter, defaultdict

    once = {}
    for url, page in pages:
        seen = style_tree.Page(features=True).read(page)
        once[style_tree.host_of(url), "\n".join(seen.blocks)] = seen
    values = defaultdict(list)
    for (host, _), seen in once.items():
        for path in seen.content:
            values[host, path].append((seen.content[path], seen.shape[path]))
    out = {}
    for node, found in values.items():
        share = []
        for column in zip(*found, strict=True):
            m = len(column)
            share.append(-sum(n / m * math.log(n / m) for n in Counter(column).values()) / math.log(m) if m > 1 else 1.0)
        out[node] = (len(found), (1 - presentation) * share[0] + presentation * share[1])
    return out


def test_importance_equals_the_plain_one(spark):
    rows = [(r.url, r.html) for r in sf(spark, "pages", "0.01").collect()]
    frame = "<main><header>Acme</header><div class=promo-free><p>Buy now</p></div><div class=text><p>{}</p></div></main>"
    rows += [(f"https://made.example/{i}", frame.format(f"story {i % 9}")) for i in range(20)]
    tree = style_tree.style_tree(spark.createDataFrame(rows, "url string, html string")).collect()
    want = plain_importance(rows)
    assert len(tree) == len(want) > 100
    for r in tree:
        pages, importance = want[r.host, r.path & (2**64 - 1)]
        assert r.pages == pages and abs(r.importance - importance) < 1e-9


def _made(spark, pages):
    rows = [(i, f"https://h{h}.example/{i}", page) for i, (h, page) in enumerate(pages)]
    return {r.page_id: r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_the_tree_decides_inside_articles_too(spark):
    """Templates without a telling name go from main and article; what varies stays, the header of an article too."""
    main = "<body><main><header><p>Acme Times</p></header><div class=x1><p>Read our <b>offer</b></p></div><div class=t><h1>Title {0}</h1><p>Body of {0} and its bridges</p></div></main></body>"
    article = "<body><article><header><h1>Title {0}</h1></header><p>Body of {0}</p><section class=x2><p>Get the app</p></section></article><div class=x3>Imprint</div></body>"
    few = "<body><main><div class=x1>Read our offer</div><p>Body of {0}</p></main></body>"
    got = _made(spark, [(1, main.format(i)) for i in range(6)] + [(2, article.format(i)) for i in range(6)] + [(3, few.format(i)) for i in range(3)])
    assert got[0] == "Title 0\nBody of 0 and its bridges" and got[8] == "Title 2\nBody of 2" and got[13] == "Read our offer\nBody of 1"


def test_an_optional_node_is_no_template(spark):
    """A node that is empty on most pages counts where it holds text."""
    page = "<body><div class=note>{}</div><div class=t><p>Story {}</p></div></body>"
    got = _made(spark, [(1, page.format("Corrected on Monday" if i == 7 else "", i)) for i in range(40)])
    assert got[7] == "Corrected on Monday\nStory 7" and got[8] == "Story 8"


def test_doubtful_names_are_not_believed_alone():
    read = lambda h: style_tree.Page().read(h).blocks
    body = "<p>A long story about a river and its bridges.</p>"
    assert read(f"<form>{body}<nav>menu</nav></form>") == ["A long story about a river and its bridges."]
    assert read(f"<div class='story notice'>{body}</div><div class=cookie>ok</div>") == ["A long story about a river and its bridges."]
    assert read(f"<form><article>{body}</article></form><div class=notice>Short one</div>") == ["A long story about a river and its bridges."]
    assert read(f"<article>Short.</article><form>{body}</form>") == ["Short."]
    assert read("<nav>a long menu of many many entries</nav><p>x</p>") == ["x"]


def test_markup_cases():
    read = lambda h: style_tree.Page().read(h).blocks
    assert read("<p>a<p>b &lt;c&gt; &nbsp; d<script>'</p><p>no'</script><ul><li>1<li>2</ul>") == ["a", "b <c> d", "1", "2"]
    assert read("<nav><nav>x</nav>y</nav><div hidden>h</div><div class='ad-slot'>z</div><header>s</header><p>t") == ["t"]
    assert read("<article><header><h1>T</h1></header><p>x</p><section class=comments><p>c</p></section></article>") == ["T", "x"]
    assert read("a<!-- x > <p>b") == ["a"] and read("1 < 2 <a href=\"x>y\">go</a>") == ["1 < 2 go"] and read("<p>q<b>r</p><p>s</b>t") == ["qr", "st"]
    assert read("<table><tr><td>a<td>b<tr><td>c</table>x<br>y") == ["a b", "c", "x y"] and read("<body <p>") == []


def test_broken_pages_take_linear_time():
    for part in ("<h1>", '<a "', "<b>", "<div><i>", "<a ' \"", "<!-", "</p>", "<form>", "<script>"):
        took = []
        for n in (10_000, 40_000):
            start = time.perf_counter()
            style_tree.Page(features=True).read(part * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0] + 0.2, part


def test_edge_pages(spark):
    assert style_tree.main_text(edge_pages(spark)).count() == len(EDGES) and style_tree.main_text(edge_pages(spark).limit(0)).count() == 0
