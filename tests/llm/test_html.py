import math
import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from llm_helpers import rows_of
from vecspark.llm import html as H

PAGE = "page_id long, url string, html string"


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Site name</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div role="complementary">Side</div>
    <div class="cookie-notice">Cookies</div><article><h1>A &amp; B</h1><p>One <b>two
      three</b>&nbsp;four<br>five<p>Six &lt;tag&gt; &#233;&#x4E2D;</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><form><p>Mail <input></p></form>
    <script>bad()</script><aside>No</aside></article><section id="comments"><p>Nice!</p></section><footer>&copy; 2020</footer></body></html>"""
    assert H.extract(page) == "A & B\nOne two three four five\nSix <tag> é中\nx\ny\n1\n2"


def test_broken_markup():
    assert H.extract("<p>a<p>b</div>c</p><b>d<p>e") == "a\nb\nc\nd\ne"
    assert H.extract("<p>a < b and c > d</p>") == "a < b and c > d"
    assert H.extract("<p title='x>y' data-a=\"<p>\">z</p>") == "z"
    assert H.extract("text <p") == "text" and H.extract("a<script>b") == "a" and H.extract("<!-- a <p>b</p>") == "" and H.extract("a<!---->b") == "ab"
    assert H.extract(None) == H.extract("") == H.extract("<p> \n </p>") == ""
    assert H.extract("plain\n text &amp;amp;") == "plain text &amp;"
    assert H.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert H.extract("<textarea><p>x</p></textarea><P CLASS=x>y</P>") == "y"


def site(host, n, r, article=False):
    """Pages of one host: chrome without telling names around a text of the page's own."""
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(f'w{r.randrange(10**6)}' for _ in range(20))}</p>" for _ in range(3))
        main = f"<article>{body}</article>" if article else f"<div class='c'>{body}</div>"
        out.append((f"http://{host}/{i}", f"<body><div class='t'><p>Home</p><p>About us</p></div>{main}<div class='z'><span>Terms and privacy</span></div></body>", body[3:-4].split("</p><p>")))
    return out


def test_style_tree_removes_what_a_site_repeats(spark):
    r = random.Random(1)
    pages = site("many.example", 40, r) + site("few.example", 2, r)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    got = {x["page_id"]: x for x in H.main_texts(spark, spark.createDataFrame(rows, PAGE).repartition(4)).collect()}
    for i, (u, _, own) in enumerate(pages):
        want = own if i < 40 else ["Home", "About us", *own, "Terms and privacy"]  # two pages say nothing about a site
        assert (got[i]["text"], got[i]["url"], got[i]["n_chars"]) == ("\n".join(want), u, len("\n".join(want)))


def test_articles_are_never_cut(spark):
    pages = [(i, "http://same.example/", "<nav>Menu</nav><article><h1>Same</h1><p>The same on all.</p></article>") for i in range(30)]
    assert {x["text"] for x in H.main_texts(spark, spark.createDataFrame(pages, PAGE)).collect()} == {"Same\nThe same on all."}


def test_host_is_the_same_in_both_readings(spark):
    from pyspark.sql import functions as F

    urls = ["http://A.example/x", "https://u:p@b.example:80/", "//c.example", " ftp://d.example?x", "e.example/x", "", None, "http:///x", "mailto:a@b"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    own = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), H.HOST, 1))
    assert [x[0] for x in df.select(own).collect()] == [H.host(u) for u in urls]


def test_messy_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://x.example/", "<p>a</p>"), (2, "", ""), (3, "http://x.example/", "<p>" + "long " * 300_000 + "</p>")]
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "1 AS host", "'x' AS text", "2 AS n_chars", "3 AS node", "4 AS low")
    got = rows_of(H.main_texts(spark, df), "page_id", "text", "n_chars")
    assert got.count((1, "", 0)) == 2 and (None, "a", 1) in got and (2, "", 0) in got and (3, ("long " * 300_000).strip(), 1_499_999) in got
    assert H.main_texts(spark, df.where("false")).count() == 0


class Articles(HTMLParser):
    """Brute force for pages whose text is what stands in <article> elements."""

    BLOCKS = {"article", "h1", "h2", "p", "ul", "li", "div"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.blocks += [""] if tag in self.BLOCKS else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.blocks += [""] if tag in self.BLOCKS else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth else ""


def test_whole_table_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Articles()
        p.feed(r["html"] or "")
        p.close()
        want[r["page_id"]] = "\n".join(t for b in p.blocks if (t := " ".join(b.split())))
    got = {r["page_id"]: r["text"] for r in H.op3_html_extract(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(got) == pages.count()


def test_the_tree_alone_knows_the_frames_of_a_large_site(spark):
    """Without names: menus, adverts and footers of a large host go, articles stay; without the tree they all stay.

    The pages are the table's largest host, with the frames of its first four pages around all its articles.
    """
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url LIKE '%//blog.tionsh.example.com/%'").orderBy("page_id").collect()
    cut = [(r["html"].partition("<article>"), r["html"].rpartition("</article>")) for r in rows]
    rows = [(r["page_id"], r["url"], cut[i % 4][0][0] + "<article>" + r["html"].split("<article>")[1].split("</article>")[0] + "</article>" + cut[i % 4][1][2]) for i, r in enumerate(rows)]
    pages = spark.createDataFrame(rows, PAGE)
    texts = lambda **how: {r["page_id"]: r["text"] for r in H.main_texts(spark, pages, **how).collect()}
    whole, tree, neither = texts(), texts(names=False), texts(tree=False, names=False)
    assert len(whole) > 300 and tree == whole
    assert all(len(neither[i]) > len(whole[i]) and whole[i] in neither[i] for i in whole)


def test_importances_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, f"http://{r.choice('ab')}.example/{i}", "<body>" + "".join(f"<div class={r.choice('xyz')}><p>{r.choice(['same', f'own {i}', 'two'])}<ul><li>{r.randrange(3)}</ul></div>" for _ in range(r.randrange(1, 5))) + f"<b>{i}</b></body>") for i in range(60)]
    got = {(x["host"], x["branch"]): x for x in H.importances(H.Scratch(spark), spark.createDataFrame(rows, PAGE).repartition(5)).collect()}
    has, content, shape, chains = (defaultdict(set) for _ in range(4))
    for _, url, source in rows:
        page = H.Page(source)
        own, copies = H.host(url), page.copies()
        for b in page.blocks:
            has[own, b.node].add(copies)
            content[own, b.node, b.text].add(copies)
            links = b.chain
            while links:
                chains[own, b.node].add(links[0])
                links = links[1]
        for n, c in page.children.items():
            shape[own, n, c].add(copies)
    for (own, branch), x in got.items():
        score, total, m = 0.0, 0, 0
        for (h, leaf), above in chains.items():
            if h == own and branch in above:
                n = [len(v) for (a, b, _), v in content.items() if (a, b) == (h, leaf)]
                size = len(has[h, leaf])
                m = max(m, size)
                score += sum(1 - math.log(k) / math.log(size) if size > 1 else 1 for k in n)
                total += len(n)
        n = [len(v) for (a, b, _), v in shape.items() if (a, b) == (own, branch)]
        p = 1 - sum(k * math.log(k) for k in n) / sum(n) / math.log(sum(n)) if sum(n) > 1 else 0.0
        assert (x["m"], x["importance"]) == (m, pytest.approx(0.9 * score / total + 0.1 * p))
    assert {k for k in has} <= set(got)


def test_what_a_site_repeats_within_its_articles_goes_and_copies_stay(spark):
    r = random.Random(3)
    own = [[" ".join(f"w{r.randrange(10**6)}" for _ in range(20)) for _ in range(3)] for _ in range(40)]
    own += [own[0]] * 30  # one article on many pages
    page = "<body><article><h1>{}</h1><p>{}</p><p>{}</p><div class='q'><p>Tell your friends</p><p>Send it on</p></div><h2>More</h2></article></body>"
    rows = [(i, "http://x.example/", page.format(*a)) for i, a in enumerate(own)]
    df = spark.createDataFrame(rows, PAGE)
    for tree in (True, False):
        got = {x["page_id"]: x["text"] for x in H.main_texts(spark, df, tree=tree).collect()}
        for i, a in enumerate(own):
            assert got[i] == "\n".join([*a, *([] if tree else ["Tell your friends", "Send it on"]), "More"])


def test_names_of_classes():
    for label in ("has-sidebar", "no-sidebar", "long-form", "social-policy", "search-result-page", "article-header", "loading", "adventure", "header-image-story"):
        assert H.names_noise(label) == 0, label
    for label in ("ad", "site-footer", "sideBar", "comment-list", "main-nav", "cookie-notice", "site-header", "search-form", "x share-bar"):
        assert H.names_noise(label), label
    article = "<article class='long-form'><h1>A</h1><p>b</p></article>"
    assert H.extract(f"<div class='page banner'>{article}</div>") == "A\nb" and H.extract(f"<div class=banner>x</div>{article}") == "A\nb"
    assert H.extract(f"{article}<section class=comments><article>nice</article></section>") == "A\nb"


def test_no_story_is_lost_to_a_teaser():
    assert H.extract("<main><h1>Title</h1><p>lead</p><article><p>Body</p></article></main>") == "Title\nlead\nBody"
    assert H.extract("<article>teaser</article><main><p>A long story.</p></main>") == "teaser\nA long story."
    assert H.extract("<article>teaser</article><div><p>A long story, that is longer.</p></div>") == "teaser\nA long story, that is longer."


def test_deep_nesting_takes_time_in_proportion():
    began = time.perf_counter()
    assert H.extract("<div>" * 100_000 + "deep" + "</div>" * 100_000) == "deep"
    assert H.extract("<table>" + "<div><p>x" * 50_000) == "\n".join(["x"] * 50_000)
    assert time.perf_counter() - began < 60
