"""HTML extraction against a plain reading of the test pages, and pages made for the purpose."""

import html
import re

import math
import time
from collections import Counter, defaultdict

from citytables.llm.html import Page, _nodes, extract, host_of, style_tree
from citytables.llm.queries import op4_html_extraction

SCHEMA = "page_id long, url string, html string, host string, blocks int"


def plain(page):
    article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li|div|article)\b[^>]*>", article)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_all_pages(spark):
    sf = "/root/testdata/sf0.01"
    want = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op4_html_extraction(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])


def run(spark, rows, **kw):
    return {r["page_id"]: r["text"] for r in extract(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **kw).collect()}


def test_style_tree_without_article_elements(spark):
    def page(i):
        return f"<body><div class=top><p>Acme shop &amp; more</p></div><div class=text><p>Story {i} of <i>many</i>&nbsp;words</p><p>End {i * i}</p></div><div class=x1><p>Read our terms</p></div></body>"

    rows = [(i, "http://a.example/p", page(i)) for i in range(12)] + [(50, "http://b.example/", page(50)), (51, None, None), (52, "", ""), (53, "u", "<p>open <b>text<p>next</div></p> tail")]
    assert run(spark, rows, tree=False)[3] == "Acme shop & more\nStory 3 of many words\nEnd 9\nRead our terms"  # the names say nothing here
    for kw in ({}, {"broadcast_rows": 0, "hot_pages": 3}):
        got = run(spark, rows, **kw)
        assert [got[i] for i in range(12)] == [f"Story {i} of many words\nEnd {i * i}" for i in range(12)]
        assert got[50] == "Story 50 of many words\nEnd 2500" and got[51] == got[52] == "" and got[53] == "open text\nnext\ntail"


def test_copies_are_kept_and_notices_go(spark):
    page = "<nav><a href=x>home</a></nav><main><h1>T</h1><header><p>By</p></header><p>a<br>b</p><section class='user-comments'><p>first!</p></section><p class=ad>buy</p><script>if (a<b) x('</p>')</script><form><p>mail</p></form>c</main><aside>s</aside>"
    assert set(run(spark, [(i, "http://c.example/", page) for i in range(9)]).values()) == {"T\nBy\na b\nc"}


def test_copies_are_one_page(spark):
    def article(i, more=""):
        return f"<body><div class=chrome><p>Shop {i}</p></div><article><h1>Title {i}</h1><p>Story {i} of {i * i}</p>{more}</article></body>"

    def bare(i):
        return f"<body><div class=text><p>Story {i}</p><ul><li>Part {i}</ul></div><div class=x><p>Read our terms</p></div></body>"

    copy = article(99, "<blockquote><p>Quoted</p></blockquote>")
    rows = [(i, "http://a.example/", article(i)) for i in range(12)] + [(20 + i, "http://a.example/", copy.replace("Shop 99", f"Shop {i}")) for i in range(5)]
    rows += [(100 + i, "http://b.example/", bare(min(i, 5))) for i in range(20)]  # 5 different pages and 15 copies
    got = run(spark, rows)
    assert {got[20 + i] for i in range(5)} == {"Title 99\nStory 99 of 9801\nQuoted"}
    assert [got[i] for i in range(12)] == [f"Title {i}\nStory {i} of {i * i}" for i in range(12)]
    assert [got[100 + i] for i in range(20)] == [f"Story {min(i, 5)}\nPart {min(i, 5)}" for i in range(20)]


def test_a_host_of_few_pages_leans_on_the_others(spark):
    page = lambda i: f"<body><div class=box><p>Join our {'club' if i % 2 else 'list'} today</p></div><div class=body><p>Tale {i}</p></div></body>"
    rows = [(i, f"http://h{i // 2}.example/", page(i)) for i in range(40)]
    assert run(spark, rows) == {i: f"Tale {i}" for i in range(40)}


def test_names_on_every_page_of_their_own(spark):
    page = lambda i: f"<body class='postid-{i}'><div id=entry-{i}><p>Tale {i}</p></div><div id=box-{i}><p>All about us</p></div></body>"
    assert run(spark, [(i, "http://a.example/", page(i)) for i in range(15)]) == {i: f"Tale {i}" for i in range(15)}


def test_names_in_an_article_are_a_hint_only(spark):
    page = "<article><h1>T</h1><p class='social-history'>Then</p><div class='comment-policy'>Rules</div><div class=share>Share!</div></article><div class=x>Else</div>"
    assert run(spark, [(1, "http://a.example/", page)]) == {1: "T\nThen\nRules"}


def test_unique_contents_of_a_path_stay(spark):
    page = lambda i: f"<body><div class=t><h2>{'News' if i % 2 else f'Head {i}'}</h2></div><p>Tale {i}</p></body>"
    got = run(spark, [(i, "http://a.example/", page(i)) for i in range(40)])
    assert got[2] == "Head 2\nTale 2" and got[3] == "Tale 3"


def test_entropies_by_brute_force(spark):
    pages = [(i, f"http://{'ab'[i % 3 == 0]}.example/", f"<body><div class=n><p>note {i % 2}</p></div><main><h1>T{i % 5}</h1>{'<ul><li>x</ul>' * (i % 3)}<p>{min(i, 15)}</p></main></body>") for i in range(20)]
    one = {}
    for _, url, page in pages:
        p = Page(page)
        for path, (content, style) in p.evidence().items():
            key = (host_of(url), path, p.key())
            one[key] = min(one.get(key, (content, style)), (content, style))
    by = {"own": defaultdict(list), "all": defaultdict(list)}
    for (host, path, _), cs in one.items():
        by["own"][host, path].append(cs)
        by["all"][path].append(cs)

    def h(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values())

    def measures(rows):
        n = len(rows)
        return n, math.exp(h([c for c, _ in rows])) / n, h([s for _, s in rows]) / math.log(n) if n > 1 else 1.0

    want = {}
    for (host, path), rows in by["own"].items():
        m, varied, style = measures(rows)
        all_m, all_varied, all_style = measures(by["all"][path])
        for content, same in Counter(c for c, _ in rows).items():
            if sum(c == content for c, _ in by["all"][path]) > 1:
                want[host, path, content] = ((m * varied + 20 * all_varied) / (m + 20), (m * style + 20 * all_style) / (m + 20), m * (1 - varied) + all_m * (1 - all_varied), same)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).mapInArrow(_nodes, "host string, path bigint, page bigint, content bigint, style bigint")
    for hot in (50_000, 2):
        got = {(r["host"], r["path"], r["content"]): (r["varied"], r["style"], r["repeats"], r["same"]) for r in style_tree(df, hot_pages=hot).collect()}
        assert got.keys() == want.keys() and len(got) > 8
        assert all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))


def blocks(page):
    return [t for _, t in Page(page).blocks]


def test_blocks():
    assert blocks("a < b <!-- <p>x</p> --> c &lt;p&gt; &amp;amp;") == ["a < b c <p> &amp;"]
    assert blocks("<ul><li>a<li>b <b>c</b></ul><table><tr><td>x<td>y</table>" * 2) == ["a", "b c", "x", "y"] * 2
    assert blocks("<p>" * 3000) == [] and len(blocks("<div>x" * 500)) == 500
    assert host_of("https://User@WWW.a.example:80/x") == "www.a.example" and host_of(None) == ""


def test_contents_are_those_of_the_evidence():
    p = Page("<body><div class=a><p>x<p>y</div><main><h1>T</h1>own<ul><li>1<li>2</ul></main><div></div></body>")
    assert p.contents() == {path: content for path, (content, _) in p.evidence().items()}


def test_broken_pages_take_linear_time():
    for page in ("<div>x" * 50_000, "<b>x" * 50_000 + "</i>" * 50_000, "<p>x<span>" * 50_000):
        begun = time.process_time()
        assert len(Page(page).evidence()) >= 1
        assert time.process_time() - begun < 10


def test_empty(spark):
    assert run(spark, []) == {}
