"""Url filters and main text, on pages with awkward markup and hosts."""

import numpy as np
import pytest

from nearloom.llm import template, urlfilter
from nearloom.llm.html import read

PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("rules", [urlfilter.RULES, [*urlfilter.RULES, *((f"h{i}.org", "/", "block") for i in range(300))]])
def test_rules(spark, rules):
    urls = ["http://WWW.Example.com/en/x?y", "https://example.com/en/", "http://a.example.com/en/1#t", "http://x.net/es/", "http://x.net/en/", "http://comx/", "http://com", "com/", None, "", "a://b://c/d", "http://q.com?x=/en/", "http://net/fr/a"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGE)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(rows, rules).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("example.com", "/en/", "example.com/en/", "block") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == ("net/es/", "block") and got[4][2] is None and got[5][2] is None and got[6] == ("com", "", None, "allow")
    assert got[7][:3] == ("", "", None) and got[8][:2] == got[9][:2] == ("", "") and got[10][:2] == ("b:", "//c/d")
    assert got[11][:3] == ("q.com", "", None) and got[12][2:] == ("net/fr/", "block")
    assert urlfilter.filter_urls(rows.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    link = lambda *to: "".join(f'<a class=x href="http://{t}/">t</a>' for t in to)
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://bad.net/fr/2", ""), (3, "http://friend.org/a", link("bad.net", "bad.net")), (4, "http://good.com/1", link("fine.org")), (5, "http://fine.org/", link("good.com")), (6, "http://alone.org/x", "")]
    got = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[3].verdict == "block" and got[3].distrust > got[3].trust
    assert got[5].verdict == "allow" and got[5].trust > 0 and got[6].verdict == "allow"


def test_ranks_settle_beyond_sixteen_links(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(20)], "src string, dst string, n double")
    got = {r.host: r.trust for r in urlfilter.propagate(edges, spark.createDataFrame([("h0", "trust")], "host string, kind string")).collect()}
    assert all(abs(got[f"h{i}"] - 0.15 * 0.85**i) < 1e-6 for i in range(21)) and got["h20"] > 0


def test_ranks_against_plain_pagerank(spark):
    g = np.random.default_rng(8)
    hosts = [f"h{i}.org" for i in range(30)] + ["a.b.site.net", "site.net", "b.site.net", "c.site.net"]
    edges = {(hosts[a], hosts[b]): float(g.integers(1, 5)) for a, b in g.integers(0, len(hosts), (90, 2)) if a != b}
    seeds = [(hosts[i], "trust" if i % 2 else "distrust") for i in (1, 2, 5, 8, 31)]
    want = {}
    for kind in ("trust", "distrust"):
        m = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in edges.items():
            a, b = (a, b) if kind == "trust" else (b, a)
            m[hosts.index(b), hosts.index(a)] += n
        out = m.sum(0)
        m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
        start = np.array([float((h, kind) in seeds) for h in hosts])
        start /= start.sum()
        want[kind] = np.linalg.solve(np.eye(len(hosts)) - 0.85 * m, 0.15 * start)
    rows = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n double")
    got = {r.host: r for r in urlfilter.propagate(rows, spark.createDataFrame(seeds, "host string, kind string")).collect()}
    for i, h in enumerate(hosts):
        for kind in want:
            assert abs((got[h][kind] if h in got else 0) - want[kind][i]) < 1e-6


def test_hosts_and_all_domains_above_are_kin(spark):
    rows = spark.createDataFrame([("blog.x.example.net", ""), ("com", ""), ("", ""), ("x.example.net", None)], "host string, html string")
    got = {(r.src, r.dst): r.n for r in urlfilter.host_edges(rows).collect()}
    assert got == {(a, b): 1.0 for p, q in (("blog.x.example.net", "x.example.net"), ("x.example.net", "example.net")) for a, b in ((p, q), (q, p))}


ARTICLE = "<article><h1>Title {i}</h1><p><b>First &amp; {i}\n words<br>here<p>Second&nbsp;block {i}</p><ul><li>a</li><li>b {i}</li></ul></article>"
WANT = "Title {i}\n\nFirst & {i} words here\n\nSecond block {i}\n\na\n\nb {i}"


def test_article_without_furniture(spark):
    rows = []
    for i in range(12):
        body = "<header>Site</header><nav><a href=/>Menu</a></nav><div class='ad top'>Buy</div>" + ARTICLE.format(i=i) + "<aside>Side</aside><div id=comments><p>Nice!</p></div><form><p>Mail</p></form><footer>&copy; me</footer>"
        rows.append((i, "http://h.org/x", f"<!doctype html><html><head><title>t</title><script>var a='</p><article>';</script></head><body>{body}</body></html>"))
    rows += [(100, None, None), (101, "http://h.org/", ""), (102, "x", "just text &lt;here&gt; 1 < 2"), (103, "http://h.org/y", "<article><p>cut <b>of"), (104, "x", "<script>never closed <p>x"), (0, "http://h.org/x", rows[0][2])]
    got = {}
    for r in template.extract(spark.createDataFrame(rows, PAGE)).collect():
        got.setdefault(r.page_id, set()).add(r.text)
    assert all(got[i] == {WANT.format(i=i)} for i in range(12))
    assert got[100] == got[101] == got[104] == {""} and got[102] == {"just text <here> 1 < 2"} and got[103] == {"cut of"}
    assert template.extract(spark.createDataFrame(rows, PAGE).limit(0)).count() == 0


def test_template_of_pages_without_article_marks(spark):
    rows = []
    for i in range(12):
        text = "".join(f"<p>{' '.join(f'word{i}{j}{k}' for k in range(12))}</p>" for j in range(3 + i % 3))
        rows.append((i, "http://t.org/p", f"<html><body><div class=top><p>Welcome to the site</p></div><div class=main><div class=text>{text}</div></div><div class=low><p>All rights reserved</p></div></body></html>"))
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(12):
        assert got[i] == "\n\n".join(" ".join(f"word{i}{j}{k}" for k in range(12)) for j in range(3 + i % 3))


def test_reader_keeps_raw_text_and_comments_out():
    blocks, opened = read("<p>a<!-- <p>b --><style>p{}</style>c<p class='x y'>d<tr><td>e<td>f</table>")
    assert [b.text for b in blocks] == ["ac", "d", "e", "f"] and opened[("p[class=x y]",)] == 1


TEXT = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><h1>T</h1><figure><table><tr><td>cell</td></tr></table><figcaption>caption</figcaption></figure></article>", ["T", "cell", "caption"]),
        ("<article><p>let <math><mi>x</mi></math> be</p><noscript><p>plain</p></noscript><p><svg><text>axis</text></svg></p><object>fallback</object></article>", ["let x be", "plain", "axis", "fallback"]),
        ("<article class='post has-sidebar'><section id='related-work'><h2 id='search'>Search</h2><p>a</p></section><div class='article-header'><h1>T</h1></div></article>", ["Search", "a", "T"]),
        ("<article class='comment'><p>a</p></article>", ["a"]),
        (f"<div class='widget'><p>{TEXT}</p></div><div class='promo'><p>b</p></div><div class='site-footer'>f</div>", [TEXT]),
        ("<head><title>t<body><article><p>a</p><select><option>o<p>b</p></article>", ["a", "o", "b"]),
    ],
)
def test_content_is_not_furniture(html, want):
    assert template.main_text(*read(html), template.Template([])).split("\n\n") == want


def test_teasers_marked_as_articles_are_not_the_page(spark):
    rows = []
    for i in range(12):
        text = "".join(f"<p>{' '.join(f'word{i}{j}{k}' for k in range(20))}</p>" for j in range(3))
        teasers = "".join(f"<article><h2>Teaser {i}{j}</h2></article>" for j in range(3))
        rows.append((i, "http://t.org/p", f"<html><body><div class=text>{text}</div><div class=more>{teasers}</div></body></html>"))
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(12):
        assert got[i] == "\n\n".join(" ".join(f"word{i}{j}{k}" for k in range(20)) for j in range(3))


def test_template_alone_finds_the_article_among_neutral_boxes(spark, sf_dir):
    """The table's pages with every telling name and class taken away: the article is known from the template."""
    names = {"<article>": "<div>", "</article>": "</div>", "<nav>": "<div class=k1>", "</nav>": "</div>", "<footer>": "<div class=k2>", "</footer>": "</div>", 'class="ad"': "class=k3"}
    rows, want = [], {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want[r.page_id] = [b.text for b in read(r.html[r.html.index("<article>") : r.html.index("</article>")])[0]]
        html = r.html
        for a, b in names.items():
            html = html.replace(a, b)
        rows.append((r.page_id, r.url, html))
    found = hit = all_ = 0
    for r in template.extract(spark.createDataFrame(rows, PAGE)).collect():
        blocks = r.text.split("\n\n")
        found, hit, all_ = found + len(blocks), hit + len([b for b in blocks if b in want[r.page_id]]), all_ + len(want[r.page_id])
    assert hit >= 0.99 * found and hit >= 0.99 * all_


def test_the_template_decides_against_what_a_page_alone_says(spark):
    fixed = "".join(f"<p>{' '.join(f'rule{j}{k}' for k in range(40))}</p>" for j in range(4))  # more than the article, the same on all pages
    own = lambda i: f"<p>{' '.join(f'w{i}x{k}' for k in range(20 + i))}</p>"
    rows = [(i, "http://t.org/p", f"<html><body><div class=k1>{fixed}</div><div class=k2>{own(i)}<div class=k4>Send this to a friend</div></div></body></html>") for i in range(9)]
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i] == " ".join(f"w{i}x{k}" for k in range(20 + i)) for i in range(9))
    assert "rule00" in template.main_text(*read(rows[0][2]), template.Template([]))


def test_hosts_of_near_copies_keep_their_text_and_deep_pages_end(spark):
    same = [f"<p>{' '.join(f's{j}{k}' for k in range(20))}</p>" for j in range(5)]
    rows = [(i, "http://c.org/p", f"<html><body><div>{''.join(same)}<p>only on page {i}</p></div></body></html>") for i in range(9)]
    rows.append((100, "http://deep.org/", "<div>" * 20000 + "deep" + "</div>" * 20000 + "<p>end"))
    got = {r.page_id: r.text for r in template.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(len(got[i].split("\n\n")) == 6 for i in range(9)) and "deep" in got[100]
