from __future__ import annotations

import html as H
import math
import random
import re

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from docloom.llm import html, itq, minhash, mixing, queries, topk, toxicity
from docloom.llm.shared import Scratch

SF = "/root/testdata/sf0.001"

# -- pages -----------------------------------------------------------------------------


def test_articles_of_all_pages(spark):
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op4_template_extract(spark, SF).collect()
    assert len(rows) == len(raw)
    for r in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", raw[r["page_id"]])[1]
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))
        assert r["text"] == " ".join(H.unescape(inner).split()) and r["n_chars"] == len(r["text"])


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><p>no</p>"</script></head><body>
<div class="cookie-banner"><p>accept</p></div><header><h1>site</h1></header><nav><a href="/">home</a></nav><div id="wrap"><{tag}><h1>Title {n}</h1>
<p>one &amp; &lt;two&gt;<br>three&nbsp;four <b>bo</b>ld<p>next   block <a href="x" title="a>b">link</a><!-- <p>hidden</p> -->
<ul><li>item<li>item {n}</ul><form><p>search</p></form><section class="comments"><p>first!</p></section></{tag}><aside>side</aside></div>
<div class="ad">buy</div><footer>f</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_what_is_no_main_text_goes(spark, tag):
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE.format(tag=tag, n=i)) for i in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got == {i: f"Title {i} one & <two> three four bold next block link item item {i}" for i in range(6)}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_text_that_all_pages_repeat_goes(spark, tag):
    same = '<div class="c7"><p>same sentence</p></div>'
    page = "<body>{s}<{t}><h1>Title {n}</h1><p>text {n}</p><p>said by all</p>{s}<ul><li>all alike</ul></{t}><section><div>imprint</div></section></body>"
    rows = [(i, "http://h.example/", page.format(s=same, t=tag, n=i)) for i in range(4)]
    rows += [(10 + i, "http://copies.example/", page.format(s=same, t="div", n=0)) for i in range(4)]  # one text
    rows += [(20 + i, "http://two.example/", page.format(s=same, t="article", n=i)) for i in range(2)]
    rows += [(30, "http://h.example/", f"<body>{same}</body>"), (31, "http://h.example/", page.format(s="<div class='c7'><p>other</p></div>", t=tag, n=31))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert [got[i] for i in range(4)] == [f"Title {i} text {i} said by all" for i in range(4)]
    assert {got[10 + i] for i in range(4)} == {"same sentence Title 0 text 0 said by all same sentence all alike imprint"}
    assert [got[20 + i] for i in range(2)] == [f"Title {i} text {i} said by all same sentence all alike" for i in range(2)]
    assert got[30] == "same sentence" and got[31] == ("other " * (tag == "div")) + "Title 31 text 31 said by all other"


KEPT = [
    'div style="overflow:hidden"', 'div aria-hidden="false"', 'div title="a hidden gem"', 'div data-hidden="1"', 'div class="content has-sidebar"',
    'div class="no-banner"', 'div id="with-comments"', 'div class="sidebar"', 'section class="related"',
]


@pytest.mark.parametrize("tag", ["article", "main"])
def test_attributes_that_hide_nothing(spark, tag):
    texts = [(f"<body><{a}><{t}><p>text {i}</p></{t}></{a.split()[0]}></body>") for i, a in enumerate(KEPT) for t in (tag, f'{tag} style="overflow:hidden"')]
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(texts)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract(pages).collect()} == {i: f"text {i // 2}" for i in range(len(texts))}


def text_of(page):
    """The text of a page whose host has no template."""
    return html.extract_text(html.read(page), set(), set(), set())


def test_attributes_that_hide():
    gone = ["div hidden", 'div HIDDEN=""', 'p aria-hidden="true"', 'div class="x site-header"', "div id=comments", 'div role="navigation"', 'div class="ad ad-300x250"', 'div class="left sidebar"']
    for a in gone:
        assert text_of(f"<article><{a}>gone</{a.split()[0]}><p>kept</p></article>") == "kept", a
    for beside in ("related", "comment-list"):  # articles in marked elements beside the page's own
        assert text_of(f'<article><p>kept</p></article><div class="{beside}"><article>gone</article></div>') == "kept"
    assert text_of('<body class="has-sidebar"><div class="content no-banner"><p>kept</p></div></body>') == "kept"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "plain text"), (4, "http://a/", "<p>a<p>b</div></i> < c"), (4, "http://a/", "<p>a<p>b</div></i> < c"), (None, "http://a/", "<!-- open <p>x"), (5, "http://b/", "<article>" + "<p>w</p>" * 20_000), (6, "http://b/", "<div " * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS template", "1 AS n_chars")
    got = html.extract(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == text[2] == text[None] == "" and text[3] == "plain text" and text[4] == "a b < c"
    assert text[5] == " ".join(["w"] * 20_000) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


def test_classes_nest_by_their_paths():
    token = lambda p, up: {"path": p, "parent": up, "flags": 1}
    frame, items, loose = [token(0, 0), token(1, 0), token(2, 1)], [token(3, 2)], [token(5, 4)]
    assert set(html.nest([items, loose, frame])) == {0, 1, 2, 3}


def test_what_a_page_may_hold():
    """Names that only look telling, odd quotes, letters whose lower case is longer, links in prose."""
    assert text_of('<div class="content has-sidebar"><p>a</p></div>') == "a"
    assert text_of('<article><p>x</p><section class="share-price"><p>b</p></section><div id="widget-history"><p>c</p></div></article>') == "x b c"
    assert text_of("<article><p title=it's>d</p><p title='>'>e</p><p a=\"b>\" c>f</p><p =x \">g</p></article>") == "d e f g"
    assert text_of("<p>" + "\u0130" * 9 + "</p><script>var a = '<p>no</p>'</SCRIPT><p>h</p>") == "\u0130" * 9 + " h"
    assert text_of('<p><a href="x">all of it is a link</a></p><p>i <a>j</a></p><div><a>k</a></div>') == "all of it is a link i j k"
    assert text_of('<div><a href="1">one</a> <a href="2">two</a> <a href="3">three</a></div><p>l</p><ul><li><a>m</a><li><a>n</a><li><a>o</a></ul>') == "l"
    assert text_of('<article><ul><li><a>m</a><li><a>n</a><li><a>o</a></ul></article>') == "m n o"


def test_cost_grows_with_the_length_of_a_page():
    import time

    for bit in ("<div>", "<ul><li>", "<b>", "<a>", "<p>", "<div class='a'>x", "<table><tr><td>y", "</div>"):
        began = time.perf_counter()
        p = html.read(bit * 40_000)
        html.text_tokens(p)
        html.extract_text(p, set(), set(), {1})
        assert time.perf_counter() - began < 6, bit


def test_blocks_outside_any_group_are_template_where_pages_repeat_them(spark):
    page = "<body><p>we use a thing</p><h1>Title {n}</h1><p>text {n}</p><p>the small print</p></body>"
    rows = [(i, "http://h.example/", page.format(n=i)) for i in range(5)] + [(9, "http://alone.example/", page.format(n=9))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"Title {i} text {i}" for i in range(5)]
    assert got[9] == "we use a thing Title 9 text 9 the small print"  # no template to deduce


# -- vectors -----------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "'x' AS ids", "'y' AS rep", "2 AS keys")


def brute_topk(rows, k=5):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for n, (q, v) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])}
    return out


def test_topk_as_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 20) / 8).tolist()) for i in range(400)]  # many ties
    rows += [(i, (rng.standard_normal(64) * 10.0 ** rng.integers(-3, 3)).tolist()) for i in range(1000, 1300)]
    rows += [(350_000, [1e300] * 3), (1, [1e300, 2.0, -1e200]), (2, [0.5, 1.0, 1e18]), (400_000, None), (450_000, [1.0, None]), (500_000, [math.nan]), (550_000, []), (3, [])]
    got = {tuple(r) for r in topk.search(vectors(spark, rows), "vec_id % 50 = 0").collect()}
    assert got == brute_topk(rows)
    assert topk.search(vectors(spark, []), "vec_id % 50 = 0").count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for scale in (1, 5):
        q, d = (np.floor(rng.standard_normal((48, n)) * 256 / np.arange(1, 49)[:, None] ** scale) for n in (30, 500))
        full = q.T @ d
        floor = np.sort(full, axis=1)[:, -5]
        who, cand, s = topk.pair_scores(q, d, floor, np.arange(48))
        assert {(a, b) for a, b in zip(who.tolist(), cand.tolist())} == set(zip(*(x.tolist() for x in np.nonzero(full >= floor[:, None])))) and (s == full[who, cand]).all()


def brute_links(rows, t=0.9):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= t
    ids, top = [i for i, _ in ok], list(range(len(ok)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    groups = {}
    for a in range(len(ok)):
        groups.setdefault(find(a), []).append(ids[a])
    return {i: (int(near[a].sum()) - 1, min(groups[find(a)])) for a, i in enumerate(ids)}


def test_vector_links(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    rows, i = [], 0
    for n, b in enumerate(base):
        for _ in range(700 if n == 0 else 3 if n % 2 else 1):  # a hot group, over several blocks
            rows.append((i, (b + rng.standard_normal(32) * 0.1).tolist()))
            i += 1
    rows += [(i + j, rows[5][1]) for j in range(20)] + [(9000, None), (9001, [0.0] * 32), (9002, [math.inf] * 32), (9003, [None] * 32), (9004, [1.0, 0.0])]
    got = {r["vec_id"]: r for r in itq.near_duplicates(vectors(spark, rows)).collect()}
    want = brute_links([r for r in rows if r[0] < 9004])
    assert len(got) == len(rows)
    found, all_ = sum(got[v]["n_links"] for v in want), sum(n for n, _ in want.values())
    assert 0.97 * all_ <= found <= all_ and all(got[v]["n_links"] <= n for v, (n, _) in want.items())
    assert sum(got[v]["component_id"] == c for v, (_, c) in want.items()) >= 0.98 * len(want)
    for v in (9000, 9001, 9002, 9003, 9004):
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (0, v, True)
    assert itq.near_duplicates(vectors(spark, [])).count() == 0


def test_recall_at_the_threshold():
    """Pairs of just the threshold's cosine share a table as often as planned."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    width, tables = itq.plan(50_000, 0.9)
    model = itq.learn(x, -(-width * tables // 64))
    assert (itq.keys(x, model, width, tables) == itq.keys(y, model, width, tables)).any(axis=1).mean() >= 0.93
    bits = np.concatenate([x @ r > c for r, c in model], axis=1).mean(axis=0)
    assert np.abs(bits - 0.5).max() < 0.01


@pytest.mark.parametrize("shared", [0.5, 0.69, 0.95])
def test_recall_with_a_common_direction(spark, shared):
    """Links at just the threshold are found as planned where all vectors share a mean direction."""
    rng = np.random.default_rng(6)
    n = 400 if shared > 0.9 else 3000
    x = math.sqrt(shared) * np.eye(64)[0] + math.sqrt((1 - shared) / 64) * rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.901 * x + math.sqrt(1 - 0.901**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = list(enumerate(np.concatenate((x, y)).tolist()))
    want = brute_links(rows)
    got = {r["vec_id"]: r["n_links"] for r in itq.near_duplicates(vectors(spark, rows)).collect()}
    found, all_ = sum(got.values()), sum(k for k, _ in want.values())
    assert 0.95 * all_ <= found <= all_ and all(got[v] <= k for v, (k, _) in want.items())


@pytest.mark.parametrize("dims", [1, 2, 8, 64])
def test_tables_follow_from_measured_pairs(dims):
    x = np.random.default_rng(8).standard_normal((500, dims)) + 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model, width, tables, radius = itq.fit(x, x, 50_000, 0.9)
    for a, b in itq.probes(x, 0.9, seed=11):
        p, q = (itq.keys(v, model, width, tables) for v in (a, b))
        assert ((p == q).any(axis=1) & (np.bitwise_count(p ^ q).sum(axis=1) <= radius)).mean() >= 0.94


# -- pipeline -----------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, seen = Scratch(spark, "test"), [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(scratch.save(stage(spark, seen[-1], SF)))
        assert seen[-1].columns == docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    ids = [[r["doc_id"] for r in s.select("doc_id").collect()] for s in seen]
    assert sorted(ids[1]) == sorted(clean)
    kept = {r["doc_id"] for r in minhash.near_duplicates(seen[1], k=5).where("kept").collect()}
    assert sorted(ids[2]) == sorted(kept)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen[2]).collect()}
    assert {d: ids[3].count(d) for d in copies} == copies
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens, times = {}, {}
    for r in pieces:
        tokens[r["doc_id"]] = r["doc_tokens"]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["length"]
    assert {d: n // tokens[d] for d, n in times.items()} == {d: n for d, n in copies.items() if n}


def test_each_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 11)) and "pipeline" in names


def test_random_pages_never_fail():
    rng = random.Random(7)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "text", " ", "<b>", "</b>", "<script>", "</script>", "<!--", "-->", "<a href=\"x>", "&amp;", "&#x41;", "<", ">", "<article>", "</article>", "<br/>", "</"]
    for _ in range(300):
        p = html.read("".join(rng.choices(bits, k=40)))
        assert sum(p.count) >= len(p.step) and all(0 <= up < max(1, node) for node, up in enumerate(p.parent))
        assert all(0 <= start < end <= len(p.texts) for _, start, end in p.spans)
