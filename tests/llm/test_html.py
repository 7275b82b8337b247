import re
from html import unescape

from pyspark.sql import functions as F

from fieldloom.llm import html_style_tree, registry


def expected(html):
    """Main text of the generated pages: their article's paragraphs, by plain text operations."""
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|$)", html or "")
    parts = re.split(r"<(?:/?p|/?h1)>", inside[1]) if inside else []
    texts = (" ".join(unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_op10(spark, sf_dir):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = registry.op10_html_style_tree(spark, sf_dir).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.text == expected(html[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title></head><body class="single"><header><h1>Site</h1></header><nav>menu</nav>
<div id="cookie-notice">We use cookies</div><div class="sidebar">side</div>
<main><article><header><h2>Head&eacute;r</h2></header><p>One <i>two</i>&nbsp;three<br>four<p>Five &lt;b&gt; &amp; six
<ul><li>a<li>b</ul><form><input>send</form><script>var x = "</p>";</script><div class="ad-box">buy</div><!-- c > --><pre> x
 y </pre></article><section class="comments"><p>first!</p></section></main><footer>f</footer></body></html>"""


def test_kinds_that_go():
    assert html_style_tree.main_text(PAGE, set()) == "Headér\nOne two three four\nFive <b> & six\na\nb\nx y"
    assert html_style_tree.main_text("", set()) == "" and html_style_tree.main_text("plain & text", set()) == "plain & text"
    assert html_style_tree.main_text("<p>a<script>never closed", set()) == "a"


def test_site_boilerplate_goes_and_copies_stay(spark):
    page = "<body><div>Welcome to our site</div><div><p>story {i} of many words</p></div><div>All rights</div></body>"
    rows = [(i, "http://h.example/" + str(i), page.format(i=i)) for i in range(40)]
    copies = [(100 + i, "http://c.example/" + str(i), "<body><article><p>one text for all</p></article></body>") for i in range(40)]
    odd = [(200, None, None), (201, "nonsense", ""), (200, None, None)]
    pages = spark.createDataFrame([*rows, *copies, *odd], "page_id long, url string, html string")
    texts = sorted((r.page_id, r.text) for r in html_style_tree.extract(pages.withColumn("text", F.lit(1))).collect())
    want = [(i, f"story {i} of many words") for i in range(40)] + [(100 + i, "one text for all") for i in range(40)] + [(200, ""), (200, ""), (201, "")]
    assert texts == want
    assert html_style_tree.extract(pages.where(F.lit(False))).count() == 0


def test_importance_by_brute_force(spark):
    """Originality, node, content and branch importance by plain loops over the pages of each host."""
    import math
    import random
    from collections import Counter, defaultdict

    rng, rows = random.Random(8), []
    for i in range(60):
        body = "".join(f"<p>{rng.choice(['same words', f'own {rng.random()}', f'of few {rng.randrange(6)}'])}</p>" for _ in range(rng.randrange(4)))
        rows.append((i % 50, f"http://h{i % 3}.example/{i % 50}", f"<ul class='m{i % 2}'><li>menu</li><li>item {rng.randrange(3)}</li></ul><article><h2>Head</h2>{body}</article>"))
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    featured = html_style_tree.features(pages)
    contents, branches = html_style_tree.importance(featured)
    want_contents, want_branches = {}, {}
    for host in ("h0.example", "h1.example", "h2.example"):
        own = [html_style_tree.blocks(h) for _, u, h in rows if f"//{host}/" in u]
        times = Counter(t for found in own for t in {t for _, t in found})
        weights = [1 - sum(len(t) * (1 - 1 / times[t]) for t in {t for _, t in found}) / sum(len(t) for _, t in found) for found in own]
        at, styles, of, has, marks, up = defaultdict(float), defaultdict(Counter), defaultdict(float), defaultdict(float), {}, {}
        for found, weight in zip(own, weights):
            elements = {e.path: e for x, _ in found for e in x.line()}
            for path, e in elements.items():
                at[path] += weight
                styles[path][str(list(dict.fromkeys(e.children)))] += weight
                marks[path] = (e.main and not e.doubtful) or marks.get(path, False)
                up[path] = [x.path for x in e.line()]
                of[path] += weight * sum(x.path == path for x, _ in found)
            for path, text in {(e.path, t) for e, t in found}:
                has[path, text] += weight if times[text] > 1 else 0
        key, lost = spark.range(1).select(F.xxhash64(F.lit(host))).first()[0], defaultdict(float)
        for (path, text), n in has.items():
            if times[text] > 1:
                rate = 1 - math.log(max(1, n)) / math.log(at[path] + html_style_tree.UNSEEN_PAGES)
                want_contents[key, path, html_style_tree.text_key(text)] = rate
                lost[path] += n * (1 - (rate if marks[path] else 1 / max(1, n)))
        looks = {p: 1.0 if m <= 1.0001 else min(1, max(0, -sum(x / m * math.log(x / m) for x in styles[p].values() if x > 0) / math.log(m))) for p, m in at.items()}
        for path in at:
            below = [p for p in at if path in up[p]]
            share = 1 - sum(lost[p] for p in below) / sum(of[p] for p in below)
            alone = max(1 - lost[p] / of[p] for p in below if of[p] > 0)
            want_branches[key, path] = max(html_style_tree.PRESENTATION * sum(looks[p] for p in below) / len(below) + (1 - html_style_tree.PRESENTATION) * share, alone)
    got = {(r.host, r.path, r.feature): r.importance for r in contents.collect()}
    assert got.keys() == want_contents.keys() and all(abs(got[k] - want_contents[k]) < 1e-9 for k in got)
    got = {(r.host, r.path): r.importance for r in branches.collect()}
    assert got.keys() == want_branches.keys() and all(abs(got[k] - want_branches[k]) < 1e-9 for k in got)


def test_tree_alone_finds_menus_adverts_and_shared_paragraphs(spark):
    """Without any list: rotating adverts and menus go as branches, a paragraph that all articles share goes by itself, a
    passage of some articles, headings and near copies stay."""
    rows = []
    for i in range(300):
        passage = "<p>a passage that one article in ten has</p>" if i % 10 == 0 else ""
        article = f"<h2>Summary</h2><p>story {i} {i * i} of its own</p>{passage}<p>Write to us about this story</p><p>more on {i}, {i + 1000}</p>"
        rows.append((i, f"http://h.example/{i}", f"<body><nav><ul><li>home</li><li>item {i % 20}</li></ul></nav><div class='x'>advert {i % 30}</div><article>{article}</article></body>"))
    near = "".join(f"<p>paragraph {k} of the text that was copied</p>" for k in range(12))
    rows += [(1000 + i, f"http://c.example/{i}", f"<body><article>{near}<p>changed in {i}</p></article></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text.split("\n") for r in html_style_tree.extract(pages, lists=False).collect()}
    for i in range(300):
        assert texts[i] == ["Summary", f"story {i} {i * i} of its own", *["a passage that one article in ten has"] * (i % 10 == 0), f"more on {i}, {i + 1000}"]
    assert all(len(texts[1000 + i]) == 13 for i in range(60))


def test_hosts(spark):
    urls = {None: "", "": "", "nonsense": "", "http://A.example/x": "a.example", " https://u:p@b.example:80?q#f": "b.example:80", "ftp://c": "c"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", html_style_tree.host_of(F.col("url")).alias("host")).collect()
    assert {r.url: r.host for r in rows} == urls
