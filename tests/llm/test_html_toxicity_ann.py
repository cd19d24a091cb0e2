import html as entities
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import HARD

from varloom.llm import ann, html, queries, toxicity

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav>
<div class="cookie-banner notice">We use cookies here</div>
<main><h1>Head&nbsp;line</h1><p>First  <b>bold</b> text &amp; more<br>next line</p><aside>Related things</aside><div class="ad">Buy now</div>
<ul><li>One<li>Two</ul><script>if (a<b) { "</p>" }</script><form><input value="x > y">Your name</form><p>Last &lt;one&gt;</p></main>
<section id="comments"><p>I disagree with all of it, every single word</p></section><footer>&copy; 2020</footer></body></html>"""


def test_page():
    w = html.train(html.LABELLED)
    assert html.extract(PAGE, w) == "Head line\n\nFirst bold text & more next line\n\nOne\n\nTwo\n\nLast <one>"
    assert html.extract(None, w) == "" and html.extract("", w) == "" and html.extract("<p", w) == "" and html.extract("<<<>>&&", w) is not None
    assert html.extract('<div class="content"><p>some words stand here</p></div><div class="footer">foot</div>', w) == "some words stand here"
    assert html.extract("<p>just one paragraph of words", w) == "just one paragraph of words"
    assert html.extract("<article>" + "<div>" * 5000 + "deep" + "<p>" + "word " * 50000, w).startswith("deep")
    assert html.extract('<article><p title="' + "a" * 100000, w) == ""


def test_zones_below_any_depth():
    w = html.train(html.LABELLED)
    for n in (3, 511, 600, 5000):
        page = "<font><span><div>" * n + "menu words <article><p>the text of the page stands here</p><div class=ad>Buy now</div><p>and ends here</p></article> footer words"
        assert html.extract(page, w) == "the text of the page stands here\n\nand ends here"
    assert html.extract("<article>" + "<b>" * 50000 + "<p>deep</i>" * 50000, w).startswith("deep")  # not quadratic


def test_layout_classes_are_no_zones():
    w = html.train(html.LABELLED)
    text = "<{0}><p>The council met on Monday and agreed on a plan.</p></{0}>"
    for name in ("article", "main"):
        for wrap in ('<body class="single-post has-sidebar">', '<div id="page" class="right-sidebar">', '<body class="search">', '<div class="layout right-sidebar"><div>', '<form id="all">'):
            assert html.extract(wrap + "<nav>Home</nav>" + text.format(name) + "<footer>Imprint</footer>", w) == "The council met on Monday and agreed on a plan.", wrap
    two = '<div class="layout right-sidebar">' + text.format("article") * 2 + "</div>"
    assert html.extract(two, w).count("council") == 2
    # Comments and teasers stay out though they are article elements.
    out = '<div class="comment-list"><article class="comment">No, not at all</article></div><div class="related"><article>Read this too</article></div>'
    assert html.extract(text.format("article") + out, w) == "The council met on Monday and agreed on a plan."
    assert html.extract('<div id="page" class="right-sidebar"><div class="content"><p>Words of the page.</p></div></div>', w) == "Words of the page."


def test_boilerplate_words_decide():
    w = html.train(html.LABELLED)
    text = "<article><p>The council met on Monday and agreed on a plan.</p>{0}<p>Work begins in spring.</p></article>{1}"
    whole = "The council met on Monday and agreed on a plan.\n\nWork begins in spring."
    for name in ("comment-body", "comment-content", "footer-content", "sidebar-content", "ad-text", "cookie-text", "sidebar main", "text advert", "main-navigation"):
        part = f'<div class="{name}"><p>Other words that do not belong to the article at all, however many of them there are.</p></div>'
        assert html.extract(text.format("", part), w) == whole, name
        assert html.extract(text.format(part, ""), w) == whole, name
    for name in ("content-with-sidebar", "post has-sidebar", "main no-ads", "main sidebar-right", "entry category-search tag-menu", "text"):
        assert html.extract(f'<nav>Home</nav><div class="{name}"><p>The council met on Monday.</p></div><div class="footer">Imprint</div>', w) == "The council met on Monday.", name
    assert html.extract("<header>Site</header><article><header><h1>The plan</h1><span>by Ann</span></header><p>The council met on Monday.</p></article>", w) == "The plan\n\nThe council met on Monday."
    assert html.extract('<article><p>The council met on Monday.</p></article><article class="comment"><p>No, they never meet at all on any day</p></article>', w) == "The council met on Monday."


STORY = "<p>The council met on Monday and agreed on a plan.</p><p>Work begins in spring, when the ground is soft.</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="tabs-content"><div class="story-text">{}</div></div>',
        '<div class="widget-main"><div class="entry-content">{}</div></div>',
        '<div class="search-page"><div class="post">{}</div></div>',
        '<div class="social-entry content">{}</div>',
        '<div class="ad-free story">{}</div>',
        '<form action="/"><div class="content">{}</div></form>',
        '<form><div class="tabs-content"><div class="widget-main"><div class="post">{}</div></div></div></form>',
    ],
)
def test_wrapper_around_most_of_the_page_is_no_boilerplate(page):
    w = html.train(html.LABELLED)
    whole = "The council met on Monday and agreed on a plan.\n\nWork begins in spring, when the ground is soft."
    around = '<nav><a>Home</a> of the site</nav><div class="sidebar"><a>Other stories to read today, and those of the days before</a></div>{}<div class="comments"><p>' + "I do not agree at all. " * 20 + '</p></div><footer>Imprint</footer>'
    assert html.extract(page.format(STORY), w) == whole
    assert html.extract(page.split("{}")[0] + STORY, w) == whole  # unclosed
    assert html.extract(around.format(page.format(STORY)), w) == whole
    # Beside marked main text the names hold.
    other = "<article><p>The mill by the river ground grain for three villages.</p></article>"
    assert html.extract(other + around.format(page.format(STORY)).replace('class="content"', 'class="inner"'), w) .startswith("The mill by the river")
    # So they do where no name of main text is inside, or less than half of the words.
    assert html.extract(f'<div class="cookie-notice">{STORY}</div><div>Few words</div>', w) in ("", "Few words")


def test_article_header_keeps_its_first_lines():
    w = html.train(html.LABELLED)
    page = '<header>Site</header><article><header><h1>The plan</h1><p class="standfirst">What the council wants.</p><p class="byline">by Ann</p><span>May</span></header><p>It met on Monday.</p><div class="user-opinions"><p>No!</p></div></article>'
    assert html.extract(page, w) == "The plan\n\nWhat the council wants.\n\nIt met on Monday."


def test_weights_are_learned():
    """No zone or tag is decided beforehand: labels the other way round turn the weights round."""
    w = html.train(html.LABELLED)
    turned = html.train([[("-" if x == "+" else "+", h) for x, h in page] for page in html.LABELLED])
    assert w["zone:article"] > 0 > w["zone:nav"] and turned["zone:article"] < 0 < turned["zone:nav"]
    assert all(x < 0 for k, x in w.items() if k.startswith("tag:")) and w["tag:p"] > w["tag:nav"] and turned["tag:p"] < turned["tag:nav"]
    assert {f"zone:{z}" for z in html.BOILERPLATE} <= w.keys() and all(w[f"zone:{z}"] < 0 for z in html.BOILERPLATE)


def test_best_stretch_is_the_maximum():
    """The scan against all stretches of random scores and of short random pages."""
    rng = random.Random(1)
    w = html.train(html.LABELLED)
    for n in range(400):
        if n % 2:
            scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randrange(14))]
        else:
            page = "".join(rng.choice(["<article>", "</article>", "<nav>", "</nav>", "<p>", "<div>", "</div>", "word ", "two words ", "<footer>", "</footer>"]) for _ in range(rng.randrange(1, 14)))
            scores = html.worth(html.tokens(page), w)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        best = max(sums.values(), default=0)
        begin, end = html.best_stretch(scores)
        if best <= 0:
            assert (begin, end) == (0, 0)
        else:
            assert math.isclose(sums[begin, end], best, abs_tol=1e-9)


def truth(h):
    a = h[h.index("<article>") + 9 : h.index("</article>")]
    parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", s.replace("<br>", " "))).split()) for s in re.split(r"</?(?:p|h1)>", a))
    return "\n\n".join(s for s in parts if s)


def test_pages_table(spark, sf_dir):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op8_html(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == truth(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_hard_pages(spark, hard, nothing):
    out = html.extract_text(hard.withColumnRenamed("text", "html"), weights=html.train(html.LABELLED)).collect()
    assert len(out) == len(HARD)
    assert html.extract_text(nothing.withColumnRenamed("text", "html")).count() == 0


def test_toxicity_accuracy(spark, sf_dir):
    got = queries.op9_toxicity(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(got) == docs
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            total += 1
            right += r["predicted"] == labels[r["doc_id"]]
    assert right / total >= 0.95


def test_nearest_examples_are_exact():
    rng = random.Random(4)
    names = [f"t{i}" for i in range(30)]
    idf = {t: rng.uniform(1, 4) for t in names} | {toxicity.REST: 1.0}
    weight = np.array(list(idf.values()))
    vectors = []
    for _ in range(700):
        v = toxicity.weigh({i: rng.randint(1, 5) for i in rng.sample(range(30), rng.randint(1, 6))}, weight)
        vectors.append(v)
    m = toxicity.Model(idf, vectors, [i % 2 for i in range(700)], (1.0, 1.0), 0.1)
    for _ in range(100):
        q = toxicity.weigh({i: rng.randint(1, 5) for i in rng.sample(range(30), rng.randint(1, 8))}, weight)
        want = sorted((-round(sum(x * v.get(i, 0) for i, x in q.items()), 12), e) for e, v in enumerate(vectors))
        want = [(-s, e) for s, e in want if s < 0][: m.k]
        assert [(pytest.approx(s, abs=1e-9), e) for s, e in want] == m.nearest(q)


def test_toxicity_hard(spark, hard, nothing):
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(12)] + [(1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(hard, labels, evidence=True).collect()
    assert len(out) == len(HARD) and all(0 <= r["score"] <= 1 for r in out)
    none = labels.limit(0)
    assert {r["score"] for r in toxicity.toxicity(hard, none).collect()} == {0.0}
    assert toxicity.toxicity(nothing, none).count() == 0
    rng = random.Random(2)
    other = lambda: " ".join("".join(rng.choice("klmnop") for _ in range(4)) for _ in range(20))
    m = toxicity.fit([(f"{other()} awful {other()}", 1) for _ in range(20)] + [(other(), 0) for _ in range(60)])
    assert m.score("so awful")[0] > 0.5 > m.score("so fine")[0] and math.isclose(m.score(None)[0], m.score("")[0])


def test_copies_of_examples_are_found():
    """A toxic example without any selected term, once or in thousands of copies, is found by its own words."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("klmnopqr") for _ in range(4)) for _ in range(30))
    clean, lone, group = [text() for _ in range(600)], text(), text()
    m = toxicity.fit([(t, 0) for t in clean] + [(lone, 1)] + [(group, 1)] * 300, (6000, 301))
    assert not m.whole and not m.starts
    assert m.score(lone)[0] > 0.5 and m.score(group)[0] > 0.5 and m.score(group + " one more")[0] > 0.5
    assert all(y < 0.5 for y, _ in m.scores(clean))
    # The batch and the block-max search agree.
    for t in [*clean[:40], lone, group, text(), " ".join(w for c in clean[:3] for w in c.split()[:9])]:
        assert [(pytest.approx(c, abs=1e-9), e) for c, e in m.nearest(m.vector(t))] == m.score(t)[1]


def brute(x, k, every):
    ids = sorted(i for i, _ in x)
    d = {}
    for q, v in x:
        if q % every:
            continue
        s = sorted(((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in x if i != q))[:k]
        d[q] = [(i, -s_) for s_, i in s]
    return ids, d


def test_ann_recall(spark):
    e = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    _, want = brute(e, 20, 20)
    got = {}
    for r in queries.op10_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(want)
    vec = dict(e)
    hit = 0
    for q, near in got.items():
        assert sorted(near) == list(range(1, 21))
        ranked = [near[i] for i in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
        for i, s in ranked:
            assert i != q and math.isclose(s, float((np.array(vec[i], float) * np.array(vec[q], float)).sum()), rel_tol=1e-12, abs_tol=1e-12)
        hit += len({i for i, _ in ranked} & {i for i, _ in want[q]})
    assert hit / (20 * len(want)) >= 0.9


def test_ann_ties_and_hard(spark):
    one = [1.0, 2.0]
    x = [(i, one) for i in range(60)] + [(100, [3.0, 1.0]), (120, [-1.0, 0.5])]
    bad = [(200, None), (220, []), (240, [0.0, 0.0]), (260, [float("nan"), 1.0]), (280, [float("inf"), 1.0]), (300, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(x + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, every=20, k=5, block_rows=1000).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    _, want = brute(x, 5, 20)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want
    assert ann.nearest(df.limit(0)).count() == 0


def test_ann_repeated_ids(spark):
    """Rows that repeat count once; an id with several vectors is several candidates and asks with its smallest."""

    def got(rows, k):
        df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, query_id int").repartition(3)
        out = {}
        for r in sorted(ann.nearest(df, k=k).collect(), key=lambda r: (r["query_id"], r["rank"])):
            out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        return out

    five = [(i, [1.0, float(i)]) for i in (1, 2, 3, 4, 5)]
    assert got([(0, [1.0, 1.0])] * 2 + five, 5) == {0: [(i + 1, 5 - i, 6.0 - i) for i in range(5)]}
    assert got([(0, [1.0, 1.0])] * 25 + [(i, [1.0, 1.0]) for i in (1, 2, 3)], 5) == {0: [(i, i, 2.0) for i in (1, 2, 3)]}
    assert got([(0, [1.0, 1.0]), (0, [9.0, 9.0]), (7, [1.0, 0.0]), (7, [0.0, 3.0]), (7, [0.0, 3.0])], 5) == {0: [(1, 7, 3.0), (2, 7, 1.0)]}


def test_ann_many_blocks(spark):
    """Clusters over many blocks: distant blocks are passed by, near ones are not."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = [(i, [float(c) for c in centres[i % 40] + 0.3 * rng.standard_normal(16)]) for i in range(3000)]
    _, want = brute(x, 10, 20)
    got = {}
    for r in ann.nearest(spark.createDataFrame(x, "vec_id long, embedding array<double>"), k=10, block_rows=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
