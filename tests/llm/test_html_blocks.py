import random

import numpy as np
import pytest

from tidebar.llm import html_blocks as H


@pytest.fixture(scope="module")
def model():
    return H.trained()


def test_blocks_of_training_pages_match_their_labels():
    r = random.Random(1)
    for _ in range(300):
        page, labels = H.training_page(r)
        assert len(H.blocks(page)) == len(labels), page


def test_held_out_accuracy(model):
    r = random.Random(99)
    pages = [H.training_page(r) for _ in range(200)]
    right = total = 0
    for (page, labels), p in zip(pages, (model.predict([H.inputs(H.blocks(p))])[0] for p, _ in pages)):
        right += sum((x >= 0.5) == bool(y) for x, y in zip(p, labels))
        total += len(labels)
    assert right / total > 0.985, right / total


def test_context_matters(model):
    """The same block is read differently in different surroundings."""
    found = H.blocks("<div>one</div>")
    alone = model.predict([H.inputs(found)])[0][0]
    r = random.Random(5)
    page, _ = H.training_page(r)
    longer = model.predict([H.inputs([*H.blocks(page), *found])])[0][-1]
    assert alone != longer


def test_gradients(model):
    m = H.Labeller(3)
    r = random.Random(2)
    made = [H.training_page(r) for _ in range(3)]
    pages, labels = [H.inputs(H.blocks(p)) for p, _ in made], [y for _, y in made]

    def loss():
        p = m.predict(pages)
        return sum(-np.log(x if y else 1 - x) for q, ys in zip(p, labels) for x, y in zip(q, ys)) / sum(map(len, labels))

    g = m.gradients(pages, labels)
    for name in m.p:
        at = tuple(a[0] for a in (abs(g[name]) > abs(g[name]).max() / 2).nonzero())
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = loss()
        m.p[name][at] = old - 1e-5
        down = loss()
        m.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


PAGE = """<html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">The</a></li><li><a href="/b">and</a></li></ul></nav><!-- ad --><div class="ad">Was ist das.</div>
<article><h1>Head &amp; title</h1><p><b>Head &amp; title goes\n on.<br><p>Second &lt;p&gt;.</p><p>Ti.</p></article><footer>&copy; x &middot; De.</footer></body></html>"""


def test_page(model):
    assert H.main_texts(model, [PAGE]) == ["Head & title\nHead & title goes on.\nSecond <p>.\nTi."]


def test_broken_markup_never_fails(model):
    pages = [None, "", "a < b", "<", "<p", "<!--", "<script>", "<p title='>", "</div></div>x", "<div " * 2000, "<div>" * 3000 + "x", '<a href="', "&#xFFFFFFFF; &bogus; &amp", "x" * 200_000, "<p>a" * 5000]
    assert len(H.main_texts(model, pages)) == len(pages)


def test_query(spark, model):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract(df, model=model).collect()), key=str)
    text = H.main_texts(model, [PAGE])[0]
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert H.extract(df.limit(0), model=model).count() == 0


def test_only_scripts_and_styles_are_cut():
    texts = lambda page: [b.text for b in H.blocks(page)]
    for tag in ('<svg class="i"/>', "<svg>", "<video-player a='1'></video-player>", "<style-guide>", "<noscript>", "<canvas>"):
        assert texts(f"<p>a</p>{tag}<p>rest of article</p>") == ["a", "rest of article"], tag
    assert texts("<p>if <math><mi>x</mi></math> is <object>seen</object> <noscript>now</noscript></p>") == ["if x is seen now"]
    assert texts("<p>a</p><script>b</script><style >c</style><p>d</p><script>e<p>f</p>") == ["a", "d"]


def test_deep_pages_keep_their_containers():
    page = '<article class="story">' + "<div>" * 400 + "<p>deep</p>" + "</article><p>after</p>"
    deep, after = H.blocks(page)
    assert set(H._path_ids("article", ' class="story"')) <= set(deep.path)
    assert after.path == sorted(H._path_ids("p", ""))


def test_every_page_of_a_table(model):
    """The small table's pages mark their article: the text of every page is its blocks, all of them and no other."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    mark = H._path_ids("article", "")[0]
    want = ["\n".join(b.text for b in H.blocks(p) if mark in b.path) for p in pages]
    assert H.main_texts(model, pages) == want and len(pages) == 250 and all(want)
    # the element's name is not what decides
    renamed = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    assert H.main_texts(model, renamed) == want


def test_forward_pass_unit_by_unit(model):
    """The labels of a page by the LSTM's equations, one block and one number after the other; pages of unlike length in one batch."""
    r = random.Random(7)
    pages = [H.inputs(H.blocks(H.training_page(r)[0])) for _ in range(3)]
    sigmoid, p, n = lambda v: 1 / (1 + np.exp(-v)), model.p, H.HIDDEN
    for page, got in zip(pages, model.predict(pages)):
        x = []
        for paths, words, measures in zip(*page):
            mean = lambda name, ids: sum(p[name][i] for i in ids) / len(ids) if ids else np.zeros(H.WIDTH)
            x.append(np.concatenate([mean("path", paths), mean("word", words), measures]))
        z = np.full(len(x), p["bias"][0])
        for k, way in enumerate("fb"):
            h, c = np.zeros(n), np.zeros(n)
            for t in range(len(x)) if way == "f" else reversed(range(len(x))):
                a = p[f"c{way}"] + x[t] @ p[f"x{way}"] + h @ p[f"h{way}"]
                c = sigmoid(a[:n]) * c + sigmoid(a[n : 2 * n]) * np.tanh(a[3 * n :])
                h = sigmoid(a[2 * n : 3 * n]) * np.tanh(c)
                z[t] += h @ p["out"][k * n : (k + 1) * n]
        assert np.allclose(got, sigmoid(z), atol=1e-9)


def test_container_measures_by_walking_up():
    page = "<body><div><p>a b c d e f g h i j k l m n o p q r s t</p><p>one</p></div><div><ul><li><a>x y</a></li><li>z</li></ul></div></body>"
    long, one, x, z = H.blocks(page)
    total = 24
    assert np.allclose(long.place[:4], [21 / total, 1, 21 / total, 20 / total]) and np.allclose(x.place[:4], [3 / total, 3 / total, 3 / total, 3 / total])
    assert one.place[7:] == (0.2, 0.2) and x.place[7:] == (0.4, 0.6) and x.place[4] == 3 / 4 and z.left == 1


def test_memory_does_not_follow_a_page(model):
    import tracemalloc

    page = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    tracemalloc.start()
    text = H.main_texts(model, [page])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and text.count("word") > 19_000


def foreign_page(r):
    """Markup of other making than the training pages: framework classes, tables, headings in side matter, links in the text."""
    word = lambda: "".join(r.choice("aeioulnrstdmk") for _ in range(r.randint(2, 10)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    main, side = r.choice([("<div class='td-post-content'>", "<div class='td-ss-main-sidebar'>"), ("<section id='story-content'>", "<aside class='widget-area'>"), ("<div itemprop='articleBody' class='entry'>", "<div class='sidebar-right'>"), ("<main class='page-content'>", "<div class='related-posts'>")])
    out, labels = [f"<html><head><title>{line(2, 8)}</title></head><body><div class='site-wrapper'>"], [0]

    def put(text, label):
        out.append(text)
        labels.append(label)

    out.append("<nav class='navbar-nav main-menu'><ul>")
    for _ in range(r.randint(3, 8)):
        put(f"<li class='menu-item'><a href='/{word()}'>{line(1, 2)}</a></li>", 0)
    out.append("</ul></nav>")
    if r.random() < 0.5:
        put(f"<div class='cookie-notice'>{line(4, 12)}.</div>", 0)
    out.append(main)
    put(f"<h1 class='headline'>{line(3, 9)}</h1>", 1)
    for _ in range(r.randint(2, 12)):
        put(f"<p>{line(8, 50)}. <a href='/q'>{line(1, 3)}</a> {line(5, 20)}.</p>", 1)
        if r.random() < 0.2:
            put(f"<h2>{line(2, 6)}</h2>", 1)
    out.append("</div></section></main>")
    out.append(side)
    put(f"<h3 class='widget-title'>{line(1, 3)}</h3>", 0)
    for _ in range(r.randint(1, 5)):
        put(f"<li><a href='/{word()}'>{line(2, 7)}</a></li>", 0)
    out.append("</aside></div>")
    out.append("<div class='comments-area'><ol>")
    for _ in range(r.randint(0, 4)):
        put(f"<li class='comment-body'>{line(5, 30)}.</li>", 0)
    out.append("</ol></div><footer class='site-info'>")
    put(f"&copy; {line(2, 8)}.", 0)
    return "".join(out) + "</footer></body></html>", labels


def test_markup_of_other_making(model):
    r = random.Random(41)
    right = total = 0
    for _ in range(120):
        page, labels = foreign_page(r)
        found = H.blocks(page)
        assert len(found) == len(labels)
        p = model.predict([H.inputs(found)])[0]
        right += sum((x >= 0.5) == bool(y) for x, y in zip(p, labels))
        total += len(labels)
    assert right / total > 0.95, right / total
