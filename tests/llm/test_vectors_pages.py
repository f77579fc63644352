"""Operators on vectors and pages against brute force, and the pipeline's stages."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordrate.llm import embedding_dedup, graph, html_extract, topk_inner

NAN, INF = float("nan"), float("inf")


ODD = [(900, None), (901, []), (902, [None] + [1.0] * 7), (903, [NAN] + [1.0] * 7), (904, [INF] + [1.0] * 7), (905, [0.0] * 8), (None, [1.0] * 8)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0, 3) for i, v in rows], "vec_id long, embedding array<double>, label int, score double, rank int")


def table(n=300, d=8, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * r.uniform(0.1, 2, size=(n, 1))
    x[50:120] = x[50] + r.normal(size=(70, d)) * 0.02  # a group of near copies
    x[200:205] = x[200]  # copies
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def best_inner(rows, k):
    """(query, rank, candidate, score) of all queries by whole numbers of any size."""
    v = [(i, [math.floor(Fraction(c) * 64) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    want = []
    for q, a in v:
        if q % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in v if c != q)[:k]
            want += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return sorted(want)


def answered(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block,queries", [(32, 4), (7, 1), (4096, 1024)])
def test_top_inner_is_exact(spark, block, queries):
    """Several waves of blocks, and one block."""
    rows = table() + ODD
    assert answered(topk_inner.top_inner(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=7, block=block, queries=queries)) == best_inner(rows, 7)


def test_top_inner_of_large_numbers_and_mixed_lengths(spark):
    """Scores beyond the whole numbers of a double, components beyond those of a long, short and empty vectors."""
    r = random.Random(4)
    rows = [(i, [r.choice([-1, 1]) * r.uniform(0.5, 2) * 10.0 ** r.choice([0, 1, 2]) for _ in range(r.choice([0, 1, 5, 8]))]) for i in range(100)]
    rows += [(100, [1e12, 1.0]), (101, [1.0 / 64, 2.0 ** 40]), (102, [0.0] * 9 + [1e300]), (103, [3.0]), (104, [-0.5, 0.25] * 4), (105, [0.0, 0.0, 0.0, 1e13, 1.0 / 64]), (106, [0.0] * 4 + [5.0])]
    got = answered(topk_inner.top_inner(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5, block=16, queries=2))
    want = [x for x in best_inner(rows, 5)]
    assert all(abs(s) < 2**63 for *_, s in want) and max(abs(s) for *_, s in want) > 2**56
    assert got == want
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        topk_inner.top_inner(vectors(spark, [(0, [1e12]), (1, [1e12])]), F.col("vec_id") == 0).collect()


def test_thresholds_and_bounds_save_products():
    """Falling lengths and the Cauchy-Schwarz bound leave most products unmultiplied, and none that counts."""
    r = np.random.default_rng(3)
    heavy = np.concatenate([r.normal(size=(6000, 8)) * 20, r.normal(size=(6000, 56))], axis=1) * r.uniform(0.05, 1, size=(6000, 1)) ** 2
    c = np.floor(64 * heavy)
    order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
    c, ids = c[order], order.astype(np.int64)
    q, qi = c[::300], ids[::300]
    rotation = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    row, found, score, products = topk_inner.process(q, qi, c, ids, np.full(len(q), -np.inf), rotation, 20)
    for i in range(len(q)):
        s = c @ q[i]
        s[ids == qi[i]] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        assert sorted(zip(found[row == i].tolist(), score[row == i].tolist())) == sorted(zip(ids[want].tolist(), s[want].tolist()))
    assert products < 0.35 * len(q) * len(c)


def test_top_inner_fewer_rows_than_k(spark):
    got = topk_inner.top_inner(vectors(spark, table()[:3]), F.col("vec_id") == 0, k=20).collect()
    assert sorted(r.rank for r in got) == [1, 2]
    assert topk_inner.top_inner(vectors(spark, ODD[:5]), F.col("vec_id") > 0).count() == 0
    assert topk_inner.top_inner(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") > 0).count() == 0
    again = table()[:60]  # a repeated query id is one query, its rows are candidates for the others
    got = answered(topk_inner.top_inner(vectors(spark, again + [(20, [0.01] * 8), (21, again[21][1])]), F.col("vec_id") == 20, k=5))
    assert len(got) == 5 and [x[1] for x in got] == [1, 2, 3, 4, 5]


def test_near_duplicate_vectors(spark):
    rows = table(400, 8, 2)
    # block 16: crowded cells are split over parts
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(vectors(spark, rows + ODD), 0.9, 0.9999, block=16).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    low = np.arange(len(x))
    while True:
        new = np.array([low[link[i]].min() for i in range(len(x))])
        if (new == low).all():
            break
        low = new
    n = link.sum(axis=1) - 1
    same = sum(got[i] == (n[i], low[i], low[i] == i) for i in range(len(x)))
    assert same >= 0.98 * len(x)  # links at the very threshold are found with probability 0.9999 each
    assert all(got[i][0] <= n[i] for i in range(len(x)))  # and no link below it
    for i, _ in ODD[:-1]:
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)


def test_near_duplicate_vectors_empty(spark):
    assert embedding_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_dedup.near_duplicate_vectors(vectors(spark, ODD)).count() == len(ODD)


def test_calibration_follows_the_threshold():
    k, tables, _, p = embedding_dedup.calibrate(1_000_000, 0.9, 0.99)
    assert p >= 0.99 and tables > embedding_dedup.COUNT and k > embedding_dedup.calibrate(10_000, 0.9, 0.99)[0]


def test_components_of_chains(spark, monkeypatch):
    r = np.random.default_rng(4)
    ids = r.permutation(500).tolist()
    edges = [(a, b) for a, b in zip(ids[:300], ids[1:300])] + [(ids[400], ids[401]), (ids[401], ids[402]), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(6)
    want = {x: min(ids[:300]) for x in ids[:300]} | {x: min(ids[400:403]) for x in ids[400:403]}
    for limit in (400_000, 40):  # one task, and star contraction over several
        monkeypatch.setattr(graph, "TASK_EDGES", limit)
        got = {r.node: r.component for r in graph.components(df).collect()}
        assert got == {k: v for k, v in want.items() if k != v}
    assert graph.components(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- x <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>The  title &amp; more</h1><p><b>First&nbsp;part<br>of a text that goes on for a while.<p>Second &lt;part&gt; of it, also with several words.</p>
<div class="comments"><p>Nice text, I liked to read it a lot.</p></div><form><label>Mail</label><input name=q></form></article>
<aside><p>Other things that one may read.</p></aside><footer>&copy; site</footer></body></html>"""
TEXT = "The title & more\n\nFirst part of a text that goes on for a while.\n\nSecond <part> of it, also with several words."


def test_main_text(spark):
    cut = PAGE[:PAGE.index("Second") + 30]
    rows = [(i, f"u{i}", PAGE, "x") for i in range(20)] + [(100, None, None, "x"), (101, "u", "", "x"), (None, "u", cut, "x"), (3, "u3", PAGE, "x"),
            (102, "u", "<div id='content'><p>Only a plain text here, in a few words.</p></div><div id=sidebar><p>Not this one, though it is long.</p></div>", "x")]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = {(i, u): TEXT for i, u, h, _ in rows if h == PAGE}
    want |= {(100, None): "", (101, "u"): "", (None, "u"): TEXT[:TEXT.index("Second")] + "Second <part> of", (102, "u"): "Only a plain text here, in a few words."}
    by = {(r.page_id, r.url): r.text for r in got}
    cut_text = by.pop((None, "u"))
    want.pop((None, "u"))
    assert by == want and cut_text.startswith(TEXT[:TEXT.index("Second") + 6])
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows)


def test_embedded_elements_cut_nothing_else():
    """Embedded elements, closed, self-closed or never closed, leave the text after them alone."""
    model = html_extract.Model({})
    last = "Last words of the article, which are many enough to be read."
    page = "<body><nav>Home</nav><article><p>First words of it, also many enough to be read.</p>{}<p>" + last + "</p></article><footer>end</footer></body>"
    first = "First words of it, also many enough to be read."
    for tag in ("svg", "math", "canvas", "audio", "video", "object", "template"):
        for some in (f"<{tag} id='x'/>", f"<{tag}>", f"<{tag} width=1>"):
            assert model.text(page.format(some)) == f"{first}\n\n{last}", some
            assert model.text(page.format(some + f"</{tag}>") + f"<{tag}></{tag}>") == f"{first}\n\n{last}", some
    for tag in ("canvas", "audio", "video", "template"):
        assert model.text(page.format(f"<{tag}>You can not see <p>this.</p></{tag}>")) == f"{first}\n\n{last}"
    for some in ("<svg><title/><style/><path d='M0'/></svg>", "<svg><script/>", "<iframe src=x>", "<noscript>"):
        assert model.text(page.format(some)) == f"{first}\n\n{last}", some
    assert model.text(page.format("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data=y>a plot</object><svg><text>A</text><text>B</text></svg> are given.</p>")) == \
        f"{first}\n\nWhere x=2 and a plot A B are given.\n\n{last}"


def test_messages_are_marginals():
    """Sum-product on the tree against the sum over all states."""
    import itertools
    import math

    page = html_extract.parse("<div class=main><p>some words to read here.</p><ul><li><a href=x>link</a></li></ul></div><footer>f</footer>")
    model = html_extract.Model({})
    n, kinds = len(page.tag), html_extract._edges(page)
    own = [-2.0] + [sum(model.weight.get(f, 0) for f in html_extract.features(page, i)) for i in range(1, n)]
    weight = [0.0, 0.0]
    odds = []
    for i in range(n):
        weight = [0.0, 0.0]
        for state in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(o for o, s in zip(own, state) if s))
            for j in range(1, n):
                p *= model.edge[kinds[j]][state[page.parent[j]]][state[j]]
            weight[state[i]] += p
        odds.append(math.log(weight[1] / weight[0]))
    assert np.allclose(model.marginals(page), odds)


def test_main_text_empty(spark):
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    got = out.collect()
    ids = {r.doc_id for r in got}
    assert 0.5 * docs.count() < len(ids) <= docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), sf_dir).columns == docs.columns
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in seqs.values())
