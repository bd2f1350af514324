"""Site quality, page text and language against plain code and held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.llm import html_text, language, quality_rules, site_quality
from isotherm.llm.queries import held_out

from .conftest import EDGE

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var a = "</p>";</script></head>
<body><nav><ul><li>Home<li>About</ul></nav><header>Site</header><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><div class="ad">Buy</div>{before}
<article><h1>Title {n}</h1><p><b>First   &amp; bold<br>line {n}<p>Second&nbsp;&eacute; &#8364;</p><form><input name=q>Find</form>
<ul><li>one</li><li>two <i>three</i></ul><section class="comments"><p>A reader says</p></section></article>
<div id="comments"><p>Another reader</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Title {n}\nFirst & bold line {n}\nSecond é €\none\ntwo three"


def test_page_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=i, before="")) for i in range(8)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: TEXT.format(n=i) for i in range(8)}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_recurring_subtrees_go_and_unique_ones_stay(spark):
    """Pages without article: what recurs on the host is its template, by counting alone."""
    page = "<body><div><span>Shared box</span><p>Same words</p></div><div><p>Own text {n}</p><p>Only here {n} &lt;b&gt;</p></div></body>"
    rows = [(i, f"https://user@Shop.example:8080/{i}", page.format(n=i)) for i in range(20)]
    rows += [(100 + i, f"http://other{i}.example/", page.format(n=i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}\nOnly here {i} <b>" for i in range(20))
    assert all(got[100 + i] == f"Shared box\nSame words\nOwn text {i}\nOnly here {i} <b>" for i in range(3))


def extracted(spark, pages):
    rows = [(i, f"http://h{i if apart else ''}.example/{i}", page) for i, (page, apart) in enumerate(pages)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_template_inside_the_main_element_goes(spark):
    """A box that recurs inside distinct articles is template; what recurs in copies of one article is not."""
    page = "<body><article><h1>T {n}</h1><div class='x'><b>Tell</b> a friend</div><p>Same words</p><p>Own {n}</p></article></body>"
    copy = "<body><i>{n}</i><main><div><p>One text</p><p>often copied</p></div></main></body>"
    pages = [(page.format(n=i), False) for i in range(20)] + [(copy.format(n=i), False) for i in range(10)]
    got = extracted(spark, pages)
    assert got[:20] == [f"T {i}\nSame words\nOwn {i}" for i in range(20)]
    assert got[20:] == ["One text\noften copied"] * 10


def test_an_element_with_the_main_text_is_not_dropped(spark):
    text = "<p>Main text of the page</p><p>that goes on</p>"
    main = "Main text of the page\nthat goes on"
    article = f"<article>{text}</article>"
    talk = "<section class='comments'><article class='comment'><p>A reader with very much to say about all this, on and on</p></article></section>"
    pages = [
        f"<body class='has-sidebar'>{text}</body>", f"<body class='sidebar'>{text}</body>", f"<body><div class='content-with-sidebar'>{text}</div></body>",
        f"<body><div class='two-col side'>{text}<div class='sidebar'><p>Aside</p></div></div></body>", f"<body><form>{text}<input></form><nav><p>x</p></nav></body>",
        f"<body><form>{article}</form></body>", f"<body><header>{article}</header><footer><p>f</p></footer></body>", f"<body><dialog open>{article}</dialog></body>",
        f"<body>{article}{talk}</body>", f"<body>{text}{talk}</body>", f"<body><main>{text}{talk}</main></body>", f"<body>{text}<div class='cookie-banner'>We use cookies</div></body>",
        f"<body><div class='discussion'>{article}</div></body>",
    ]
    assert extracted(spark, [(p, True) for p in pages]) == [main] * len(pages)


def test_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner))
        assert got[r["page_id"]]["text"] == "\n".join(filter(None, parts))
        assert got[r["page_id"]]["url"] == r["url"]


def test_page_edges(spark):
    rows = [
        (1, None, None, "x"), (2, "", "", "x"), (3, "no url", "<p>Text", "x"), (3, "no url", "<p>Text", "x"), (None, "http://h/", "<br><p>", "x"),
        (4, "http://h/", "plain & simple &am", "x"), (5, "http://h/", "<div " * 5000 + "<p>end", "x"), (6, "http://h/", "<div>" * 30_000 + "deep", "x"),
        (7, "http://h/", "<p>" + "word &lt; " * 200_000, "x"), (8, "http://h/", "</p></div><p a='>'>odd</b>", "x"), (9, "http://h/", "<!-- never ends <p>x", "x"),
        (10, "http://h/", "<script>if (a < b) '</p>'</script>after", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string").withColumn("text", F.lit("taken"))
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    assert got[3, "Text"] == 2 and got[1, ""] == got[2, ""] == got[None, ""] == got[9, ""] == 1
    assert got[4, "plain & simple &am"] == got[6, "deep"] == got[8, "odd"] == got[10, "after"] == 1
    assert got[7, ("word < " * 200_000).strip()] == 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs, ~held_out()).select("*", held_out().alias("held_out")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    right = np.array([r["lang_pred"] == truth[r["doc_id"]] for r in unseen])
    score = np.array([r["score"] for r in unseen])
    assert len(unseen) > 200 and right.mean() > 0.98 and ((score >= 0) & (score <= 1)).all()
    assert abs(score.mean() - right.mean()) < 0.05  # calibrated


def test_language_sees_only_the_text_of_learned_rows(spark, documents):
    """Changing lang and source of held-out rows changes nothing."""
    other = documents.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    pick = lambda d: {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in language.identify(d, ~held_out()).collect()}
    assert pick(documents) == pick(other)


def test_language_edges(spark, documents, edge, empty):
    rows = language.identify(documents.unionByName(edge.select(*documents.columns)), ~held_out()).collect()
    got = Counter((r["doc_id"], r["lang_pred"]) for r in rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if not any(map(str.isalpha, r["text"] or "")))
    assert sum(got.values()) == documents.count() + len(EDGE)
    assert language.identify(empty, ~held_out()).count() == 0
    nothing = language.identify(edge.withColumn("lang", F.lit(None).cast("string")), ~held_out())
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    kept = language.keep_known(edge, 0.5)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 7, 9, None}
    assert not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    model = language.Ftrl(50, 3, l1=0.5)
    for _ in range(2000):
        k = int(rng.integers(3))
        at = np.array([k, 10 + int(rng.integers(40))])
        model.learn(at, np.array([1.0, 1.0]), k)
    w = model.weights()
    assert all(w[k].argmax() == k for k in range(3)) and (w[10:] == 0).mean() > 0.5


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(4000, 4)) * 2
    p = language.softmax(scores)
    label = np.array([rng.choice(4, p=row) for row in p])
    assert language.temperature(scores * 3, label) == pytest.approx(3, rel=0.15)


def test_site_rates_are_shrunk(spark):
    """Against the same estimate in plain numpy."""
    rows = [(h, f"p{h}", n, float(s)) for h, (n, s) in enumerate([(1000, 900), (500, 100), (2, 0), (1, 1), (300, 240)])]
    groups = spark.createDataFrame(rows, "host long, path string, n long, s double")
    mu = 0.7
    got = {r["host"]: r["rate"] for r in site_quality.shrunk(groups, "n", "s", F.lit(mu), "rate").collect()}
    n, s = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])
    big = n > 1
    between = (n[big] * (s[big] / n[big] - mu) ** 2).sum()
    variance = max((between - big.sum() * mu * (1 - mu)) / n[big].sum(), 1e-9)
    strength = min(max(mu * (1 - mu) / variance - 1, 1), 1e6)
    for h in range(len(rows)):
        assert got[h] == pytest.approx((s[h] + strength * mu) / (n[h] + strength))
    assert abs(got[3] - mu) < abs(1 - mu)


def test_site_quality_on_unseen_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r["doc_id"]: r for r in site_quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    unseen = labels.where("doc_id % 2 = 1").collect()
    assert np.mean([rows[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in unseen]) > 0.93
    for r in rows.values():
        odds = np.log(r["p_text"] / (1 - r["p_text"])) if 0 < r["p_text"] < 1 else 0
        assert r["kept"] == (r["p_good"] >= 0.5) and -13 < odds < 13


def test_a_site_moves_its_documents(spark):
    """Two sites with the same unclear text; the one whose other pages are bad is rated lower."""
    good, bad, unclear = "plain words in a row ", "#### $$$$ %%%% ", "plain words #### $$$$ "
    rows = [(i, good * 5, "h1", "a") for i in range(40)] + [(100 + i, bad * 5, "h2", "b") for i in range(40)]
    rows += [(200, unclear * 5, "h1", "a"), (201, unclear * 5, "h2", "b"), (202, unclear * 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    p = {r["doc_id"]: r["p_good"] for r in site_quality.classify(docs, labels).collect()}
    assert p[201] < p[202] < p[200]


def test_site_quality_edges(edge, empty, labels, no_labels):
    assert sorted((r["doc_id"] or 0) for r in site_quality.classify(edge, labels).collect()) == sorted(e[0] or 0 for e in EDGE)
    rows = site_quality.classify(edge, no_labels).collect()
    assert len(rows) == len(EDGE) and all(r["kept"] and r["p_good"] is None for r in rows)
    assert site_quality.classify(empty, no_labels).count() == 0


def test_repeated_rows_do_not_enlarge_the_samples(spark, monkeypatch):
    """A document that is repeated very often is one of the sample, and leaves the others their places."""
    rows = [(i, f"word{i} and some more words {'#' * (i % 2)}", "en") for i in range(40)]
    rows += [rows[7]] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality_rules.Logistic.fit
    monkeypatch.setattr(quality_rules.Logistic, "fit", lambda self, at, share, y: seen.append(len(y)) or fit(self, at, share, y))
    quality_rules.train(docs, marks)
    assert seen == [40]
    assert site_quality.labelled(docs, marks, 5000).count() == 40
    learned = []
    learn = language.Ftrl.learn
    monkeypatch.setattr(language.Ftrl, "learn", lambda self, at, value, label: learned.append(label) or learn(self, at, value, label))
    language.train(docs, per_language=100, epochs=1)
    assert len(learned) == 32
