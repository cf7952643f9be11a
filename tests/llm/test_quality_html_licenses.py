import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsweave.llm import html as web
from opsweave.llm.licenses import CONFIRM, TEMPLATES, Templates, gram_column, grams, license_scan, tokens, train, word_column
from opsweave.llm.quality import BLOCK, Model, features, fit, keep_good, score_quality, train_quality
from tests.llm.data import documents, empty, sentence


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(sentence(rng, rng.randrange(5, 15)).capitalize() for _ in range(rng.randrange(2, 12)))
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            text = (text.upper() + "!!" if kind == 0 else " | ".join(text.split()) if kind == 1
                    else " ".join(w for w in text.split()[:8] for _ in range(9)))
        rows.append((i, text, "en", "s", len(text)))
        if rng.random() < 0.9:
            labels.append((i, int(good), 0))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_quality_on_held_out_rows(spark):
    docs, labels, rows = corpus(spark)
    model = train_quality(docs, labels)
    got = {r["doc_id"]: r for r in score_quality(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["score"] == pytest.approx(model.score(text)) and got[i]["predicted"] == (got[i]["score"] >= 0.5)
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = keep_good(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels, _ = corpus(spark, 150)
    model = train_quality(docs, labels)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    again = train_quality(changed, flipped)
    assert np.array_equal(model.weights, again.weights) and (model.bias, model.slope, model.shift) == (again.bias, again.slope, again.shift)


def test_quality_odd_rows(spark):
    docs, labels, _ = corpus(spark, 120)
    model = train_quality(docs, labels)
    odd = documents(spark, extra=True)
    scores = score_quality(odd, model)
    assert scores.count() == odd.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    assert keep_good(odd, model).columns == odd.columns
    assert score_quality(empty(spark), model).count() == 0 and keep_good(empty(spark), model).count() == 0
    no_labels = train_quality(empty(spark), labels)
    assert no_labels.score("any") == no_labels.score("")
    one_class = fit([features("a b"), features("c")], np.array([1, 1]))
    assert one_class.score("anything") > 0.5


def test_features_of_long_text_do_not_depend_on_blocks(monkeypatch):
    text = sentence(random.Random(1), 3000)
    whole = features(text)
    from opsweave.llm import quality
    assert len(text) < BLOCK
    monkeypatch.setattr(quality, "BLOCK", 1000)
    cut = features(text)
    assert set(whole) <= set(cut) and len(cut) - len(whole) <= 0.05 * len(whole)
    assert Model(np.zeros(1 << 18), 0.0, 1.0, 0.0).score("") == 0.5


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Head</header><div class="ad banner">Buy</div><div id='cookie-notice'>Cookies</div>
<article><h1>Title&nbsp;{n}</h1><p><b>First   line<br>goes on &lt;{n}&gt;<p>Second {n}</p><!-- <p>gone</p> --><ul><li>one {n}<li>two {n}</ul>
<form><p>Name</p></form><section class="comments"><article><p>A reader says</p></article></section><p>Shared words</p></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""
WANT = "Title {n}\nFirst line goes on <{n}>\nSecond {n}\none {n}\ntwo {n}"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text_of(html):
    return "\n".join(b.text for b in web.main_blocks(web.parse(html)[1]))


@pytest.mark.parametrize("html, text", [
    (PAGE.format(n=1), WANT.format(n=1) + "\nShared words"), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"),
    ("<article><p>cut off here <b>and", "cut off here and"), ("<article>a</article><p>b", "a"), ("<div>x <i>y</i>z</div>", "x yz"),
    ("<nav>m<article><p>t</p></article>", "t"), ("<p>1 < 2 &amp; 3 &gt; 2 &#233; &unknown;</p>", "1 < 2 & 3 > 2 é &unknown;"),
    ("<p title='a > b'>q</p><a href=\"x", "q"), ("<ul><li><a href=x>only links</a></li></ul><p>text</p>", "text"),
    ("<script>if (a < b) {", ""), ("<p hidden=1 class=ad>x</p><p>y</p>", "y"), ("<table><tr><td>a<td>b</table>", "a\nb"),
    ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<p>a<br/>b</p>", "a b"), ("<div class='header'>no</div><main>m</main>", "m")])
def test_main_text(html, text):
    assert text_of(html) == text


def test_template_texts_are_left_out(spark):
    rows = [(i, f"https://a.example/{i}", PAGE.format(n=i)) for i in range(8)]
    rows += [(100 + i, f"http://b.example:80/{i}", PAGE.format(n=i)) for i in range(2)]  # too few pages for a template
    rows += [(200 + i, "https://copies.example/x", "<article><p>all the same</p><p>again</p></article>") for i in range(6)]
    rows += [(300, None, None), (301, "", ""), (302, "no url", "<p>x</p>"), (0, "https://a.example/0", PAGE.format(n=0)), (None, None, "<p>n</p>")]
    got = {}
    for r in web.extract_text(pages(spark, rows).withColumn("text", F.lit("clash")).withColumn("row", F.lit(1))).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for i in range(8):
        assert set(got[i]) == {WANT.format(n=i) + "\nShared words"}, "what stands in the article stays, also if all pages share it"
    assert len(got[0]) == 2
    for i in range(2):
        assert got[100 + i] == [WANT.format(n=i) + "\nShared words"]
    for i in range(6):
        assert got[200 + i] == ["all the same\nagain"], "an article is not dropped as a whole"
    assert got[300] == got[301] == [""] and got[302] == ["x"] and got[None] == ["n"]
    assert web.extract_text(pages(spark, [])).count() == 0


def test_subheadings_of_an_article_stay_on_hosts_of_any_size(spark):
    page = ("<body><nav>Menu</nav><div><p>Welcome to us</p></div><article><h1>Dish {n}</h1><h2>Ingredients</h2><p>flour {n}</p>"
            "{more}</article><div><p>Call us</p></div></body>")
    more = "<section class=tip><h3>Tip</h3><div class=in><p>Serve it hot</p></div></section>"
    rows = [(10 * size + i, f"https://h{size}.example/{i}", page.format(n=i, more=more if i < 5 else ""))
            for size in (4, 5, 8) for i in range(size)]
    got = {r["page_id"]: r["text"] for r in web.extract_text(pages(spark, rows)).collect()}
    for size in (4, 5, 8):
        for i in range(size):
            assert got[10 * size + i] == f"Dish {i}\nIngredients\nflour {i}" + ("\nTip\nServe it hot" if i < 5 else "")


def test_template_decides_where_no_article_is_marked(spark):
    page = "<body><div><p>Welcome to us</p></div><div><h1>Dish {n}</h1><p>flour {n}</p><p>sugar {n}</p></div><div><p>Call us</p><p>or write</p></div></body>"
    rows = [(i, f"https://h.example/{i}", page.format(n=i)) for i in range(7)]
    got = {r["page_id"]: r["text"] for r in web.extract_text(pages(spark, rows)).collect()}
    assert got == {i: f"Dish {i}\nflour {i}\nsugar {i}" for i in range(7)}


@pytest.mark.parametrize("html, text", [
    ('<div class="content-sidebar-wrap"><article><h1>T</h1><p>Long story</p></article></div>', "T\nLong story"),
    ('<article class="post has-sidebar"><p>a</p></article>', "a"), ('<article><h2 class="section-header">S</h2><p>a</p></article>', "S\na"),
    ('<p>text <span class="ad">Buy now</span> more</p>', "text more"), ("<article>a <button>Share</button> b</article>", "a b"),
    ("<article><p>a<noscript>no</noscript> b</p></article>", "a b"), ('<article><p>a <span class="comments">3</span></p></article>', "a"),
    ("<article><p>before <button>click</p><p>after</p></article>", "before\nafter"), ("<p>before <button>click<p>after", "before\nafter"),
    ('<article class="comment"><p>r</p></article><p>x</p>', "x"), ('<body class="ad"><p>x</p></body>', "x"),
    ('<div class="site-footer wide">f</div><div id="main-nav">n</div><p>x</p>', "x"), ('<p>a<span class="ad">b</span>c</p>', "a c"),
    ("<div><aside>open<p>in</div><p>x</p>", "x"), ('<div class="nav"><p>m</div><div class="menu-bar"><ul><li>k</ul></div><p>x</p>', "x")])
def test_asides_by_whole_names_and_to_their_end(html, text):
    assert text_of(html) == text


def test_classes_share_vectors(spark):
    rows = [(i, "h", "<div><p>same</p>" + "<i>x</i>" * (i % 3) + f"<p>{i}</p></div>") for i in range(9)]
    keyed = spark.createDataFrame(rows, "row long, host string, html string")
    classes = web.equivalence_classes(web.occurrences(keyed)).collect()
    by_vector = {}
    for r in classes:
        by_vector.setdefault(r["vector"], []).append(r["is_text"])
    assert sorted(map(sorted, by_vector.values())) == [[False, False, True]]  # page, div and the shared text; <p> comes twice


def scan_brute(text):
    """Families whose template has enough in common with a line, by sets."""
    t, out = Templates(), set()
    for line in (text or "").split("\n"):
        mine = set(grams(tokens(line)))
        shares = {}
        for i, s in enumerate(t.sets):
            both = len(mine & set(s))
            shares[i] = max(both / len(s), both / len(mine) if both >= 6 else 0)
        best = max(shares.values(), default=0)
        if best >= CONFIRM:
            out |= {t.families[t.family_of[i]] for i, v in shares.items() if v == best}
    return out


@pytest.fixture(scope="module")
def license_docs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lines = [sentence(rng, rng.randrange(5, 40)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(rng.randrange(4), TEMPLATES[i // 3 % len(TEMPLATES)][1])
        rows.append((i, "\n".join(lines), "en", "s", 0))
    rows += [(200, "The MIT students hold a driving license in general.\nAll of the software is free.", "en", "s", 0),
             (201, "  * licensed UNDER the apache license, version 2.0 (the \"License\");\r\nrest", "en", "s", 0),
             (202, "© 2019 us. Released under the MIT License. See below.", "en", "s", 0)]
    return documents(spark, rows), rows


def test_licenses(spark, license_docs):
    docs, rows = license_docs
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        families = set(filter(None, got[i]["licenses"].split(",")))
        want = scan_brute(text)
        assert bool(families) == bool(want) and families <= want, (i, families, want)
        assert got[i]["n_paragraphs"] == text.count("\n") + 1
        assert (got[i]["license"] == "unknown") == (not families) and (got[i]["license"] in families or not families)
    planted = [(i, TEMPLATES[i // 3 % len(TEMPLATES)][0]) for i in range(0, 120, 3)]
    assert sum(got[i]["license"] == family for i, family in planted) >= len(planted) - 1
    assert got[200]["license"] == "unknown" and got[201]["license"] == "Apache-2.0" and got[202]["license"] == "MIT"


def test_one_line_that_templates_lack_moves_no_threshold(spark):
    strange = "granted free license: modify, publish, sublicense, sell this software under these terms without warranty"
    for n in (40, 41, 42):
        rows = [(i, "many copies came here", "en", "s", 0) for i in range(n)] + [(500, strange, "en", "s", 0)]
        model = train(documents(spark, rows))
        assert model.threshold == 0.5


def test_license_grams_and_odd_rows(spark, license_docs):
    lines = ["", "MIT", "of the", "A-b C.d  é9 ß", "the MIT License of the MIT License"]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", gram_column(word_column(F.col("x"))).alias("g"))
    assert {r["x"]: sorted(r["g"]) for r in df.collect()} == {x: grams(tokens(x)) for x in lines}
    model = train(license_docs[0])
    odd = documents(spark, extra=True)
    assert license_scan(odd, model).count() == odd.count()
    assert license_scan(empty(spark), model).count() == 0
