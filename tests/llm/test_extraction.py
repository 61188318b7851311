"""Blocks, the field's sums and decoding, and accuracy on pages it was not trained on."""

import itertools
import math

import numpy as np
import pytest

from cdcflow.llm import extraction as X


@pytest.fixture(scope="module")
def field():
    return X.train(X.labelled_pages())


def texts(page):
    return [b.text for b in X.blocks(page)]


@pytest.mark.parametrize(
    "page, wanted",
    [
        (None, []),
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<ul><li>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<p>one<br>two <b>three</b>four</p>", ["one two threefour"]),
        ("<p>&lt;p&gt; &amp;amp; &eacute;&#x41;&nbsp;x</p>", ["<p> &amp; éA x"]),
        ("<script>var a = '<p>no</p>'</script><style>p{}</style><title>t</title><p>yes</p>", ["yes"]),
        ("a<!-- <p>no</p> -->b<!-- open", ["ab"]),
        ("<p title=\"a > b\" class='x'>in</p ></div>out", ["in", "out"]),
        ("<a href='x", []),
        ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
        ("1 < 2 & 3 > 2", ["1 < 2 & 3 > 2"]),
        ("<P>UPPER</P><DIV>case</DIV>", ["UPPER", "case"]),
    ],
)
def test_blocks(page, wanted):
    assert texts(page) == wanted


def test_sums_are_those_of_all_labellings():
    r = np.random.default_rng(1)
    scores, move = r.normal(size=(5, 2)), r.normal(size=(2, 2))
    weights = {}
    for labels in itertools.product((0, 1), repeat=5):
        s = sum(scores[i, y] for i, y in enumerate(labels)) + sum(move[a, b] for a, b in itertools.pairwise(labels))
        weights[labels] = math.exp(s)
    total = sum(weights.values())
    marginal, moves = X.expected(scores, move)
    for i in range(5):
        assert marginal[i, 1] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
    for a, b in itertools.product((0, 1), repeat=2):
        wanted = sum(w * sum(p == (a, b) for p in itertools.pairwise(y)) for y, w in weights.items()) / total
        assert moves[a, b] == pytest.approx(wanted)
    field = X.Field(np.vstack([scores, np.zeros((1, 2))]), move)
    assert tuple(field.decode([[i] for i in range(5)])) == max(weights, key=weights.get)


def test_labels_of_unseen_pages(field):
    pages = X.labelled_pages(150, seed=1234)
    right = total = 0
    for page, labels in pages:
        found = field.decode(X.features(X.blocks(page)))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_given_pages_give_their_article(spark, field):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in X.extracted(pages, field).collect():
        page = html[r["page_id"]]
        article = page[page.index("<article>") : page.index("</article>")]
        assert r["text"] == "\n".join(texts(article)) and r["n_chars"] == len(r["text"])


def test_rows_of_all_kinds(spark, field):
    rows = [
        (1, "u", None, "x"), (1, "u", None, "x"), (None, None, "", "x"), (2, None, "<nav><a href=x>home</a></nav>", None),
        (3, "u", "<article><p>" + "Long text. " * 50_000 + "</p></article>", None), (4, "u", "<div " * 2000, None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((tuple(r) for r in X.extracted(frame, field).collect()), key=repr)
    long = ("Long text. " * 50_000).strip()
    assert found == sorted(
        [(1, "u", "", 0), (1, "u", "", 0), (None, None, "", 0), (2, None, "", 0), (3, "u", long, len(long)), (4, "u", "", 0)], key=repr
    )
    assert X.extracted(spark.createDataFrame([], frame.schema), field).count() == 0


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<p>a <svg class='i'/> b</p><p>c</p>", ["a b", "c"]),
        ("<p>a <svg viewBox='0 0 1 1' /> b</p><svg><text>no</text></svg><p>c</p>", ["a b", "c"]),
        ("<p>a<svg><g><svg><text>no</text></svg><text>no</text></g></svg>b</p>", ["ab"]),
        ("<p>a<svg><path d='M0'><p>b</p>", ["a", "b"]),
        ("<p>x <math><mi>y</mi><mo/><mn>2</mn></math> z</p><p>a <math/> b</p>", ["x y2 z", "a b"]),
        ("<noscript><p>one</p></noscript><object data='x'>two</object>three", ["one", "two", "three"]),
    ],
)
def test_drawings_formulas_and_fallbacks(page, wanted):
    assert texts(page) == wanted
