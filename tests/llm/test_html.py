"""HTML extraction: generated layouts that training has not seen, the given pages, parsing and defined cases."""

import html
import re

import pytest
from pyspark.sql import functions as F

from skein.llm.html_extract import extract_text, leaf_blocks, train, training_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return train(pages)


def article(page):
    inside = page.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_given_pages(pages, model):
    got = {r.page_id: r for r in extract_text(pages, model).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_new_layouts(model):
    held = training_pages(150, seed=1234)
    wrong = total = 0
    for (page, main), text in zip(held, model.main_text([p for p, _ in held])):
        found = set(text.split("\n"))
        for b in leaf_blocks(page):
            total += 1
            wrong += (b.text in main) != (b.text in found)
    assert wrong / total < 0.02


def test_parser():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a &lt;b&gt; &#8364;\n\t c<p>d<b>e</b>f<br>g") == ["a <b> € c", "def g"]
    assert texts("<ul><li>x<li>y</ul>z<script>var a='</p>';</SCRIPT >w<style>p{") == ["x", "y", "zw"]
    assert texts("a<!-- no --><p title='x>y'>b</p><p title=\"u") == ["a", "b"]
    assert texts("1 < 2 &amp cut<p>é") == ["1 < 2 & cut", "é"]
    assert texts("") == [] and texts("<p> &#32; </p>") == []
    assert texts("<p>" * 2000 + "deep" + "<div>" * 2000 + "er") == ["deep", "er"]
    assert [b.tag for b in leaf_blocks("<div><p>a<div>b</div>c</div>d")] == ["p", "div", "div", ""]


def test_left_out_elements():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<article><p>a<svg class='i'/>b</p><p>c <math/>d</p><p>e<svg><path d='x'/></svg>f</p></article>") == ["ab", "c d", "ef"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>") == ["if x=1 then"]
    for tag in "button select object canvas audio video template datalist svg noscript".split():
        assert texts(f"<div><p>a <{tag}>not</p><p>b</p></div><p>c</p>") == ["a", "b", "c"], tag
        assert texts(f"<p>a<{tag}>not<q>this</q></{tag}>b</p>c</{tag}>d") == ["ab", "cd"], tag
        assert texts(f"<div>a<{tag}><option>x<div>y</div>z</{tag}>b</div>") == (["a", "y", "zb"] if tag == "svg" else ["ab"]), tag
        assert texts(f"<p><a>x<{tag}></a>y</p>") == ["xy"] and texts(f"<p>x<{tag}></b>y</{tag}>z") == ["xz"], tag
        assert texts(f"<table><tr><td>a<{tag}>no<td>b</table>c") == (["a", "b", "c"]), tag
        assert texts(f"a<{tag}>no") == ["a"] and texts(f"<{tag}><script>'</{tag}>'</script>no</{tag}>b") == ["b"] or tag == "svg"
    assert texts("<p>a<svg><title/><style/><g></svg>b<p>c<svg><foreignObject><p>n</p></foreignObject>o</svg>d") == ["ab", "cd"]
    assert texts("<p>a<svg><path><p>b") == ["a", "b"]
    assert texts("a<textarea><p>b</textarea>c<iframe><p>d</iframe>e<title>f") == ["ace"]


def test_cases(spark, model, pages):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<article><h1>Some title</h1><p>A text.</p>", "x"),
                                (2, "u", "<article><h1>Some title</h1><p>A text.</p>", "x")],
                               "page_id long, url string, html string, text string")
    got = sorted(map(repr, extract_text(df, model).collect()))
    assert len(got) == 4 and sum("n_chars=0" in r for r in got) == 2 and sum("Some title\\nA text." in r for r in got) == 2
    none = pages.where(F.lit(False))
    assert extract_text(none, train(none)).count() == 0
