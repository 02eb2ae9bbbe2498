"""Extraction and plain text on layouts written by hand, on the driver's pages, and on hostile markup."""

import re
import time

import numpy as np
import pytest

from folioforge.llm import extract, warc

# Layouts that ``extract.template`` does not write; words of the main text begin with "yes", all others with "no".
LAYOUTS = [
    "<html><body><div id=masthead><a href=/>no1</a><a href=/b>no2</a></div><div class=story><h2>yes1 yes2</h2><p>yes3 yes4 yes5, yes6 yes7. yes8 yes9 yes10 yes11, yes12.<p>yes13 yes14 yes15 yes16 yes17 yes18 yes19. yes20 yes21, yes22 yes23.</div><div id=footer>no3 no4</div>",
    "<body><nav role=navigation><ul><li><a href=1>no1</a><li><a href=2>no2</a><li><a href=3>no3</a></ul></nav><main><section><h1>yes1</h1><p>yes2 yes3 yes4, yes5 yes6 yes7 yes8. yes9.</p><blockquote>yes10 yes11 yes12 yes13 yes14.</blockquote><p>yes15 yes16 yes17, yes18 yes19 yes20 yes21.</p></section></main><aside><h3>no4</h3><p>no5 no6 no7</p></aside><footer><p>no8 no9</p></footer>",
    "<html><head><title>no0</title><body><table><tr><td class=menu><ul><li><a href=a>no1</a></li><li><a href=b>no2</a></li><li><a href=c>no3</a></li></ul></td><td class=content><h1>yes1 yes2 yes3</h1><p>yes4 yes5 yes6 yes7, yes8 yes9 yes10. yes11 yes12 yes13 yes14.</p><p>yes15 yes16 yes17 yes18 yes19, yes20. yes21 yes22 yes23 yes24.</p></td></tr></table>",
    "<body><header><h1>no1</h1></header><div class='cookie-consent'><p>no2 no3 no4 no5</p><button>no6</button></div><article class='post'><h1>yes1 yes2</h1><p>yes3 yes4 yes5 yes6 yes7, yes8. yes9 yes10.</p><div class='advertisement'>no7 no8</div><p>yes11 yes12 yes13 yes14, yes15 yes16 yes17.</p><ul><li>yes18 yes19 yes20</li><li>yes21 yes22 yes23</li></ul></article><section id='comments'><h3>no9</h3><div class='comment'><p>no10 no11 no12 no13</p></div></section>",
    "<body><div class=wrap><div class=content-main><p>yes1 yes2 yes3 yes4 yes5 yes6, yes7 yes8 yes9. yes10 yes11 yes12 yes13.</p><p>yes14 yes15 yes16, yes17 yes18 yes19 yes20 yes21.</p></div><div class=sidebar><h4>no1</h4><ul><li><a href=x>no2 no3</a></li><li><a href=y>no4 no5</a></li></ul></div></div><form action=/s><label>no6</label><input><button>no7</button></form>",
]


def long(first, n, kind="no"):
    return " ".join(f"{kind}{first + i}" + ("," if i % 9 == 4 else "." if i % 13 == 7 else "") for i in range(n))


# Long texts that are not main, and headings in elements of no name or in the text's own header.
LAYOUTS += [
    "<body><div class=sidebar><p>"+long(1,80)+"</p></div><article><h1>yes1 yes2</h1><p>"+long(3,60,"yes")+"</p><p>"+long(70,40,"yes")+"</p></article>",
    "<body><header><a href=/>no1</a></header><main><h1>yes1 yes2 yes3</h1><p>"+long(4,50,"yes")+"</p></main><div class='related'><h3>no2 no3</h3><p>"+long(10,90)+"</p></div><footer><p>"+long(200,85)+"</p></footer>",
    "<body><div><div><h1>yes1 yes2 yes3</h1><div><p>"+long(4,70,"yes")+"</p><p>"+long(100,40,"yes")+"</p></div></div></div>",
    "<body><nav><ul><li><a href=1>no1</a><li><a href=2>no2</a></ul></nav><article><header><h1>yes1 yes2</h1><p class=byline>yes3 yes4</p></header><p>"+long(5,60,"yes")+"</p></article><div class='cookie-notice'><p>"+long(10,80)+"</p><button>no500</button></div>",
    "<body><div class='advert'><p>"+long(1,82)+"</p></div><div id=content><h2>yes1 yes2</h2><p>"+long(3,45,"yes")+"</p><p>"+long(60,45,"yes")+"</p></div><div id=footer><p>"+long(300,60)+"</p></div>",
    "<body><div class=page><div class=col><h1>yes1</h1><p>"+long(2,80,"yes")+"</p></div><div class='side-bar'><h4>no1</h4><p>"+long(2,75)+"</p><p>"+long(100,50)+"</p></div></div>",
    "<html><body><div class=banner>no1 no2</div><section class=story><h1>yes1 yes2</h1><p>"+long(3,60,"yes")+"</p><ul><li>yes100 yes101</li><li>yes102 yes103</li></ul></section><section id=comments><h3>no3</h3><div class=comment><p>"+long(10,70)+"</p></div><div class=comment><p>"+long(100,40)+"</p></div></section>",
    "<body><form class=newsletter><p>"+long(1,40)+"</p><input><button>no60</button></form><article class='entry'><div><h1>yes1 yes2 yes3</h1></div><div><p>"+long(4,80,"yes")+"</p></div></article><aside><h3>no61</h3><p>"+long(70,80)+"</p></aside>",
    "<body><div id=page-header><h1>no1 no2</h1><p>"+long(3,30)+"</p></div><div role=main><h1>yes1 yes2</h1><p>"+long(3,70,"yes")+"</p><blockquote>"+long(100,30,"yes")+"</blockquote></div><div class=copyright><p>"+long(50,50)+"</p></div>",
    "<table><tr><td class=nav><a href=a>no1</a><a href=b>no2</a></td><td class=main-text><h1>yes1</h1><p>"+long(2,75,"yes")+"</p></td><td class=sponsored><p>"+long(3,80)+"</p></td></tr></table>",
]


def test_attributes_of_any_length_count():
    page = '<body><div class=text><h1>yes</h1><p>%s</p></div><div data-x="%s" class="comments"><p>%s</p></div>'
    texts = ["\n".join(t for (node, t), main in zip(p.runs, [extract.decode(p, *extract.score(extract.train(), [p]))[node] for node, _ in p.runs], strict=True) if main) for p in [extract.Page(page % (long(1, 60, "yes"), "x" * n, long(1, 60))) for n in (10, 1200, 100_000)]]
    assert texts[0] == texts[1] == texts[2] and "no1" not in texts[0] and "yes60" in texts[0]


def test_hand_written_layouts(spark):
    df = spark.createDataFrame(list(enumerate(LAYOUTS)), "page_id int, html string")
    right = wrong = missed = 0
    for r in extract.extract(df, ["page_id"]).collect():
        got, all_ = set(re.findall(r"\w+", r.out.text)), set(re.findall(r"\byes\d+", LAYOUTS[r.row.page_id]))
        right, wrong, missed = right + len(got & all_), wrong + len(got - all_), missed + len(all_ - got)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


@pytest.mark.parametrize("unit", ["<a '", '<a "', "<", "<p", "</", "<!", "<!--", "<script ", "<head><title>", "<select>", "&", "<svg ", "'\"<b x='", "<![CDATA[", "</title"])
def test_hostile_markup_takes_linear_time(unit):
    source = unit * ((1 << 20) // len(unit))
    began = time.time()
    page = extract.Page(source)
    extract.features(page, np.zeros(extract.BUCKETS))
    assert time.time() - began < 12
    began = time.time()
    warc.plain_text(source)
    assert time.time() - began < 12


@pytest.mark.parametrize("page", ["%s", "<html><head><title>t</title>%s", "<html><body>%s</html>", "<body><select><option>a%s", "<p title='it''s'>%s", "<div class=\"a>b\">%s</div>"])
def test_optional_tags_keep_the_text(page):
    main = "<article><p>The whole text</p></article>"
    assert "The whole text" in [t for _, t in extract.Page(page % main).runs] and "The whole text" in warc.plain_text(page % main).split("\n")


def test_odd_pages(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "<p>a &amp; b", 1), (3, "<article><p>" + "word, " * 100_000 + "</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, row int").selectExpr("*", "row AS out", "row AS text", "row AS n_chars", "'u' AS url")
    got = extract.extract(df, df.columns).collect()
    assert sorted((str(r.row.page_id), r.out.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 599_999), ("None", 5)]
    assert extract.extract(df.where("false"), ["page_id"]).count() == 0
    made = warc.derive(warc.responses(df))
    assert made.count() == 10 and warc.derive(warc.responses(df.where("false"))).count() == 0
