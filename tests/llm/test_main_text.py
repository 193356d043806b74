"""Main text of pages: the given pages, and hand-written ones."""

from __future__ import annotations

import re
from html import unescape

import pytest

from sensorlake.llm import queries as Q
from sensorlake.llm.main_text import extract, main_text

from tests.conftest import SMOKE_DIR

PROSE = "the cat is on the mat and it was good to be in the house " * 4


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a &amp; b&nbsp; c &#65;\n\n d</p>", "a & b c A d"),
        ("a<b>c</b>d <i>e</i>", "acd e"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<!-- never closed <p>x", ""),
        ("<script>var t = '</p>'; never closed", ""),
        ("<style>p{}</style><p>x<br>y", "x y"),
        ("<p><b>one<br><p>two</p>", "one two"),
        ("<article><p>one<div class=ad>buy</div><p>two</article><footer>f</footer>", "one two"),
        ("<nav><a href=x>Menu</a></nav><main><h1>T</h1><p>x</p></main><aside>s</aside>", "T x"),
        ("<article class='post has-sidebar'><p>Keep</p></article><article class=comment><p>no</p></article>", "Keep"),
        ("<article><p>Keep</p><section id='comments'><p>no</p></section><form>f<input></form></article>", "Keep"),
        ("<article><header><p>By me</p></header><p>Keep</p><div class='cookieNotice'>c</div></article>", "Keep"),
        ("<article><p>Keep</p><ul><li><a href=a>one link</a></li><li><a href=b>two</a></li></ul></article>", "Keep"),
        ("<article><p>See <a href='x>y'>this</a> now</p></article>", "See this now"),
        ("<div style='display: none'>x</div><div hidden>y</div><div aria-hidden=true>z</div><main>w", "w"),
        (f"<div><a href=x>Home</a></div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><div>© me</div>", f"{PROSE.strip()} Short. {PROSE.strip()}"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", ["<p>" + "x" * 2_000_000, "<" * 50_000, "<a " * 20_000, "<p>" * 20_000, "</p>" * 20_000, "<div class='" + "a" * 100_000])
def test_very_long_pages_end(html):
    assert isinstance(main_text(html), str)


def test_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMOKE_DIR}/pages.parquet").collect()}
    got = Q.op7_main_text(spark, SMOKE_DIR).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)
        assert r.text == " ".join(unescape(re.sub(r"<[a-z/][^>]*>", " ", article[1])).split())
        assert r.n_chars == len(r.text)


def test_columns_and_odd_rows(spark):
    rows = [(1, "u", None, "x", 5), (1, "u", None, "x", 5), (None, None, "<p>😀</p>", None, None), (2, "", "", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "u", "", 0), (1, "u", "", 0), (None, None, "😀", 1), (2, "", "", 0)], key=repr
    )
    assert extract(df.where("false")).count() == 0


MENU = "<nav><a href=a>Home</a> <a href=b>About</a></nav>"
FOOTER = "<footer>All rights reserved by the owners of this page, who may be reached at the address given above.</footer>"
OTHERS = [
    "Wczoraj wieczorem mieszkańcy miasta spotkali się przy rzece, aby wspólnie obejrzeć pokaz sztucznych ogni nad mostem.",
    "Вчера вечером жители города собрались у реки, чтобы вместе посмотреть праздничный салют над старым мостом и набережной.",
    "昨天晚上全市居民聚集在河边一起观看大桥上空的烟花表演活动持续了一个多小时吸引了数千名游客参加当地商家也推出了各种优惠活动欢迎大家前来体验传统文化与现代艺术的完美结合给人留下深刻印象",
]


@pytest.mark.parametrize("text", OTHERS)
@pytest.mark.parametrize("times", [1, 3])
def test_other_languages_in_plain_divs(text, times):
    for long in (text, f"{text} {text}"):
        body = "".join(f"<div>{long}</div>" for _ in range(2))
        assert main_text(f"{MENU}<div><h2>Tytuł</h2>{body}</div>{FOOTER}" * times).count(text) == times * long.count(text) * 2
        links = "<div><a href=a>Home</a> <a href=b>About the town and its people</a></div>"
        assert main_text(f"{links}{body}{links}<div>© 2020</div>") == f"{long} {long}"
        assert "Home" not in main_text(MENU + body + FOOTER) and "reserved" not in main_text(MENU + body + FOOTER)


@pytest.mark.parametrize("names", ["Alice Johnson, Robert Miller, Catherine Brown, Gustav Lindqvist, Maria Fernandez", "git clone repository; cd repository; make install; systemctl restart example.service"])
def test_paragraphs_of_few_stop_words_between_good_ones(names):
    assert 70 <= len(names) < 140
    assert main_text(f"{MENU}<p>{PROSE}</p><p>{names}</p><p>{PROSE}</p>{FOOTER}") == f"{PROSE.strip()} {names} {PROSE.strip()}"


def test_blocks_with_links_and_few_stop_words_stay_bad():
    linked = "Alice Johnson, Robert Miller, Catherine Brown, Gustav Lindqvist, <a href=x>Maria Fernandez</a>"
    assert main_text(f"<p>{PROSE}</p><p>{linked}</p><p>{PROSE}</p>") == f"{PROSE.strip()} {PROSE.strip()}"
