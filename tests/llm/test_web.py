"""HTML extraction and WARC round trips."""

import base64
import hashlib
import zlib

import pytest

from curvemill.llm.html_text import extract, main_text
from curvemill.llm.warc import WarcError, archived, records, steps, write_archives, written

LONG = "This is a long paragraph of the text that is about the weather in the north of the country, and it goes on for a while with more words, so that it is long enough to be taken as the main text of the page, as one would have it."
PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">{LONG}</div><div id="content"><h1>The title</h1><p>{LONG}</p><p>Short &amp; sweet.</p><p>{LONG}</p></div>
<aside>{LONG}</aside><section id="comments"><p>{LONG}</p></section><form><label>Name</label></form><script>var a = "<p>";</script><footer>&copy; 2020 {LONG}</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE) == f"The title {LONG} Short & sweet. {LONG}"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<!-- only -->", ""),
        ("<article><h1>A&amp;B</h1><p><b>One<br>two<p>x &lt; y&nbsp;z</article><footer>no</footer>", "A&B One two x < y z"),
        ("<article><p>a<b>b</b>c</p><div class='ad'>buy</div><p>d</p><ul class=share><li>e</li></ul></article>", "abc d"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<nav>menu</nav><main>text &#233;&#x41;</main>", "text éA"),
        ("<article>" + "<p>w w</p>" * 3000 + "</article>", " ".join(["w w"] * 3000)),
    ],
)
def test_small_pages(page, want):
    assert main_text(page) == want


ARTICLE = f"<article><h2>T</h2><p>{LONG}</p></article>"
POLISH = "Pogoda na północy kraju była wczoraj bardzo zmienna, wiatr wiał mocno od morza, deszcz padał przez całą noc, drogi były śliskie, pociągi spóźniały się nawet kilka godzin, ludzie czekali cierpliwie przy dworcach oraz przystankach."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content-sidebar-wrap"><main>{LONG}</main></div>', LONG),
        (f'<div class="layout with-sidebar">{ARTICLE}<div class="sidebar">{LONG}</div></div>', f"T {LONG}"),
        (f'<div id="page-banner-container"><div class="ad">{LONG}</div><main>{LONG}</main></div>', LONG),
        (f"<form id=f><nav>menu</nav>{ARTICLE}</form>", f"T {LONG}"),
        (f"<form id=f><header>Site</header><h1>T</h1><p>{LONG}</p></form>", f"T {LONG}"),
        (f'<div class="overlay"><article>{LONG}</article></div>', LONG),
        (f'<div id="c"><p>{LONG}</p></div><div class="comment-list"><article>{LONG}!</article></div>', LONG),
        (f'{ARTICLE}<div class="related-posts"><article>{LONG}</article></div><aside><article>no</article></aside>', f"T {LONG}"),
        (f'<div title="the hidden life" data-id="nav"><p>{LONG}</p></div><div hidden>{LONG}</div><div style="display: none">{LONG}</div><p aria-hidden=true>{LONG}', LONG),
        (f'<article><a name="s1"><p>{LONG}</p><p>{LONG}</p></article>', f"{LONG} {LONG}"),
        (f"<article><p><a href=x>{LONG}</a></p><p>{LONG}</p></article>", LONG),
        (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<div class="content has-sidebar"><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class="sidebar"><p>{LONG}</p></div></div><div class="site-footer">{LONG}</div>', f"T {LONG} {LONG}"),
        (f'<article class="post tags-news comments-open"><p>{LONG}</p></article>', LONG),
        (f'<form id="aspnetForm"><div><p>{LONG}</p></div></form>', LONG),
        (f'<form id="aspnetForm"><div class="menu"><a href=x>Home</a></div><div id="content"><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div><div class="footer">{LONG}</div></form>', f"{LONG} Short one. {LONG}"),
        (f'<div class="content"><p>{LONG}</p></div><article>teaser</article>', LONG),
        (f'<div class="content"><p>{LONG}</p></div><form class="newsletter-form"><p>Join our list of readers and get the news of the week by mail, as you like it.</p><input></form>', LONG),
        (f'<div class="content"><p>{LONG}</p></div><div class="cookie-notice"><p>{LONG}</p><p>{LONG}</p></div>', LONG),
        (f'<article class="comment"><p>{LONG}</p></article><article class="post"><p>{LONG}!</p></article>', f"{LONG}!"),
        (f"<article>Short news of one line.</article><div class='widget'>{LONG}</div><div>Imprint</div>", "Short news of one line."),
        (f"<nav>menu</nav><div><p>{POLISH}</p><p>{POLISH[:119]}</p></div><footer>end</footer>", f"{POLISH} {POLISH[:119]}"),
    ],
)
def test_names_hidden_links_and_languages(page, want):
    assert main_text(page) == want


def test_extract_rows(spark):
    rows = [(1, "u", "<article>é</article>", "t"), (1, "u", "<article>é</article>", "t"), (2, None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (2, None, "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archive_round_trip(spark):
    same = "<p>same é</p>"
    rows = [(9, "http://a/ü b", same, 1), (4, "u", same, 1), (5, None, None, 1), (6, "u", "", 1), (7, "u", "x" * 100_000, 1), (8, "u", same + "\r\n\r\nWARC/1.1", 1), (None, "u", "alone", 1)]
    got = {r["page_id"]: r for r in archived(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")).collect()}
    first = {9: 4, 6: 5}
    for page_id, _, html, _ in rows:
        data, r = (html or "").encode(), got[page_id]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[page_id]) if page_id in first else ("response", None))
    assert archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_least_size_keeps_small_payloads_as_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = {r["page_id"]: r["refers_to"] for r in archived(spark.createDataFrame(rows, "page_id long, url string, html string"), least=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}


def test_reader_in_steps_and_broken_archives():
    data = written(1, "u", b"one", None) + written(2, "u", b"one", 1) + written(3, None, b"\r\n\r\n", None)
    whole = list(records(steps(data)))
    assert whole == list(records(data[i : i + 1] for i in range(len(data))))
    assert [r.payload for r in whole] == [b"one", b"", b"\r\n\r\n"] and whole[1].http["content-length"] == "3"
    with pytest.raises(WarcError, match="cut off"):
        list(records([data[:-3]]))
    with pytest.raises(WarcError):
        list(records([b"junk" + data]))
    inside = zlib.decompress(written(1, "u", b"one", None), 31)
    pack = lambda b: (z := zlib.compressobj(wbits=31)).compress(b) + z.flush()
    with pytest.raises(WarcError, match="digest"):
        list(records([pack(inside.replace(b"one", b"two"))]))
    with pytest.raises(WarcError, match="framed"):
        list(records([pack(inside[:-4])]))
