"""Main text of generated pages whose text is known by construction, of pages that lost theirs before, and the time of nested ones."""

import html
import random
import time

import pytest

from curvemill.llm.html_text import main_text

LONG = "This is a long paragraph of the text that is about the weather in the north of the country, and it goes on for a while with more words, so that it is long enough to be taken as the main text of the page, as one would have it."
MIDDLE = "It was on the way to the station that they found out what the others had known for days, and it was not a pleasant walk at all."
CHROME = '<div><a href="/">Home</a></div>'


@pytest.mark.parametrize(
    "page, want",
    [
        (f'{CHROME}<div class="entry"><h1>Opening hours</h1><p>We are open from 9 to 5.</p><p>Closed on Sundays.</p></div><footer>Imprint</footer>', "Opening hours We are open from 9 to 5. Closed on Sundays."),
        (f"<nav>menu</nav><h1>Soup</h1><p>{LONG}</p><p>{MIDDLE}</p><ul><li>2 onions</li><li>1 l of water</li><li>salt</li></ul><footer>end</footer>", f"Soup {LONG} {MIDDLE} 2 onions 1 l of water salt"),
        (f"<nav>menu</nav><ul><li>2 onions</li><li>salt</li></ul><p>{LONG}</p><footer>end</footer>", f"2 onions salt {LONG}"),
        (f'<main><div class="press-notice"><h2>News</h2><p>{LONG}</p></div></main>', f"News {LONG}"),
        (f'<main><div class="share-price-analysis"><p>{LONG}</p></div><div class="share-buttons"><p>Tell a friend</p></div></main>', LONG),
        (f'<article><div class="article-promo-body"><p>{LONG}</p></div></article>', LONG),
        (f'<article><div class="side-by-side"><p>{MIDDLE}</p></div><div id="ad-lib"><p>{LONG}</p></div></article>', f"{MIDDLE} {LONG}"),
        ('<main><h1>The Old Inn</h1><div id="menu"><p>Soup of the day, 4.50</p><p>Pie, 9.00</p></div></main>', "The Old Inn Soup of the day, 4.50 Pie, 9.00"),
        (f'<main><div id="menu"><a href=a>Start</a> <a href=b>News</a></div><p>{LONG}</p></main>', LONG),
        (f'<article><p>{LONG}</p><p>See <a href=x>the report of the commission on the state of the northern harbours</a> for more.</p></article>', f"{LONG} See the report of the commission on the state of the northern harbours for more."),
        (f'<article><p>{LONG}</p><p><a href=x>Read the report of the commission on the state of the northern harbours here</a></p></article>', LONG),
        (f'<article><p>{LONG}</p><div class="ad-box">Buy now</div><div class="cookie-notice">{LONG}</div><p>End.</p></article>', f"{LONG} End."),
        ("<p>Only this.</p>", "Only this."),
        ("<h1>Only a heading</h1>", "Only a heading"),
        ("<nav>a</nav><footer>b</footer>", ""),
        (f"<div class='sidebar'><p>{LONG}</p></div>", ""),
    ],
)
def test_text_is_kept(page, want):
    assert main_text(page) == want


WORDS = "the harbour of was in and ships that to stone it light with on for river they from market had".split()


def sentence(r, least, most):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(least, most))).capitalize() + "."


def inline(r, text):
    """Markup that leaves the text as it is."""
    escaped = html.escape(text) if r.random() < 0.5 else "".join(f"&#{ord(c)};" if r.random() < 0.05 else c for c in text)
    words = escaped.split(" ")
    i = r.randrange(len(words))
    words[i] = r.choice(["<b>{}</b>", "<em class=x>{}</em>", "{}", "<a href='/y'>{}</a>" if len(words) > 3 else "{}", "<span>{}</span>", "<!-- c -->{}"]).format(words[i])
    return r.choice([" ", "\n ", " &#32;"]).join(words)


NOISE = [
    lambda r: "<nav><ul>" + "".join(f"<li><a href=/{i}>{r.choice(WORDS)}</a></li>" for i in range(4)) + "</ul></nav>",
    lambda r: f"<header><h1>Site</h1><p>{sentence(r, 30, 50)}</p></header>",
    lambda r: f"<footer><p>&copy; {sentence(r, 20, 60)}</p></footer>",
    lambda r: f"<aside><p>{sentence(r, 40, 60)}</p></aside>",
    lambda r: f"<div class='{r.choice(['ad', 'sidebar', 'cookie-banner', 'newsletter signup', 'related-posts', 'widget'])}'><p>{sentence(r, 40, 60)}</p></div>",
    lambda r: f"<section id=comments><div class=comment><p>{sentence(r, 30, 60)}</p></div></section>",
    lambda r: "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    lambda r: f"<script>if (a < b) document.write('<p>{sentence(r, 40, 60)}</p>')</script><style>p > a {{}}</style>",
    lambda r: f"<div style='display:none'><p>{sentence(r, 40, 60)}</p></div>",
    lambda r: f"<!-- <p>{sentence(r, 40, 60)}</p> -->",
]


def body(r, plain):
    """(html, blocks) of an article; plain pages have a long text first and last, as nothing else tells where it ends."""
    parts, texts = [], []

    def add(tag, text, end=True):
        texts.append(text)
        parts.append(f"<{tag}>{inline(r, text)}" + (f"</{tag}>" if end else ""))

    add("h1", sentence(r, 3, 8))
    add("p", sentence(r, 45, 90))
    for _ in range(r.randrange(6)):
        kind = r.randrange(6)
        if kind == 0:
            add("h2", sentence(r, 2, 6))
            add("p", sentence(r, 45, 80))
        elif kind == 1:
            items = [sentence(r, 2, 9) for _ in range(r.randrange(1, 5))]
            texts.extend(items)
            parts.append("<ul>" + "".join(f"<li>{inline(r, x)}" for x in items) + "</ul>")
        elif kind == 2:
            add("blockquote", sentence(r, 12, 30))
        elif kind == 3:
            cells = [sentence(r, 1, 4) for _ in range(4)]
            texts.extend(cells)
            parts.append(f"<table><tr><td>{cells[0]}<td>{cells[1]}<tr><td>{cells[2]}</td><td>{cells[3]}</table>")
        elif kind == 4:
            add("p", sentence(r, 2, 8), r.random() < 0.5)
        else:
            add("p", sentence(r, 15, 60), r.random() < 0.5)
    if plain:
        add("p", sentence(r, 50, 80))
    return "".join(parts), texts


SHAPES = [
    ("article", "<article>{}</article>"),
    ("main", "<main>{}</main>"),
    ("role", "<main class='content' role=main><article class='post status-open'>{}</article></main>"),
    ("deep", "<div><div><section><article id=a1><div class='entry-content'>{}</div></article></section></div></div>"),
    ("grid", "<div class='layout with-sidebar'><main>{}</main></div>"),
    ("form", "<form id=aspnetForm><main>{}</main></form>"),
    ("header", "<article><header>{}</header></article>"),
    ("span", "<article><span class=lead>{}</span></article>"),
    ("upper", "<ARTICLE CLASS=Text>{}</ARTICLE>"),
    ("open", "<article>{}"),
]
PLAIN = [("plain", "{}"), ("div", "<div id=content>{}</div>"), ("td", "<table><tr><td>{}</td></tr></table>"), ("section", "<section class='text has-sidebar'>{}</section>"), ("form", "<form id=f><div>{}</div></form>"), ("nested", "<div class=page><div class=inner>{}</div></div>")]


@pytest.mark.parametrize("plain, name, shape", [(False, *s) for s in SHAPES] + [(True, *s) for s in PLAIN])
def test_generated_pages(plain, name, shape):
    r = random.Random(name)
    for _ in range(60):
        content, texts = body(r, plain)
        before, after = ("".join(r.choice(NOISE)(r) for _ in range(r.randrange(4))) for _ in range(2))
        if name == "open":  # an article that is never closed takes in what follows
            after = r.choice(["</body></html>", "<footer>end of the page</footer>"])
        page = f"<!DOCTYPE html><html><head><title>{sentence(r, 4, 8)}</title><meta charset=utf-8></head><body>{before}{shape.format(content)}{after}</body></html>"
        assert main_text(page) == " ".join(texts), page


@pytest.mark.parametrize(
    "page",
    ['<div class="sidebar-wrap"><h1>x' * 50_000, "<form><article>" * 25_000 + "text", "<div>" * 50_000 + "x" + "</p></div></q>" * 50_000, "<!" * 50_000, "<p class=ad>x<span class=ad>y" * 25_000, "<a href='" * 50_000, "&am" * 100_000, "<table>" * 20_000 + "<tr><td>z" * 20_000],
)
def test_time_grows_with_the_length(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 5
