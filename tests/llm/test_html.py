"""Main text: generated pages beside a plain tree reader, and pages that tell rules apart."""

import time
import tracemalloc
from html import escape
from html.parser import HTMLParser

import numpy as np
import pytest

from plumbline.llm import html

JUNK = [
    "<nav><ul><li><a href='/'>{}</a></li></ul></nav>", "<aside><p>{}</p></aside>", "<footer>{}</footer>", "<div class='ad'>{}</div>",
    "<div class='cookie-notice'><p>{}</p></div>", "<div id='sidebar'><p>{}</p></div>", "<form><label>{}</label></form>",
    "<div class='related-posts'><a href='/r'>{}</a></div>", "<ul class='share-buttons'><li>{}</li></ul>", "<p hidden>{}</p>",
    "<div style='display: none'><div>{}</div></div>", "<section class='comments'><p>{}</p></section>", "<script>{}</script>",
    "<!-- {} -->", "<ol class='commentlist'><li>{}</li></ol>", "<p class='ad'>{}</p>", "<noscript>{}</noscript>", "<div class='mc-newsletter-x9'><a href='/'>{}</a></div>",
]
KEPT = [
    "<p>{}</p>", "<h2 id='search'>{}</h2>", "<section id='related-work'><p>{}</p></section>", "<p class='legal'>{}</p>", "<ul><li>{}</li></ul>",
    "<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td></tr></table>", "<pre>{}</pre>", "<p><math><mi>{}</mi></math></p>",
    "<div class='text with-sidebar'><p>{}</p></div>", "<h3 class='ad-title'>{}</h3>", "<section id='login'><h2>{}</h2></section>", "<dl><dt>{}</dt></dl>", "<p><b><i>{}</i></b></p>",
]
WRAPS = ["<article>{}</article>", "<main><article>{}</article></main>", "<div class='post'>{}</div>", "<form action='/x'><div>{}</div></form>", "<div id='page'><main>{}</main></div>", "<article><header><h1>Head</h1></header>{}</article>"]


class Plain(HTMLParser):
    """Blocks of text of a well-formed page, by the standard library's reader and plain recursion."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.at, self.out, self.raw = [], [[]], 0
        self.feed(page)
        self.out = [" ".join("".join(x).split()) for x in self.out]
        self.out = [x for x in self.out if x]

    def handle_starttag(self, tag, attrs):
        self.raw += tag in html.RAW
        if tag in html.BLOCK or tag in html.JUNK_TAGS:
            self.out.append([])
        if tag == "br":
            self.out[-1].append(" ")

    def handle_endtag(self, tag):
        self.raw -= tag in html.RAW
        if tag in html.BLOCK or tag in html.JUNK_TAGS:
            self.out.append([])

    def handle_data(self, data):
        if not self.raw:
            self.out[-1].append(data)


def sentence(rng, words):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, words)) + str(rng.choice([" & co", " <x>", " é漢", "."]))


def generated(seed):
    rng = np.random.default_rng(seed)
    wrap = WRAPS[seed % len(WRAPS)]
    text, parts = ["Head"] if "Head" in wrap else [], []
    for _ in range(rng.integers(5, 25)):
        t = sentence(rng, rng.integers(20, 40))
        if rng.random() < 0.3:
            parts.append(JUNK[rng.integers(len(JUNK))].format(escape(sentence(rng, 4))))
        else:
            text.append(" ".join(t.split()))
            parts.append(KEPT[rng.integers(len(KEPT))].format(escape(t).replace(" ", "\n ", 1)))
    around = [JUNK[rng.integers(len(JUNK))].format(escape(sentence(rng, 5))) for _ in range(4)]
    page = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(around[:2]) + wrap.format("".join(parts)) + "".join(around[2:]) + "</body></html>"
    return page, " ".join(text)


@pytest.mark.parametrize("seed", range(60))
def test_generated_pages(seed):
    page, text = generated(seed)
    read = html.parse(page)
    hidden = [t for el, t, _ in read.blocks]
    assert hidden == Plain(page).out
    assert html.extract(read, None) == text


def test_generated_pages_by_host(spark):
    rows = [(s, f"http://h{s % 6}.org/{s}", generated(s)[0]) for s in range(60)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {s: generated(s)[1] for s in range(60)}


LONG = "<p>" + "Text of the story goes on. " * 20 + "</p>"
SAID = " ".join(["Text of the story goes on."] * 20)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form><nav>x</nav><h1>T</h1>{LONG}<select><option>o</select><button>b</button></form>", f"T {SAID}"),
        (f"<article><p>In <span style='DISPLAY : none'>no</span>line <span class='ad'>Buy <span>now</span></span>end <em hidden>x</em>.</p>{LONG}</article>", f"In line end . {SAID}"),
        (f"<article><p>a <span hidden>never closed</p>{LONG}</article>", f"a {SAID}"),
        (f"<article>{LONG}<p>f <math><mi>y</mi><annotation encoding='application/x-tex'>\\y</annotation></math></p></article>", f"{SAID} f y"),
        (f"<header>Site</header><article><header><h1>T</h1></header><div class='post-header'>by me</div>{LONG}<footer>f</footer></article>", f"T by me {SAID}"),
        (f"<article>{LONG}</article><div class='comments'><p>{'Reader says much. ' * 200}</p></div>", SAID),
        (f"<article>{LONG}<article class='comment'>Reader</article></article>", SAID),
        (f"<body class='sidebar search'><div class='social'>{LONG}</div></body>", SAID),
        (f"<article>{LONG}<p>1 < 2 <3 a<b</p></article>", f"{SAID} 1 < 2 <3 a"),
        (f"<article>{LONG}<p title='it\"s >'>q</p><a href=\"x>y\">z</a></article>", f"{SAID} q z"),
        (f"<article>{LONG}<p title=\"never closed>q</p></article>", f"{SAID} q"),
        (f"<table><tr><td class='sidebar'>s</td><td>{LONG}</td></tr></table>", SAID),
        ("<p>only <script>if (a<b) x</script>this", "only this"),
        ("text<!-- open", "text"),
        ("text <", "text <"),
    ],
)
def test_pages_that_tell_rules_apart(page, text):
    assert html.extract(html.parse(page), None) == text


PAGES = ["<" * 10**6, "<a" * 500_000, "<a " * 330_000 + ">", '<a "' * 250_000, "<a \"><b '" * 100_000, "<!" * 500_000, "<!--" * 250_000, "<a b" * 250_000 + ">", "<title>" * 140_000, "<p " + 'a="' * 300_000 + ">", "&#" * 500_000, "</p" * 300_000]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_broken_megabytes_are_read_in_linear_time(k):
    began = time.process_time()
    html.extract(html.parse(PAGES[k]), None)
    assert time.process_time() - began < 5


def test_deep_pages_take_linear_time_and_memory():
    for unit in ("<div class='a'>", "<div class='a'>x", "<ul><li>"):
        page = unit * (100_000 // unit.count("<")) + "deep"
        began = time.process_time()
        out = html.extract(html.parse(page), None)
        assert time.process_time() - began < 10 and out.endswith("deep")
    tracemalloc.start()
    html.extract(html.parse("<div class='a'>" * 30_000), None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 200 MB at 100,000
