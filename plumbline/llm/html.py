"""Main text of web pages, by paths on which the pages of a host agree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, lookup, slices

#: A path wins if it is the deepest one with this share of the host's best score; others wait as fallback. It says where
#: the article is; each page then adds the text around it.
AGREE, FALLBACK = 0.8, 0.05
#: A form, and a container with a telling name, that hold more than this share of the page's text are the page itself.
FORM_SHARE, NAME_SHARE = 0.5, 0.9
#: A container whose name only hints at junk is junk if this share of its characters are links.
LINK_SHARE = 0.3
HOSTS = 100_000

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body blockquote dd div form li main ol section table tbody td tr ul".split())
CLOSES_P = BLOCK - {"html", "head", "body"}
ITEMS = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What is not main text, by element, role, and the words of a class or id.
JUNK_TAGS = frozenset("nav header footer aside form button select dialog menu audio video object canvas".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disqus footer gdpr header legal login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promos promoted promotion recommended related replies reply respond responses "
    "search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that say nothing themselves, so that a junk word beside them decides.
FILLER_WORDS = frozenset(
    "area article articles bar block bottom box button buttons column container content form global group icons inner items item left link "
    "links list main module outer page panel post posts primary region right row section secondary site slot stories thread top unit "
    "user users view wrap wrapper zone".split()
)
#: Words that decide for a paragraph or an inline element too.
NARROW_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising adsense comment comments cookie cookies sponsored".split())
LAYOUT_WORDS = frozenset("with has no without".split())
#: Words beside "header" that make it the head of the article.
HEAD_WORDS = frozenset("article content entry post story".split())
#: Elements judged by name; headings never are.
NAMED = frozenset("div section ul ol li dl table tr td fieldset figure center".split())

_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"(?:display\s*+:\s*+none|visibility\s*+:\s*+hidden)")

#: What an element looks like from outside: plain, surely junk, junk by its name, hinting at junk, a form.
PLAIN, SURE, NAME, HINT, FORM = range(5)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    path: int
    depth: int
    kind: int


@dataclass
class Page:
    """Elements in page order, parents first, and blocks of text: (element, text, characters within links)."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or ("style" in attrs and bool(_HIDDEN.search(attrs["style"].lower())))


def named(name: str) -> int:
    """What one class or id says: NAME if all its words are junk or filler (SURE for comments), HINT if one of several is junk."""
    parts = [x.lower() for x in _NAME.findall(name) if not x.isdigit()]
    told = [x in JUNK_WORDS or x.startswith("comment") for x in parts]
    if not any(told) or not LAYOUT_WORDS.isdisjoint(parts):
        return PLAIN
    if "header" in parts and sum(told) == 1 and not HEAD_WORDS.isdisjoint(parts):
        return PLAIN
    if any(x.startswith("comment") for x in parts) and all(t or x in FILLER_WORDS for t, x in zip(told, parts, strict=True)):
        return SURE
    return NAME if all(t or x in FILLER_WORDS for t, x in zip(told, parts, strict=True)) else HINT


def narrow(attrs: dict[str, str]) -> bool:
    """Whether a class of a paragraph or inline element names an advert, a comment or the like."""
    for name in attrs.get("class", "").split():
        parts = [x.lower() for x in _NAME.findall(name) if not x.isdigit()]
        if parts and not NARROW_WORDS.isdisjoint(parts) and all(x in NARROW_WORDS or x in FILLER_WORDS for x in parts):
            return True
    return False


def kind_of(tag: str, attrs: dict[str, str], in_article: bool = False) -> int:
    """How an element is taken; `in_article` if it lies in an article or main.

    A header within an article or main holds its headline and is plain. An id alone is no more than a hint on a
    section, as ids there repeat headings; comments excepted.
    """
    if hidden(attrs):
        return SURE
    role = attrs.get("role", "").lower()
    if tag == "form" or role == "form":
        return FORM
    if tag == "header" and in_article:
        return PLAIN
    if tag in JUNK_TAGS or role in JUNK_ROLES:
        return SURE
    if tag in ("p", "article"):
        return NAME if narrow(attrs) else PLAIN
    if tag not in NAMED:
        return PLAIN
    told = [named(c) for c in attrs.get("class", "").split()]
    by_id = named(attrs.get("id", ""))
    told.append(HINT if by_id == NAME and tag == "section" else by_id)
    return next((k for k in (SURE, NAME, HINT) if k in told), PLAIN)


def step(tag: str, attrs: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its classes, digits as one sign."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def path_number(parent: int, step_: str) -> int:
    """A path as a signed 64-bit number made of its parent's and its last step, so that deep pages hold no long strings."""
    return int.from_bytes(blake2b(step_.encode("utf-8", "surrogatepass"), digest_size=8, key=parent.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


@lru_cache(4096)
def shape(tag: str, rest: str, in_article: bool) -> tuple[str, int]:
    """Step and kind of an element, given the text of its attributes."""
    attrs = attributes(rest)
    return step(tag, attrs), kind_of(tag, attrs, in_article)


class _Reader:
    """Reads one page in time linear in its length; see `parse`."""

    def __init__(self, html: str):
        self.html, self.page = html, Page()
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # places in the stack of each open tag
        self.words: list[str] = []
        self.linked, self.links = 0, 0
        self.muted: list[tuple[str, int, int]] = []  # hidden inline elements: tag, stack size, open ones of that tag within
        self.quotes = True
        self.ends: dict[str, int] = {}

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            if not self.stack:
                self.opened("body", "")
            self.page.blocks.append((self.stack[-1], text, self.linked))
        self.words.clear()
        self.linked = 0

    def opened(self, tag: str, rest: str):
        els = self.page.elements
        parent = self.stack[-1] if self.stack else -1
        up = els[parent] if self.stack else None
        in_article = bool(self.open.get("article") or self.open.get("main"))
        step_, kind = (shape if len(rest) < 500 else shape.__wrapped__)(tag, rest, in_article)
        els.append(Element(tag, parent, path_number(up.path if up else 0, step_), up.depth + 1 if up else 0, SURE if self.muted else kind))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(els) - 1)

    def closed(self, to: int):
        self.flush()
        for i in self.stack[to:]:
            self.open[self.page.elements[i].tag].pop()
        del self.stack[to:]
        while self.muted and self.muted[-1][1] > to:
            self.muted.pop()

    def last(self, tag: str) -> int:
        return self.open[tag][-1] if self.open.get(tag) else -1

    def shielded(self, place: int, tags) -> bool:
        """Whether one of the tags is open above a place of the stack."""
        return any(self.last(t) > place for t in tags)

    def find(self, what: str, at: int) -> int:
        """str.find that remembers that nothing is left, so that repeats cost nothing."""
        if self.ends.get(what, len(self.html)) < at:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.ends[what] = -1
        return found

    def tag_end(self, at: int) -> int:
        """The end of a tag, if a ">" follows; quotes that never close are no quotes, for the rest of the page."""
        if self.quotes:
            m = _TAG_END.match(self.html, at)
            if m:
                return m.end()
            self.quotes = False
        return self.find(">", at) + 1

    def text(self, piece: str):
        if piece and not self.muted:
            text = unescape(piece)
            self.words.append(text)
            if self.links:
                self.linked += len(text)

    def read(self) -> Page:
        html, at, done = self.html, 0, 0
        while True:
            at = self.find("<", at)
            if at < 0:
                break
            head = html[at + 1 : at + 4]
            if head == "!--":
                self.text(html[done:at])
                stop = self.find("-->", at + 4)
                at = done = len(html) if stop < 0 else stop + 3
                continue
            if head[:1] in ("!", "?"):
                stop = self.find(">", at)
                if stop < 0:
                    break
                self.text(html[done:at])
                at = done = stop + 1
                continue
            if self.find(">", at) < 0:
                break  # no tag ends any more
            m = _TAG_NAME.match(html, at + 1)
            if not m:
                at += 1
                continue
            stop = self.tag_end(m.end())
            self.text(html[done:at])
            at = done = self.tag(bool(m[1]), m[2].lower(), html[m.end() : stop - 1], stop)
        self.text(html[done:])
        self.flush()
        return self.page

    def tag(self, end: bool, tag: str, rest: str, at: int) -> int:
        """Takes one tag; the place where reading goes on."""
        if tag in RAW and not end:
            if rest.rstrip().endswith("/") and tag not in ("script", "style"):
                return at
            m = re.compile(f"</{tag}", re.I).search(self.html, at) if self.ends.get(f"</{tag}", 0) >= 0 else None
            if not m:
                self.ends[f"</{tag}"] = -1
                return len(self.html)
            stop = self.find(">", m.end())
            return len(self.html) if stop < 0 else stop + 1
        if tag == "br":
            self.text(" ")
        elif tag == "hr":
            self.flush()
        elif tag in BLOCK or tag in JUNK_TAGS:
            self.block(end, tag, rest)
        elif tag not in VOID:
            if tag == "a":
                self.links = max(0, self.links - 1) if end else self.links + 1
            self.inline(end, tag, rest)
        return at

    def inline(self, end: bool, tag: str, rest: str):
        """Inline elements belong to their block; those hidden or named an advert are left out with all within."""
        if self.muted and self.muted[-1][0] == tag:
            name, size, depth = self.muted.pop()
            depth += -1 if end else 1
            if depth:
                self.muted.append((name, size, depth))
        elif not end and not self.muted and not rest.rstrip().endswith("/"):
            if tag in ("annotation", "annotation-xml"):
                self.muted.append((tag, len(self.stack), 1))
            elif rest and ("hidden" in (low := rest.lower()) or "style" in low or "class" in low):
                attrs = attributes(rest)
                if hidden(attrs) or narrow(attrs):
                    self.muted.append((tag, len(self.stack), 1))

    def block(self, end: bool, tag: str, rest: str):
        if end:
            place = self.last(tag)
            if place >= 0:
                self.closed(place)
            else:
                self.flush()
            self.links = 0
            return
        self.flush()
        self.links = 0
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in CLOSES_P and (place := self.last("p")) >= 0 and not self.shielded(place, ("table", "button", "object")):
            self.closed(place)
        if tag in ITEMS and (place := self.last(tag)) >= 0 and not self.shielded(place, ITEMS[tag].split()):
            self.closed(place)
        if tag == "body" and self.open.get("head"):
            self.closed(self.open["head"][0])
        self.opened(tag, rest)


def parse(html: str | None) -> Page:
    """Elements and text blocks of a page, unclosed and stray tags included; time and memory are linear in its length.

    A "<" that opens no tag is text. Contents of scripts, styles and the like are left out, as are hidden inline elements.
    """
    return _Reader(html or "").read()


def judge(page: Page) -> list[bool]:
    """Whether each element is junk, itself or by what it lies in.

    A form or name decides unless the element holds more than FORM_SHARE or NAME_SHARE of the text outside sure junk; a
    hint decides if more than LINK_SHARE of the element's characters are links.
    """
    els = page.elements
    sure = [False] * len(els)
    for i, e in enumerate(els):
        sure[i] = e.kind == SURE or (e.parent >= 0 and sure[e.parent])
    size, linked = [0] * len(els), [0] * len(els)
    for el, text, within in page.blocks:
        if not sure[el]:
            size[el] += len(text)
            linked[el] += within
    for i in range(len(els) - 1, 0, -1):
        if els[i].parent >= 0:
            size[els[i].parent] += size[i]
            linked[els[i].parent] += linked[i]
    total = sum(size[i] for i, e in enumerate(els) if e.parent < 0)
    junk = [False] * len(els)
    for i, e in enumerate(els):
        if e.kind in (NAME, FORM):
            told = size[i] <= (FORM_SHARE if e.kind == FORM else NAME_SHARE) * total
        else:
            told = e.kind == SURE or (e.kind == HINT and linked[i] > LINK_SHARE * size[i])
        junk[i] = told or (e.parent >= 0 and junk[e.parent])
    return junk


def container_scores(page: Page, junk: list[bool] | None = None) -> dict[int, tuple[float, int]]:
    """Score and depth of each container path: text outside links and junk, less twice the junk within."""
    els, junk = page.elements, judge(page) if junk is None else junk
    gain = [0.0] * len(els)
    for el, text, linked in page.blocks:
        gain[el] += -2.0 * len(text) if junk[el] else max(0, len(text) - 2 * linked)
    for i in range(len(els) - 1, 0, -1):
        if els[i].parent >= 0:
            gain[els[i].parent] += gain[i]
    scores: dict[int, tuple[float, int]] = {}
    for i, e in enumerate(els):
        if e.tag in CONTAINER and not junk[i]:
            scores[e.path] = (scores.get(e.path, (0.0, 0))[0] + gain[i], e.depth)
    return {p: s for p, s in scores.items() if s[0] > 0}


def outermost(page: Page, path: int, junk: list[bool]) -> set[int]:
    """The elements with a path, or the containers around them that hold more of the article.

    A container around is taken if it leaves text outside links and junk out of the containers within. Around an
    article or main, and in body, only text of its own counts: other containers there are other parts of the page.
    Elements with one path have containers around them with one path, so each step up looks at fewer.
    """
    els = page.elements
    up = [-1] * len(els)  # the nearest container at or around an element
    for i, e in enumerate(els):
        up[i] = i if e.tag in CONTAINER else up[e.parent] if e.parent >= 0 else -1
    within, own = [0] * len(els), [0] * len(els)
    for el, text, linked in page.blocks:
        if not junk[el] and len(text) > 2 * linked:
            within[el] += 1
            if up[el] >= 0:
                own[up[el]] += 1
    for i in range(len(els) - 1, 0, -1):
        if els[i].parent >= 0:
            within[els[i].parent] += within[i]
    level = {i for i, e in enumerate(els) if e.path == path and not junk[i]}
    best, whole = level, False
    while level:
        whole = whole or any(els[i].tag in ("article", "main") for i in level)
        level = {up[els[i].parent] for i in level if els[i].parent >= 0} - {-1}
        tag = els[next(iter(level))].tag if level else ""
        if tag in ("article", "main") or not (whole or tag == "body"):
            more = sum(within[i] for i in level) > sum(within[i] for i in best)
        else:
            more = any(own[i] for i in level)
        if more:
            best = level
    return best


def extract(page: Page, paths: list[int] | None) -> str:
    """Text of the blocks below the first of the paths that the page has, in page order, without junk.

    Text of the article that stands around that container comes with it (`outermost`). A page with none
    of the paths is read at its own best container, or whole if it has none.
    """
    els, junk = page.elements, judge(page)
    here = {e.path for e, j in zip(els, junk, strict=True) if not j}
    path = next((p for p in paths or [] if p in here), None)
    if path is None:
        own = container_scores(page, junk)
        best = max((s for s, _ in own.values()), default=0)
        path = max(((d, s, p) for p, (s, d) in own.items() if s >= AGREE * best), default=(0, 0, None))[2]
    tops = outermost(page, path, junk) if path is not None else set()
    inside = [False] * len(els)
    for i, e in enumerate(els):
        inside[i] = path is None or i in tops or (e.parent >= 0 and inside[e.parent])
    return " ".join(t for el, t, _ in page.blocks if inside[el] and not junk[el])


def _votes(batches):
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, html in zip(batch.column(0), batch.column(1), strict=True):
            host = host.as_py()
            found = container_scores(parse(html.as_py()))
            best = max((score for score, _ in found.values()), default=1.0)
            for path, (score, depth) in found.items():
                mine = sums.setdefault((host, path), [0.0, depth])
                mine[0] += score / best  # a page has one vote, however long
        rows = [(h, p, s, d) for (h, p), (s, d) in sums.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["host", "path", "score", "depth"])


def _texts(batches):
    for batch in slices(batches, 256):
        out = []
        for html, paths in zip(batch.column(2), batch.column(3), strict=True):
            out.append(extract(parse(html.as_py()), paths.as_py()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, pages, paths) from rows (host, html): the winning path first, then the fallbacks by score.

    Every page votes for its containers by their share of its best score; votes are summed by host and path, within the
    tasks first. The winner is the deepest path with AGREE of the best score.
    """
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path long, score double, depth int")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("score"), F.max("depth").alias("depth"))
    sums = keep(sums, "votes")
    best = sums.groupBy("host").agg(F.max("score").alias("best"))
    near = sums.join(best, "host").where(F.col("score") >= FALLBACK * F.col("best"))
    wins = F.col("score") >= AGREE * F.col("best")
    order = F.struct((~wins).alias("lost"), F.when(wins, -F.col("depth")).otherwise(0).alias("shallow"), (-F.col("score")).alias("less"), "path")
    paths = near.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("p"))
    counts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return paths.select("host", F.col("p.path").alias("paths")).join(counts, "host")


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Character references are decoded; white space within a block becomes one space; blocks are
    joined in page order by one space; inline elements do not break a block, a line break is a space.

    Defined cases: null and empty pages give an empty text; pages without host form one group; a page
    that lacks its host's paths is read at its own best container; repeated rows get equal rows; an
    empty table gives an empty result; other columns play no part.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*[a-zA-Z][\w+.-]*://([^/:?#\s]+)", 1)), r"^www\.", "")
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    winners = keep(host_paths(rows), "paths")
    if winners.limit(HOSTS + 1).count() <= HOSTS:
        met = rows.join(F.broadcast(winners.select("host", "paths")), "host", "left")
    else:
        met = lookup(rows, winners, ["host"], "pages", ["paths"])
    kind = rows.schema["id"].dataType.simpleString()
    out = met.select("id", "url", "html", "paths").mapInArrow(_texts, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
