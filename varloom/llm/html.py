"""Main-text extraction by maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores by the zone it stands
in (the nearest telling ancestor: article, nav, footer, a class such as
"sidebar", ...): the log odds of that zone in the main text of labelled pages.
A tag costs the logarithm of how likely it is part of main text.  One linear
scan finds the contiguous stretch with the highest sum: the content region.
Boilerplate inside an article (an advert between paragraphs) has no vote, and
what stands in a boilerplate zone inside the region is left out.

Of the words in a class, id or role one that names boilerplate decides
("comment-body", "footer-content"), but for words that only tell the layout of
a page ("content-with-sidebar").  A heading or a paragraph in the header of an
article is part of the article, but for a byline.

Where a page has no main text by these names, boilerplate words in the class
of an element (and the element `form`) that holds or itself names main text
and stands around more than half of the page's words outside links are void:
they tell the look of the page ("tabs-content", "ad-free story").

Null or empty html, or a page without positive words, gives "".  Broken
markup never fails: unclosed elements run to their parent's end, an
unfinished tag at the end is dropped.  Rows are independent.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm._shared import bounded_batches, hash_sample
from varloom.llm.bpe import small_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Fixed values of the markup language: elements without content, elements
#: whose content is not text of the page, and elements that do not break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title select textarea button option datalist audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and words in class or id that name a zone.
ZONE_TAGS = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "notice"}
ZONE_WORDS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc",
    "header": "header masthead banner topbar branding",
    "footer": "footer copyright colophon",
    "aside": "sidebar aside related recommended widget rail promo trending",
    "ad": "ad ads advert adverts advertisement sponsor sponsored",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe paywall gdpr",
    "comments": "comment comments opinions disqus respond replies discussion",
    "share": "share sharing social",
    "form": "form search login signup",
    "article": "article post entry story",
    "main": "main content body text",
}
_WORD_ZONE = {w: z for z, ws in ZONE_WORDS.items() for w in ws.split()}
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "ad", "notice", "comments", "share", "form"})

#: Ids of elements around the whole page, and classes that tell its layout: neither names a zone.
WRAPPERS = frozenset("page wrap wrapper site container outer layout root app page-wrapper site-wrapper main-wrapper".split())
#: Words of a class after which the rest tells what else the page has, beginnings of names that the site gives, and columns.
_REST = re.compile(r"(?:^|[-_])(?:has|no|with|without|and)[-_].*")
_GIVEN = re.compile(r"(?:category|tag|type|status|format|term|author)[-_]")
_COLUMNS = re.compile(r"(?:left|right|both|one|two)[-_]?sidebars?|sidebars?[-_]?(?:left|right|both|none)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Class words of what an article's header holds beside its heading and its first lines.
_BYLINE = re.compile(r"(?:^|[^a-z])(?:by|byline|author|date|dateline|meta|time|published|info|tags|kicker)(?:[^a-z]|$)")

#: Hand-labelled pages: "+" lines are main text, "-" lines are not.
LABELLED = [
    [("-", "<nav><a>Home</a><a>About us</a></nav>"), ("+", "<article><h1>Harvest starts early</h1><p>Farmers in the valley began picking this week.</p><p>Yields look good.</p></article>"), ("-", "<footer>Copyright, all rights reserved</footer>")],
    [("-", '<div class="header">Daily Post</div><div class="menu"><ul><li><a>News</a></li><li><a>Sport</a></li></ul></div>'), ("+", '<div class="content"><h2>Bridge reopens</h2><p>The old bridge carried its first cars on Monday after two years of repairs.</p></div>'), ("-", '<div class="sidebar"><a>Most read today</a></div><div class="footer">Contact us</div>')],
    [("-", '<div id="cookie-notice">We use cookies</div>'), ("+", "<main><p>The committee met twice and agreed on a plan for the new school building.</p><ul><li>First the roof</li><li>Then the yard</li></ul></main>"), ("-", '<section id="comments"><p>Great read, thanks for it!</p><p>I do not agree at all.</p></section><form>Your name</form>')],
    [("-", '<header><a>Login</a></header><div class="ad">Buy two and get one free</div>'), ("+", '<div class="post"><p>Snow fell on the pass overnight and the road stays shut until noon.</p></div>'), ("-", '<aside>Related stories for you</aside><div class="share">Share this</div>')],
    [("-", "<div><span>Skip to the text</span></div>"), ("+", "<article><h1>Ferry timetable</h1><p>The ferry leaves <em>twice</em> an hour from the <a>old pier</a> in summer.</p><table><tr><td>Morning</td><td>seven</td></tr></table></article>"), ("-", '<div><a>Back to the top</a><span>Printed on paper</span></div><div class="newsletter"><p>Letters every week</p></div>')],
    [("+", "<h1>Notes on bread</h1><p>Flour, water and salt rest for a night before the loaf is shaped and baked.</p><div>Let it cool for an hour.</div><ul><li>Rye keeps longest</li></ul>")],
    [("-", "<nav><a>Index</a></nav>"), ("+", "<h2>The mill</h2><p>The mill by the river ground grain for three villages until the dam was built.</p><blockquote>It never stood still.</blockquote>"), ("-", '<div class="footer"><a>Imprint</a></div><form><label>Search words</label></form><div class="comments"><p>My aunt lived there</p></div>')],
]


def boilerplate(zone: str) -> bool:
    """"in:ad" is an advert inside the article: left out, but no reason to end the region there."""
    return zone.removeprefix("in:") in BOILERPLATE


def _class_zone(tag: str, zone: str, void: bool = False) -> str:
    """The zone that class, id and role of a tag name, or else `zone`: boilerplate (if not `void`) before article before main text."""
    words: list[str] = []
    columns: list[str] = []
    for marked in _MARK.finditer(tag):
        value = (marked[1] or marked[2] or marked[3] or "").lower()
        if marked[0][:2].lower() == "id" and value.strip() in WRAPPERS:
            return zone
        for part in value.split():
            if not _GIVEN.match(part):
                (columns if _COLUMNS.fullmatch(part) else words).extend(re.split(r"[^a-z]+", _REST.sub("", part)))
    zones = [_WORD_ZONE[w] for w in words if w in _WORD_ZONE and not (void and _WORD_ZONE[w] in BOILERPLATE)]
    if not zones and columns and not void:
        return "aside"
    return next((z for z in zones if z in BOILERPLATE), "article" if "article" in zones else zones[0] if zones else zone)


class _Held:
    """Words outside links of a page, and of each element that its class (or `form`) makes boilerplate."""

    def __init__(self):
        self.words = 0
        self.open: list[list] = []  # place in the stack, offset of the tag, words before it, whether it holds a name of main text
        self.of: dict[int, int] = {}
        self.named = 0  # the open elements up to here hold such a name

    def begin(self, place: int, offset: int) -> None:
        self.open.append([place, offset, self.words, False])

    def name(self) -> None:
        while self.named < len(self.open):
            self.open[self.named][3] = True
            self.named += 1

    def cut(self, place: int) -> None:
        while self.open and self.open[-1][0] >= place:
            _, offset, before, named = self.open.pop()
            if named:
                self.of[offset] = self.words - before
        self.named = min(self.named, len(self.open))


def page_tokens(page: str) -> list[tuple[str, str, str]]:
    """The tokens of a whole page; boilerplate names around most of it are void where it has no other main text."""
    held = _Held()
    toks = tokens(page, held=held)
    if any(kind == "text" and zone in ("article", "main") and s.strip() for kind, s, zone in toks):
        return toks
    held.cut(0)  # elements that the page does not close
    void = frozenset(at for at, words in held.of.items() if 2 * words > held.words)
    return tokens(page, void) if void else toks


def tokens(page: str, void: frozenset[int] = frozenset(), held: _Held | None = None) -> list[tuple[str, str, str]]:
    """(kind, name or text, zone): kind "open", "close" or "text".  Content of hidden elements is skipped.

    Tags that begin at the offsets `void` name no boilerplate; `held` counts words by element.
    """
    out: list[tuple[str, str, str]] = []
    # Name, zone, the place of the paragraph that the next <p> would end (0: none), and
    # the place of the element whose class made this boilerplate (0: none did, or a tag did).
    stack: list[tuple[str, str, int, int]] = [("", "body", 0, 0)]
    places: dict[str, list[int]] = {}  # by name: where it stands in the stack

    def cut(i: int) -> None:
        for name, *_ in stack[i:]:
            places[name].pop()
        del stack[i:]
        if held:
            held.cut(i)

    at, n = 0, len(page)
    lower = None
    content = False  # an article or main element stood outside such boilerplate
    around_all = 0  # the element around the articles that did not
    while at < n:
        m = _TOKEN.match(page, at)
        s, offset = m[0], at
        at = m.end()
        if s[0] != "<" or s == "<":
            out.append(("text", s, stack[-1][1]))
            if held and not places.get("a") and (not boilerplate(stack[-1][1]) or (stack[-1][3] and stack[-1][1] != "comments")):
                held.words += len(s.split())
            continue
        if s[1] in "!?" or s[-1] != ">":
            continue
        name = _NAME.match(s)[1].lower()
        if s[1] == "/":
            if places.get(name):
                cut(places[name][-1])
            out.append(("close", name, stack[-1][1]))
            continue
        if name in HIDDEN and s[-2] != "/":
            if name != "head":
                lower = lower or page.lower()
                end = lower.find(f"</{name}", at)
                if end < 0 and name in ("button", "option", "select", "object", "map"):
                    continue
                at = n if end < 0 else end
                close = page.find(">", at)
                at = n if close < 0 else close + 1
            continue
        _, zone, _, by = stack[-1]
        around = zone
        named = ZONE_TAGS.get(name)
        told = "" if named or "=" not in s or name in ("html", "body") else _class_zone(s, "")
        if held and name not in VOID and s[-2] != "/" and (name == "form" or told in BOILERPLATE) and told != "comments":
            held.begin(len(stack), offset)
        if held and zone != "comments" and (name in ("article", "main") or told in ("article", "main") or (told in BOILERPLATE - {"comments"} and _class_zone(s, "", True) in ("article", "main"))):
            held.name()
        if not boilerplate(zone):
            by = 0
            if name == "form" and offset in void:
                zone = _class_zone(s, zone, True)
            elif named:
                zone = named
                if name == "form":
                    by = len(stack)
                elif name == "article" and "=" in s:  # a reader's comment, a sponsored or a related article
                    told = _class_zone(s, "")
                    if told in ("comments", "ad") or (told == "aside" and "sidebar" not in s.lower()):
                        zone = told
            elif "=" in s and name not in ("html", "body"):
                zone = _class_zone(s, zone, offset in void)
                by = len(stack) if zone in BOILERPLATE else 0
            if zone in BOILERPLATE and around in ("article", "main"):
                zone, by = "in:" + zone, 0
            content |= zone in ("article", "main") and name in ("article", "main")
        elif by and name in ("article", "main") and (name == "main" or zone != "comments") and (name == "main" or not content or by == around_all) and _class_zone(s, "") not in BOILERPLATE:
            # A class such as "right-sidebar" was the layout of the page, not a sidebar.
            zone, around_all, by, content = name, by, 0, True
        elif zone == "in:header" and (name in HEADINGS or (name == "p" and not any(_BYLINE.search((x[1] or x[2] or x[3] or "").lower()) for x in _MARK.finditer(s)))):
            zone = "article"
        if name == "p" and stack[-1][2]:  # a paragraph ends where the next begins
            cut(stack[-1][2])
        if name not in VOID and s[-2] != "/":
            places.setdefault(name, []).append(len(stack))
            stack.append((name, zone, len(stack) if name == "p" else stack[-1][2] if name in INLINE else 0, by))
        out.append(("open", name, zone))
    return out


def _feature(kind: str, s: str, zone: str, marked: bool) -> str | None:
    """What a token is weighed by; None: it has no vote.  Text outside all zones differs where a page marks its content."""
    if kind == "text":
        if zone[:3] == "in:":
            return None
        return f"zone:{zone}" if zone != "body" else "zone:body beside content" if marked else "zone:body"
    return f"tag:{s}"


def _marked(toks: list[tuple[str, str, str]]) -> bool:
    return any(zone in ("article", "main") for _, _, zone in toks)


def train(labelled: Iterable[list[tuple[str, str]]]) -> dict[str, float]:
    """Weights from pages given as (label, html) stretches: log odds of a zone's words, log shares of tags ("tag:" for unknown ones)."""
    seen: dict[str, Counter] = {"+": Counter(), "-": Counter()}
    for page in labelled:
        parts = [(label, tokens(part)) for label, part in page]
        marked = any(_marked(toks) for _, toks in parts)
        for label, toks in parts:
            for kind, s, zone in toks:
                feature = _feature(kind, s, zone, marked)
                if feature and kind != "close":
                    seen[label][feature] += len(s.split()) if kind == "text" else 1
    weights: dict[str, float] = {}
    for group in ("zone:", "tag:"):
        total = {x: sum(v for k, v in seen[x].items() if k.startswith(group)) + 1 for x in "+-"}
        for key in sorted({k for x in "+-" for k in seen[x] if k.startswith(group)} | {group}):
            share = {x: (seen[x][key] + 0.5) / total[x] for x in "+-"}
            weights[key] = math.log(share["+"] / share["-"]) if group == "zone:" else math.log(share["+"] / (share["+"] + share["-"]))
    return weights


def own_labels(page: str) -> list[tuple[str, str]]:
    """A page that marks its article or main element is a labelled page."""
    m = re.search(r"<(article|main)\b.*?</\1\s*>", page, re.S | re.I)
    return [("-", page[: m.start()]), ("+", m[0]), ("-", page[m.end() :])] if m else []


def worth(toks: list[tuple[str, str, str]], weights: dict[str, float]) -> list[float]:
    """The score of each token of a page."""
    marked = _marked(toks)
    out = []
    for kind, s, zone in toks:
        feature = _feature(kind, s, zone, marked)
        if feature is None:
            out.append(0.0)
        elif kind == "text":
            out.append(weights.get(feature, 0.0) * len(s.split()))
        else:
            out.append(weights.get(feature, weights.get("tag:", -0.7)))
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """(begin, end) of the contiguous stretch with the highest sum, in one pass; (0, 0) if no sum is above 0."""
    best, begin, end = 0.0, 0, 0
    run, start = 0.0, 0
    for i, x in enumerate(scores):
        run += x
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, begin, end = run, start, i + 1
    return begin, end


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    toks = page_tokens(page)
    begin, end = best_stretch(worth(toks, weights))
    blocks: list[str] = []
    block: list[str] = []

    def close() -> None:
        s = " ".join(entities.unescape("".join(block)).split())
        if s:
            blocks.append(s)
        block.clear()

    for kind, s, zone in toks[begin:end]:
        if kind == "text":
            if not boilerplate(zone):
                block.append(s)
        elif s == "br":
            block.append(" ")
        elif s not in INLINE:
            close()
    close()
    return "\n\n".join(blocks)


def labelled_sample(pages: DataFrame, html: str = "html", most: int = 256) -> list[str]:
    """At most `most` pages for training, those with the smallest hashes."""
    p = pages.select(F.col(f"`{html}`").alias("h")).where("h is not null")
    return [r[0] for r in hash_sample(p, pages.count(), most, "h").collect()]  # counting rows reads no html


def extract_text(pages: DataFrame, html: str = "html", *, weights: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """Replace `html` by `text`, its main text; weights by default from hand-labelled pages and at most 256 of these pages."""
    bounded_batches(pages.sparkSession)
    if weights is None:
        weights = train([*LABELLED, *filter(None, map(own_labels, labelled_sample(pages, html)))])
    keep = [f for f in pages.schema.fields if f.name != html and f.name.lower() != text.lower()]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])

    def run(batches):
        for b in small_batches(batches):
            got = [extract(x, weights) for x in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(got, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)
