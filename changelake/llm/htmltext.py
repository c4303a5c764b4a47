"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by the elements around them, positive as a rule and negative inside
elements that hold no content; tags score negative. One linear scan finds the contiguous region of largest total. All weights are
counted on the labelled pages below. An element that marks content, and an article or main, around most words of that region widen it to
their edges; nothing the scan found is cut.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from changelake.llm.common import arrow_map, narrowed
from changelake.llm.texthash import slices

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object select".split())
#: Elements that may stand in a head; any other tag, and text, ends one that is not closed.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay in the line; all others, and br and hr, part blocks.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: A new one of these ends an open one of the second, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A class that starts with one of these tells a state of the page, such as no-sidebar or has-menu, not what the element is.
_STATE = frozenset("no not non has have with without is hide hidden show enable enabled disable disabled".split())

#: Labelled pages: what stands between the two comments is content, all other text is not.
LABELLED = (
    """<body class="home"><header id="masthead" class="header banner"><div class="logo branding">Example Daily</div><nav class="menu navbar navigation"><ul>
    <li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport and games</a></li></ul></nav></header><div class="breadcrumb breadcrumbs"><a>Home</a>
    <a>World</a></div><main id="content"><article class="post story"><!--main--><h1 class="title headline">A long day at the river</h1><p class="lead intro">The water rose in the night
    and nobody in the village slept until the morning came.</p><p>People carried what they could to the church on the hill, and <a href="#">neighbours</a> helped.</p>
    <p>By noon the rain had stopped and the first boats arrived from the town.</p><!--/main--></article></main><aside class="sidebar widget"><div class="widget related">Read
    more stories like this one</div><div class="ad ads advert advertisement sponsor sponsored promo promoted">Buy new boots now, half price this week</div></aside><section id="comments"
    class="comment comments discussion replies respond disqus"><h2>Comments</h2><div class="comment">I was there and it was quite wet, thank you</div><div class="reply">So was
    I, all day long</div></section><footer class="footer copyright colophon">Copyright Example Daily, all rights reserved, imprint and terms</footer></body>""",
    """<body><div class="cookie cookies consent gdpr notice notification alert banner">We use cookies to make this site better, please accept them</div><div class="topbar toolbar menu">
    Menu Search Login</div><div id="main" class="container wrapper"><div class="entry-content post-body article-body content text story-body"><!--main--><p>To bake bread you need flour,
    water, salt and time.</p><p>Mix everything in a bowl and let it rest for one hour under a cloth.</p><ul><li>500 grams of flour</li><li>a spoon of salt</li></ul>
    <p>Then put it into the hot oven and wait until it is brown.</p><!--/main--></div><div class="share sharing social socials follow">Share on all your networks</div><form
    class="newsletter subscribe subscription signup"><label>Your mail</label><button>Subscribe to our letter</button></form><div class="recommended recommendations popular trending
    outbrain teaser">Ten cakes you should try, and five you should not</div></div><footer>Contact and privacy</footer></body>""",
    """<body><nav><a>One</a> <a>Two</a> <a>Three</a></nav><div class="popup modal overlay lightbox dialog">Join now and save money</div><section class="page article"><!--main--><h2>How the
    engine works</h2><p>Fuel and air are mixed, pressed and lit, and the gas pushes the piston down.</p><blockquote>An engine is a fire in a cage.</blockquote><table><tr><td>Strokes</td>
    <td>four in most cars</td></tr></table><p>The crank turns the motion of the piston into a circle.</p><!--/main--></section><aside>See also other machines</aside><div
    class="pagination pager paging">Previous page, next page</div><div class="disclaimer legal warning">This is no advice of any kind</div><div class="login signin account">Sign in to
    your account</div><div class="search searchbox">Search this site</div></body>""",
    """<body><div role="navigation">Skip to content, menu, home, shop</div><div role="banner">The Shop of Tools</div><div role="main"><!--main--><p>A hammer has a head and a handle, and both
    have to fit the hand that uses them.</p><p>Choose a heavy head for wood and a light one for thin nails, and keep the handle dry.</p><!--/main--></div><div role="complementary">Other
    tools people bought here</div><div role="search">Find a tool</div><div role="form">Write to us about tools</div><div role="contentinfo">About us, returns, imprint</div><menu>Cut Copy
    Paste</menu><dialog>Are you sure about it</dialog><form>Name and mail and a long message</form><button>Send it now</button></body>""",
)


@dataclass
class Element:
    tag: str
    names: tuple[str, ...]
    begin: int
    stop: int = -1
    parent: Element | None = None
    bad: float = 0.0
    words: int = field(default=0, repr=False)


def _names(attributes: str) -> tuple[str, ...]:
    """Parts of the class, id and role of a tag, in lower case."""
    if not attributes or "=" not in attributes:
        return ()
    names = [
        [part.lower() for part in _NAME_PART.findall(word)]
        for _, *values in _ATTRIBUTE.findall(attributes) for word in next((v for v in values if v), "").split()
    ]
    return tuple(part for parts in names if len(parts) < 2 or parts[0] not in _STATE for part in parts)


def read(page: str) -> tuple[list, list[Element]]:
    """The page as a list of items and its elements.

    Items: ("word piece", text, element), ("tag", name, element), ("break", "", element) and ("comment", text, element).
    Raw elements, the head, options, declarations and a tag cut off by the end give nothing. A script or style that is not closed takes
    the rest of the page; other raw elements that are not closed are read like any tag, a title up to the next one. A head ends at the first
    tag or text that cannot stand in it, an option at the first tag that is not in the line.
    """
    items: list[tuple[str, str, Element]] = []
    top = Element("", (), 0)
    elements, stack = [top], [top]
    open_tags: Counter[str] = Counter()
    at, size = 0, len(page)
    in_head = False
    unclosed: set[str] = set()  # raw elements without another end tag

    def close(to: int) -> None:
        while len(stack) > to:
            e = stack.pop()
            e.stop = len(items)
            open_tags[e.tag] -= 1

    def nearest(tag: str) -> int:
        """Place of the innermost open element of this name, 0 if there is none."""
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if open_tags[tag] > 0 else 0

    while at < size:
        m = _PART.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            text = m.group()
            if text.startswith("<!--"):
                items.append(("comment", text, stack[-1]))
            elif not text.startswith(("<!", "<?")):
                if in_head and not text.strip():
                    continue
                in_head = False
                items.append(("text", html.unescape(text), stack[-1]))
            continue
        if not m.group(4):
            break  # cut off by the end of the page
        name = name.lower()
        if in_head:
            in_head = not m.group(1) and name in HEAD or bool(m.group(1)) and name in HEAD - {"html", "head"}
            if name in HEAD - RAW or m.group(1) and in_head:
                continue
        elif name == "head":
            in_head = not m.group(1)
            continue
        if name not in INLINE:
            items.append(("break", "", stack[-1]))
        if m.group(1):
            place = nearest(name)
            if place:
                items.append(("tag", name, stack[-1]))
                close(place)
            continue
        if name in RAW:
            if m.group(3).endswith("/") and name not in ("script", "style", "title", "textarea"):
                continue
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is not None or name in ("script", "style"):
                at = end.end() if end else size
                continue
            unclosed.add(name)
            if name == "title":
                at = size if (tag := page.find("<", at)) < 0 else tag
                continue
        if name == "option":
            while at < size and (part := _PART.match(page, at)):
                inner, ends = (part.group(2) or "").lower(), bool(part.group(1))
                if inner and inner not in INLINE and not (ends and inner == "option"):
                    break
                at = part.end()
                if inner == "option":
                    break
            continue
        if name in CLOSES_P:
            place = nearest("p")
            if place and not any(e.tag in ("table", "button", "object") for e in stack[place + 1 :]):
                close(place)
        if name in IMPLIED:
            ended, within = IMPLIED[name]
            for i in () if not any(open_tags[x] > 0 for x in ended) else range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ended:
                    close(i)
                    break
        element = Element(name, _names(m.group(3)), len(items), parent=stack[-1])
        items.append(("tag", name, element))
        elements.append(element)
        if name in VOID or m.group(3).endswith("/") and name not in CLOSES_P | INLINE:
            element.stop = len(items)
        else:
            stack.append(element)
            open_tags[name] += 1
    close(0)
    return items, elements


@dataclass(frozen=True)
class Weights:
    """word: score of a word; tag: score of each tag, negative; feature: log odds of content of words inside <tag> and .name"""

    word: float
    tag: dict[str, float]
    other_tag: float
    feature: dict[str, float]


def learn(pages: tuple[str, ...]) -> Weights:
    """Count weights on labelled pages, with half a count added to everything."""
    inside, outside = Counter(), Counter()
    tags_in, tags_out = Counter(), Counter()
    words_in = words_out = 0
    for page in pages:
        main = False
        for kind, text, element in read(page)[0]:
            if kind == "comment":
                main = "/main" not in text if "main" in text else main
            elif kind == "tag":
                (tags_in if main else tags_out)[text] += 1
            elif kind == "text":
                n = len(text.split())
                words_in, words_out = words_in + n * main, words_out + n * (not main)
                e: Element | None = element
                seen = set()
                while e is not None:
                    seen |= {f"<{e.tag}>", *(f".{x}" for x in e.names)}
                    e = e.parent
                for f in seen:
                    (inside if main else outside)[f] += n
    rate = words_out / max(1, words_in)
    feature = {f: math.log((inside[f] * rate + 0.5) / (outside[f] + 0.5)) for f in inside | outside}
    density = lambda n, words: (n + 0.5) / (words + 1.0)
    tag = {t: -max(0.1, math.log(1 + density(tags_out[t], words_out) / density(tags_in[t], words_in))) for t in tags_in | tags_out}
    return Weights(1.0, tag, -0.5, feature)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return learn(LABELLED)


#: Log odds below which an element holds no content, and above which it is a frame of content.
_BAD, _GOOD = -1.0, 0.5
#: These wrap whole pages: what their names say holds for the page, not for a part of it.
_WHOLE = frozenset(("", "html", "body"))


def _judge(items: list, elements: list[Element], w: Weights) -> None:
    """Set `bad` of every element: the score of a word in it if that is negative, else 0; it holds for all inside.

    What is bad by itself still counts as good if it holds the core: the article or main of most words, or else the element of most
    words that a name marks as content. Where there is no core, or one without a tenth of the page's words that is no article or main, this
    goes for a form, and for what is bad by name only, that holds most of the page's words.
    """
    before = [0]
    for kind, text, _ in items:
        before.append(before[-1] + (len(text.split()) if kind == "text" else 0))
    tags, names = [], []
    for e in elements:
        e.words = before[e.stop] - before[e.begin]
        tag = w.feature.get(f"<{e.tag}>", 0.0) if e.tag not in _WHOLE | {"div", "section", "ul", "li", "a", "p", "label", "h2"} else 0.0
        named = min([w.feature[f".{x}"] for x in e.names if f".{x}" in w.feature], default=0.0) if e.tag not in _WHOLE | {"article", "main"} else 0.0
        tags.append(tag if tag < _BAD else 0.0)
        names.append(named if named < _BAD else 0.0)
    marked = [e for e, tag, name in zip(elements, tags, names) if e.words and not tag and not name and _marks(e, w)]
    core = max(marked, key=lambda e: (e.tag in ("article", "main"), e.words), default=None)
    sure = core is not None and (core.tag in ("article", "main") or 10 * core.words >= before[-1])
    for e, tag, name in zip(elements, tags, names):
        holds = core is not None and e.begin <= core.begin and core.stop <= e.stop
        most = not sure and 2 * e.words > before[-1] and (tag == 0.0 or e.tag == "form")
        e.bad = 0.0 if holds and (sure or tag == 0.0) or most else min(tag, name)
        e.bad = min(e.bad, e.parent.bad if e.parent else 0.0)


def main_text(page: str, w: Weights | None = None) -> str:
    """Main text of a page: blocks in page order, white space inside and between them as one space."""
    w = w or default_weights()
    items, elements = read(page)
    _judge(items, elements, w)
    best = total = 0.0
    begin = first = last = 0
    for i, (kind, text, element) in enumerate(items):
        if kind == "text":
            total += len(text.split()) * (w.word if element.bad == 0.0 else element.bad)
        elif kind == "tag":
            total += w.tag.get(text, w.other_tag)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, first, last = total, begin, i + 1
    for frame in _frames(items, elements, first, last, w):
        first, last = min(first, frame.begin), max(last, frame.stop)
    out = ["" if element.bad < 0 or kind in ("tag", "comment") else " " if kind == "break" else text for kind, text, element in items[first:last]]
    return " ".join("".join(out).split())


def _frames(items: list, elements: list[Element], first: int, last: int, w: Weights) -> list[Element]:
    """The smallest element that marks content, and the smallest article or main, that hold most of the region's words; they only widen it."""
    before = [0]  # words of the region before each item
    for i, (kind, text, e) in enumerate(items):
        before.append(before[-1] + (len(text.split()) if kind == "text" and e.bad == 0.0 and first <= i < last else 0))
    marked = outer = None
    for e in elements:
        if e.bad == 0.0 and _marks(e, w) and 2 * (before[e.stop] - before[e.begin]) > before[-1]:
            if marked is None or e.stop - e.begin <= marked.stop - marked.begin:
                marked = e
            if e.tag in ("article", "main") and (outer is None or e.stop - e.begin <= outer.stop - outer.begin):
                outer = e
    return [e for e in (marked, outer) if e is not None]


def _marks(e: Element, w: Weights) -> bool:
    """Whether an element says that it holds content."""
    return e.tag in ("article", "main") or e.tag not in INLINE | {"h1", "p"} | _WHOLE and any(w.feature.get(f".{x}", 0.0) > _GOOD for x in e.names)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    One row per input row. A null or empty page, and one without content, gives an empty text. Repeated rows, null ids and urls come
    back as they are; extra columns are ignored. Pages are read whole; time grows with the length of a page.
    """
    weights = default_weights()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                texts = [main_text(page, weights) if page else "" for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    narrow = narrowed(pages, page_id=id_col, url=url_col, html=html_col).selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html")
    return arrow_map(narrow, each, "page_id bigint, url string, text string, n_chars bigint")
