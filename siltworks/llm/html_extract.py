"""Main text of web pages: two passes over text blocks.

Pass one classifies each block by its stop-word density, its length and its link density: *good*, *bad*, or, where these do
not decide, *near* (some text, little to tell it by) or *short* (too little text to tell). Pass two lets each undecided block
inherit the label of its nearest decided neighbours. Place moves the limits of pass one and never decides alone: blocks in
elements that the markup names as the article are judged more kindly, those in navigation, footers, forms, adverts, comments and
the like need more text with more stop words. Which part of a page is the main one follows from the text that
pass one finds in each part, weighed by its place: where a part that is named as a sidebar holds the page's prose,
the name is wrong, and where elements named as the article hold little of it, they are teasers. A page whose words are in
none of the stop lists is judged by length and link density.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.llm.scale import bound_batches

#: Frequent function words of some languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it was for on are as with his they at be this from have or by one had not but
    what all were when we there can an your which their said if do will each about how up out them then she
    der die das und in zu den mit von ist des sich auf für als dem ein eine im nicht auch es an werden aus er
    hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur
    de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son sa
    ou mais comme on nous leur elle cette ces aux
    el los las y del se con una su para es al lo como más o pero sus le ya este sí porque esta entre cuando muy
    sin sobre ser tiene también me hasta hay donde quien desde todo nos durante
    di che il e per non si un una sono da del con ma della o é não mais um na no os uma dos
    """.split()
)

#: What elements do to the text around and inside them.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a page that hold no main text.
OUTSIDE = frozenset("nav footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names that name such parts, those of what readers write, and parts that tell nothing.
BAD_PART = re.compile(
    r"(?:ad|ads|adv|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert|popup|modal|"
    r"overlay|newsletter|subscri\w+|signup|login|sidebar\w*|sidebar|rail|widget\w*|related|recommend\w*|trending|popular|menu\w*|nav|navbar|"
    r"navigation|topnav|breadcrumb\w*|pagination|pager|toolbar|header|masthead|footer|copyright|legal|disclaimer|"
    r"share(?!price|holder|market|capital|value)\w*|sharing|social\w*|tags?|tagcloud|hidden|toc|paywall|outbrain|taboola)"
)
READER_PART = re.compile(r"(?:comment\w*|disqus|respon[ds]\w*|repl(?:y|ies)|discussion|feedback)")
PLAIN_PARTS = frozenset(
    """
    site page main top bottom left right inner outer container wrapper wrap box list section area block bar panel item items link links button
    icon post posts article articles entry story stories content text body title head group row col column primary secondary global mobile
    desktop fixed sticky form image user reader slot unit zone wide small large and up only skip sr sign side byline
    """.split()
)
BAD_WHOLE = frozenset("sign-up side-bar skip-link sr-only byline-links".split())
GOOD_NAME = re.compile(
    r"(?:^|[\s_-])(?:article\w*|post|post-body|post-content|entry|entry-content|story\w*|main-content|content-body|"
    r"page-content|body-text|article-body)(?:$|[\s_-])",
    re.I,
)
#: Names of an article's title line or of what is told about it, not of its body.
ABOUT_NAME = re.compile(
    r"(?:^|(?<=[\s_-]))(?:article|post|entry|story)\w*[_-]+(?:title|headline|heading|header|meta\w*|date|time|published|author|"
    r"byline|info|details|summary|excerpt|teaser|preview|card|link|thumb\w*|image)(?=$|[\s_-])",
    re.I,
)
#: Classes that describe a layout ("has-sidebar"), not a part.
STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|is|js)[_-]\S+", re.I)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: How lines about the site, not the article, begin.
SITE_LINE = re.compile(r"(copyright\b|©|\(c\)\s*\d{4}|all rights reserved|powered by\b|share this\b|skip to\b)", re.I)

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)")
TAG_STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[\u2e80-\uffef]")


@dataclass(frozen=True)
class BlockRules:
    """Pass one. Lengths are characters (wide ones count twice), densities shares of words or characters.

    So many neighbouring blocks of links, ``link_run``, are a menu wherever they are. A page with a smaller share of
    stop words than ``no_stop_words`` is in a language that no list fits.
    """

    max_link_density: float = 0.4
    short_chars: int = 70
    long_chars: int = 200
    low_stop_words: float = 0.15
    high_stop_words: float = 0.25
    no_stop_words: float = 0.05
    link_run: int = 3
    #: How a part's place moves the limits of length and of stop words, and what its text weighs against other parts'.
    places: tuple[tuple[str, float, float, float], ...] = (
        ("inside", 1.0, 0.6, 1.0), ("", 1.0, 1.0, 1.0), ("beside", 2.0, 1.2, 1.0), ("named", 1.5, 1.2, 0.5), ("outside", 2.0, 1.4, 0.25),
    )

    def moved(self, place: str) -> tuple[float, float, float]:
        return next((length, stops, weight) for name, length, stops, weight in self.places if name == place)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    place: str = ""
    heading: bool = False

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


def _named(names: str) -> str:
    """``named`` or ``outside`` where a class or id names a part beside the article: all its parts do, or tell nothing.

    "related-posts" is such a name, "related-work" and "tags-of-war" are not.
    """
    found = ""
    for token in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", token) if p and not p.isdigit()]
        reader = [bool(READER_PART.fullmatch(p)) for p in parts]
        bad = [bool(BAD_PART.fullmatch(p)) for p in parts]
        if token in BAD_WHOLE or (any(bad) or any(reader)) and all(x or y or p in PLAIN_PARTS for x, y, p in zip(bad, reader, parts, strict=True)):
            found = "outside" if any(reader) else found or "named"
    return found


def _place(name: str, attrs: str, above: str, depth_in_article: bool) -> str:
    """What an element makes of its text: ``hidden``, ``outside``, ``named`` (beside the article), ``inside`` or what is above."""
    if above == "hidden" or name in HIDDEN:
        return "hidden"
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attrs)} if "=" in attrs else {}
    if HIDDEN_STYLE.search(found.get("style", "")) or found.get("aria-hidden", "").lower() == "true":
        return "hidden"
    if "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attrs)):
        return "hidden"
    if above == "outside":
        return "outside"
    if name in OUTSIDE or found.get("role", "").lower() in ROLES:
        return "outside"
    if name == "header" and not depth_in_article:
        return "outside"
    names = STATE.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")
    if name in ("article", "main"):
        return "outside" if re.search(r"comment", names, re.I) else "named" if above == "named" else "inside"
    if name not in ("body", "html") and names.strip():
        beside = _named(names)
        if beside:
            return beside
        if above != "named" and name not in HEADINGS and GOOD_NAME.search(ABOUT_NAME.sub(" ", names)):
            return "inside"
    return above


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag ends whose name ends at ``at``: behind the next ``>`` that no quoted value holds.

    A quote counts after ``=`` only, and not if nothing closes it: ``lost`` keeps the quotes that are known not to come
    again, so that a page is searched for each once.
    """
    while stop := TAG_STOP.search(page, at):
        if stop[0] == ">":
            return stop.end()
        before = stop.start() - 1
        while before >= at and page[before].isspace():
            before -= 1
        at = stop.end()
        if stop[0] not in lost and before >= 0 and page[before] == "=":
            close = page.find(stop[0], at)
            if close < 0:
                lost.add(stop[0])
            else:
                at = close + 1
    return len(page)


class _Open:
    """The open elements of a page, innermost last. Every question is answered in constant time.

    Elements that end in the middle of the stack stay there as dead entries until those inside them have ended.
    """

    def __init__(self) -> None:
        self.entries: list[list] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, place: str) -> None:
        k = len(self.entries)
        self.entries.append([name, place, True])
        self.at.setdefault(name, []).append(k)
        if name in BLOCKS:
            self.blocks.append(k)

    def place(self) -> str:
        return self.entries[-1][1] if self.entries else ""

    def count(self, name: str) -> int:
        return len(self.at.get(name, ()))

    def in_heading(self) -> bool:
        return any(alive and name in HEADINGS for name, _, alive in self.entries[-4:])

    def _end_one(self, k: int) -> None:
        name = self.entries[k][0]
        self.entries[k][2] = False
        places = self.at[name]
        # It is the innermost of its name, but for elements that an outer end tag closes from the inside out.
        places.pop() if places[-1] == k else places.remove(k)
        if self.blocks and self.blocks[-1] == k:
            self.blocks.pop()

    def _trim(self) -> None:
        while self.entries and not self.entries[-1][2]:
            self.entries.pop()

    def end(self, name: str) -> None:
        """An end tag: closes the innermost element of the name and what is open in it, unless that crosses a block."""
        places = self.at.get(name)
        if not places:
            return
        deep = places[-1]
        inner_block = self.blocks[-1] if self.blocks else -1
        if name in BLOCKS or inner_block < deep:
            while len(self.entries) > deep:
                if self.entries[-1][2]:
                    self._end_one(len(self.entries) - 1)
                self.entries.pop()
            self._trim()
        elif name == "a":
            self._end_one(deep)

    def imply_end(self, name: str) -> None:
        """A start tag that ends open paragraphs, items or cells. Inline elements in them stay open."""
        ended = ENDS.get(name, {"p"} if name in BLOCKS else frozenset())
        while self.blocks and self.entries[self.blocks[-1]][0] in ended:
            self._end_one(self.blocks[-1])
        self._trim()


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order. Unclosed and stray tags are tolerated, as browsers do."""
    out: list[Block] = []
    now = Block()
    opened = _Open()

    def close_block() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block()

    def add(raw: str) -> None:
        place = opened.place()
        if place == "hidden" or not raw:
            return
        if now.parts and now.place != place:
            close_block()
        text = html.unescape(raw)
        now.place = place
        now.heading = now.heading or opened.in_heading()
        now.parts.append(text)
        if opened.count("a"):
            now.link_chars += len(SPACE.sub("", text))

    at, size = 0, len(page)
    raw_ends: dict[str, int] = {}
    lost: set[str] = set()
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        if mark := COMMENT.match(page, start):
            at = mark.end()
            if mark["cdata"] is not None:
                add(mark["cdata"].replace("&", "&amp;"))
            continue
        token = TAG.match(page, start)
        if not token:
            add("<")
            at = start + 1
            continue
        name = token["name"].lower()
        at = _tag_end(page, token.end(), lost)
        if name in BLOCKS:
            close_block()
        elif name in ("br", "wbr"):
            now.parts.append(" " if name == "br" else "")
            continue
        if token["close"]:
            opened.end(name)
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if raw_ends.get(name) != size else None
            at = end.end() if end else size
            raw_ends[name] = at
            continue
        attrs = page[token.end() : at].removesuffix(">")
        if attrs.rstrip().endswith("/") and name not in BLOCKS:
            continue
        opened.imply_end(name)
        in_article = opened.count("article") + opened.count("main") > 0
        opened.push(name, _place(name, attrs, opened.place(), in_article))
    close_block()
    return out


#: A start tag of the key ends an open element of the value that no other block has been opened in.
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}


@dataclass(frozen=True)
class _Told:
    """What pass one looks at: a block's length, its link density, its share of stop words, and its place."""

    chars: int
    links: float
    stops: float
    place: str
    heading: bool
    site_line: bool


def _tell(found: list[tuple[Block, str]], rules: BlockRules) -> list[_Told]:
    """The signals of each block. Where no stop list fits the page, every block has as many as it takes."""
    words = [WORD.findall(text.lower()) for _, text in found]
    stops = [sum(w in STOP_WORDS for w in some) for some in words]
    fits = sum(stops) >= rules.no_stop_words * sum(map(len, words))
    out = []
    for (block, text), some, n in zip(found, words, stops, strict=True):
        chars = len(text) if text.isascii() else 2 * len(text) - len(WIDE.sub("", text))
        links = block.link_chars / max(1, len(text) - text.count(" ")) if block.link_chars else 0.0
        share = n / max(1, len(some)) if fits else 1.0
        out.append(_Told(chars, links, share, block.place, block.heading, chars < rules.short_chars and bool(SITE_LINE.match(text))))
    return out


def _first_pass(told: list[_Told], rules: BlockRules, article: bool | None) -> list[str]:
    """A label for each block; ``article`` tells whether marked elements are the article, teasers, or (None) plain blocks."""
    out = []
    for t in told:
        inside = t.place == "inside" and article is True
        place = t.place
        if not inside and place in ("", "inside"):
            place = "beside" if article is True else ""
        longer, denser, _ = rules.moved(place)
        if t.links > rules.max_link_density:
            out.append("links" if inside else "bad")
        elif t.chars < rules.short_chars * longer:
            teaser = t.place == "inside" and article is False
            out.append("bad" if teaser or (t.site_line and not inside) else "short")
        elif t.stops >= (rules.low_stop_words if inside else rules.high_stop_words) * denser:
            out.append("good" if inside or t.chars > rules.long_chars * longer else "near")
        elif t.stops >= rules.low_stop_words * denser or inside:
            out.append("near")
        else:
            out.append("bad")
    # Links in an article are its own, unless several blocks of nothing else follow each other.
    at = 0
    while at < len(out):
        run = at
        while run < len(out) and out[run] == "links":
            run += 1
        if run > at:
            label = "bad" if run - at >= rules.link_run and all(t.links > 0.99 for t in told[at:run]) else "short"
            out[at:run] = [label] * (run - at)
        at = max(run, at + 1)
    return out


#: Which places share neighbours: a block on the other side of a part's border is no neighbour.
SIDES = {"inside": "inside", "": "", "named": "out", "outside": "out"}


def _second_pass(labels: list[str], told: list[_Told], main: set[str]) -> list[bool]:
    """Undecided blocks take their nearest decided neighbours' label; of two that differ, see below.

    Between a good and a bad one a *near* block is good and a short one goes with the nearer. Headings look ahead: they
    belong to what follows. Where nothing is decided, blocks of a side in ``main`` are good, others are not.
    """
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for found, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[str, int] = {}
        for i in order:
            side = SIDES[told[i].place]
            found[i] = last.get(side)
            if labels[i] in ("good", "bad"):
                last[side] = i
    out = []
    for i, label in enumerate(labels):
        if label in ("good", "bad"):
            out.append(label == "good")
            continue
        b, a = before[i], after[i]
        one, two = labels[b] if b is not None else None, labels[a] if a is not None else None
        if one is None and two is None:
            out.append(SIDES[told[i].place] in main)
        elif one == two:
            out.append(one != "bad")
        elif told[i].heading:
            out.append(two == "good")
        elif label == "near":
            out.append("good" in (one, two))
        elif one is None or two is None:
            out.append((one or two) == "good")
        else:
            out.append((one if i - b <= a - i else two) == "good")
    return out


def _article(told: list[_Told], rules: BlockRules) -> bool | None:
    """Whether elements that the markup names as the article hold most of the text that pass one calls good.

    Without good blocks, of that of near ones, and without these of short ones. Parts named otherwise do not count. None if
    it names no article.
    """
    if not any(t.place == "inside" for t in told):
        return None
    labels = _first_pass(told, rules, None)
    for label in ("good", "near", "short"):
        mine = {side: sum(t.chars for x, t in zip(labels, told, strict=True) if x == label and t.place == side) for side in ("inside", "")}
        if any(mine.values()):
            return mine["inside"] > mine[""]
    return True


#: What a block's characters count for the part it is in, by its label.
EVIDENCE = {"good": 1.0, "near": 0.5, "short": 0.1, "links": 0.1, "bad": 0.0}


def _main_part(told: list[_Told], rules: BlockRules) -> str:
    """The part that holds the page's text: ``article`` (marked or plain blocks), ``named`` or ``outside``.

    Each part's text is weighed by what pass one, with the limits of its place, calls it, and by its place. Of parts beside
    the article only text that is surely good counts: an advert's sentence is not more than a short article.
    """
    labels = _first_pass(told, rules, _article(told, rules))
    sums = {"article": 0.0, "named": 0.0, "outside": 0.0}
    for label, t in zip(labels, told, strict=True):
        part = t.place if t.place in sums else "article"
        if part == "article" or label == "good":
            sums[part] += t.chars * EVIDENCE[label] * rules.moved("" if part == "article" else part)[2]
    return max(sums, key=lambda part: (sums[part], part == "article"))


def judged(told: list[_Told], rules: BlockRules) -> list[bool]:
    """Which blocks are the page's main text: the main part, then both passes.

    If a part named otherwise is the main one, its blocks are judged as plain ones; if not, what pass one calls good in
    it is not the article's.
    """
    part = _main_part(told, rules)
    if part != "article":
        told = [replace(t, place="") if t.place == part else t for t in told]
    article = _article(told, rules)
    labels = _first_pass(told, rules, article)
    labels = ["bad" if t.place in ("named", "outside") and x in ("good", "near") else x for x, t in zip(labels, told, strict=True)]
    main = {"inside"} if article is True else {"", "inside"}
    return _second_pass(labels, told, main)


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The article's blocks in page order, white space collapsed, joined by an empty line; '' without any."""
    found = [(b, b.text()) for b in blocks(page or "")]
    found = [(b, t) for b, t in found if t]
    return "\n\n".join(t for g, (_, t) in zip(judged(_tell(found, rules), rules), found, strict=True) if g)


def extract_text(df: DataFrame, html_col: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """Add ``text`` (the main text of the whole page) and ``n_chars`` (its code points) to the rows of ``df``.

    Null and empty pages have an empty text; rows that repeat come out as often; an empty table gives an empty
    table; columns of ``df`` pass through, ``text`` and ``n_chars`` of the input are replaced. No row leaves
    its task; a page of any length is read whole, in time linear in it.
    """
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in ("text", "n_chars")]
    slim = df.select(F.col(html_col).alias("__html"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py(), rules) for page in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], names=[*names, "text"])

    schema = T.StructType([*[slim.schema[n] for n in names], T.StructField("text", T.StringType())])
    out = slim.mapInArrow(run, schema)
    out = out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def extract_report(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
