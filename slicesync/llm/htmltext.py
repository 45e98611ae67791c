"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing and a threshold.

A page is fed to the standard library's parser in pieces; its events make lines, one for
each block, with the line's text, its tags, its links' text and the container it stands
in. Page furniture that says what it is by element or role (navigation, forms, ...) gives
no lines, nor does what a page hides. Containers that go by a name of furniture (class or id)
are left out, unless they hold most of the page's content: then the text-to-tag ratios
overrule the name. An article in furniture is none, but for one among readers' comments, or
one that goes by a comment's name itself. Each line's ratio of text to tags is smoothed with
a Gaussian over its neighbours; the smoothed ratios fall into two clusters, and the lines of
the upper one are content. The region is the innermost container that holds most of the
content's text: an article is taken whole, short paragraphs included, and goes before the
``main`` around it; of any other container the lines from the first to the last content line
are taken, without lines that are mostly links.

Null or empty HTML gives empty text, as does a page without text. Rows with the same id
are extracted each for itself. No rows give no rows. Pages are independent of each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicesync.llm.batches import slices

FED = 1 << 16
SIGMA = 1.0
APART = 4.0
#: A container is the region if it holds at least this share of the content's text.
SHARE = 0.75

# Elements by their part in a page, and names that furniture goes by.
HIDDEN = frozenset("script style noscript template title iframe object svg canvas select button".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
CONTAINERS = frozenset("body section div table ul ol dl td blockquote".split()) | ARTICLE
BLOCKS = CONTAINERS | FURNITURE | frozenset(
    "address br caption dd details dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hr html legend li p "
    "pre summary tbody tfoot th thead title tr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a start tag ends if it was left open, unless one of the second kind was opened since.
_CELL = ("table", "template", "object")
_LIST = tuple("article aside blockquote button dd dialog dl fieldset figure footer form header main menu nav "
              "object ol section table td template th ul".split())
_ROWS = [(("tbody", "tfoot", "thead"), _CELL), (("tr",), _CELL), (("td", "th"), _CELL)]
ENDS = {tag: [(("p",), ("button", "caption", "object", "table", "td", "template", "th"))]
        for tag in BLOCKS - set("body br caption head html legend tbody td tfoot th thead title tr".split())}
ENDS["li"] = [(("li",), _LIST), *ENDS["li"]]
ENDS["dd"] = ENDS["dt"] = [(("dd", "dt"), tuple(t for t in _LIST if t != "dd")), *ENDS["dd"]]
ENDS |= {tag: _ROWS for tag in ("tbody", "tfoot", "thead")} | {"tr": _ROWS[1:]} | {tag: _ROWS[2:] for tag in ("td", "th")}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter "
    "notice pagination popup promo promoted related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget".split())
#: What readers write below a page, in the languages of the tables.
COMMENTS = frozenset(
    "comment comments commentaire commentaires comentario comentarios disqus kommentar kommentare reactions replies "
    "reply respond responses reviews".split())
NAMES |= COMMENTS
#: Two words that make a name only together.
PAIRED = frozenset({("author", "bio"), ("author", "box"), ("author", "card"), ("author", "profile")})
#: Words after which a class tells a state: has-sidebar, no-comments.
MODIFIERS = frozenset("has no not with without".split())
ADVERTS = frozenset("ad ads advert adverts advertisement".split())
WHOLE = ARTICLE | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
JUDGED = CONTAINERS - WHOLE | frozenset(
    "address center dd details dt fieldset figure li tbody tfoot th thead tr".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
_WORD = re.compile(r"[A-Za-z][a-z]*")


_UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)")


def _is_furniture(attributes: list[tuple[str, str | None]]) -> bool:
    return any((name == "role" and value in ROLES) or name == "hidden" for name, value in attributes)


def _is_unseen(attributes: list[tuple[str, str | None]]) -> bool:
    return any((name == "aria-hidden" and (value or "").lower() == "true") or (
        name == "style" and value and _UNSEEN.search(value)) for name, value in attributes)


def _named(tag: str, attributes: list[tuple[str, str | None]]) -> str:
    """The word that furniture goes by in a container's class or id, '' if none. A section's id, as
    it is often made from its heading, and an article's class count if they are a comment's; of
    other elements only a class that is the word for an advert counts."""
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return ""
    for name, value in attributes:
        if name in ("class", "id") and value:
            for part in value.split():
                words = [w.lower() for w in _WORD.findall(part)]
                if tag == "article":
                    if name == "class" and words and words[0] in COMMENTS:
                        return words[0]
                    continue
                if tag not in JUDGED:
                    if name == "class" and part.lower() in ADVERTS:
                        return part.lower()
                    continue
                for word, after in zip(words, [*words[1:], ""]):
                    if word in MODIFIERS:
                        break  # what follows says what the element has, not what it is
                    if (word, after) in PAIRED and not (tag == "section" and name == "id"):
                        return f"{word}-{after}"
                    if word in (COMMENTS if tag == "section" and name == "id" else NAMES):
                        return word
    return ""


class _Lines(HTMLParser):
    """Lines of a page. A container is its number; ``parents`` has the one around it and
    ``named`` the name of furniture that it goes by, if any.

    ``open`` has the elements that are not closed yet, also while one is dropped, so that
    an element left open ends with its ancestor.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, link characters, container
        self.parents, self.kinds, self.named = [-1], [""], [""]
        self.before: dict[int, tuple[int, bool]] = {}  # tags and link outside a named element
        self.open: list[tuple[str, int]] = [("", 0)]  # tag and the container that text in it stands in
        self.places: dict[str, list[int]] = {}  # where in ``open`` a tag stands
        self.blocks: list[int] = []  # where in ``open`` any block stands
        self.dropped = 0  # where in ``open`` the element without lines stands, 0 if none
        self.text, self.tags, self.linked, self.in_link = [], 0, 0, False

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1]))
            self.tags = 0
        self.text, self.linked = [], 0

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, place: int) -> None:
        """Ends the element at a place in ``open`` and all that was opened in it."""
        for at in range(len(self.open) - 1, place - 1, -1):
            self.places[self.open[at][0]].pop()
            if at in self.before:
                self._end_line()
                self.tags, self.in_link = self.before.pop(at)
        del self.open[place:]
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        if self.dropped >= place:
            self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and not self.dropped:
            self._end_line()
        for ended, within in ENDS.get(tag, ()):
            place = self._last(ended)
            if place and place > self._last(within):
                self._close(place)
        if tag == "body" or (tag in ARTICLE and self.dropped and self.open[self.dropped][0] not in HIDDEN):
            self.dropped = 0  # what was dropped before it was left open
        if not self.dropped:
            self.tags += 1
            if tag == "a":
                self.in_link = True
        if tag in VOID or tag == "html":
            return
        container = self.open[-1][1]
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS or tag in HIDDEN:
            self.blocks.append(len(self.open))
        if self.dropped:
            self.open.append((tag, container))
            return
        if tag in HIDDEN or tag in FURNITURE or (tag not in WHOLE and _is_furniture(attrs)) or (
                tag not in ("html", "body") and _is_unseen(attrs)):
            self._end_line()
            self.dropped = len(self.open)
        elif (named := _named(tag, attrs)) or tag in CONTAINERS:
            if named:
                self._end_line()
                self.before[len(self.open)] = self.tags, self.in_link
            self.parents.append(container)
            self.kinds.append(tag)
            self.named.append(named)
            container = len(self.kinds) - 1
        self.open.append((tag, container))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = self._last((tag,))
        if self.blocks and place < self.blocks[-1] and tag not in BLOCKS and tag not in HIDDEN:
            place = 0  # the end of an inline element ends no block
        inside = self.dropped
        if not inside and tag in BLOCKS:
            self._end_line()
        if place:
            self._close(place)
        if not inside or 0 < place < inside:
            self.tags += 1
            if tag == "a":
                self.in_link = False

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian average of each value with its neighbours; the weights sum to one."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The cut between two clusters of the logarithms of the values (two means); below all
    of them if the clusters' means are not ``APART`` times each other, as there is but one."""
    logs = [math.log1p(v) for v in values]
    low, high = min(logs), max(logs)
    for _ in range(32):
        cut = (low + high) / 2
        below, above = [v for v in logs if v < cut], [v for v in logs if v >= cut]
        if not below or not above:
            break
        means = sum(below) / len(below), sum(above) / len(above)
        if means == (low, high):
            break
        low, high = means
    return math.expm1((low + high) / 2) if high - low > math.log(APART) else 0.0


def _content(lines: list[tuple[str, int, int, int]]) -> tuple[list[bool], list[bool]]:
    """Which lines are content, and which have a high ratio though they may be mostly links."""
    ratios = smoothed([len(t) / max(1, n) for t, n, _, _ in lines])
    cut = threshold(ratios)
    high = [r >= cut for r in ratios]
    return [h and k * 2 <= len(t) for h, (t, _, k, _) in zip(high, lines)], high


def _mass(parser: _Lines, lines: list[tuple[str, int, int, int]], content: list[bool]) -> list[int]:
    """Characters of content in each container. A container has a higher number than the one around it."""
    mass = [0] * len(parser.kinds)
    for (text, _, _, container), good in zip(lines, content):
        mass[container] += len(text) if good else 0
    for c in range(len(mass) - 1, 0, -1):
        mass[parser.parents[c]] += mass[c]
    return mass


def _overruled(parser: _Lines) -> set[int]:
    """Named containers that hold most of the page's content, unless an article apart from
    them holds some: the page then says itself where its content is."""
    if not any(parser.named) or not parser.lines:
        return set()
    mass = _mass(parser, parser.lines, _content(parser.lines)[0])
    most = {c for c, named in enumerate(parser.named) if named and mass[c] * 2 > mass[0]}
    last = list(range(len(mass)))  # the last container within each
    for c in range(len(mass) - 1, 0, -1):
        last[parser.parents[c]] = max(last[parser.parents[c]], last[c])
    hidden = _furniture(parser, most)
    articles = [a for a, kind in enumerate(parser.kinds) if kind in ARTICLE and mass[a] and not hidden[a]]
    return {c for c in most if all(c < a <= last[c] or a < c <= last[a] for a in articles)}


def _furniture(parser: _Lines, overruled: set[int]) -> list[bool]:
    """Of each container, whether its lines are left out; an article in furniture is none, unless
    that is for comments."""
    out, among = [False], [False]
    for c in range(1, len(parser.kinds)):
        around, own = parser.parents[c], parser.named[c] if c not in overruled else ""
        among.append(among[around] or own in COMMENTS)
        out.append(bool(own) or (out[around] and (among[c] or parser.kinds[c] not in ARTICLE)))
    return out


def _article_within(parser: _Lines, region: int, mass: list[int], hidden: list[bool]) -> int:
    """The first article within ``main`` that holds most of the content, else ``main`` itself."""
    inside = {region}
    for c in range(region + 1, len(mass)):
        if parser.parents[c] in inside:
            inside.add(c)
            if parser.kinds[c] == "article" and not hidden[c] and mass[c] >= max(1, SHARE * mass[0]):
                return c
    return region


def main_text(html: str) -> str:
    """The text of the content region, blocks joined by one space."""
    parser = _Lines()
    for first in range(0, len(html), FED):
        parser.feed(html[first : first + FED])
    parser.close()
    overruled = _overruled(parser)
    hidden = _furniture(parser, overruled)
    lines = [line for line in parser.lines if not hidden[line[3]]]
    if not lines:
        return ""
    content, high = _content(lines)
    if not any(content):
        content = high
    mass = _mass(parser, lines, content)
    inner: list[list[int]] = [[] for _ in mass]
    for c in range(1, len(mass)):
        inner[parser.parents[c]].append(c)
    region = 0
    while parser.kinds[region] not in ARTICLE:
        best = max(inner[region], key=mass.__getitem__, default=0)
        # An element whose name was overruled is not the region while content stands beside it.
        if not best or mass[best] < (1 if best in overruled else SHARE) * mass[0]:
            break
        region = best
    if parser.kinds[region] == "main":
        region = _article_within(parser, region, mass, hidden)
    within = [c == region for c in range(len(mass))]
    for c in range(region + 1, len(mass)):
        within[c] = within[parser.parents[c]]
    inside = [at for at, line in enumerate(lines) if within[line[3]]]
    if parser.kinds[region] not in ARTICLE:
        kept = [at for at in inside if content[at]]
        inside = [at for at in inside if kept[0] <= at <= kept[-1] and (
            content[at] or lines[at][2] * 2 <= len(lines[at][0]))]
    return " ".join(lines[at][0] for at in inside)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row; ``n_chars`` counts code points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(h or "") for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"))
    kind = dict(chosen.dtypes)["page_id"]
    return chosen.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
