"""Main text of web pages by two-pass block rules.

A page is read once and cut into blocks at block-level tags.

Pass one gives each block points for its own words: long blocks of many stop words
gain, blocks of links, of few stop words or with a copyright sign lose, short ones
get none. The page's structure only adds to them: an article element (main where
there is none) or a name like it adds, being outside a marked article, in a
navigation, footer, aside or form, or in an element whose class, id or role names an
advert, a notice, a menu or a sidebar takes away. Only what is hidden or stands among
reader comments is out whatever it says. Blocks with ``SURE`` points are good, with
minus ``SURE`` bad.

Pass two decides the short and doubtful ones in between. Neighbouring ones of one parent
element that together are a long block of many stop words are good. The others take
the label of the nearest decided neighbours. Where these differ the structure decides, then the
neighbour in the same parent element, then the text goes on from the one before
(headings belong to the one after). Doubtful blocks between bad ones stay if they
are of ``ALONE`` characters, and with them short ones beside them in the same parent element.

A heading like "Comments" begins what readers wrote only if it is no first-level heading, text of
the article stands before it, and what follows in the element around it looks like comments: a
number in the heading, or ``BYLINES`` short blocks with a date, a time or who said it. Otherwise it
is a heading like others. A page in which no block is good is read again
without the names of elements, for a name around the whole page says nothing.

An article or main element lifts what the names of elements around it say. Where no
long block reaches the lower stop-word density, the page is in a language that the
list doesn't cover, and length and links decide alone.

Defined cases: null or empty html and pages without a good block give an empty
text; unclosed and stray tags, comments, truncated markup and character references
without a semicolon are read as browsers read them; repeated rows give repeated
results. Reading is linear in a page's length, whatever its markup.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import in_batches

LENGTH_LOW, LENGTH_HIGH, STOP_NONE, STOP_LOW, STOP_HIGH, LINKS_MOST = 70, 200, 0.04, 0.10, 0.18, 0.33
SURE, ALONE = 2, 100

#: Frequent function words of languages the pages may be in.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its just like
    may more most my no not of on one only or other our out over said she so some than that the their them then there these they this to up was we were what
    when which who will with would you your der die das den dem des ein eine einer eines und oder aber nicht ist sind war im in zu auf für mit von bei als auch
    an aus nach wie es er sie wir ich sich noch nur so über um wenn werden wird hat haben durch vor zum zur le la les un une des du de et est sont en dans pour
    par sur pas que qui ne au aux ce cette ces il elle nous vous ils avec plus se son sa ses ou mais comme el los las una unos y o es son del al con para por
    que no se su sus lo como más pero fue ha este esta entre cuando muy sin sobre ser también me hasta hay""".split()
)

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
_RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title select button datalist noembed noframes xmp head map".split())
#: Those of them that browsers read as text: they run to the page's end if nothing ends them.
_RAW_TEXT = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
#: Those that a tag can close itself.
_FOREIGN = frozenset("svg math".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
#: Elements whose names are a page's.
_ROOTS = frozenset("html body".split())
#: Elements whose content is furniture whatever their names, and those that may also wrap a whole page.
_APART, _WRAPPERS = frozenset("nav footer aside menu dialog".split()), frozenset("form header".split())
#: Names of elements that hold what readers wrote, and headings over it.
_COMMENTS = re.compile(r"(?:^|[^a-z])(?:comments?|commentlist|disqus|respond|repl(?:y|ies))(?:$|[^a-z])")
_COMMENTS_HEAD = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|repl(?:y|ies)|responses?|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\)| ?: ?\d*)?", re.I)
#: A short line over a comment: when, or that somebody said something.
_BYLINE = re.compile(
    r"\b\d{4}-\d\d?-\d\d?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}\b|\b\d+ ?(?:min|minutes?|hours?|days?|weeks?|months?|years?) ago\b|\b(?:said|says|wrote|writes|replied|posted)\b[^.]*:?$|"
    r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}(?:, \d{4})?\b|\b\d{1,2}\.? (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|^reply$",
    re.I,
)
BYLINES, BYLINE_MOST = 2, 80
#: Words in class, id or role names that mark page furniture, and those that mark the article.
_BAD_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ad|ads|adv|advert\w*|adslot|adsense|banner|sponsor\w*|promo\w*|comment\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|sidebar\w*|side|aside|rail|widget\w*|related|recommend\w*|share|sharing|social|nav\w*|menu\w*|breadcrumbs?|crumbs|pager|pagination|toc|foot|footer\w*|"
    r"header|masthead|topbar|copyright|legal|tags|search\w*|complementary|contentinfo|toolbar|form)(?:$|[^a-z])"
)
_GOOD_NAMES = re.compile(r"(?:^|[^a-z])(?:article|articlebody|post|entry|story|content|main|hentry|body)(?:$|[^a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
_PLAIN = re.compile(r"[^'\">]*+")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
#: Names that tell a page's state, not what an element is.
_STATES = re.compile(r"(?<![\w-])(?:has|with|without|no|show|hide|is|js)-[\w-]+")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    apart: bool = False
    furniture: bool = False
    #: 2 in an article element, 1 in main or under an article's name.
    article: int = 0
    heading: bool = False
    #: Number of the element around the block's own.
    home: int = 0
    #: Number of the heading of comments that it stands under, if any.
    under: int = 0
    text: str = ""
    good: bool = False


class Place(NamedTuple):
    """What holds inside an element: out of the page's text for sure, furniture, article, heading, its number and its parent's, and the heading of comments above it."""

    apart: bool = False
    furniture: bool = False
    article: int = 0
    heading: bool = False
    number: int = 0
    parent: int = 0
    under: int = 0


def _ends(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


_RAW_ENDS = {name: _ends(name) for name in _RAW_TEXT}
_RAW_TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])([^>]*+)>?", re.I) for name in _RAW - _RAW_TEXT}


def _closed(page: str, name: str) -> dict[int, int]:
    """By the start of each element ``name`` that an end tag of its own closes, the place after that tag."""
    out, stack = {}, []
    for m in _RAW_TAGS[name].finditer(page):
        if m[1]:
            if stack:
                out[stack.pop()] = m.end()
        elif name not in _FOREIGN or not m[2].endswith("/"):
            stack.append(m.start())
    return out


class _Tags:
    """Where a page's tags end. A quoted value may hold anything; a quote that nothing closes is looked for once."""

    def __init__(self, page: str):
        self.page, self.none = page, {"'": len(page), '"': len(page), ">": len(page)}

    def _next(self, sign: str, at: int) -> int:
        if at >= self.none[sign]:
            return -1
        found = self.page.find(sign, at)
        if found < 0:
            self.none[sign] = at
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at ``at``, or the page's end."""
        page = self.page
        while at < len(page):
            at = _PLAIN.match(page, at).end()
            if at >= len(page) or page[at] == ">":
                return at
            value = page[at - 1] == "=" or (page[at - 1].isspace() and page[max(0, at - 20) : at].rstrip()[-1:] == "=")
            stop = self._next(page[at], at + 1) if value else at
            if stop < 0:
                stop = self._next(">", at)
                return stop if stop >= 0 else len(page)
            at = stop + 1
        return at


class _Reader:
    """Reads a page into blocks."""

    def __init__(self, page: str, by_name: bool):
        self.page, self.by_name, self.done, self.numbers = page, by_name, [], 0
        self.stack: list[tuple[str, Place]] = []  # name, and the place around the element
        self.open: Counter = Counter()
        self.place, self.links, self.now = Place(), 0, Block()
        self.heads: list[Block] = []  # that may stand over comments

    def close(self) -> None:
        b, p = self.now, self.place
        if b.parts and (text := " ".join(_html.unescape("".join(b.parts)).split())):
            b.text = text
            self.done.append(b)
            if b.heading and not b.under and _COMMENTS_HEAD.fullmatch(b.text):
                self._perhaps_comments()
        self.now = Block(apart=p.apart, furniture=p.furniture, article=p.article, heading=p.heading, home=p.parent, under=p.under)

    def _perhaps_comments(self) -> None:
        """What follows in the element around the innermost heading may be comments."""
        for i in range(len(self.stack) - 1, -1, -1):
            name, around = self.stack[i]
            if name in _HEADINGS:
                if name != "h1" and any(len(x.text) >= LENGTH_LOW and not (x.apart or x.furniture) for x in self.done[:-1]):
                    self.heads.append(self.done[-1])
                    self.stack[i] = (name, around._replace(under=len(self.heads)))
                return

    def _comments(self) -> None:
        """Blocks under a heading of comments are out of the text if they look like it."""
        below: dict[int, list[Block]] = {}
        for b in self.done:
            if b.under:
                below.setdefault(b.under, []).append(b)
        for number, blocks in below.items():
            head = self.heads[number - 1]
            if any(c.isdigit() for c in head.text) or sum(len(b.text) <= BYLINE_MOST and bool(_BYLINE.search(b.text)) for b in blocks) >= BYLINES:
                for b in (head, *blocks):
                    b.apart = True

    def say(self, text: str) -> None:
        self.now.parts.append(text)
        if self.links:
            self.now.linked += len(text.strip())

    def _pop(self) -> str:
        name, self.place = self.stack.pop()
        self.open[name] -= 1
        return name

    def ended(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in _BLOCKS:
            self.close()
        if self.open[name]:
            while self._pop() != name:
                pass
            if name in _BLOCKS:
                self.close()

    def begun(self, name: str, attributes: str) -> None:
        if name in _BLOCKS:
            # A new block ends an open paragraph, an item ends the item before it.
            ends = name if name in _ITEMS else "p"
            for open_name, _ in reversed(self.stack):  # inline elements that are still open end with it
                if open_name in ("p", ends):
                    while self._pop() != open_name:
                        pass
                    break
                if open_name in _BLOCKS:
                    break
        if name == "a":
            self.links = 1
        if name in _VOID or attributes.endswith("/"):
            if name in _BLOCKS:
                self.close()
            return
        names = " ".join(x for x in (a or b or c for a, b, c in _NAMED.findall(attributes)) if x) if attributes and self.by_name else ""
        names = _STATES.sub("", _CAMEL.sub("-", names).lower())
        around = self.place
        apart = around.apart or (name not in _ROOTS and bool(names and _COMMENTS.search(names))) or bool(attributes and _HIDDEN.search(attributes))
        semantic = name in ("article", "main")
        furniture, article = around.furniture, around.article
        if semantic and not apart and around.number not in self.shut:
            furniture, article = False, max(article, 2 if name == "article" else 1)
        elif name in _APART or (name in _WRAPPERS and not article) or (not semantic and name not in _ROOTS and bool(names and _BAD_NAMES.search(names))):
            furniture = True
        elif not furniture and name in ("div", "section", "td") and names and _GOOD_NAMES.search(names):
            article = max(article, 2 if "article" in names else 1)
        if name in _BLOCKS or furniture != around.furniture or apart != around.apart:
            self.close()
        self.numbers += 1
        if name in _APART or around.number in self.shut:
            self.shut.add(self.numbers)
        block = name in _BLOCKS
        self.stack.append((name, around))
        self.open[name] += 1
        self.place = Place(apart, furniture, article, around.heading or name in _HEADINGS, self.numbers if block or name in _APART else around.number, around.number if block else around.parent, around.under)
        if block or furniture != around.furniture or apart != around.apart:
            self.close()

    def read(self) -> list[Block]:
        page, at, tags, closed = self.page, 0, _Tags(self.page), {}
        self.shut: set[int] = set()  # elements in which no article begins
        while at < len(page):
            m = _TOKEN.search(page, at)
            if m is None:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name, stop = m[2].lower(), tags.end(at)
            attributes, at = page[at:stop], stop + 1
            if m[1]:
                self.ended(name)
            elif name == "br":
                self.say(" ")
            elif name in _RAW:
                if name in _RAW_TEXT:
                    end = _RAW_ENDS[name].search(page, at)
                    at = end.end() if end else len(page)
                elif name != "head":  # its own raw elements may hold anything; what nothing closes is read on after the tag
                    if name not in closed:
                        closed[name] = _closed(page, name)
                    at = max(at, closed[name].get(m.start(), at))
            else:
                self.begun(name, attributes)
        self.close()
        self._comments()
        return self.done


def blocks_of(page: str, by_name: bool = True) -> list[Block]:
    """Blocks with text, in page order; ``by_name``: names of elements count."""
    return _Reader(page, by_name).read()


def density(text: str) -> float:
    """Share of stop words."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(blocks: list[Block]) -> tuple[list[int], list[int]]:
    """Points of each block, and the part of them that its place gives."""
    top = max((b.article for b in blocks if not b.apart and not b.furniture), default=0)
    dense = [density(b.text) if len(b.text) >= LENGTH_LOW else 0.0 for b in blocks]
    covered = any(d >= STOP_LOW and b.linked <= LINKS_MOST * len(b.text) for b, d in zip(blocks, dense, strict=True))
    points, places = [], []
    for b, d in zip(blocks, dense, strict=True):
        n = len(b.text)
        if b.linked > LINKS_MOST * n:
            words = -3
        elif n < LENGTH_LOW:
            words = 0
        elif not covered:
            words = 2 if n > LENGTH_HIGH else 1
        else:
            words = (2 if n > LENGTH_HIGH else 1) if d >= STOP_HIGH else 1 if d >= STOP_LOW else -2 if d < STOP_NONE and n > LENGTH_HIGH else -1
        if b.text.startswith(("©", "Copyright")):
            words -= 3
        place = -9 if b.apart else -4 if b.furniture else 0 if not top else 2 if b.article == top else -2
        points.append(words + place)
        places.append(place)
    return points, places


def _runs(blocks: list[Block], sure: list[int]) -> Iterator[list[int]]:
    """Neighbouring undecided blocks of one parent."""
    run: list[int] = []
    for i, b in enumerate(blocks):
        if run and (sure[i] or b.home != blocks[run[-1]].home):
            yield run
            run = []
        if not sure[i]:
            run.append(i)
    if run:
        yield run


def second_pass(blocks: list[Block], points: list[int], places: list[int]) -> None:
    """Labels every block good or bad."""
    n = len(blocks)
    sure = [1 if p >= SURE else -1 if p <= -SURE else 0 for p in points]
    for run in _runs(blocks, sure):
        text = " ".join(blocks[i].text for i in run)
        if len(run) > 1 and len(text) > LENGTH_HIGH and density(text) >= STOP_HIGH:
            for i in run:
                sure[i] = 1
    before, after = [-1] * n, [-1] * n  # places of the nearest decided blocks
    for i in range(1, n):
        before[i] = i - 1 if sure[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if sure[i + 1] else after[i + 1]
    for i, b in enumerate(blocks):
        if sure[i]:
            b.good = sure[i] > 0
            continue
        x, y = before[i], after[i]
        left, right = sure[x] if x >= 0 else -1, sure[y] if y >= 0 else -1
        if left == right:
            b.good = left > 0 or (points[i] > 0 and len(b.text) >= ALONE)
        elif places[i]:
            b.good = places[i] > 0
        else:
            at_home = [x >= 0 and blocks[x].home == b.home, y >= 0 and blocks[y].home == b.home]
            of_right = b.heading if at_home[0] == at_home[1] else at_home[1]
            b.good = (right if of_right else left) > 0
    _beside(blocks, sure)


def _beside(blocks: list[Block], sure: list[int]) -> None:
    """Short undecided blocks stay with a neighbour of the same parent that stays by its own length."""
    alone = {i for i, b in enumerate(blocks) if b.good and not sure[i]}
    for order, step in ((range(1, len(blocks)), -1), (range(len(blocks) - 2, -1, -1), 1)):
        for i in order:
            b = blocks[i]
            if not sure[i] and not b.good and not b.linked and i + step in alone and blocks[i + step].home == b.home:
                b.good = True
                alone.add(i)


def main_text(page: str | None) -> str:
    for by_name in (True, False):  # a name around the whole page says nothing
        blocks = blocks_of(page or "", by_name)
        second_pass(blocks, *first_pass(blocks))
        if any(b.good for b in blocks):
            break
    return "\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = [main_text(t) for t in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
