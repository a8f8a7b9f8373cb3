"""Main text of web pages by tag-path ratios.

A page is cut into blocks, each with its path of tags from the root. For every path of a page the text length,
the length inside links and the punctuation of its blocks are summed; the ratio of text and the ratio of
punctuation to the number of blocks are fused, smoothed over neighbouring blocks and averaged for each path again.
Paths above a share of the best one are content. What lies in the smallest element around the content is the main
text, without the parts that its tags or attributes name as something else; inside an article a name that only begins with such a
word counts only if the part does not read as prose. Where the smallest element is the whole page, the main text begins with the first
block of content, and blocks of links behind the last one are left out. Lists of links in it stay.

Pages are independent of each other: nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.llm.common import arrow_map

# Fixed values of HTML: elements without content, and those that don't begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label ruby rt rp wbr img br".split())
#: Elements that a start tag of the same group closes.
SIBLINGS = [{"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}, {"thead", "tbody", "tfoot"}]

#: Elements whose content is no text.
CODE = {"script", "style"}
#: Elements that are never part of the main text.
OTHER = set("head title noscript template iframe object svg math canvas nav footer aside form select option button textarea dialog menu".split())
#: Words in class, id or role that name something else than the main text.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advert\w*|adbox|banner|sponsor\w*|promo\w*|sidebar|side|menu|navbar|navigation|nav|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|alert|"
    r"popup|modal|overlay|comments?|commentlist|replies|reply|respond|discussion|disqus|related|recommended|share|sharing|social|newsletter|subscribe|subscription|signup|login|search|widget|toolbar|pagination|pager|contentinfo|complementary)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Names that tell what lies inside or is missing, and a header, which inside the main text is its own.
ABOUT = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S*", re.IGNORECASE)
HEADER = re.compile(r"(?:^|(?<=[\s_-]))header(?=$|[\s_-]|\d)", re.IGNORECASE)
#: Words that say where or in what a named part stands.
PLACES = set("area bar block body bottom box button buttons card container content entry form icon icons inline inner item items left link links list main meta panel posts right row section slot text title top unit wrap wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")

#: A path is content if its score is at least this share of the best path's.
SHARE = 0.2
#: Weight of paths inside an element that says it is the main text.
MAIN_WEIGHT = 20.0


@dataclass(slots=True)
class Block:
    """Text between two block borders, with the path and the innermost element around it, by their numbers."""

    path: int
    element: int
    other: bool
    main: bool
    text: str
    linked: int
    named: int


@dataclass(slots=True)
class Open:
    """An open element: what holds for it and all around it."""

    tag: str
    path: int
    number: int
    element: int  # the innermost element that is not inline: this one or one around it
    border: int  # its place on the stack, -1 if there is none
    other: bool
    main: bool
    linked: bool
    named: int  # the innermost named element, 0 if there is none


_ROOT = Open("", 0, 0, 0, -1, False, False, False, 0)


class Blocks(HTMLParser):
    """Cuts a page into blocks; end tags may be missing, as in real pages.

    Elements are numbered as they open. Their parents and last descendants are kept in tables, so that a block costs the
    same at every depth.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}  # tag -> places of its open elements
        self.paths: dict[tuple[int, str], int] = {}
        self.tags, self.parents, self.last = [""], [0], [0]  # of each element; parents are not inline
        self.outer: dict[int, int] = {}  # named element -> the next named one around it
        self.doubtful: set[int] = set()  # named elements that need the text's word for it
        self.holders: set[int] = set()  # named elements around a main element or a title
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.code: str | None = None
        if page.rfind("<!--") > page.rfind("-->"):
            page += "-->"  # an open comment ends with the page
        self.feed(re.sub(r"<[a-zA-Z/][^<>]*$", "", page))  # and an open tag is none
        self.close()
        self.flush()
        self.drop(0)
        self.last[0] = len(self.tags) - 1
        self.settle()
        self.release()

    def top(self) -> Open:
        return self.stack[-1] if self.stack else _ROOT

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            now = self.top()
            self.found.append(Block(now.path, now.element, now.other, now.main, text, min(self.linked, len(text)), now.named))
        self.parts, self.linked = [], 0

    def within(self, element: int, number: int) -> bool:
        return element <= number <= self.last[element]

    def around(self, element: int, number: int) -> int:
        """The innermost element that holds both."""
        while not self.within(element, number):
            element = self.parents[element]
        return element

    def settle(self) -> None:
        """Frees doubtful elements whose text reads as prose: punctuated, and less than half of it linked."""
        sums = {n: [0, 0, 0] for n in self.outer}
        for b in self.found:
            if b.named and not b.other:
                for k, x in enumerate((len(b.text), b.linked, len(PUNCTUATION.findall(b.text)))):
                    sums[b.named][k] += x
        free: dict[int, int] = {0: 0}
        for n in sorted(self.outer, reverse=True):  # an element's number is above those around it
            if self.outer[n]:
                sums[self.outer[n]] = [x + y for x, y in zip(sums[self.outer[n]], sums[n], strict=True)]
        for n in sorted(self.outer):
            length, linked, marks = sums[n]
            prose = n in self.doubtful and marks > 0 and 2 * linked < length
            self.outer[n] = free[self.outer[n]]
            free[n] = self.outer[n] if prose else n
        for b in self.found:
            b.named = free[b.named]

    def release(self) -> None:
        """Blocks in named elements become others, except where such an element is a frame around the main text.

        That is one with more text than all that is free, if no main element is free, and if it holds a main element or
        a title or nothing is free at all.
        """
        own: dict[int, list[Block]] = {}
        for b in self.found:
            if not b.other:
                own.setdefault(b.named, []).append(b)
        sizes = {n: sum(len(b.text) - b.linked for b in own.get(n, ())) for n in (0, *self.outer)}
        filled, inner = set(own), {}
        for n in sorted(self.outer, reverse=True):
            if self.outer[n]:
                sizes[self.outer[n]] += sizes[n]
                if n in filled:
                    filled.add(self.outer[n])
            inner.setdefault(self.outer[n], []).append(n)
        free, most, released = own.get(0, []), sizes[0], {0}
        main, any_free = any(b.main for b in free), bool(free)
        frames = [(-sizes[n], n) for n in inner.get(0, ()) if n in filled]
        heapify(frames)
        while frames and not main:
            size, n = heappop(frames)
            if -size <= most:
                break
            if any_free and n not in self.holders:
                continue
            released.add(n)
            blocks = own.get(n, [])
            most += sum(len(b.text) - b.linked for b in blocks)
            main, any_free = any(b.main for b in blocks), any_free or bool(blocks)
            for k in inner.get(n, ()):
                if k in filled:
                    heappush(frames, (-sizes[k], k))
        for b in self.found:
            b.other = b.other or b.named not in released

    def drop(self, place: int) -> None:
        """Closes the element at a place of the stack and all inside it."""
        if self.top().border >= place:
            self.flush()
        for e in reversed(self.stack[place:]):
            self.last[e.number] = len(self.tags) - 1
            self.places[e.tag].pop()
        del self.stack[place:]

    def closes(self, tag: str) -> int | None:
        """The open element that a start tag ends."""
        border = self.top().border
        if border < 0:
            return None
        group = next((g for g in SIBLINGS if tag in g), ())
        return border if self.stack[border].tag == "p" or self.stack[border].tag in group else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CODE:
            self.code = tag
            return
        if tag not in INLINE:
            place = self.closes(tag)
            if place is not None:
                self.drop(place)
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        around = self.top()
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
        main = tag in ("article", "main") or "main" in named.split()
        other = tag in OTHER or hidden or tag == "header" and not around.main
        words = ABOUT.sub("", named)
        words = HEADER.sub("", words) if around.main else words
        says = bool(NAMED.search(words))
        if (main and not says or tag == "h1") and not other and not around.other:
            n = around.named
            while n and n not in self.holders:
                self.holders.add(n)
                n = self.outer[n]
        number, label = len(self.tags), f"{tag}.{named}" if named else tag
        self.tags.append(tag)
        self.parents.append(around.element)
        self.last.append(number)
        inner = around.named
        if says and tag not in ("html", "body", "article", "main"):
            self.outer[number], inner = inner, number
            if around.main and not any(plainly_named(w) for w in words.split()):
                self.doubtful.add(number)
        inline = tag in INLINE
        path = around.path if inline else self.paths.setdefault((around.path, label), len(self.paths) + 1)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(
            Open(
                tag, path, number, around.element if inline else number, around.border if inline else len(self.stack),
                around.other or other, around.main or main, around.linked or tag == "a", inner,
            )
        )

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in CODE:
            self.code = None
            return
        places = self.places.get(tag)
        # An inline end tag ends nothing outside its block.
        if places and not (tag in INLINE and places[-1] < self.top().border):
            self.drop(places[-1])

    def handle_data(self, data: str) -> None:
        if self.code:
            return
        self.parts.append(data)
        if self.top().linked:
            self.linked += len(data.strip())


def plainly_named(word: str) -> bool:
    """Whether a name is one of ``NAMED``, alone or as the last part of a compound, or before a word for a place on the page.

    ``reader-comments`` and ``share-buttons`` are, ``share-price`` and ``side-effects`` are not.
    """
    parts = [x for x in re.split(r"[_-]+", word.rstrip("0123456789_-")) if not x.isdigit()]
    while len(parts) > 1 and parts[-1].lower() in PLACES:
        parts.pop()
    return bool(parts and NAMED.search(parts[-1]))


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused and smoothed ratio of every tag path of a page."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(b.text) - b.linked
        s[2] += len(PUNCTUATION.findall(b.text))
    fused = [sums[b.path][1] / sums[b.path][0] * (1 + sums[b.path][2] / sums[b.path][0]) for b in blocks]
    smooth = [
        (fused[max(i - 1, 0)] + 2 * fused[i] + fused[min(i + 1, len(fused) - 1)]) / 4 for i in range(len(fused))
    ]
    scores: dict[int, float] = {}
    for b, value in zip(blocks, smooth, strict=True):
        weight = 0.0 if b.other else MAIN_WEIGHT if b.main else 1.0
        scores[b.path] = scores.get(b.path, 0.0) + weight * value / sums[b.path][0]
    return scores


def main_text(page: str) -> str:
    """Blocks of the main text in page order, one line each; empty if there is none."""
    read = Blocks(page)
    blocks, tags = read.found, read.tags
    scores = path_scores(blocks)
    best = max(scores.values(), default=0)
    if not best:
        return ""
    places = [i for i, b in enumerate(blocks) if not b.other and scores[b.path] >= SHARE * best]
    first = blocks[places[0]].element
    around = first
    for i in places:
        around = read.around(around, blocks[i].element)
    # Inside a single block or right below <body> all from its start is taken; inside an element all of it.
    whole = tags[around] not in ("", "html", "body") and (around != first or len(places) > 1)
    if not whole and around == first and around and tags[read.parents[around]] not in ("", "html", "body"):
        around, whole = read.parents[around], True  # one block of content: its element's other blocks belong to it
    if whole:
        return "\n".join(b.text for b in blocks if not b.other and read.within(around, b.element))
    # Behind the last content only blocks of links are left out.
    behind = [b for b in blocks[places[-1] + 1 :] if 2 * b.linked < len(b.text)]
    return "\n".join(b.text for b in blocks[places[0] : places[-1] + 1] + behind if not b.other)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Needs ``page_id, url, html``; other columns are left out. A null or empty page has an empty text. Repeated
    rows give repeated results; an empty table gives no rows.
    """

    def work(batch: pa.RecordBatch) -> list:
        texts = [main_text(p) if p else "" for p in batch.column("text").to_pylist()]
        return [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]]

    rows = pages.select(F.col("page_id").cast("long"), "url", F.col("html").alias("text"))
    return arrow_map(rows, work, "page_id long, url string, text string, n_chars long")
