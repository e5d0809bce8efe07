"""Main text of web pages by block rules in two passes (operator 12).

A page is cut into blocks at its block elements. The first pass decides what it can by the share of stop words, the
length and the share of linked characters. Short and middling blocks stay open; the second pass gives each the label of
the nearest decided block. Elements that say what they are count before the rules: menus, footers, sidebars, adverts,
forms and comments are never text, and where a page declares its article, only what lies inside is, and blocks in it
are only dropped if they are made of links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm._common import bounded_batches, table

# Frequent function words of English, German, French, Spanish, Italian and Portuguese.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his if in into is it its not of on or she so that the their
    them then there they this to was we were which who will with would you your
    aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach
    nicht noch nur oder sich sie sind um und von vor war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais nous ou par pas plus pour que qui sa
    se ses son sont sur un une vous
    al como con del el ella entre era esta este ha las lo los más muy no o para pero por porque sin sobre su sus también y ya
    che di e gli i non per più sono una uno
    ao com da das do dos ele em foi mas na nas nos os ou pelo sem seu uma""".split()
)
# How elements are named.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small strike strong sub sup time tt u var".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
NEVER = frozenset("nav footer aside form button select option optgroup textarea label input script style noscript template svg canvas audio video object iframe dialog menu head".split())
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BOILERPLATE = frozenset(
    """ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted
    promotion recommendations related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe
    subscription widget""".split()
)
OUTSIDE_ONLY = frozenset("header masthead topbar".split())
ARTICLE, MAIN = 2, 1

_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`]+)))?")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class Rules:
    """Lengths in characters, the others as shares."""

    short: int = 70
    long: int = 200
    stop_low: float = 0.15
    stop_high: float = 0.3
    links: float = 0.33
    article_links: float = 0.5
    #: A page below this share of stop words is in a language that the list doesn't know; length decides then.
    known: float = 0.05


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    never: bool
    level: int
    region: int
    stop: int = 0
    words: int = 0

    @property
    def link_share(self) -> float:
        return self.linked / len(self.text)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), a or b or c)
    return found


def _named(value: str) -> set[str]:
    """Words of class names and ids; names that deny (no-sidebar, has-ads) say nothing of the element itself."""
    words: set[str] = set()
    for name in value.split():
        parts = [x.lower() for x in _NAMES.findall(name)]
        if parts and parts[0] not in ("no", "has", "with", "without"):
            words.update(parts)
    return words


class _Cutter:
    """Cuts a page into blocks, in one walk over its tags."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # name, never text, level, region
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.regions = 0
        self.link_depth: int | None = None
        self.breaks = 0
        self.heading = False

    @property
    def here(self) -> tuple[str, bool, int, int]:
        return self.stack[-1] if self.stack else ("", False, 0, 0)

    def text(self, raw: str) -> None:
        if raw:
            value = unescape(raw) if "&" in raw else raw
            if self.breaks and not value.isspace():
                self.breaks = 0
            self.parts.append(value)
            if self.link_depth is not None:
                self.linked.append(value)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, never, level, region = self.here
                self.blocks.append(Block(text, len(" ".join("".join(self.linked).split())), self.heading, never, level, region))
            self.parts, self.linked = [], []
        self.breaks = 0

    def push(self, name: str, never: bool, level: int, region: int) -> None:
        self.stack.append((name, never, level, region))
        self.open[name] = self.open.get(name, 0) + 1

    def pop_to(self, names: tuple[str, ...]) -> None:
        """Close elements up to the nearest one of these names."""
        while self.stack:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if name in names:
                break
        if self.link_depth is not None and len(self.stack) < self.link_depth:
            self.link_depth = None

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            return
        block = name in BLOCKS
        if block:
            self.flush()
            if self.stack and self.stack[-1][0] == "p":
                self.pop_to(("p",))
            ended = CLOSED_BY_NEXT.get(name)
            if ended and self.stack and self.stack[-1][0] in ended:
                self.pop_to(ended)
                if name == "tr" and self.stack and self.stack[-1][0] == "tr":
                    self.pop_to(("tr",))
            self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
        if name in VOID:
            return
        _, never, level, region = self.here
        own_level, own = self._kind(name, attributes, level)
        if own_level > level:
            self.regions += 1
            level, region = own_level, self.regions
        if own and not never and self.parts:
            self.flush()  # an inline element that is never text
        if name == "a":
            if "href" in attributes.lower() and self.link_depth is None:
                self.link_depth = len(self.stack)
        if name not in FORMATTING or own:
            self.push(name, never or own, level, region)

    def _kind(self, name: str, attributes: str, level: int) -> tuple[int, bool]:
        """(level that the element declares, whether it is never text)."""
        declared = ARTICLE if name == "article" else MAIN if name == "main" else 0
        if name in NEVER or name == "header" and not level:
            return 0, True
        if not attributes.strip(" /"):
            return declared, False
        a = _attributes(attributes)
        role = a.get("role", "").lower()
        if role == "main":
            declared = max(declared, MAIN)
        elif role == "article" or a.get("itemprop", "").lower() == "articlebody":
            declared = ARTICLE
        if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")) or role in ROLES:
            return 0, True
        if name in ("html", "body", "main"):
            return declared, False
        names = _named(a.get("class", "")) | _named(a.get("id", ""))
        if name == "article":
            return declared, bool(names & {"comment", "comments", "reply", "replies"})
        return declared, bool(names & BOILERPLATE) or not level and bool(names & OUTSIDE_ONLY)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.heading = False
        if name == "a":
            self.link_depth = None
        if self.open.get(name):
            if self.parts and any(n == name and never for n, never, _, _ in self.stack[-1:]):
                self.flush()
            self.pop_to((name,))

    def cut(self, html: str) -> list[Block]:
        at, size, tag = 0, len(html), _TAG
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            self.text(html[at:lt])
            follow = html[lt + 1 : lt + 2]
            if follow == "!" or follow == "?":
                comment = _COMMENT.match(html, lt)
                close = comment.end() if comment else html.find(">", lt) + 1
                at = close if close > 0 else size
                continue
            found = tag.match(html, lt)
            if found is None and tag is _TAG and (follow.isalpha() or follow == "/") and '"' in html[lt:] + "'":
                later = _PLAIN_TAG.match(html, lt)
                if later is not None:
                    tag, found = _PLAIN_TAG, later  # quotes don't pair up to the end: from here on a tag ends at its first >
            if found is None:
                if follow.isalpha() or follow == "/" and html[lt + 2 : lt + 3].isalpha():
                    break  # a tag that never ends
                if follow == "/":
                    close = html.find(">", lt)
                    at = size if close < 0 else close + 1
                    continue
                self.text("<")
                at = lt + 1
                continue
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self.end(name)
            elif name in RAW:
                if name in BLOCKS:
                    self.flush()
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                if close is None:
                    break
                end = html.find(">", close.end())
                at = size if end < 0 else end + 1
            else:
                self.start(name, found[3])
        self.flush()
        return self.blocks


GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"


def first_pass(blocks: list[Block], rules: Rules = Rules()) -> list[str]:
    """Labels by the block alone; ``near`` and ``short`` are open."""
    for b in blocks:
        words = [w.lower() for w in _LETTERS.findall(b.text)]
        b.words, b.stop = len(words), sum(w in STOP_WORDS for w in words)
    total = sum(b.words for b in blocks if not b.never)
    known = total and sum(b.stop for b in blocks if not b.never) / total >= rules.known
    labels = []
    for b in blocks:
        share = b.stop / b.words if b.words else 0.0
        if b.never:
            labels.append(BAD)
        elif b.level:
            if b.link_share > rules.article_links:
                labels.append(SHORT if b.heading else BAD)
            else:
                labels.append(GOOD if len(b.text) >= rules.long or len(b.text) >= rules.short and (share >= rules.stop_low or not known) else NEAR if len(b.text) >= rules.short else SHORT)
        elif b.link_share > rules.links or "©" in b.text and len(b.text) < rules.long:
            labels.append(SHORT if b.heading else BAD)
        elif len(b.text) < rules.short:
            labels.append(BAD if b.linked and not b.heading else SHORT)
        elif not known:
            labels.append(GOOD if len(b.text) >= rules.long else NEAR)
        elif share >= rules.stop_high:
            labels.append(GOOD if len(b.text) >= rules.long else NEAR)
        else:
            labels.append(NEAR if share >= rules.stop_low else BAD)
    return labels


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Open blocks take the label of the nearest decided one; in a declared article, that of the nearest in it.

    Where both sides are equally near, a heading goes with what follows, a middling block is text, and a short one goes
    with what precedes. Without any decided block, open blocks are text in an article and not outside.
    """
    n = len(blocks)
    decided = [label in (GOOD, BAD) and not (b.never and b.level) for b, label in zip(blocks, labels, strict=True)]
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: int | None = None
        for i in order:
            b = blocks[i]
            out[i] = last if last is not None and (not b.level or blocks[last].region == b.region) else None
            if decided[i] and (last is None or not b.never or not blocks[last].level):
                last = i
    kept = []
    for i, (b, label) in enumerate(zip(blocks, labels, strict=True)):
        if label in (GOOD, BAD):
            kept.append(label == GOOD)
            continue
        p, f = before[i], after[i]
        if p is None and f is None:
            kept.append(bool(b.level))
        elif p is None or f is None:
            kept.append(labels[p if f is None else f] == GOOD)
        elif i - p != f - i:
            kept.append(labels[p if i - p < f - i else f] == GOOD)
        elif b.heading:
            kept.append(labels[f] == GOOD)
        else:
            kept.append(label == NEAR and GOOD in (labels[p], labels[f]) or labels[p] == GOOD)
    return kept


def extract(html: str, rules: Rules = Rules()) -> str:
    """The main text of a page, its blocks joined by line breaks."""
    blocks = _Cutter().cut(html)
    kept = second_pass(blocks, first_pass(blocks, rules))
    level = max((b.level for b, k in zip(blocks, kept, strict=True) if k), default=0)
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k and b.level >= level)


def _extract(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", rules) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    A null or empty html gives an empty text; so does a page without main text. Pages are read whole, whatever their
    length. Repeated rows each give a row, null ids and urls are passed on, an empty table gives no rows, and other
    columns are not read. Character references are decoded once; white space (line breaks and single ``<br>`` included)
    becomes one space, two ``<br>`` in a row begin a new block. A tag that never ends drops what follows it, as in a browser.
    """
    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_extract(rules), "page_id long, url string, text string, n_chars long")


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


#: The pages of the tables at hand keep their main text in one article of headings and paragraphs; for those, SQL says it as well.
OP12_SQL = r"""
WITH bodies AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|$)', 1, 's') AS body FROM pages),
marked AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '</?(?:p|h1)>', chr(10), 'g') AS body FROM bodies),
plain AS (SELECT page_id, url, regexp_replace(replace(body, '<br>', ' '), '<[^>]*>', '', 'g') AS body FROM marked),
decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g') AS body FROM plain),
texts AS (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)), '') AS text FROM decoded)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
