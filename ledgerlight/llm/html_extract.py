"""Main text of web pages by tree scoring.

Each block of running text earns points for its length and its commas, discounted by the share of its text in links.
The points go in full to its container, by half to that one's container, by a third to the next, and so on. The
container with the most points, itself discounted by link density, is the article; siblings of it that score well
belong to it. Menus, headers, footers, sidebars, notices, adverts, forms and reader comments, known by their element, role or class,
take no part, nor do scripts, styles and hidden parts. Headings are never known by class or id, and sections only by names that
fit nothing else: inside an ``article`` a word of ``SURE`` or two words of ``NOISE``, elsewhere any of them but ``UNSURE``, and
never beside words that are no qualifiers (``related-work``). Other elements inside an ``article`` are known by a word of ``SURE``, or by names that have no
words but these and such as boilerplate's parts have (``share-buttons``, not ``copyright-history``). Share of links only chooses the container: lists, tables and boxes
of links inside the article stay.

Character references are decoded; white space becomes one space inside a block, and one space joins the blocks in page order.
Nothing else is dropped, however short or long.

The parser is a tolerant one: unclosed and misnested tags, unquoted attributes and pages cut off anywhere are read as a
browser would, near enough for text. It keeps no recursion, so deep nesting is safe, and its memory is a small multiple of the page.

Defined cases: a null or empty page, and one without running text, gives an empty text; rows repeated in full are rows like
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MODIFIED = re.compile(r"\b(?:has|with|no|without|hide)[-_][\w-]+", re.I)
COMMAS = re.compile("[,،、，]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg canvas object audio video select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open element of the second set, up to one of the third.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
}
SCOPE = frozenset("table td th caption button object html body article section div main aside nav header footer form blockquote li ul ol dd".split())
#: Blocks that pass their points up instead of keeping them.
PARAGRAPH = frozenset("p li dd dt td th pre blockquote figcaption caption summary address legend h1 h2 h3 h4 h5 h6 tr tbody thead tfoot".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE = frozenset(
    "nav navbar navigation menu menubar header masthead topbar footer sidebar aside widget widgets ad ads adv advert adverts advertisement "
    "advertisements adsense adbox adslot sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice notices alert alerts popup "
    "modal overlay newsletter subscribe subscription signup login signin share sharing social breadcrumb breadcrumbs pagination pager related "
    "recommended recommendations comment comments commentlist disqus reply replies respond discussion toolbar copyright disclaimer".split()
)
REPLIES = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Of the words above, those that name no section of an article, and those that do so as often as not.
SURE = frozenset("navbar topbar ad ads adv advert adverts adsense adbox adslot breadcrumb breadcrumbs pagination pager comments commentlist disqus".split())
UNSURE = frozenset("header related discussion notice notices alert alerts respond".split())
#: Words that may stand beside them in the name of a section that is boilerplate.
QUALIFIERS = frozenset("site page main top bottom left right global section area container wrapper wrap box block bar list inner outer item items link links post posts articles stories form".split())
#: And in the names of other boilerplate inside an article.
PARTS = frozenset("button buttons icon icons count row col column inline message slot unit cta us up in field thread meta tools strip card cards teaser teasers grid text title heading head body content js is small large top".split())
KEPT = frozenset("html body main article".split())
LEVELS = 5
SIBLING_SHARE = 0.2


class _Page:
    """A page as nodes in page order and the text segments between their tags."""

    def __init__(self, page: str):
        self.tag, self.parent, self.begin, self.end = ["#"], [0], [0], [0]
        self.noise, self.holds, self.link = [False], [False], [False]
        self.segments: list[str] = []
        self.owner: list[int] = []
        self._parse(page)

    def _text(self, raw: str) -> None:
        if raw:
            self.segments.append(html.unescape(raw) if "&" in raw else raw)
            self.owner.append(self.open[-1])

    def _space(self) -> None:
        self.segments.append(" ")
        self.owner.append(-1)

    def _pop(self) -> None:
        node = self.open.pop()
        self.count[self.tag[node]] -= 1
        if self.tag[node] in BLOCK:
            self._space()
        self.end[node] = len(self.segments)

    def _pop_to(self, wanted: frozenset, stop: frozenset) -> None:
        """Closes the innermost open element of ``wanted`` and all inside it, unless one of ``stop`` comes first."""
        if not any(self.count.get(t) for t in wanted):
            return
        for at in range(len(self.open) - 1, 0, -1):
            t = self.tag[self.open[at]]
            if t in wanted:
                while len(self.open) > at:
                    self._pop()
                return
            if t in stop:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._space()
            return
        if name in BLOCK:
            self._pop_to(frozenset("p"), SCOPE)
            if name in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
                self._pop()
            if name in ENDS:
                self._pop_to(*ENDS[name])
            self._space()
        elif name == "a":
            self._pop_to(frozenset("a"), SCOPE)
        if name in VOID:
            return
        node, up = len(self.tag), self.open[-1]
        self.tag.append(name)
        self.parent.append(up)
        self.begin.append(len(self.segments))
        self.end.append(-1)
        self.link.append(name == "a" or self.link[up])
        self.noise.append(name in BOILERPLATE or ("=" in attributes or "hidden" in attributes) and self._is_noise(name, attributes, bool(self.count.get("article"))))
        self.holds.append(name in ("article", "main"))
        self.open.append(node)
        self.count[name] = self.count.get(name, 0) + 1

    @staticmethod
    def _is_noise(name: str, attributes: str, inside: bool) -> bool:
        """inside: whether an ``article`` is open around it."""
        found: set[str] = set()
        for m in NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if name in HEADINGS:
                    continue
                if name == "section":
                    for one in MODIFIED.sub(" ", value).split():
                        words = {w.lower() for w in WORDS.findall(one)}
                        if words <= NOISE | QUALIFIERS:
                            found |= words & NOISE
                    if len(found) > 1 or found & (SURE if inside else NOISE - UNSURE):
                        return True
                    continue
                value = MODIFIED.sub(" ", value)
                if inside and name not in KEPT:  # running text may be named after what it is about: copyright-history
                    value = " ".join(part for part in value.split() if (of := {w.lower() for w in WORDS.findall(part)}) & SURE or of <= NOISE | QUALIFIERS | PARTS)
                words = {w.lower() for w in WORDS.findall(value)}
                if words & (REPLIES if name in KEPT else NOISE):
                    return name not in ("html", "body")
            elif key == "role":
                if value.lower() in ROLES:
                    return True
            elif key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return True
            elif key == "hidden" or value.lower() == "true":
                return True
        return False

    def _parse(self, page: str) -> None:
        self.open, self.count = [0], {"#": 1}
        at = 0
        while m := TAG.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            if at == len(page) and page[-1] != ">":  # cut off inside a tag
                break
            name = name.lower()
            if not closing:
                if name in RAW:
                    if not attributes.endswith("/"):
                        close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                        at = close.end() if close else len(page)
                elif name == "plaintext":
                    at = len(page)
                else:
                    self._start(name, attributes)
            elif name == "br":
                self._space()
            elif self.count.get(name):
                self._pop_to(frozenset([name]), frozenset() if name in BLOCK else BLOCK)
        self._text(page[at:] if at < len(page) else "")
        while len(self.open) > 1:
            self._pop()
        self.end[0] = len(self.segments)
        for node in range(len(self.tag) - 1, 0, -1):
            if self.holds[node]:
                self.holds[self.parent[node]] = True

    def skipped(self, forms: bool = True) -> list[bool]:
        """Whether a node is boilerplate or inside some; one that wraps an article is not."""
        out = [False] * len(self.tag)
        for node in range(1, len(self.tag)):
            around = self.noise[node] and (self.tag[node] in KEPT or not self.holds[node]) and (forms or self.tag[node] != "form")
            out[node] = out[self.parent[node]] or around
        return out

    def text(self, ranges: list[tuple[int, int]], without: list[tuple[int, int]]) -> str:
        """The segments of ``ranges``, which don't overlap, without those of ``without``."""
        segments = self.segments
        for a, b in without:
            segments[a:b] = [" "] * (b - a)
        return " ".join(" ".join("".join(segments[a:b]) for a, b in ranges).split())


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    p = _Page(page)
    text = _best(p, p.skipped())
    if not text and not any(p.holds):
        text = _best(p, p.skipped(forms=False))  # a form may wrap a page that marks no article
    return text


def _best(p: _Page, skip: list[bool]) -> str:
    n = len(p.tag)
    length, linked, own, own_linked, commas = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    block = list(range(n))  # the block that a node's text belongs to
    for node in range(1, n):
        if p.tag[node] not in BLOCK:
            block[node] = block[p.parent[node]]
    for text, node in zip(p.segments, p.owner, strict=True):
        if node >= 0 and not skip[node]:
            k = len(" ".join(text.split()))
            if k:
                b = block[node]
                length[node] += k
                own[b] += k
                commas[b] += len(COMMAS.findall(text))
                if p.link[node]:
                    linked[node] += k
                    own_linked[b] += k
    for node in range(n - 1, 0, -1):
        length[p.parent[node]] += length[node]
        linked[p.parent[node]] += linked[node]
    if not length[0]:
        return ""

    score = [0.0] * n
    for node in range(n):
        if own[node]:
            points = min(own[node] / 25, 1) + commas[node] + min(own[node] / 100, 3)
            points *= 1 - own_linked[node] / own[node]
            at, level = node, 0
            while p.tag[at] in PARAGRAPH and at:
                at = p.parent[at]
            while level < LEVELS:
                score[at] += points / (level + 1)
                if not at:
                    break
                at, level = p.parent[at], level + 1

    final = [score[i] * (1 - linked[i] / length[i]) if length[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (final[i], -i))
    if not final[best]:
        best = 0
    at = best
    while at and p.tag[at] != "article":
        at = p.parent[at]
    best = at or best

    chosen = [best]
    if best and p.tag[p.parent[best]] != "#":
        up = p.parent[best]
        for node in range(up + 1, n):
            if p.parent[node] != up or node == best or skip[node] or not length[node]:
                continue
            density = linked[node] / length[node]
            if p.tag[best] == "article":
                joins = p.tag[node] == "article" and final[node] >= SIBLING_SHARE * final[best]
            else:
                joins = final[node] >= SIBLING_SHARE * final[best] or p.tag[node] in PARAGRAPH and density < 0.25
            if joins:
                chosen.append(node)
    chosen.sort()

    holes: list[tuple[int, int]] = []
    for node in range(1, n):
        if holes and p.begin[node] < holes[-1][1]:
            continue
        if skip[node] and not skip[p.parent[node]]:
            holes.append((p.begin[node], p.end[node]))
    return p.text([(p.begin[i], p.end[i]) for i in chosen], holes)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",), html_col: str = "html") -> DataFrame:
    """The columns of ``keep``, ``text`` and ``n_chars`` (code points) for each row of ``pages``."""
    ship(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part["_html"].to_pylist()]
                columns = [part[c] for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(run, f"{kept}, text string, n_chars long")
