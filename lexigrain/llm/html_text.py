"""Main-text extraction from HTML by two-pass block rules.

A page is read once, in time linear in its length, into blocks: stretches of
text between block-level tags.  Blocks of elements that are never main text (a
menu, a footer, a form, an element whose class says advert) are boilerplate.
All others are classified: pass one decides by link density, length and
stop-word density; what it leaves open, short blocks for the most part,
inherits in pass two the label of the nearest decided neighbours.  An
``article`` or ``main`` element is evidence: it keeps neighbours apart, speaks
for text that nothing else decides, and where it holds most of a page's dense
text, dense text outside it is taken for a notice.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.worker import serving
from lexigrain.storage import bound_batches

# Elements whose content is never text, that are boilerplate, that hold the article, and that end a block.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas select option datalist textarea button head title".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements read as raw text up to their end tag, and those of them that run to the end of the page without one.
RAW = frozenset("script style noscript template textarea title iframe select svg".split())
RAW_TO_END = frozenset("script style textarea title iframe".split())
# Parts of a class, id or role that make an element boilerplate, those that make its short blocks so, and those that say that the element merely has the part that follows.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promos promotion sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer masthead siteheader "
    "comment comments commentlist replies disqus cookie cookies consent notice notices gdpr popup modal newsletter teaser teasers toolbar pagination pager contentinfo complementary".split()
)
WEAK_HINTS = frozenset("subscribe share sharing social related recommended login signup search widget copyright legal disclaimer reply".split())
HAVING = frozenset("has with no without hide".split())
# Frequent words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he in is it its not of on or that the this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qui que sa se son sur un une vous "
    "als am auch auf aus bei das dem den der die ein eine einer es für ich im ist mit nicht sich sie sind und von war wie wird zu zum "
    "con del el ella los las lo más no para pero por se su sus y como al si ya".split()
)

#: Characters from which a block is long; words that a shorter one needs to be judged by its stop words.
LONG_CHARS, FEW_WORDS = 140, 8
#: Share of linked characters above which a block is boilerplate; share of stop words that makes a long block text, and a shorter one.
LINK_DENSITY, STOP_DENSITY_LONG, STOP_DENSITY = 0.4, 0.08, 0.2

# No group of these can match one stretch in two ways, so no tag makes them go back.
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_loose_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_attribute = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))?+)?+")
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
_letters = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block-level tags, and where it stood."""

    text: str
    link_chars: int
    heading: bool
    article: bool
    boilerplate: bool
    weak: bool = False
    label: bool | None = None


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page: kind is "text", "open", "close" or "raw" (an element whose content was skipped).

    Linear: whatever a search for an end has failed to find is not searched
    for again.  A quote that is never closed is a plain character; where no
    tag ends outside quotes any more, tags end at the next ">".
    """
    at, size = 0, len(page)
    last = page.rfind(">")
    tag, endless = _tag, set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            # Nothing after the last ">" is a tag, but a comment may begin there.
            end = page.find("<!--", at)
            end = size if end < 0 else end
            if end > at:
                yield "text", page[at:end], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        follows = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif follows in ("!", "?") or (follows == "/" and not page[lt + 2 : lt + 3].isalpha()):
            at = page.find(">", lt) + 1
        elif not (follows == "/" or (follows.isascii() and follows.isalpha())):
            yield "text", "<", ""
            at = lt + 1
        else:
            m = tag.match(page, lt)
            if m is None and tag is _tag:
                tag = _loose_tag
                m = tag.match(page, lt)
            if m is None:
                yield "text", "<", ""
                at = lt + 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                yield "close", name, ""
            elif name in RAW and not m[3].endswith("/"):
                end = None if name in endless else _raw_end[name].search(page, at)
                if end is not None:
                    at = end.end()
                else:
                    endless.add(name)
                    if name in RAW_TO_END:
                        at = size
                yield "raw", name, ""
            else:
                yield "open", name, m[3]


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's attributes make it boilerplate, and whether they make its short blocks so."""
    strong = weak = False
    for m in _attribute.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            strong = True
        elif key in ("class", "id", "role") and name not in ("body", "html", "main", "article"):
            for word in value.split():
                parts = [p.lower() for p in _parts.findall(word)]
                for before, part, after in zip(["", *parts], parts, [*parts[1:], ""], strict=False):
                    if before not in HAVING:
                        strong = strong or part in HINTS or part + after in ("sidebar", "siteheader", "navbar")
                        weak = weak or part in WEAK_HINTS
        elif key == "class" and name == "article":
            strong = strong or not {"teaser", "comment", "ad"}.isdisjoint(p.lower() for p in _parts.findall(value))
    return strong, weak


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, empty ones left out."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, boilerplate, article, weak; of the element and all around it
    names: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    links, heading = 0, False

    def close_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            own = len(" ".join(html.unescape("".join(linked)).split()))
            boiler, article, weak = open_[-1][1:] if open_ else (False, False, False)
            out.append(Block(text, min(own, len(text)), heading, article, boiler, weak))
        parts.clear()
        linked.clear()

    def pop() -> str:
        name = open_.pop()[0]
        names[name] -= 1
        return name

    for kind, name, attributes in tokens(page):
        if kind == "text":
            parts.append(name)
            if links:
                linked.append(name)
        elif kind == "raw":
            if name in ("iframe", "svg", "select"):
                parts.append(" ")
        elif name == "a":
            links = 0 if kind == "close" else 1
        elif name in ("br", "img", "input"):
            parts.append(" ")
        elif name in BLOCKS or name in SKIPPED:
            close_block()
            links = 0
            if kind == "close":
                if names[name]:
                    while pop() != name:
                        pass
                heading = False
                continue
            # A paragraph, list item or cell that was left open ends where the next begins.
            while open_ and open_[-1][0] == "p":
                pop()
            if name in ("li", "tr", "td", "th", "dt", "dd") and open_ and open_[-1][0] == name:
                pop()
            heading = name[0] == "h" and name[1:].isdigit()
            if name in VOID:
                continue
            boiler, article, weak = open_[-1][1:] if open_ else (False, False, False)
            strong, some = _marks(name, attributes) if attributes else (False, False)
            boiler = boiler or strong or name in BOILERPLATE or name in SKIPPED or (name == "header" and not article)
            open_.append((name, boiler, article or name in ARTICLE, weak or some))
            names[name] += 1
    close_block()
    return out


def decide(b: Block) -> bool | None:
    """Pass one: a block's label by itself, None where that leaves it open."""
    if b.boilerplate or b.link_chars > LINK_DENSITY * len(b.text):
        return False
    words = _letters.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    long = len(b.text) >= LONG_CHARS
    if stops >= (STOP_DENSITY_LONG if long else STOP_DENSITY) * len(words) and (long or len(words) >= FEW_WORDS) and words:
        return True
    if not long and (b.weak or b.text.startswith("©")):
        return False
    return None


def inherit(found: list[Block]) -> list[bool | None]:
    """Pass two: the label of the nearest decided neighbours for every block left open, None where there are none.

    Only neighbours on the same side of an ``article`` element's edge count,
    and those that stand in a menu, footer or the like only where there are no
    others.  A heading goes with what follows it, if that is decided; at equal
    distance text on either side is enough.
    """
    out = [b.label for b in found]
    for side in (False, True):
        known = [k for k, b in enumerate(found) if b.article is side and b.label is not None]
        decided = [k for k in known if not found[k].boilerplate] or known
        for k, b in enumerate(found):
            if b.label is not None or b.article is not side or not decided:
                continue
            at = bisect_left(decided, k)
            left = decided[at - 1] if at else None
            right = decided[at] if at < len(decided) else None
            if left is None or (right is not None and (b.heading or right - k < k - left)):
                out[k] = found[right].label
            elif right is None or k - left < right - k:
                out[k] = found[left].label
            else:
                out[k] = found[left].label or found[right].label
    return out


def classify(found: list[Block]) -> list[Block]:
    """Label every block: True for main text. Two passes, as the module says."""
    for b in found:
        b.label = decide(b)
    # Dense text outside the article is a notice if the article holds most of the page's.
    dense = [sum(len(b.text) for b in found if b.label and b.article is side) for side in (False, True)]
    if dense[1] > dense[0]:
        for b in found:
            if not b.article:
                b.label = False
    labels = inherit(found)
    # What has no decided neighbour is text inside an article, and on a page where nothing else is.
    none = not any(labels)
    for b, label in zip(found, labels, strict=True):
        b.label = (b.article or none) and not b.boilerplate if label is None else label
    if not any(b.label for b in found):
        for b in found:
            b.label = not b.boilerplate and not b.weak and b.link_chars <= LINK_DENSITY * len(b.text) and not b.text.startswith("©")
    return found


def main_text(page: str | None) -> str:
    """Main text of a page, blocks joined by one line break; null and pages without any give the empty string."""
    return "\n".join(b.text for b in classify(blocks(page)) if b.label) if page else ""


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with the page's main text and ``n_chars``, its code points; one row per row, no shuffle."""
    bound_batches(pages.sparkSession)
    fields = [pages.schema[c] for c in keep]

    @serving("html_text")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "text", "n_chars"])

    named = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).cast("string").alias("html"))
    schema = ", ".join([*(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "text string", "n_chars long"])
    return named.mapInArrow(run, schema).toDF(*keep, text_col, "n_chars")
