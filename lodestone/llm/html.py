"""Main text of web pages by two passes of block rules.

A page is read once, tag by tag, into blocks: stretches of text between the tags of block elements.  What stands in menus,
page headers, footers, sidebars, forms, adverts, notices, comments or hidden elements, by tag, role or class, is
removed before.  The first pass decides each other block by its density of links, its length and its density of stop words; headings and short
blocks stay open.  In the second pass an open block gets the label of the nearest decided neighbours, a heading that of what follows it.
An article or main element sets the scope: its blocks see neighbours inside of it only, and where it holds most of the good
text, blocks outside of it are no part of the page's text.

One narrow pass over whole pages, about 1 MB at once or one page; nothing is shuffled.  Work is linear in the page.

Defined results.  Null and empty html give an empty text.  Broken markup: a tag that isn't closed ends with the element around it, a
comment or script that isn't closed takes the rest.  Ties between neighbours go to the article inside one, else to the side that drops.  Very
long pages are whole.  Null ids are rows like any other, rows that repeat have equal results.  An empty table gives an empty table.
Only the columns to keep and the html are read, under numbers, so that names never clash.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import with_results

#: Frequent function words of en, de, fr, es.
STOP_WORDS = frozenset(
    """the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were
    der die das und ist von zu den mit nicht ein eine im für auf dem des sich auch es an werden aus er hat dass sie nach bei
    le la les de des un une et est en du que qui dans il ne pas pour sur au avec ce se sont par plus mais ou nous
    el los las y del que se un una por con para su al lo como más pero sus este ya sin sobre entre era son""".split()
)
SHORT, LONG = 70, 200  # characters below which a block is open, and above which few stop words are enough
FEW_STOP, MANY_STOP = 0.15, 0.3  # stop words among the words
MOST_LINKS = 0.33  # characters inside links

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp template".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPES = frozenset(("article", "main"))
REMOVED = frozenset("nav footer aside form menu button select dialog noscript svg math object canvas audio video head".split())
REMOVED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form status note".split())
REMOVED_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal
    overlay newsletter subscribe subscription signup login sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar footer
    masthead copyright disclaimer social share sharing related recommended recommendations teaser comment comments reply replies respond disqus discussion search form
    skip hidden""".split()
)
ARTICLE_NAMES = REMOVED_NAMES & frozenset("ad ads advert advertisement sponsored promo related recommended teaser comment comments reply".split())
#: Elements that end when one of the same kind begins, but not one outside of these.
SIBLINGS = {k: frozenset(v.split()) for k, v in {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "a": ""}.items()}
NOTHING, CELLS = frozenset(), frozenset(("td", "th", "table"))
#: Elements in which a paragraph can stand: one that is open outside of them doesn't end when a block begins.
HOLDERS = frozenset("td th table div section article main li blockquote button body".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attr>(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>"'])?+|["'])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAIN = re.compile(r"""(?i)role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody""")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NOT_OWN = re.compile(r"(?:with|has|no|without|hide|show)[-_]", re.I)


def removed(name: str, attributes: str, in_scope: bool) -> bool:
    """Whether an element is no part of the main text, by its tag and attributes."""
    if name in REMOVED or (name == "header" and not in_scope):
        return True
    if not attributes or name in ("html", "body"):
        return False
    a = {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(attributes)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    role = a.get("role", "").lower()
    if role in REMOVED_ROLES and not (role in ("banner", "note") and in_scope):
        return True
    banned = ARTICLE_NAMES if name in SCOPES else REMOVED_NAMES
    for word in f"{a.get('class', '')} {a.get('id', '')}".split():
        if not _NOT_OWN.match(word) and not banned.isdisjoint(p.lower() for p in re.split(r"[-_:]+", _CAMEL.sub("-", word))):
            return True
        if not in_scope and name not in SCOPES and re.split(r"[-_]", word.lower())[-1] == "header":
            return True
    return False


class Block:
    """Text of one block, with what the rules look at."""

    __slots__ = ("text", "links", "heading", "scope", "label")

    def __init__(self, text: str, links: int, heading: bool, scope: int, label: bool | None):
        self.text, self.links, self.heading, self.scope, self.label = text, links, heading, scope, label


class _Open:
    """An element that isn't closed yet."""

    __slots__ = ("name", "gone", "mute", "scope", "heading", "link")

    def __init__(self, name: str, attributes: str, above: _Open | None):
        self.name = name
        gone = above is not None and above.gone
        self.scope = above.scope if above else 0
        self.gone = gone or removed(name, attributes, self.scope > 0)
        #: removed from inside a block, which goes on without it
        self.mute = (above is not None and above.mute) or (self.gone and not gone and name not in BLOCKS)
        self.heading = name in HEADINGS or (above is not None and above.heading)
        self.link = name == "a" or (above is not None and above.link)

    def begins_scope(self, attributes: str) -> bool:
        return not (self.gone or self.scope) and (self.name in SCOPES or (attributes != "" and _MAIN.search(attributes) is not None))


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order.  Those of removed elements have no text and are decided: they drop."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links = scopes = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                top = stack[-1] if stack else None
                gone = top is not None and top.gone and not top.mute
                out.append(Block("" if gone else text, min(links, len(text)), top is not None and top.heading, top.scope if top else 0, False if gone else None))
        links = 0

    def close(i: int) -> None:
        """Close the i-th open element and all inside it.  Text belongs to the block that it stands in."""
        for j in range(len(stack) - 1, i - 1, -1):
            if stack[j].name in BLOCKS:
                flush()
            stack.pop()

    def opened(name: str, until: frozenset[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name == name:
                return i
            if stack[i].name in until:
                break
        return -1

    def say(text: str) -> None:
        nonlocal links
        if stack and stack[-1].mute:
            return
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if stack and stack[-1].link:
            links += len(" ".join(text.split()))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if m["end"]:
            i = opened(name, CELLS if not block else NOTHING)
            if i >= 0:
                close(i)
            elif block:
                flush()
            continue
        attributes = m["attr"]
        if name == "br":
            parts.append(" ")
            continue
        if block:
            i = opened("p", HOLDERS)
            if i >= 0:
                close(i)
            flush()
        if name in VOID:
            continue
        if name in SIBLINGS:
            i = opened(name, SIBLINGS[name])
            if i >= 0 and (name != "a" or i == len(stack) - 1):
                close(i)
        empty = attributes.endswith("/") and not block
        if name in RAW:
            if not empty or name in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
                closing = page.find(">", stop.start()) if stop else -1
                at = closing + 1 if closing >= 0 else end
            continue
        if not empty:
            element = _Open(name, attributes, stack[-1] if stack else None)
            if element.begins_scope(attributes):
                scopes += 1
                element.scope = scopes
            stack.append(element)
    flush()
    return out


def decide(block: Block, stop_words: frozenset[str] = STOP_WORDS) -> bool | None:
    """First pass: True for main text, False for none of it, None where only the neighbours can tell."""
    n = len(block.text)
    inside = block.scope > 0
    if block.heading:
        return None
    if block.links > MOST_LINKS * n or (not inside and block.text.startswith("©")):
        return False
    if n < SHORT:
        return None
    words = _WORD.findall(block.text.lower())
    density = sum(w in stop_words for w in words) / max(1, len(words))
    if density >= MANY_STOP or (n >= LONG and density >= FEW_STOP):
        return True
    return None if inside or density >= FEW_STOP else False


def settle(labels: list[bool | None], headings: list[bool], default: bool) -> list[bool]:
    """Second pass: open blocks get the label of the nearest decided neighbours, headings that of the next one.  Where both sides
    differ, the nearer one says; default where both are as near, or where there is none."""
    n = len(labels)
    after: list[int | None] = [None] * n
    seen = None
    for i in range(n - 1, -1, -1):
        after[i] = seen
        if labels[i] is not None:
            seen = i
    out, before = [], None
    for i, label in enumerate(labels):
        if label is not None:
            before = i
            out.append(label)
            continue
        j = after[i]
        if headings[i] and j is not None:
            out.append(bool(labels[j]))
        elif before is None or j is None or labels[before] == labels[j]:
            near = before if j is None else j
            out.append(default if near is None or (headings[i] and default) else bool(labels[near]))
        elif i - before != j - i:
            out.append(bool(labels[before if i - before < j - i else j]))
        else:
            out.append(default)
    return out


def main_text(page: str, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The page's main blocks in order, one a line."""
    found = blocks(page)
    labels = [b.label if b.label is not None else decide(b, stop_words) for b in found]
    good = [False] * len(found)
    for scope in sorted({b.scope for b in found}):
        # what an article removes is no neighbour of its text; outside of articles menus and notices are
        own = [i for i, b in enumerate(found) if b.scope == scope and (b.text or not scope)]
        for i, label in zip(own, settle([labels[i] for i in own], [found[i].heading for i in own], scope > 0)):
            good[i] = label and found[i].text != ""
    size = lambda inside: sum(len(b.text) for b, g in zip(found, good) if g and (b.scope > 0) == inside)
    inside = size(True)
    if inside and inside >= size(False):
        good = [g and b.scope > 0 for b, g in zip(found, good)]
    if not any(good):  # nothing is decided: what isn't removed or made of links is all there is
        good = [b.text != "" and label is not False for b, label in zip(found, labels)]
    return "\n".join(b.text for b, g in zip(found, good) if g)


def _work(stop_words: frozenset[str]):
    def work(pages: pa.Array) -> list[pa.Array]:
        texts = [main_text(p, stop_words) if p else "" for p in pages.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return work


def extract(pages: DataFrame, keep: list[str], html: str = "html", stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """The columns keep, text and n_chars of each page."""
    return with_results(pages, html, keep, {"text": T.StringType(), "n_chars": T.LongType()}, _work(stop_words))


def op11_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
