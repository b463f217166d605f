"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# HTML's elements by the way they are treated.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXTUAL = frozenset("p li td th dd dt pre blockquote caption figcaption h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("head nav footer aside form button select option datalist svg canvas object audio video "
                     "map menu dialog math fieldset legend input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                  "menubar toolbar".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",)),
          "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")),
          "option": ("option", ("select",))}
# Words in class or id that mark what surrounds an article.
MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*"
    r"|comments?|comment-?\w+|replies|reply|respond|responses|disqus\w*|side-?bar\w*|menus?|nav|navbar|navigation"
    r"|footer|site-?footer|page-?footer|header|site-?header|page-?header|masthead|breadcrumbs?|share|sharing|social"
    r"|related|recommend\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|pager|pagination"
    r"|toolbar|widgets?|alert|skip-?link|search)(?![a-z])")
LAYOUT = re.compile(r"\b(?:with|has|no|without)-[\w-]+")
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+))", re.S)
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
LEVELS = 5       # ancestors that a paragraph's points reach


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Place after the bracket that closes a tag; brackets in quotes of any length don't.

    Where a quote stays open, or no bracket follows, the tag ends at the first bracket.  The
    quotes on such a way lead nowhere for later tags either; ``dead`` remembers them, so that
    no part of a page is looked through again and again.
    """
    place, met = at, []
    while found := STOP.search(html, place):
        if found[0] == ">":
            return found.end()
        if found.start() in dead:
            break
        met.append(found.start())
        place = html.find(found[0], found.end()) + 1
        if not place:
            break
    dead.update(met)
    return html.find(">", at) + 1 or len(html)


def _unwanted(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """(left out for what it is, left out for what its class or id says)."""
    if tag in LEFT_OUT or (tag == "header" and not inside_article):
        return True, False
    if not attributes.strip("/ >\n\t\r"):
        return False, False
    marked = hidden = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id"):
            marked |= bool(MARKS.search(LAYOUT.sub(" ", value)))
        elif name == "role":
            hidden |= value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
    return hidden, marked and tag not in ("article", "main", "body", "html")


class Page:
    """A page as a tree in lists: node i has a parent before it, and text runs hang on nodes."""

    def __init__(self, html: str):
        self.tag, self.parent = ["#root"], [-1]
        self.out, self.marked = [False], [False]     # left out for the element, for its class
        self.runs: list[tuple[int, int, bool, str]] = []     # (block number, node, in a link, text)
        self._read(html)
        n = len(self.tag)
        holds = [t in ("article", "main") for t in self.tag]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i]
        self.marked = [m and not h for m, h in zip(self.marked, holds)]

    def _read(self, html: str) -> None:
        stack, links, articles, block, at = [0], 0, 0, 0, 0
        runs, tags = self.runs, self.tag
        dead: set[int] = set()
        depths: defaultdict[str, list[int]] = defaultdict(list)    # of every open element, by name

        def close(depth: int) -> None:
            nonlocal links, articles
            for node in stack[depth:]:
                depths[tags[node]].pop()
                links -= tags[node] == "a"
                articles -= tags[node] == "article"
            del stack[depth:]

        def nearest(names: tuple[str, ...], stops: tuple[str, ...]) -> int:
            depth = max((depths[name][-1] for name in names if depths[name]), default=0)
            return depth if all(not depths[name] or depths[name][-1] <= depth for name in stops) else 0

        while True:
            found = TAG.search(html, at)
            text = html[at:found.start() if found else len(html)]
            if text:
                runs.append((block, stack[-1], links > 0, text))
            if not found:
                return
            at = found.end()
            slash, name = found.groups()
            if not name:
                continue
            at = _tag_end(html, at, dead)
            name, attributes = name.lower(), html[found.end():at]
            inline = name in INLINE
            if not inline:
                block += 1
            if slash:
                depth = nearest((name,), () if inline or name != "p" else ("table",))
                if depth:
                    close(depth)
                continue
            if name == "a" and links:
                close(nearest(("a",), ()))
            elif not inline and name != "br":
                depth = nearest(("p",), ("table", "button", "td", "th", "#root")) if stack[-1] and name not in VOID else 0
                if depth:
                    close(depth)
                if name in CLOSES:
                    own, stops = CLOSES[name]
                    depth = nearest((own, "td", "th") if own in ("td", "th") else (own,), stops)
                    if depth:
                        close(depth)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            if name in VOID:
                continue
            out, marked = _unwanted(name, attributes, articles > 0)
            self.parent.append(stack[-1]), tags.append(name), self.out.append(out), self.marked.append(marked)
            if not attributes.rstrip(">").endswith("/") or inline or name in TEXTUAL or name in ("div", "section", "article"):
                depths[name].append(len(stack))
                stack.append(len(tags) - 1)
                links += name == "a"
                articles += name == "article"

    def main_text(self, by_class: bool = True) -> str:
        parent, tag, n = self.parent, self.tag, len(self.tag)
        gone = [False] * n
        for i in range(1, n):
            gone[i] = gone[parent[i]] or self.out[i] or (by_class and self.marked[i])
        blocks: dict[int, list[str]] = {}
        owner: dict[int, int] = {}
        chars, linked = [0] * n, [0] * n
        carrier = list(range(n))    # the block element a node's text belongs to
        for i in range(1, n):
            if tag[i] in INLINE:
                carrier[i] = carrier[parent[i]]
        for block, node, in_link, text in self.runs:
            if gone[node]:
                continue
            text = unescape(text) if "&" in text else text
            size = len(text.strip())
            chars[node] += size
            linked[node] += size * in_link
            if block not in blocks:
                blocks[block], owner[block] = [], carrier[node]
            blocks[block].append(text)
        texts = {b: " ".join("".join(parts).split()) for b, parts in blocks.items()}
        texts = {b: t for b, t in texts.items() if t}
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
            linked[parent[i]] += linked[i]
        score = [0.0] * n
        for b, text in texts.items():
            node = owner[b]
            if tag[node] in HEADINGS:
                continue
            points = (1 if len(text) >= 25 else 0) + min(len(text) / 100, 3) + text.count(",")
            if tag[node] in TEXTUAL:
                node = parent[node]
            level = 0
            while node >= 0 and level < LEVELS:
                score[node] += points / (1, 2, 4, 8, 16)[level]
                node, level = parent[node], level + 1
        score = [s * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i, s in enumerate(score)]
        best = max(range(n), key=lambda i: (score[i], -i))
        if not score[best]:
            # No paragraphs: headings alone, if an article holds them.
            best = next((i for i in range(n) if tag[i] in ("article", "main") and chars[i] and not gone[i]), -1)
            if best < 0:
                return ""
        inside = best
        while inside > 0 and tag[inside] != "article":
            inside = parent[inside]
        if inside > 0:
            best = inside
        else:
            while parent[best] > 0 and tag[parent[best]] not in ("body", "html") and score[parent[best]] >= 0.75 * score[best]:
                best = parent[best]
        kept = {best}
        for i in range(1, n):
            if i != best and parent[i] == parent[best] and not gone[i] and chars[i]:
                density = linked[i] / chars[i]
                if score[i] >= max(10.0, 0.2 * score[best]) or (tag[i] == "p" and chars[i] > 80 and density < 0.25):
                    kept.add(i)
        within = [False] * n
        for i in range(n):
            lists = tag[i] in ("ul", "ol", "table", "div", "section") and chars[i] and linked[i] > 0.6 * chars[i]
            within[i] = i in kept or (i > 0 and within[parent[i]] and not (lists and i != best))
        return " ".join(t for b, t in texts.items() if within[owner[b]])


def main_text(html: str | None) -> str:
    """The article of a page; empty for null, for empty pages and for pages without text."""
    if not html:
        return ""
    page = Page(html)
    return page.main_text() or page.main_text(by_class=False)


def extract(frame: DataFrame, html: str) -> DataFrame:
    """Add the main text: ``row`` (the other columns), ``text`` and ``n_chars``.

    Paragraphs pass points for length and commas to their ancestors, less with every level;
    an ancestor's sum is discounted by its link density.  The best container, or the article
    element around it, is kept with those siblings that score well or are long paragraphs.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
    are left out by element, role, class or id before.  Pages are independent of each other;
    null and empty pages give an empty text, and an empty table an empty result.
    """
    text_batches(frame.sparkSession)
    kept = [c for c in frame.columns if c != html]
    names = [f"c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h.as_py()) for h in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), pa.array(found, pa.string())], [*names, "_text"])

    slim = frame.select(*[frame[f"`{c}`"].alias(n) for c, n in zip(kept, names)],
                        frame[f"`{html}`"].cast("string").alias("_html"))
    schema = slim.drop("_html").withColumn("_text", F.lit("")).schema
    return slim.mapInArrow(run, schema).select(
        F.struct(*[F.col(n).alias(c) for c, n in zip(kept, names)] or [F.lit(None).alias("_")]).alias("row"),
        F.col("_text").alias("text"), F.char_length("_text").cast("long").alias("n_chars"))
