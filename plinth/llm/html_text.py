"""The main text of web pages, by composite text density.

A page becomes a tree of its elements. What can't belong to the article is cut off first: elements whose tag or role
says menu, header, footer, sidebar, dialog or form, and what isn't text (scripts, styles). A class name or id alone decides only where all of its
words say so ("sidebar", "cookie-notice"); with other words in it ("related-work", "menu-of-the-day") what the element holds decides: links, lists of
links, fields of a form, a few words. Headings, headers with a heading inside an article, and field sets without fields stay.
An element of such a name that holds the main part of the page is a wrapper and stays:
it holds ``main``, or more characters outside links than all that isn't cut off (comments: an article besides).
Names such as "share" or "social" count only for elements with links or lists. Words after "has", "no", "with" and such in a name are not the element's.
Reader comments are also known by their shape: siblings of one kind, each with a writer or a date, after the article's text; a name that says reply or discussion
makes two of them enough, without one it takes three.
Then every element gets its density: characters per tag, the more lowered the more of the characters and tags
are links'. The element with the largest sum of its children's densities is the core
of the article. The lowest density on the way from there to the body is the threshold: parents are taken in as
long as they are the article element, or hold another child of that density.

Inside the chosen element nothing is dropped. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by two line ends.

A null or empty page, or one without text, gives an empty text. Rows are handled one by one: repeated rows
give equal texts, extra columns are ignored, very long pages are read in one pass.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import arrow_map, text_chunks

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)", re.S)
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
MARK = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "annotation", "canvas", "object", "video", "audio", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | {"math", "mfrac", "mi", "mn", "mo", "mover", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "munder", "munderover", "semantics"}
CUT = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Parts of class names and ids, in small letters.
CUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Never wrappers of a page.
STRICT = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "head"}
#: Names of lists of links, and also of what an article may be about: they count where there are links or lists.
WEAK = {"related", "share", "sharing", "social", "toolbar", "widget"}
LISTS = {"a", "button", "label", "li", "select"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TALK = {"comment", "comments", "disqus", "replies", "respond"}
#: The next word of a name is what an element has, lacks or does, not what it is.
ABOUT = {"has", "have", "no", "not", "with", "without", "hide", "hidden", "show"}
KEPT = {"html", "body", "article", "main"}
#: A start tag of the first kind ends an open element of the second, within the third.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NAME = re.compile(r"[a-z0-9]+")
#: Words of names around what readers write, and in those of a writer or a date.
TALKISH = TALK | {"discussion", "discussions", "feedback", "remarks", "reply", "response", "responses", "thread", "threads"}
SAID = {"ago", "author", "avatar", "by", "byline", "date", "datetime", "posted", "published", "time", "timestamp", "user", "username", "when", "writer"}
DATED = re.compile(r"\b(?:\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d+ (?:second|minute|hour|day|week|month|year)s? ago)\b|\b(?:says|wrote):", re.I)
TITLES = {"header", "masthead", "banner"}
FIELDS = {"input", "select", "textarea", "button"}
#: Characters: an element of a mixed name with fewer is a label; text before comments.
LABEL, BEFORE = 60, 100


class Element:
    __slots__ = ("chars", "cut", "density", "fields", "link_chars", "link_tags", "look", "parent", "parts", "plain", "strength", "tag", "tags", "words")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.cut, self.plain = 0.0, "", False
        #: The share of its name's words that say it is to be cut off; all words of its names; its kind among siblings; whether it holds fields.
        self.strength, self.words, self.look, self.fields = 0.0, frozenset(), "", False

    def children(self) -> Iterator[Element]:
        return (x for x in self.parts if isinstance(x, Element))


class Ends:
    """Where start tags of a page end. After the first one that ends nowhere outside quotes, the places of all
    quotes and ends are kept, and those that lead to no end, so that a page of such tags is no slower."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.marks: list[int] | None = None

    def of(self, at: int) -> int:
        """The end of the tag whose attributes begin ``at``: the first > outside quotes; if a quote is never
        closed, the first >; -1 if there is none."""
        if at > self.last:
            return -1
        if self.marks is None:
            end = ATTRIBUTES.match(self.page, at).end()
            if self.page[end : end + 1] == ">":
                return end
            self.marks = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.quotes = {q: [k for k in self.marks if self.page[k] == q] for q in "\"'"}
            self.dead: set[int] = set()
        tried, now = [], at
        while (k := bisect_left(self.marks, now)) < len(self.marks) and k not in self.dead:
            tried.append(k)
            if (mark := self.page[self.marks[k]]) == ">":
                return self.marks[k]
            same = self.quotes[mark]
            if (n := bisect_right(same, self.marks[k])) == len(same):
                break
            now = same[n] + 1
        self.dead.update(tried)
        return self.marks[next(k for k in range(bisect_left(self.marks, at), len(self.marks)) if self.page[self.marks[k]] == ">")]


def cut_off(e: Element, attributes: str) -> None:
    """Why an element may be cut off: "strict" (never a wrapper), "talk", "name", "weak"; empty if it isn't."""
    cut, e.strength, e.words = named(attributes)
    e.look = f"{e.tag} {' '.join(''.join(v) for kind, *v in MARK.findall(attributes) if kind.lower() == 'class')}" if attributes else e.tag
    e.plain = e.tag == "article" and cut != "talk"
    if e.tag in CUT:
        e.cut, e.strength = "strict" if e.tag in STRICT else "name", 1.0
    elif e.tag not in KEPT:
        e.cut = cut


def named(attributes: str) -> tuple[str, float, frozenset[str]]:
    """What the names of an element say, how much of a name says it, and all words of the names."""
    found, strength, words = "", 0.0, set()
    for kind, *values in MARK.findall(attributes) if attributes else ():
        for name in "".join(values).lower().split():
            every = NAME.findall(name)
            words.update(every)
            parts = {x for before, x in zip(["", *every], every, strict=False) if before not in ABOUT}
            if hit := parts & (ROLES if kind.lower() == "role" else CUT_NAMES):
                share = 1.0 if kind.lower() == "role" else len(hit) / len(set(every))
                of = "talk" if hit & TALK else "name" if hit - WEAK else "weak"
                if (of == "talk", of == "name", share) > (found == "talk", found == "name", strength):
                    found, strength = of, share
    return found, strength, frozenset(words)


def stays(e: Element, inside: bool, titled: bool, headed: bool, listed: bool) -> bool:
    """Whether an element that may be cut off by its tag or name holds what belongs to the text. ``inside`` an article; it holds a heading; a list."""
    share = e.link_chars / max(1, e.chars)
    if e.tag == "fieldset":
        return not e.fields
    if e.tag in CUT:
        return titled
    if e.tag in HEADINGS:
        return inside or e.strength < 1
    if e.strength >= 1 and not (inside and headed and e.words & TITLES and share < 0.5):
        return False
    if e.fields or share >= 0.5:
        return False
    if not inside or e.strength < 0.5:
        return e.strength < 0.5
    if e.cut == "talk":
        return not e.words & (TALK - {"comment"})
    return share < 0.3 and (e.chars >= LABEL or headed or listed)


def comments(body: Element) -> list[Element]:
    """What readers wrote, by its shape: siblings that look alike, each with a writer or a date, after text."""
    before, said, seen, order, todo = {}, set(), 0, [], [(body, 0)]
    while todo:
        x, _ = todo.pop()
        if isinstance(x, str):
            seen += len(" ".join(x.split()))
            continue
        before[x] = seen
        order.append(x)
        todo += [(part, 0) for part in reversed(x.parts)]
    for e in reversed(order):
        if e.tag == "time" or e.words & SAID or any(isinstance(x, str) and DATED.search(x) for x in e.parts) or any(x in said and x.tag not in ("article", "main") for x in e.children()):
            said.add(e)
    out = []
    for e in order:
        alike: dict[str, list[Element]] = {}
        for x in e.children():
            if x.tag not in INLINE and x.tag not in HEADINGS and x.tag != "p":
                alike.setdefault(x.look, []).append(x)
        for group in alike.values():
            talk = bool(e.words & TALKISH) + bool(group[0].words & TALKISH)
            enough = len(group) >= 3 - min(talk, 2)
            if enough and before[group[0]] >= BEFORE and all(x in said for x in group) and all(x.chars for x in group) and not any(x.tag in ("main", "tr", "li") and not talk for x in group):
                out += [e] if e.words & TALKISH and e.tag not in KEPT else group
    return out


def prune(body: Element) -> None:
    """Take out what is cut off, but for wrappers of the page's main part."""
    measure(body)
    for x in comments(body):
        x.cut, x.strength = x.cut or "talk", 1.0
    order, zone, linked, size = [], {body: None}, {body: False}, Counter()
    main, plain = [], set()  # elements cut off around a main; those around an article that isn't a comment
    todo = [body]
    above = {body: None}  # the nearest element cut off around one
    inside, weak, busy, titled, headed, listed = {body: False}, [], set(), set(), set(), set()  # in an article; with links; headers of an article; with a heading; with a list
    while todo:
        e = todo.pop()
        order.append(e)
        for x in e.parts:
            if isinstance(x, str):
                if not linked[e]:
                    size[zone[e]] += len(" ".join(x.split()))
                continue
            zone[x], linked[x] = x if x.cut else zone[e], linked[e] or x.tag == "a"
            inside[x] = inside[e] or e.tag in ("article", "main")
            if x.cut:
                above[x] = zone[e]
                if x.cut == "weak":
                    weak.append(x)
            if x.tag in LISTS:
                busy.add(zone[x])
            if x.tag in HEADINGS:
                headed.add(zone[x] if zone[x] is not x else zone[e])
                if zone[x] is not None and zone[x].tag == "header" and inside[zone[x]]:
                    titled.add(zone[x])
            if x.tag in ("ul", "ol", "dl", "table"):
                listed.add(zone[x])
            if x.tag == "main" and zone[x] is not None:
                main.append(zone[x])
            if x.plain:
                plain.add(zone[x])
            todo.append(x)
    if len(above) == 1:
        return

    def around(z: Element | None) -> list[Element]:
        out = []
        while z is not None:
            if z.cut:
                out.append(z)
            z = above[z]
        return out

    def spare(elements: list[Element]) -> None:
        for z in elements:
            z.cut = ""
            size[None] += size[z]

    for z in list(busy):
        busy.update(around(z))
    idle = {z for z in weak if z not in busy}
    for z in weak:
        z.cut = "name"
    for z in order:
        if z.cut and (z in idle or stays(z, inside[z], z in titled, z in headed, z in listed)):
            z.cut, a = "", above[z]
            while a is not None and not a.cut:
                a = above[a]
            size[a] += size.pop(z, 0)
    for z in main:
        if all(x.cut != "strict" for x in around(z)):
            spare(around(z))
    for z in sorted((z for z in above if z is not body), key=lambda z: -size[z]):
        if size[z] <= size[None]:
            break
        path = around(z)
        if z.cut and all(x.cut == "name" or (x.cut == "talk" and z in plain) for x in path):
            spare(path)
    for e in order:
        if any(isinstance(x, Element) and x.cut for x in e.parts):  # blocks before and after one that is cut off stay apart
            parts = ((None if x.tag not in INLINE else "") if isinstance(x, Element) and x.cut else x for x in e.parts)
            e.parts = [x for x in parts if x != ""]


def tree(page: str) -> Element:
    """The body's element; ``cut`` tells what is to be cut off."""
    root = now = Element("body", None)
    open_tags, opened = ["body"], Counter(["body"])
    at = 0

    def close(n: int) -> None:
        nonlocal now
        for _ in range(n):
            opened[open_tags.pop()] -= 1
            if now.parent is not None:
                now = now.parent

    def text(part: str) -> None:
        if part:
            now.parts.append(html.unescape(part))

    def depth(of: set[str], within: set[str] = frozenset()) -> int:
        """How many elements to close until one of these is closed; 0 if none is open, or not within."""
        for n in range(1, len(open_tags)):
            if open_tags[-n] in of:
                return n
            if open_tags[-n] in within:
                break
        return 0

    ends = Ends(page)
    last = max(ends.last, page.rfind("<!--"))
    for m in iter(lambda: TOKEN.search(page, at) if at <= last else None, None):
        stop = ends.of(m.end()) if m[2] else m.end() - 1
        if stop < 0:
            text(page[at : m.end()])
            at = m.end()
            continue
        text(page[at : m.start()])
        at = stop + 1
        end, start, attributes = (m[1] or "").lower(), (m[2] or "").lower(), page[m.end() : stop]
        if start in FIELDS:
            now.fields = True
        if end:
            if end not in ("body", "html") and opened[end]:
                close(depth({end}))
        elif start in RAW and not attributes.endswith("/"):
            stop = re.compile(rf"</{start}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            text(" ")
        elif start in VOID or (start in RAW):
            text("\n" if start in ("br", "hr") else " " if start in RAW else "")
        elif start in ("html", "body"):
            close(depth({"head"}) if opened["head"] else 0)
        elif start:
            if start not in INLINE and opened["p"]:
                n = depth({"p"})
                if all(t in INLINE for t in open_tags[len(open_tags) - n + 1 :]):
                    close(n)
            if start in ENDS and any(opened[t] for t in ENDS[start][0]):
                close(depth(*ENDS[start]))
            open_tags.append(start)
            opened[start] += 1
            child = Element(start, now)
            cut_off(child, attributes)
            now.parts.append(child)
            now = child
    text(page[at:])
    return root


def measure(body: Element) -> list[Element]:
    """Counts and densities of all elements, children before parents."""
    order, todo = [], [body]
    while todo:
        e = todo.pop()
        e.chars = e.tags = e.link_chars = e.link_tags = 0
        e.density = 0.0
        order.append(e)
        todo += e.children()
    for e in reversed(order):
        for x in e.parts:
            if isinstance(x, str):
                e.chars += len(" ".join(x.split()))
            elif x is not None:
                e.chars += x.chars
                e.tags += x.tags + 1
                e.link_chars += x.link_chars
                e.link_tags += x.link_tags + (x.tag == "a")
                e.fields = e.fields or x.fields
        if e.tag == "a":
            e.link_chars = e.chars
    share = body.link_chars / max(1, body.chars)
    for e in order:
        if e.chars:
            tags, links, link_tags = max(1, e.tags), max(1, e.link_chars), max(1, e.link_tags)
            base = math.log(e.chars / max(1, e.chars - e.link_chars) * e.link_chars + share * e.chars + math.e)
            e.density = max(0.0, e.chars / tags * math.log(max(1.0, e.chars / links * tags / link_tags)) / math.log(max(base, 1 + 1e-9)) if base > 1 + 1e-9 else e.chars / tags * math.log(max(1.0, e.chars / links * tags / link_tags)))
    return order[::-1]


def article(body: Element) -> Element:
    elements = measure(body)
    total = lambda e: sum(x.density for x in e.children() if x.tag not in INLINE) + sum(len(" ".join(x.split())) for x in e.parts if isinstance(x, str))
    core = max(reversed(elements), key=total)
    path, e = [core], core
    while e.parent is not None:
        e = e.parent
        path.append(e)
    threshold = min(x.density for x in path)
    chosen = core
    for below, above in zip(path, path[1:], strict=False):
        if above.tag in ("article", "main") or below.tag in INLINE or any(x is not below and x.density >= threshold and x.chars for x in above.children()):
            chosen = above
    return chosen


def blocks(e: Element) -> str:
    out, line = [], []

    def flush() -> None:
        if words := " ".join("".join(line).split()):
            out.append(words)
        line.clear()

    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            flush()
        elif x.tag in INLINE:
            todo += reversed(x.parts)
        else:
            flush()
            todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n\n".join(out)


def main_text(page: str) -> str:
    body = tree(page)
    prune(body)
    return blocks(article(body))


def extract(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` string and ``n_chars`` long (its code points) for each row."""
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep)).fill_null("")
            for a, b in text_chunks(column):
                texts = [main_text(x) for x in column[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(len(keep))), pa.array(texts, pa.string())], [*keep, "text"])

    return arrow_map(pages.select(*keep, html_col), run, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))
