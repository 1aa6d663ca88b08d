"""Main text of HTML pages by tree scoring.

Paragraph-like blocks give points for length and commas to their ancestors (all
to the parent, half to the grandparent, then less); a container's points are
discounted by its link density.  The text of the best container and of its
related siblings is kept, in page order.  Text that lies directly in a container
counts as a paragraph of it.

Comments and raw elements are cut out first, in one pass, and what follows the
last ``>`` is text, so that the time grows with the page.  Marked sections and
unknown declarations are comments.  A form, or a part named after search or a
widget, is left out unless it wraps the article: holds a ``main``, an ``article``
with the page's ``h1``, or more than half of the page's text.

Null, empty and text-less pages give an empty text.  Repeated rows get equal
results; extra columns pass through.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style noscript template head title nav header footer aside button select textarea iframe svg "
           "object canvas menu dialog".split())
IN_HEAD = set("head title meta link script style base noscript template html".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr "
            "html li main ol p pre section summary table tbody td tfoot th thead tr ul br".split())
PARAGRAPH = set("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSES_P = BLOCK - {"br", "html", "body"}
# Class, id and role words of parts that are not the article.
BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ad(?!-hoc)|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|disqus|"
                         r"footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|"
                         r"replies|share|sharing|sidebar|social|sponsor\w*|subscribe|complementary|"
                         r"contentinfo)(?=$|[\s_-])", re.I)
WRAPPER = re.compile(r"(?:^|[\s_-])(?:search|widget|modal|toolbar)(?=$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?=$|[\s_-])", re.I)
RAW = re.compile(r"<!--|<(script|style|textarea|title)(?=[\s/>])", re.I)
SPACES = re.compile(r"\s+")
#: Characters from which text directly in a container counts as a paragraph.
LEAST_RUN = 25


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "wraps", "points", "chars", "linked")

    def __init__(self, tag, parent, skip, wraps=False):
        self.tag, self.parent, self.skip, self.wraps = tag, parent, skip, wraps
        self.children, self.points, self.chars, self.linked = [], 0.0, 0, 0


class Tree(HTMLParser):
    """Element tree; an end tag closes up to its element, a block closes an
    open paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open = {"html": 1}

    def _pop(self):
        self.open[self.at.tag] -= 1
        self.at = self.at.parent

    def parse_marked_section(self, i, report=1):
        end = self.rawdata.find("]]>" if self.rawdata.startswith("<![CDATA[", i) else ">", i)
        return self.rawdata.find(">", max(end, i)) + 1 or -1

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.open.get(tag):
            return
        if self.open.get("head") and tag not in IN_HEAD:
            self._close("head")  # its end tag may be left out
        if tag in CLOSES_P and self.open.get("p"):
            self._close("p")
        if tag == "li" and self.at.tag == "li":
            self._pop()
        label = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        named = HEADER.sub(" ", label) if tag in HEADINGS else label
        skip = tag in SKIP or hidden or (tag not in ("body", "article", "main") and bool(BOILERPLATE.search(named)))
        if tag == "header" and self.at.tag in ("article", "main"):
            skip = hidden
        wraps = tag == "form" or (tag not in ("body", "article", "main") and bool(WRAPPER.search(named)))
        node = Node(tag, self.at, self.at.skip or skip, wraps)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self._pop()

    def handle_endtag(self, tag):
        if self.open.get(tag):
            self._close(tag)

    def _close(self, tag):
        while self.at.tag != tag:
            self._pop()
        if self.at.parent is not None:
            self._pop()

    def handle_data(self, data):
        if not self.at.skip:
            self.at.children.append(data)


def _walk(node: Node):
    """Elements below a node in page order, without recursion."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node) and not c.skip]


def _cut_raw(html: str) -> str:
    """A page without comments and raw elements; what follows the last ``>`` can
    hold no whole tag."""
    out, at = [], 0
    while m := RAW.search(html, at):
        out.append(html[at:m.start()])
        if m.group(1):
            end = re.compile(f"</{m.group(1)}(?=[\\s/>])[^>]*>", re.I).search(html, m.end())
            at = end.end() if end else len(html)
        else:
            end = html.find("-->", m.start() + 2)  # <!--> is a whole comment
            at = end + 3 if end >= 0 else len(html)
    html = "".join([*out, html[at:]])
    last = html.rfind(">") + 1
    return html[:last] + html[last:].replace("<", "&lt;")


def _drop_wrappers(root: Node) -> None:
    """Skip the forms and the like that do not wrap the article."""
    nodes = list(_walk(root))
    if not any(n.wraps for n in nodes):
        return
    chars, tags = {}, {}
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, Node) and not c.skip]
        chars[n] = sum(len(c.strip()) for c in n.children if isinstance(c, str)) + sum(chars[k] for k in kids)
        tags[n] = {n.tag} & {"main", "article", "h1"}
        tags[n].update(*[tags[k] for k in kids])
    for n in nodes:
        if n.wraps and not ("main" in tags[n] or {"article", "h1"} <= tags[n] or 2 * chars[n] > chars[root]):
            n.skip = True


def _score(root: Node) -> list[Node]:
    _drop_wrappers(root)
    nodes = list(_walk(root))
    for n in reversed(nodes):  # children before parents
        own = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        kids = [c for c in n.children if isinstance(c, Node) and not c.skip]
        n.chars = own + sum(k.chars for k in kids)
        n.linked = n.chars if n.tag == "a" else sum(k.linked for k in kids)
    for n in nodes:
        run = "".join(c for c in n.children if isinstance(c, str)) if n.tag not in PARAGRAPH else ""
        direct = n.tag in BLOCK and len(run.strip()) >= LEAST_RUN
        if n.chars and (n.tag in PARAGRAPH or direct):
            own = SPACES.sub(" ", run if direct else "".join(_inline(n)))
            gain = (1 + own.count(",") + min(len(own) / 100, 3)) * (1 - n.linked / n.chars)
            up, share = n if direct else n.parent, 1.0
            for level in range(4):
                if up is None:
                    break
                up.points += gain * share
                up, share = up.parent, (0.5 if level == 0 else share / 2)
    return nodes


def _inline(node: Node):
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            yield c
        elif not c.skip:
            todo += reversed(c.children)


def _blocks(node: Node) -> list[str]:
    """White-space-normalised block texts in page order."""
    out, run = [], []

    def flush():
        text = SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo = [node]
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            run.append(c)
        elif not c.skip:
            if c.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(c.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    tree = Tree()
    tree.feed(_cut_raw(html or ""))
    tree.close()
    nodes = _score(tree.root)
    value = lambda n: n.points * (1 - n.linked / n.chars) if n.chars else 0.0
    best = max(nodes, key=value)
    if value(best) <= 0:
        best = tree.root
    while best.parent is not None and best.tag in PARAGRAPH | {"ul", "ol", "tbody", "tr", "table", "b", "strong", "em", "i", "span"}:
        best = best.parent  # the container, not one of its lists or runs
    for up in _ancestors(best):
        if up.tag in ("article", "main"):
            best = up
            break
    if best.parent is None:
        return " ".join(_blocks(best))
    bar = 0.2 * value(best)
    keep = []
    for c in best.parent.children:
        if c is best:
            keep += _blocks(c)
        elif isinstance(c, Node) and not c.skip and c.chars:
            density = c.linked / c.chars
            if c.tag not in ("ul", "ol") and (value(c) >= bar or c.tag in HEADINGS or (c.tag == "p" and (not c.linked or (c.chars > 80 and density < 0.25)))):
                keep += _blocks(c)
    return " ".join(keep)


def _ancestors(node: Node):
    while node is not None:
        yield node
        node = node.parent


def extract(html: Column) -> Column:
    @F.pandas_udf("string")
    def udf(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in pages], dtype=object)
    return udf(html)
