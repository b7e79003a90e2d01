"""HTML extraction by tree scoring.

The page is scanned once into a tree of containers and text blocks. Menus, headers, footers, sidebars, notices, adverts, forms
and comments are cut off by tag, role or class name. Every remaining block passes points to the containers above it: one, plus
one a comma, plus one each 100 characters (three at most), all of it to its parent and half, a third, ... to those further
up, as far as ANCESTORS. A container's points are discounted by its link density, and the best one wins; where it lies inside
an article or main element that is not full of links, that whole element is the text. Else text beside the winner joins it
unless it is full of links, and so do sibling containers that score or read well enough. The text is all blocks of what is
kept, in page order.

Scanning is linear in the page, whatever its tags: every quote and every open tag is looked at a bounded number of times.

Defined cases: null or empty html gives an empty text; unclosed, crossed and cut-off tags end where their container ends; text
outside any tag counts as a block of the body; pages are judged one by one, so repeated rows, null ids and ties need no rule
(of equal containers the first wins); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import ship, small_batches

#: Tags of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
CUT = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "math", "head", "fieldset", "label"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "blockquote", "body", "center", "dd", "details", "div", "dl", "figure", "header", "hgroup", "html", "main", "ol", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Block starts that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS | CUT
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Words in class and id names of parts that are no article, and of parts that are.
POOR = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|related|recommended|replies|reply|respond|share|sharing|shoutbox|sidebar|side|signup|social|subscribe|tags?|toolbar|topbar|widgets?|site-header|page-header)(?=$|[\s_-])", re.I)
GOOD = re.compile(r"article|body|content|entry|hentry|main|page-text|post|story|text", re.I)
SPECIAL, ANGLE = re.compile("[>\"']"), re.compile("[<>]")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Containers above a block that get points from it, and the link density from which text counts as links.
ANCESTORS, LINKED = 32, 0.33


class Node:
    """A container: its points, text and link lengths, and its blocks (text, linked characters) and containers in page order."""

    __slots__ = ("tag", "above", "points", "length", "linked", "inside", "lift")

    def __init__(self, tag: str, above: Node | None, lift: float):
        self.tag, self.above, self.points, self.length, self.linked, self.inside, self.lift = tag, above, 0.0, 0, 0, [], lift


class Scanner:
    """Tags and the text between them."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.ends: dict[int, int] = {}  # opening quote -> where the tag that it lies in ends, -1 if nowhere
        self.seen = (0, -1)  # from the first place to the second there is no special character

    def _special(self, at: int) -> int:
        """The next >, \" or ' from a place, or the page's end."""
        if not self.seen[0] <= at <= self.seen[1]:
            m = SPECIAL.search(self.page, at)
            self.seen = (at, m.start() if m else self.size)
        return self.seen[1]

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name begins at a place ends, quoted parts skipped; -1 if nowhere."""
        passed, end = [], -1
        while (at := self._special(at)) < self.size:
            if self.page[at] == ">":
                end = at + 1
                break
            if at in self.ends:
                end = self.ends[at]
                break
            passed.append(at)
            at = self.page.find(self.page[at], at + 1) + 1
            if not at:
                break
        for quote in passed:
            self.ends[quote] = end
        return end

    def tokens(self) -> Iterator[tuple[int, int, bool]]:
        """Begin, end, and whether it is a tag, of each piece; comments and declarations are left out."""
        page, size, at, text = self.page, self.size, 0, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                close = "-->" if page[at + 2] == "-" else "]]>"
                stop = page.find(close, at + 4)
                stop, tag = (stop + 3 if stop >= 0 else size), False
            elif page[at + 1 : at + 2] in ("!", "?"):
                stop = page.find(">", at)
                stop, tag = (stop + 1 if stop >= 0 else size), False
            elif NAME.match(page, at):
                stop, tag = self._tag_end(at + 1), True
                if stop < 0:
                    # an unclosed quote: the tag ends at the next >, and at the page's end if that cuts it off; else it is text
                    m = ANGLE.search(page, at + 1)
                    if m and m.group() == "<":
                        at = m.start()
                        continue
                    stop = m.end() if m else size
            else:
                at += 1
                continue
            if text < at:
                yield text, at, False
            if tag:
                moved = yield at, stop, True
                if moved is not None:
                    stop = moved
            at = text = stop
        if text < size:
            yield text, size, False


def _cut(tag: str, attributes: dict[str, str], within_article: bool) -> bool:
    if tag in CUT or (tag == "header" and not within_article):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(POOR.search(attributes.get(k, "")) for k in ("class", "id"))


def parse(page: str) -> Node:
    """The tree of a page, without the parts that are cut."""
    root = here = Node("html", None, 0.0)
    nodes = [root]
    stack: list[tuple[str, Node | None]] = []  # open tags; a container's own node, else None
    everywhere: Counter[str] = Counter()  # open tags by name
    scopes: list[Counter[str]] = [Counter()]  # those since the last open container or cut part
    parts: list[str] = []
    linked, in_link, skip = 0, 0, 0  # skip: depth of the stack at which the cut part began, plus one

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not skip:
            plain = entities.unescape(raw)
            parts.append(plain)
            if in_link:
                linked += len(plain.strip())

    def close_block() -> None:
        nonlocal linked
        if parts:
            found = " ".join("".join(parts).split())
            if found:
                here.inside.append((found, linked))
                points = (1 + found.count(",") + min(len(found) // 100, 3)) * (1 - min(1.0, linked / len(found)))
                here.length += len(found)
                here.linked += linked
                node, depth = here, 1
                while node is not None and depth <= ANCESTORS:
                    node.points += points / depth
                    depth, node = depth + 1, node.above
            parts.clear()
        linked = 0

    def enter(tag: str, node: Node | None) -> None:
        stack.append((tag, node))
        everywhere[tag] += 1
        if tag in CONTAINERS or tag in CUT:
            scopes.append(Counter())
        else:
            scopes[-1][tag] += 1

    def leave(tags) -> None:
        """Close the innermost open tag of these, and all inside it."""
        nonlocal here, in_link, skip
        depth = len(stack)
        while stack[depth - 1][0] not in tags:
            depth -= 1
        depth -= 1
        blocks = any(x in BLOCKS for x, _ in stack[depth:])
        if not skip and blocks:
            close_block()
        while len(stack) > depth:
            tag, node = stack.pop()
            everywhere[tag] -= 1
            if tag in CONTAINERS or tag in CUT:
                scopes.pop()
            else:
                scopes[-1][tag] -= 1
            if tag == "a":
                in_link = max(0, in_link - 1)
            if node is not None and not skip:
                here = node.above or root
        if skip and len(stack) < skip:
            skip = 0

    scan = Scanner(page).tokens()
    moved = None
    while True:
        try:
            begin, end, is_tag = next(scan) if moved is None else scan.send(moved)
        except StopIteration:
            break
        moved = None
        if not is_tag:
            text(page[begin:end])
            continue
        token = page[begin:end]
        tag, closing = NAME.match(token).group(1).lower(), token[1] == "/"
        if closing:
            # a stray end tag inside a cell or container does not close what lies outside
            if (everywhere if tag in CONTAINERS or tag in CUT else scopes[-1])[tag]:
                leave((tag,))
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, end)
            stop = page.find(">", close.start()) if close else -1
            moved = stop + 1 if stop >= 0 else len(page)
            continue
        if tag in ("br", "hr", "wbr"):
            if tag != "wbr":
                text(" ")
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            ended = [x for x in ("p", "li") if scopes[-1][x] and (x == "p" or tag == "li")]
            if ended:
                leave(ended)
        if skip:
            enter(tag, None)
            continue
        if tag in BLOCKS or tag in CUT:
            close_block()
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token)} if " " in token or "\n" in token else {}
        if _cut(tag, attributes, bool(everywhere["article"] or everywhere["main"])):
            close_block()
            enter(tag, None)
            skip = len(stack)
        elif tag in CONTAINERS:
            lift = 10.0 if tag in ("article", "main") or any(GOOD.search(attributes.get(k, "")) for k in ("class", "id")) else 0.0
            here = Node(tag, here, lift)
            nodes.append(here)
            here.above.inside.append(here)
            enter(tag, here)
        else:
            enter(tag, None)
            in_link += tag == "a"
    close_block()
    for node in reversed(nodes):  # those inside come after those around them
        if node.above is not None:
            node.above.length += node.length
            node.above.linked += node.linked
    return root


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.length) if node.length else 0.0


def _score(node: Node) -> float:
    return (node.points + node.lift) * (1 - _density(node)) if node.length else 0.0


def _blocks(node: Node, out: list[str]) -> None:
    pending = [iter(node.inside)]
    while pending:
        for x in pending[-1]:
            if isinstance(x, tuple):
                out.append(x[0])
            else:
                pending.append(iter(x.inside))
                break
        else:
            pending.pop()


def _joins(x: Node, enough: float) -> bool:
    """Whether a container beside the best one belongs to the text: it scores well, or reads as a sentence."""
    if _density(x) >= LINKED:
        return False
    if _score(x) >= enough:
        return True
    text: list[str] = []
    _blocks(x, text)
    return any(len(t) >= 40 and t[-1] in ".!?" for t in text)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by single spaces."""
    if not page:
        return ""
    root = parse(page)
    best, nodes = root, [root]
    for node in nodes:
        nodes.extend(x for x in node.inside if not isinstance(x, tuple))
        if _score(node) > _score(best):
            best = node
    around, whole = best, None
    while around is not None:
        if around.tag in ("article", "main") and _density(around) < 0.5 and (whole is None or whole.tag != "article"):
            whole = around
        around = around.above
    best = whole or best
    out: list[str] = []
    if best.above is None or whole:
        _blocks(best, out)
        return " ".join(out)
    enough = max(10.0, 0.2 * _score(best))
    for x in best.above.inside:
        if isinstance(x, tuple):
            if x[1] <= LINKED * len(x[0]):
                out.append(x[0])
        elif x is best or _joins(x, enough):
            _blocks(x, out)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
