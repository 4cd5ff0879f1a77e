"""Operator 1: the main text of HTML pages, by scoring the element tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackyard.llm import scratch

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start a block of text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never text of an article.
SKIP = frozenset("script style noscript template head title nav footer header aside button select input textarea iframe object embed svg math canvas audio video dialog menu search map".split())
#: Elements whose text the parser takes as it is, up to their end tag.
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
#: Words in class, id or role that mark what is no article.
JUNK = frozenset("ad ads advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs combx comment comments commentary discussion disqus replies reply respond cookie cookies consent gdpr notice notices notification alert disclaimer copyright footer foot header masthead menu nav navbar navigation navigational topbar pager pagination paging popup popover modal overlay promo promos promoted promotion related recommended recommendations remark remarks rss share sharing shares shoutbox sidebar sidebars aside skyscraper social sponsor sponsored sponsors subscribe subscription newsletter signup login search tags tagcloud toolbar tools widget widgets outbrain taboola complementary contentinfo toc skip".split())
#: Words that mark an article, which outweigh those above unless they are about readers' comments.
GOOD = frozenset("article articlebody body content contents entry main story post text hentry".split())
READERS = frozenset("comment comments discussion disqus replies reply respond shoutbox".split())
#: Words of those above that may as well be the topic of a part: alone in a class or id they leave out a part without prose only. Of them, those that may be about readers, unless what is in it tells of some.
TOPIC = frozenset("discussion remark remarks related share sharing social tags tools".split())
TALK = frozenset("discussion remark remarks".split())
#: Words in such a part, and an element, that tell of readers.
VOICES = frozenset("avatar commenter poster replies reply respond timestamp upvote username vote votes".split())
#: Parts of such words that tell as well where words are run together.
JUNK_PART = re.compile("comment|disqus|sidebar|cookie|newsletter|advert|sponsor|breadcrumb|navbar|popup")
#: Words of layout, which may stand beside junk words in an id; with others an id is the slug of a heading.
LAYOUT = frozenset("area block box bar bottom col column container content div fixed form inner item items js left links list main outer page panel posts right row section site top wrap wrapper".split())
#: Further words that say nothing where they stand beside junk words in one name; with others, as in share-price, the name is about something else.
FILLER = frozenset("article articles body button buttons card cards content entry feed grid group header heading hero holder icon icons img latest link media module more news posts read story stories slot sticky strip tab tabs text title top unit view wide zone".split())
#: Elements that a word may leave out: containers, no headings, paragraphs or parts of a line.
CONTAINER = frozenset("address center dd details div dl dt fieldset figure hgroup legend li ol section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element: what they end, and where the search for it stops.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tr", "tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements of lists and tables, which these searches pass from one to the next.
FRAME = frozenset(t for what, stop in ENDS.values() for t in what + stop)
#: Elements that keep an end tag inside them from ending elements outside.
SCOPE = frozenset("html body table td th article section div main aside nav header footer form ul ol blockquote".split())
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article".split())
_CUT = re.compile(r"[^0-9A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its tag, whether it is left out, and its children, elements and strings in page order."""

    __slots__ = ("tag", "up", "kids", "skip", "score", "size", "linked", "commas", "own", "inside", "block", "frame", "talk")

    def __init__(self, tag: str, up: Node | None, skip: int = 0):
        self.tag, self.up, self.skip = tag, up, skip
        #: What the element is in, itself included, as bits; the nearest block and the nearest element of a list or table, so that no search climbs through others.
        self.inside = up.inside if up else 0
        self.block = self if up is None or tag in BLOCK else up.block
        self.frame = self if up is None or tag in FRAME else up.frame
        #: The outermost part around it that may be readers' talk.
        self.talk = up.talk if up else None
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.size = self.linked = self.commas = self.own = 0


#: An element is left out for sure, by the words in its attributes unless it turns out to hold the page, or as readers' comments unless it holds the article; a doubtful one if it holds no prose; a form unless it is
#: a wrapper of the article.
SURE, MARKED, READER, DOUBT, FORM = 1, 2, 3, 4, 5
#: Bits of ``inside``: an article, a header of it, a doubtful element.
ARTICLE, HEADER, WEAK = 1, 2, 4


def _compound(token: str) -> bool:
    """Whether a name of several words has one that is neither junk nor filler: share-price is about prices."""
    words = [w.lower() for w in _CUT.split(token) if w]
    known = lambda w: w in JUNK or w in LAYOUT or w in FILLER or w in GOOD or len(w) < 3 or w.isdigit()
    return len(words) > 1 and not all(map(known, words)) and not JUNK_PART.search(token.lower())


def _reader(words: set[str]) -> bool:
    return bool(words & READERS and words != words & TALK) or any(w.startswith("comment") and not w.startswith("commenta") for w in words)


def _left_out(tag: str, attributes: list[tuple[str, str | None]]) -> int:
    if tag in SKIP:
        return SURE
    if tag == "form":
        return SURE if any(name in ("hidden", "inert") for name, _ in attributes) else FORM
    if tag in ("html", "body", "article", "main"):
        return 0
    words: set[str] = set()
    doubtful: set[str] = set()
    slug: set[str] = set()
    for name, value in attributes:
        if name in ("hidden", "inert") or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
            return SURE
        if name in ("class", "id", "role", "itemprop") and value:
            for token in value.split():
                (slug if name == "id" else doubtful if _compound(token) else words).update(w.lower() for w in _CUT.split(token) if w)
    if tag not in CONTAINER:
        return 0
    # Ids of sections are slugs of their headings, as are ids with words that are neither junk nor layout.
    section = tag == "section" or "section" in words
    known = lambda w: w in JUNK or w in LAYOUT or w in GOOD or w.isdigit() or JUNK_PART.search(w)
    if all(map(known, slug)) and not (section and len(slug) == 1 and not any(map(JUNK_PART.search, slug))):
        words |= slug
    if words and words <= TOPIC:
        return DOUBT
    if _reader(words):
        return READER
    if words and not words & GOOD and (words & JUNK or JUNK_PART.search(" ".join(words))):
        return MARKED
    return DOUBT if doubtful & JUNK and not words & GOOD else 0


class Tree(HTMLParser):
    """A forgiving tree builder: missing end tags are supplied, stray ones ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.open: dict[str, int] = {}
        self.marked: list[Node] = []
        self.doubtful: list[Node] = []
        self.headers: list[Node] = []
        self.heads: list[Node] = []
        self.articles: list[Node] = []
        self.forms: list[Node] = []

    def _close_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.up
        if node.up:
            self.open[node.tag] -= 1
            self.at = node.up

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") or tag == "form" and self.open.get("form"):
            return  # html and body are the root; a form in a form is none
        if tag in BLOCK:
            node = self.at.block
            if node.tag == "p":
                self._close_to(node)
        if tag in ENDS:
            what, stop = ENDS[tag]
            node = self.at.frame
            while node.up and node.tag not in stop:
                if node.tag in what:
                    self._close_to(node)
                node = node.up.frame
        if tag in VOID:
            if tag == "br":
                self.at.kids.append(" ")
            elif tag == "hr":
                self.at.kids.append(Node("hr", self.at))
            return
        new = Node(tag, self.at, _left_out(tag, attrs))
        self._hear(new, attrs)
        self.at.kids.append(new)
        self.at = new
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in ("article", "main"):
            new.inside |= ARTICLE
        elif tag == "header" and new.inside & ARTICLE:
            if not new.inside & HEADER:
                self.headers.append(new)
            new.inside |= HEADER
        if new.skip == DOUBT:
            new.skip = 0
            new.inside |= WEAK
            self.doubtful.append(new)
        if new.skip in (MARKED, READER):
            self.marked.append(new)
        elif new.skip == FORM:
            self.forms.append(new)
        if tag in ("h1", "main"):
            self.heads.append(new)
        elif tag == "article":
            self.articles.append(new)

    def _hear(self, new: Node, attrs: list[tuple[str, str | None]]) -> None:
        """A part named by one word of talk starts here; or what starts tells that the part around it is talk of readers."""
        words = {w.lower() for name, value in attrs if name in ("class", "id") and value for w in _CUT.split(value) if w}
        part = new.talk
        if part is not None and not part.skip and (new.tag == "textarea" or new.skip == READER or words & VOICES or any(w.startswith("comment") and not w.startswith("commenta") for w in words)):
            part.skip = READER
            self.marked.append(part)
        if part is None and new.skip == DOUBT and words & TALK:
            new.talk = new

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):  # others ignore the slash
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        node = self.at
        while node.up and node.tag != tag:
            if node.tag in SCOPE and tag not in SCOPE:
                return
            node = node.up
        if node.up and node.tag == tag:
            self._close_to(node)

    def handle_data(self, data):
        self.at.kids.append(data)


def _measure(root: Node) -> list[Node]:
    """Sizes of all elements that stay, in page order; text in links counts as linked."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.size = node.linked = node.commas = node.own = 0
        order.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.skip)
    for node in reversed(order):
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(" ".join(kid.split()))
                node.own += n
                node.size += n
                node.commas += kid.count(",") + kid.count("、") + kid.count("，")
            elif not kid.skip:
                node.size += kid.size
                node.linked += kid.linked
                node.commas += kid.commas
                if kid.tag not in BLOCK:
                    node.own += kid.own
        if node.tag == "a":
            node.linked = node.size
    return order


def _text_sizes(root: Node) -> dict[Node, int]:
    """Characters under each element, without parts that are left out for sure."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in node.kids if not isinstance(k, str))
    sizes: dict[Node, int] = {}
    for node in reversed(order):
        sizes[node] = sum(len(" ".join(k.split())) if isinstance(k, str) else 0 if k.skip in (SURE, READER) else sizes[k] for k in node.kids)
    return sizes


def _holders(tree: Tree) -> set[Node]:
    """Elements around the article: above a main heading, a main element or the only article of the page, none of them in parts left out for sure."""
    out: set[Node] = set()
    lost: set[Node] = set()
    for node in tree.heads + (tree.articles if len(tree.articles) == 1 else []):
        above = []
        while node is not None and node.skip != SURE and node not in out and node not in lost:
            above.append(node)
            node = node.up
        (out if node is None or node in out else lost).update(above)
    return out


def keep_forms(tree: Tree) -> None:
    """A form around the article is a wrapper, as on pages that are one form: it stays, and its controls go as they do anywhere.

    It is one if a paragraph in it is long enough to score and has few links, and it holds the main heading or the only article, or more than three fifths of the page's text.
    """
    if not tree.forms:
        return
    holders, sizes = _holders(tree), _text_sizes(tree.root)
    for form in tree.forms:
        around = form in holders or 5 * sizes[form] > 3 * sizes[tree.root]
        if around and any(n.tag in PARAGRAPH and n.own >= 25 and _density(n) <= 1 / 3 for n in _measure(form)):
            form.skip = 0


def keep_wrappers(tree: Tree) -> None:
    """A marked element is a wrapper, not a part to leave out, if it holds the article; of comments that is enough.

    Of others it must hold three fifths of the page's text too, and may be without the article where nothing outside marked elements scores.
    """
    if not tree.marked:
        return
    holders = _holders(tree)
    for node in tree.marked:
        if node.skip == READER and node in holders:
            node.skip = 0
    every = _text_sizes(tree.root)
    sizes = [(every[node], node) for node in tree.marked if node.skip == MARKED]
    if max((n for n, _ in sizes), default=0) < 200:
        return
    page = every[tree.root]
    scores = any(n.tag in PARAGRAPH and n.own >= 25 for n in _measure(tree.root))
    for n, node in sizes:
        if 5 * n > 3 * page and (node in holders or not scores):
            node.skip = 0


def keep_headings(tree: Tree) -> None:
    """Of a header inside an article its headings stay: they are the article's."""
    for header in tree.headers:
        found, todo = [], [header]
        while todo:
            node = todo.pop()
            if node is not header and (node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not node.skip):
                found.append(node)
            elif node is header or node.tag == "header" or not node.skip:
                todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
        header.kids, header.skip = list(found), 0


def drop_doubtful(tree: Tree) -> None:
    """Doubtful elements go unless they hold prose: a paragraph that scores, and no more than a third of the text in links. So a word of a topic decides nothing on its own."""
    if not tree.doubtful:
        return
    prose: set[Node] = set()
    for node in reversed(_measure(tree.root)):
        if node in prose or node.tag in PARAGRAPH and node.own >= 25 and _density(node) <= 1 / 3:
            prose.add(node)
            if node.up is not None:
                prose.add(node.up)
    for node in tree.doubtful:
        if node not in prose or _density(node) > 1 / 3:
            node.skip = MARKED


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The container with the best score, and those of its siblings that belong to it, in page order.

    A paragraph passes a point, one for each comma and up to three for its length to its parent, half to the grandparent and less to those above,
    and a container's score is discounted by its link density. Where no paragraph is long enough to
    score, the largest article, main or the page itself is taken.
    """
    order = _measure(root)
    scored: list[Node] = []
    for node in order:
        if node.tag not in PARAGRAPH or node.own < 25:
            continue
        points = (1 + node.commas + min(node.own // 100, 3)) * (1 - _density(node)) * (0.5 if node.inside & WEAK else 1.0)
        # A container with text of its own is its own paragraph.
        up, share = (node.up if node.tag not in ("div", "section", "article") else node), 1.0
        level = 0
        while up is not None and level < 5:
            if not up.score:
                scored.append(up)
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (level * 3)
            up = up.up
    marked = [n for n in order if n.tag in ("article", "main") and n.size]
    if not scored:
        return [max(marked, key=lambda n: n.size)] if marked else [root]
    best = max(scored, key=lambda n: n.score * (1 - _density(n)))
    # The article element around the best container is the container.
    up = best
    while up is not None:
        if up.tag in ("article", "main") and _density(up) < 0.5:
            best = up
            break
        up = up.up
    if best.up is None:
        return [best]
    limit = 0.2 * best.score
    kept = []
    for kid in best.up.kids:
        if not isinstance(kid, Node) or kid.skip:
            continue
        if kid is best or kid.score * (1 - _density(kid)) >= limit:
            kept.append(kid)
        elif kid.tag == "p" and kid.size and (_density(kid) < 0.25 if kid.size > 80 else not kid.linked and best.tag not in ("article", "main")):
            kept.append(kid)
    return kept


def _link_list(node: Node) -> bool:
    """A block inside an article that is a menu: nearly all of it is links, and they are short. Long ones in a row are its sources."""
    if node.tag not in ("ul", "ol", "div", "table", "section", "dl") or node.size == 0 or _density(node) <= 0.8:
        return False
    links, texts, todo = 0, 0, [node]
    while todo:
        x = todo.pop()
        if x.tag == "a":
            links, texts = links + 1, texts + x.size
        else:
            todo.extend(k for k in x.kids if isinstance(k, Node) and not k.skip)
    return texts < SOURCE * links


#: Mean characters of the links in a list of sources.
SOURCE = 25


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks under ``nodes``, in page order, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif not x.skip and (x is top or not _link_list(x)):
                if x.tag in BLOCK:
                    end()
                    todo.append(None)
                todo.extend(reversed(x.kids))
        end()
    return out


def extract(html: str | None) -> str:
    """Main text of a page; empty for null, for an empty page and for one without text."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    keep_headings(tree)
    keep_forms(tree)
    keep_wrappers(tree)
    drop_doubtful(tree)
    return "\n".join(blocks(main_nodes(tree.root)))


def _extract(html: pd.Series) -> pd.Series:
    return html.map(lambda x: extract(x) if isinstance(x, str) else "")


def with_main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each page in column ``out``: the best container of the element tree and its siblings.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and hidden parts are left
    out. Character references are decoded, white space in a block becomes one space, blocks are joined by a newline.
    Null and empty pages give the empty string; markup that is cut off is read as far as it goes. Pages are independent: no shuffle. Work is
    linear in the length of a page, however deep its elements are. Repeated rows are read each; an existing column ``out`` is replaced; an empty table gives an empty one.
    """
    scratch.bound_batches(pages.sparkSession)
    return pages.withColumn(out, F.pandas_udf(_extract, "string")(F.col(html)))
