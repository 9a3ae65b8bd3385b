"""Main text of web pages by consensus host paths.

Each page is read once to score its containers: the text they hold outside boilerplate. The page votes for the path of
its best container, tags with generalised classes from the root down (``html>body>div.post-#>article``). Spark counts
the votes of every host; then each page is read again and the text comes from the elements on its host's winning path,
or from the page's own best container where the host's path is not on the page or holds only a part of that container.

A page's whole container is the deepest one outside of which no text is left. A narrower one, with at least ``SHARE`` of
the text at each step, takes its place only where every piece of text it leaves out is the host's furniture: pieces that
half of the host's pages or more leave out alike, with different main texts.

Words of a class or id are evidence, not a veto. A class token counts where all its parts are words of boilerplate or of
layout (``related-posts``; not ``has-sidebar``, ``share-price``), and an element so marked stays where it holds the page's
prose: as much text outside links as all unmarked elements together if a heading or article is in it, else four times
as much. Comments stay only around the page's main heading. An element on the host's winning path is taken, marked or
not, where the page has no unmarked one there.

Defined cases. Null, empty and textless pages: empty text. Pages without a host in the url vote under the empty host.
Ties of votes: more text, then the path that sorts last. Repeated rows vote each and stay rows. Unclosed and misplaced
tags are repaired as browsers do for blocks; a tag whose quotes never close ends at its first ``>``. What is left out
separates its neighbours unless it is inline or a script. Texts are read whole. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import per_batch, staged

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body article main section div td blockquote center".split())
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "p": {"p"},
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select article section div main body html td th".split())
#: Elements that are never main text.
BOILERPLATE_TAGS = frozenset(
    "head nav header footer aside script style noscript template svg math button select option input textarea "
    "iframe object menu dialog title fieldset".split()
)
#: Roles that say the same of any element.
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split()
)
#: Left-out elements that do not separate the text around them.
SEAMLESS = INLINE | frozenset("script style noscript template".split())
#: Words of a class or id that are evidence of boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie "
    "cookies copyright footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted promotion related search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words of a class or id that are evidence of what readers wrote.
COMMENT_WORDS = frozenset(
    "comment commentlist comments discussion disqus replies reply respond response responses".split()
)
#: Words that say where or how a part is laid out, not what it is.
LAYOUT_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card cards center col column container content "
    "count desktop entry feed fixed floating form global group icon icons inner item items label layout left link links "
    "list main media mobile module outer page panel post posts primary region right row secondary section site slot "
    "sticky stories story strip text thread title top unit wrap wrapper".split()
)
#: A class token with one of these tells of the layout around a part, or that the part is missing.
MODIFIERS = frozenset("has is no non not with without".split())
#: A child with at least this share of its parent's text may take its place, if what it leaves out is furniture.
SHARE = 0.8
#: Paths of all hosts up to this size are copied to every task; beyond it only those of hosts with one page in
#: ``LARGE_HOSTS`` or more, so of ``LARGE_HOSTS`` hosts at most.
COPIED_BYTES, LARGE_HOSTS = 64 << 20, 1000

# Attributes as the HTML tokenizer reads them: quotes matter after an equals sign only.
_ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?:>|[^A-Za-z>][^>]*+(?:>|\Z))"
    rf"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?:(?P<attrs>{_ATTRS})>|(?P<rough>[^>]*+)(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    path: str
    parent: Node | None
    boilerplate: bool
    #: Marked by words only, so that ``boilerplate`` is a verdict on the page's text; 2 for comments.
    suspect: int = 0
    #: Characters inside links.
    linked: int = 0
    #: Text pieces, child nodes and ``None`` for a break, in page order.
    content: list = field(default_factory=list)


def suspicion(names: str) -> int:
    """What the class tokens and ids of an element are evidence of: 0 nothing, 1 boilerplate, 2 comments."""
    found = 0
    for token in names.split():
        parts = _NAME.findall(_CAMEL.sub(" ", token).lower())
        if MODIFIERS.isdisjoint(parts) and all(
            x in BOILERPLATE_WORDS or x in COMMENT_WORDS or x in LAYOUT_WORDS or len(x) < 3 or x.isdigit() for x in parts
        ):
            found = max(found, 2 * (not COMMENT_WORDS.isdisjoint(parts)), 1 * (not BOILERPLATE_WORDS.isdisjoint(parts)))
    return found


def _generalised(classes: str) -> str:
    """The first class with its numbers as ``#``: what a template's pages share."""
    first = classes.split()[:1]
    return "." + re.sub(r"\d+", "#", first[0].lower()) if first else ""


def parse(page: str) -> Node:
    """A tree of the page's elements; inline elements are looked through."""
    root = node = Node("", "", None, False)
    at, in_link, suspects = 0, False, False
    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            text = html.unescape(page[at:end])
            node.content.append(text)
            if in_link:
                node.linked += len("".join(text.split()))
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or "").lower()
        if found["cdata"]:
            node.content.append(found["cdata"])
        if not tag:
            continue
        if tag == "a":
            in_link = not found["close"]
        if found["close"]:
            if tag == "br" or tag == "p" and not _open(node, "p"):
                node.content.append(None)
            elif tag not in INLINE or _hidden_inline(node, tag):
                node = _closed(node, tag)
            continue
        written = found["attrs"] or found["rough"] or ""
        attrs = {
            k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(written)
        } if written.strip(" /") else {}
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(
            re.search(r"display\s*:\s*none", attrs.get("style", ""))
        )
        suspect = 0
        if tag not in ("html", "body", "main"):
            suspect = suspicion(f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else 0
            suspect = suspect or int(tag == "form")
            hidden = hidden or not BOILERPLATE_ROLES.isdisjoint(attrs.get("role", "").lower().split())
        boilerplate = tag in BOILERPLATE_TAGS or hidden
        suspect = 0 if boilerplate else suspect
        if tag in VOID:
            node.content.append(None if tag not in ("wbr", "img") else "")
            continue
        if tag in RAW:
            if tag not in SEAMLESS:
                node.content.append(None)
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if suspect:
            boilerplate = suspects = True
        if tag in INLINE and not boilerplate:
            continue
        node = _made_room(node, tag)
        name = tag + _generalised(attrs.get("class", ""))
        child = Node(tag, f"{node.path}>{name}" if node.path else name, node, boilerplate, suspect)
        node.content.append(child)
        node = child
    if suspects:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Take back the verdict on marked elements that hold the page's prose."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    heads: dict[int, set[str]] = {}
    for node, x in _walk(root, marked=True):
        if isinstance(x, str):
            size[id(node)] = size.get(id(node), 0) + len("".join(x.split()))
        elif x is True:
            linked[id(node)] = linked.get(id(node), 0) + node.linked
            own = heads.setdefault(id(node), set())
            if node.tag in ("h1", "main") or node.tag == "article" and not node.suspect:
                own.add(node.tag)
            if node.parent is not None:
                up = id(node.parent)
                size[up] = size.get(up, 0) + size.get(id(node), 0)
                linked[up] = linked.get(up, 0) + linked[id(node)]
                heads.setdefault(up, set()).update(own)
    front = _outermost(root)
    outside = size.get(id(root), 0) - sum(size.get(id(x), 0) for x in front)
    while front:
        front.sort(key=lambda x: size.get(id(x), 0))
        node = front.pop()
        whole, held = size.get(id(node), 0), heads.get(id(node), set())
        prose = whole - linked.get(id(node), 0)
        if node.suspect == 2:
            held = held - {"article"}
        if 2 * prose < whole or not whole or prose < (1 if held else 4) * outside or node.suspect == 2 and not held:
            continue
        node.boilerplate = False
        inner = _outermost(node)
        outside += whole - sum(size.get(id(x), 0) for x in inner)
        front += inner


def _outermost(top: Node) -> list[Node]:
    """Marked elements below ``top`` that are in no other one."""
    found, stack = [], [top]
    while stack:
        for x in stack.pop().content:
            if isinstance(x, Node):
                if x.suspect:
                    found.append(x)
                elif not x.boilerplate:
                    stack.append(x)
    return found


def _open(node: Node | None, tag: str) -> Node | None:
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def _hidden_inline(node: Node, tag: str) -> bool:
    """Inline elements are nodes only where they are boilerplate."""
    return _open(node, tag) is not None


def _closed(node: Node, tag: str) -> Node:
    match = _open(node, tag)
    return match.parent if match is not None and match.parent is not None else node


def _made_room(node: Node, tag: str) -> Node:
    """Close what a start tag closes: paragraphs before blocks, list items before list items."""
    if tag in ENDS_P and (p := _near(node, {"p"})):
        node = p.parent
    if tag in SIBLINGS and (item := _near(node, SIBLINGS[tag])):
        node = item.parent
    return node


def _near(node: Node | None, tags: set[str]) -> Node | None:
    while node is not None and node.tag and (node.tag in tags or node.tag not in SCOPES):
        if node.tag in tags:
            return node
        node = node.parent
    return None


def _walk(top: Node, marked: bool = False):
    """(node, entering) in page order without recursion; boilerplate is left out, but if wanted not what words mark."""
    stack = [(top, iter(top.content))]
    yield top, None
    while stack:
        node, rest = stack[-1]
        for x in rest:
            if isinstance(x, Node):
                if not x.boilerplate or marked and x.suspect:
                    stack.append((x, iter(x.content)))
                    yield x, None
                    break
                yield node, "" if x.tag in SEAMLESS else "\n"
            else:
                yield node, "\n" if x is None else x
        else:
            stack.pop()
            yield node, True


def text_of(top: Node) -> str:
    """Blocks in page order, white space as one space."""
    pieces: list[str] = []
    for node, x in _walk(top):
        if x is None or x is True:
            if node.tag not in INLINE:
                pieces.append("\n")
        else:
            pieces.append(x)
    return " ".join("".join(pieces).split())


@dataclass
class Found:
    """A page's whole and narrow container, the text in them, and marks of the pieces between the two."""

    whole: Node
    whole_size: int
    narrow: Node
    narrow_size: int
    rest: list[int]

    def best(self, furniture: frozenset[int] = frozenset()) -> Node:
        return self.narrow if furniture.issuperset(self.rest) else self.whole


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def containers(root: Node) -> Found:
    """The deepest container that holds all of the page's text, and the deepest that holds most of it."""
    sizes: dict[int, int] = {}
    for node, x in _walk(root):
        if isinstance(x, str):
            sizes[id(node)] = sizes.get(id(node), 0) + len("".join(x.split()))
        elif x is True and node.parent is not None:
            sizes[id(node.parent)] = sizes.get(id(node.parent), 0) + sizes.get(id(node), 0)
    top, tags = root, CONTAINERS
    for node, x in _walk(root):  # an article or main with most of the text ends the search
        if x is None and node.tag in ("article", "main") and sizes.get(id(node), 0) >= sizes.get(id(root), 0) / 2:
            top, tags = node, frozenset() if node.tag == "article" else frozenset({"article"})
            break
    whole, narrow, rest = _deepest(top, sizes, tags)
    return Found(whole, sizes.get(id(whole), 0), narrow, sizes.get(id(narrow), 0), rest)


def _deepest(node: Node, sizes: dict[int, int], tags: frozenset[str]) -> tuple[Node, Node, list[int]]:
    whole, rest = node, []
    while True:
        down = [
            c for c in node.content
            if isinstance(c, Node) and not c.boilerplate and c.tag in tags
            and sizes.get(id(c), 0) and sizes[id(c)] >= SHARE * sizes.get(id(node), 0)
        ]
        headed = any(isinstance(c, Node) and c.tag == "h1" for c in node.content)
        if not down or headed:
            return whole, node, rest
        for c in node.content:
            if isinstance(c, str) and c.strip():
                rest.append(_mark(" ".join(c.split())))
            elif isinstance(c, Node) and c is not down[0] and not c.boilerplate and sizes.get(id(c), 0):
                rest.append(_mark(text_of(c)))
        node = down[0]
        if not rest:
            whole = node


def on_path(root: Node, path: str) -> list[Node]:
    """Outermost elements on a path, in page order; marked ones where there are no others, comments never."""
    plain: list[Node] = []
    marked: list[Node] = []
    for node, x in _walk(root, marked=True):
        if x is None and node.path == path and node.suspect < 2:
            found = marked if _left_out(node) else plain
            if not any(_inside(node, f) for f in found[-1:]):
                found.append(node)
    return plain or marked


def _left_out(node: Node | None) -> bool:
    while node is not None and not node.boilerplate:
        node = node.parent
    return node is not None


def _inside(node: Node | None, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is other


def vote(page: str | None) -> tuple[str | None, int]:
    """Path of the page's whole container and the text in it; no vote without text."""
    if not page:
        return None, 0
    found = containers(parse(page))
    return (found.whole.path or None, found.whole_size) if found.whole_size else (None, 0)


def _ballot(page: str | None) -> tuple:
    """Path and text of the whole and of the narrow container, the pieces between them, and a mark of the narrow text."""
    found = containers(parse(page)) if page else None
    if found is None or not found.whole_size:
        return None, 0, None, 0, [], 0
    mark = _mark(text_of(found.narrow)) if found.rest else 0
    return (
        found.whole.path or None, found.whole_size, found.narrow.path or None, found.narrow_size, sorted(set(found.rest)), mark,
    )


def extract(page: str | None, path: str | None, furniture: frozenset[int] = frozenset()) -> str:
    """Text on the given path, else, or where the path is only a part of it, of the page's own best container."""
    if not page:
        return ""
    root = parse(page)
    nodes = on_path(root, path) if path else []
    for node in nodes:  # the host's pages agree that this is text, whatever it is called
        while node is not None:
            node.boilerplate, node = False, node.parent
    own = containers(root).best(furniture)
    if any(n is own or not _inside(n, own) for n in nodes):
        text = " ".join(filter(None, map(text_of, nodes)))
        if text:
            return text
    return text_of(own)


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_votes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path, furniture, pages): the winner of each host's votes. Votes are added up before they are shuffled."""
    rows = pages.select(_host(F.col(url)).alias("host"), F.col(page).alias("html"))
    names = ("whole", "whole_size", "narrow", "narrow_size", "rest", "mark")

    def work(columns: dict[str, pa.Array]) -> dict:
        found = [_ballot(x) for x in columns["html"].to_pylist()]
        made = {n: [x[k] for x in found] for k, n in enumerate(names)}
        return {"host": columns["host"]} | made | {"rest": pa.array(made["rest"], pa.list_(pa.int64()))}

    ballots = per_batch(
        rows, work, "host string, whole string, whole_size long, narrow string, narrow_size long, rest array<long>, mark long"
    )
    counted = staged(ballots.groupBy("host", "whole", "narrow", "rest").agg(
        F.count("*").alias("n"), F.sum("whole_size").alias("whole_size"), F.sum("narrow_size").alias("narrow_size"),
        F.min("mark").alias("low"), F.max("mark").alias("high"),
    ), "host-votes")
    pieces = counted.select("host", F.explode("rest").alias("piece"), "n", "low", "high").groupBy("host", "piece").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    totals = counted.filter("whole is not null or narrow is not null").groupBy("host").agg(F.sum("n").alias("total"))
    furniture = pieces.filter("low < high").join(totals, "host").filter("2 * n >= total").groupBy("host").agg(
        F.collect_list("piece").alias("furniture")
    )
    met = counted.join(furniture, "host", "left").withColumn(
        "furniture", F.coalesce("furniture", F.array().cast("array<bigint>"))
    )
    narrow = F.size(F.array_except("rest", "furniture")) == 0
    votes = met.select(
        "host", "n", "furniture", F.when(narrow, F.col("narrow")).otherwise(F.col("whole")).alias("path"),
        F.when(narrow, F.col("narrow_size")).otherwise(F.col("whole_size")).alias("size"),
    )
    summed = votes.groupBy("host", "path").agg(
        F.sum("n").alias("votes"), F.sum("size").alias("size"), F.first("furniture").alias("furniture")
    )
    return summed.groupBy("host").agg(
        F.max(F.when(F.col("path").isNotNull(), F.struct("votes", "size", "path", "furniture"))).alias("won"),
        F.sum("votes").alias("pages"),
    ).select("host", "won.path", F.coalesce("won.furniture", F.array().cast("array<bigint>")).alias("furniture"), "pages")


def host_paths(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, path) of ``host_votes``, for hosts with any text."""
    return host_votes(pages, url, page).select("host", "path").filter("path is not null")


def _routed(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """Rows with their host's path and furniture; no host's pages meet in one task.

    All hosts are copied to the tasks where they are few. Otherwise this is done for the large hosts, of which there are
    at most ``LARGE_HOSTS`` by their definition, and only pages of the other hosts are shuffled.
    """
    votes = staged(votes, "host-paths")
    size = votes.agg(
        F.sum("pages").alias("pages"),
        F.sum(F.octet_length("host") + F.coalesce(F.octet_length("path"), F.lit(0)) + 8 * F.size("furniture") + 64).alias("bytes"),
    ).first()
    if (size["bytes"] or 0) <= COPIED_BYTES:
        return rows.join(F.broadcast(votes.drop("pages")), "host", "left")
    large = F.col("pages") * LARGE_HOSTS >= size["pages"]
    few, many = votes.filter(large).drop("pages"), votes.filter(~large).drop("pages")
    return rows.join(F.broadcast(few), "host").unionByName(
        rows.join(F.broadcast(few.select("host")), "host", "left_anti").join(many, "host", "left")
    )


def extract_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html",
) -> DataFrame:
    """(page_id, url, path, text) of every page."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"), _host(F.col(url)).alias("host")
    )
    routed = _routed(rows, host_votes(pages, url, page)).drop("host")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in routed.schema if f.name in ("page_id", "url"))

    def work(columns: dict[str, pa.Array]) -> dict:
        pages, paths = columns.pop("html").to_pylist(), columns["path"].to_pylist()
        furniture = [frozenset(x or ()) for x in columns.pop("furniture").to_pylist()]
        return columns | {"text": [extract(*x) for x in zip(pages, paths, furniture, strict=True)]}

    return per_batch(routed, work, f"{kept}path string, text string")
