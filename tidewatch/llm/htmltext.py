"""Main text of web pages by host consensus.

A container's score reaches all containers around it; each page votes for the
generalised path (tags with classes, without numbers) of the smallest containers
that hold nearly all of its good text; Spark sums the votes by host; then every
page is read again and the text of the containers on the winning path of its
host is taken, or on its own path where the host's holds too little of it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.text import small_batches
from tidewatch.operators.ordering import join_spread

#: A quote opens a value only behind `=`; one that is never closed, or closed in front of more letters with tags between, is an ordinary character.
VALUE = r"\"[^\"<>]*+\"|'[^'<>]*+'|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:{VALUE})?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![a-zA-Z_:-])([a-zA-Z_:-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object"}
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = {"article", "main", "section", "div", "td", "body", "html", "center", "blockquote"}
BOILERPLATE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", *RAW}
NAMES = (
    r"(?:ads?|adverts?|advertis(?:ing|ements?)|adsense|banners?|sponsor(?:s|ed)?|promos?|promotions?|nav|navbar|navigation|menus?|menubar|breadcrumbs?|sidebars?|side|aside|footers?|header|masthead|topbar|toolbar|cookies?|consent|notices?|popups?|modals?|overlays?"
    r"|newsletters?|subscribe|subscriptions?|signup|login|forms?|search|searchbox|searchbar|searchform|comments?|commentlist|replies|reply|disqus|respond|share|shares|sharebar|sharing|socials?|related|recommended|recommendations?|widgets?|pagination|pager|tags?|copyright|legal|disclaimer|skip|skiplinks?)"
)
#: Words that leave a name in a compound what it is; words such as has, no, with or price do not.
PLACES = r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|wrapper|wrap|container|box|list|area|block|inner|outer|bar|links?|items?|slot|unit|section|icons?|buttons?|posts|articles|stories|\d+)"
#: A whole class word or id: a name, names and places together, or a part of a post that is none of its text.
BOILERPLATE_NAMES = re.compile(rf"^(?:(?:{PLACES}[-_]+)*{NAMES}\d*(?:[-_]+(?:{NAMES}|{PLACES}))*|(?:post|entry|article)[-_]+(?:comments?|tags|share|sharing|socials?|related|footer|nav|navigation|ads?|pagination))$")
#: Names that are also ordinary words: on a block of the article they count only if its text is mostly links.
DOUBTFUL = {"copyright", "disclaimer", "forms", "legal", "menus", "promotions", "recommendations", "recommended", "related", "replies", "reply", "search", "share", "sharing", "side", "tags"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
#: An opening tag of the left ends open elements of the right up to the nearest one.
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
STOPS = {"ul", "ol", "table", "dl", "select", "div", "article", "section", "body", "main"}
#: A page's vote must hold NEARLY all of its good text; the host's path is taken if it holds MOST of it.
NEARLY, MOST = 0.9, 0.5


@dataclass
class Node:
    """A container with the parts of its own text, in page order, and what decides its score."""

    step: str
    above: "Node | None"
    key: int
    parts: list = field(default_factory=list)
    text: int = 0
    linked: int = 0
    doubtful: bool = False

    @property
    def path(self) -> str:
        steps, node = [], self
        while node.above is not None:
            steps.append(node.step)
            node = node.above
        return "/".join(["", *reversed(steps)])


@dataclass
class Lost:
    """What an element took out of the page that is boilerplate only softly: by its names, or as a form or hidden."""

    named: bool
    text: int = 0
    titles: int = 0
    paragraphs: int = 0


#: Why an element is boilerplate: its tag or role; a form or hidden; its names; a name that is also an ordinary word.
HARD, SOFT, NAMED, DOUBT = 1, 2, 3, 4


def step(name: str, attributes: str) -> tuple[str, int]:
    """(generalised tag with classes, why the element is boilerplate, 0 if it is not)."""
    classes, hard, soft = [], name in BOILERPLATE_TAGS and name != "form", name == "form"
    names: list[str] = []
    if attributes and "=" in attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key == "class" or (key == "id" and name not in HEADINGS):
                words = value.split()
                names += [w for w in words if BOILERPLATE_NAMES.match(w)]
                if key == "class":
                    classes += [re.sub(r"\d+", "", w) for w in words]
            elif (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true"):
                hard = True
            elif key == "style" and re.search(r"display\s*+:\s*+none", value):
                soft = True
    if attributes and re.search(r"(^|\s)hidden(\s|=|$)", attributes) and "type=" not in attributes:
        soft = True
    why = HARD if hard else SOFT if soft else 0
    if not why and names:
        why = NAMED if not DOUBTFUL.issuperset(names) else DOUBT
    generalised = ".".join([name, *sorted(set(filter(None, classes)))])
    if name in ("html", "body") or (why == DOUBT and name in HEADINGS):
        why = 0
    return generalised, why


def read_page(page: str) -> list[Node]:
    """All containers of a page, in page order.

    The text of a block goes to the nearest container around it, outside of
    boilerplate; a container also keeps the places of the containers inside it.
    A form, a hidden element or one that only its class or id makes boilerplate
    is a wrapper if it holds nearly all of the page's text or, beside an article's
    title, nearly all of what is not boilerplate: the page is read again without
    taking it so, and after some such wrappers without looking at names at all.
    Comments are no wrapper however long, as the article's text stays without them.
    """
    wrappers: set[int] = set()
    for _ in range(6):
        nodes, lost, article, title = read_once(page, wrappers)
        kept = sum(n.text for n in nodes)
        whole = kept + sum(x.text for x in lost.values())
        more = {
            at
            for at, x in lost.items()
            if x.text and ((x.titles and x.text >= NEARLY * (kept + x.text)) or (x.text >= NEARLY * whole and not article and (not title if x.named else x.paragraphs)))
        }
        if not more and not kept:
            more = {at for at, x in lost.items() if x.named}  # nothing is left, and no one name took it
        if not more:
            return nodes
        wrappers |= more
    return read_once(page, None)[0]


def read_once(page: str, wrappers: set[int] | None) -> tuple[list[Node], dict[int, Lost], bool, bool]:
    """(containers, what was lost to each soft boilerplate by its place, whether text stayed in an article, whether a title stayed); None looks at no names."""
    lost: dict[int, Lost] = {}
    losing, softly = -1, 0  # the outermost element that is boilerplate; how many of the open ones are so softly
    root = Node("", None, 0)
    nodes, holders = [root], [root]
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, boilerplate from here on, softly, container, article
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    blocks: list[int] = []  # places in the stack that are not inline
    unended: set[str] = set()
    bad, links, articles, buffer, at, end = 0, 0, 0, [], 0, len(page)
    linked, article, title = 0, False, False

    def flush() -> None:
        nonlocal linked, article
        text = " ".join(html.unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            node = holders[-1]
            node.parts.append(text)
            node.text += len(text)
            node.linked += min(linked, len(text))
            article = article or articles > 0
        linked = 0

    def close(depth: int) -> None:
        nonlocal bad, softly, links, articles
        while len(stack) > depth:
            tag, was_bad, was_soft, container, whole = stack.pop()
            opened[tag].pop()
            if tag not in INLINE:
                flush()
                blocks.pop()
            bad -= was_bad
            softly -= was_soft
            links -= tag == "a"
            articles -= whole
            if container:
                holders.pop()

    def nearest(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text_end, name = end, None
        else:
            text_end, name = m.start(), m[2]
        if text_end > at and not bad:
            buffer.append(page[at:text_end])
            if links:
                linked += text_end - at
        elif text_end > at and softly == bad:
            lost[losing].text += len("".join(page[at:text_end].split()))
        if m is None:
            break
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            place = nearest({name})
            if place >= 0 and not (name in INLINE and blocks and blocks[-1] > place):
                close(place)
            elif name == "p" and place < 0 and not bad:
                flush()
            continue
        if name not in INLINE and not bad:
            flush()
        if name in VOID:
            continue
        generalised, why = step(name, m[3])
        if why == HARD and name == "header" and articles:
            why = 0  # an article's own header
        if why == DOUBT and not (name not in INLINE and (articles or name == "section")):
            why = NAMED
        soft = why in (SOFT, NAMED)
        if (soft and wrappers is not None and m.start() in wrappers) or (why == NAMED and wrappers is None):
            why, soft = 0, False
        is_bad = soft or why == HARD
        if name in RAW:
            drawing = name in ("svg", "math")
            if drawing and m[3].rstrip().endswith("/"):
                continue
            done = None if name in unended else RAW_END[name].search(page, at)
            if done is None:
                unended.add(name)
            at = done.end() if done else at if drawing else end
            continue
        if name not in INLINE:
            # a block ends an open paragraph and whatever inline elements were left open in it
            if blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            before = nearest(ENDS[name]) if name in ENDS else -1
            if before > nearest(STOPS):
                close(before)
        if m[3].rstrip().endswith("/") and name in ("path", "g"):
            continue
        doubtful = why == DOUBT and not bad
        container = (name in CONTAINERS or doubtful) and not bad and not is_bad
        if container:
            node = Node(generalised, holders[-1], path_key(holders[-1].key, generalised), doubtful=doubtful)
            holders[-1].parts.append(node)
            holders.append(node)
            nodes.append(node)
        opened.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        whole = name in ("article", "main") and not bad and not is_bad
        stack.append((name, is_bad, soft, container, whole))
        if soft and not bad:
            losing = m.start()
            lost[losing] = Lost(why == NAMED)
        if not is_bad and softly == bad:
            if not bad:
                title = title or name == "h1"
            else:
                lost[losing].titles += name in ("h1", "article", "main")
                lost[losing].paragraphs += name == "p"
        bad += is_bad
        softly += soft
        articles += whole
        links += name == "a"
    flush()
    return without_doubtful(nodes), lost, article, title


def without_doubtful(nodes: list[Node]) -> list[Node]:
    """The containers less those of doubtful names whose text is mostly links, and all inside them."""
    if not any(n.doubtful for n in nodes):
        return nodes
    inside = {id(n): [n.text, n.linked] for n in nodes}
    for n in reversed(nodes):
        if n.above is not None:
            for k in (0, 1):
                inside[id(n.above)][k] += inside[id(n)][k]
    gone: set[int] = set()
    for n in nodes:
        text, linked = inside[id(n)]
        if n.above is not None and (id(n.above) in gone or (n.doubtful and 2 * linked >= text)):
            gone.add(id(n))
    for n in nodes:
        if any(isinstance(x, Node) and id(x) in gone for x in n.parts):
            n.parts = [x for x in n.parts if not (isinstance(x, Node) and id(x) in gone)]
    return [n for n in nodes if id(n) not in gone]


def held(nodes: list[Node]) -> tuple[dict[int, int], bool]:
    """Good text under all containers of each path, and whether the page has any.

    Good text is a container's own text less that of its links twice; a page of
    nothing but links counts all of its text. Nodes are in page order, so a
    container comes before those inside it.
    """
    own = [max(0, n.text - 2 * n.linked) for n in nodes]
    good = any(own)
    if not good:
        own = [n.text for n in nodes]
    inside = {id(n): x for n, x in zip(nodes, own, strict=True)}
    for n in reversed(nodes):
        if n.above is not None:
            inside[id(n.above)] += inside[id(n)]
    sums: dict[int, int] = {}
    for n in nodes:
        sums[n.key] = sums.get(n.key, 0) + inside[id(n)]
    return sums, good


def whole_text(node: Node) -> list[str]:
    """Blocks of a container and all inside it, in page order."""
    out, todo = [], [iter(node.parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, Node):
                todo.append(iter(part.parts))
                break
            out.append(part)
        else:
            todo.pop()
    return out


def path_key(above: int, generalised: str) -> int:
    """A path as a number, from the one above it: deep pages cost no long strings."""
    return xxhash.xxh3_64_intdigest(generalised.encode("utf-8", "replace"), seed=above) >> 1


def best_path(nodes: list[Node]) -> tuple[Node | None, float]:
    """The page's vote, as a container on its path, with the good text there; None for a page without text.

    Down from the root as long as one path inside holds nearly all of the page's
    good text; then up again, so that no title or lead beside it is lost, to the
    outermost path that still adds good text. An <article> or <main> is left
    upwards only for a <main> around it.
    """
    sums, good = held(nodes)
    whole = sums[nodes[0].key]
    if not whole:
        return None, 0.0
    best, seen = nodes[0], set()
    for n in nodes:
        # two paths that hold more than half each lie in each other, and the inner one begins later
        if n.key not in seen and sums[n.key] >= NEARLY * whole:
            best = n
        seen.add(n.key)
    top, node, bound = best, best, ""
    while node is not None:
        tag, more = node.step.split(".")[0], sums[node.key] > sums[top.key]
        if tag == "article" or (tag == "main" and (more or not bound)) or (more and not bound):
            top = node
        bound = bound or (tag if tag in ("article", "main") else "")
        node = node.above
    return top, float(sums[top.key]) if good else 0.0


def text_on(nodes: list[Node], key: int | None) -> str | None:
    """Text of all containers on a path; None if the page has none with text."""
    blocks = [block for n in nodes if n.key == key for block in whole_text(n)]
    return " ".join(blocks) if blocks else None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of `pages` with host, path, text and n_chars added.

    host is what stands between `//` and the next `/`, `?` or `#` of the url,
    without user, port, case and leading `www.`; null or odd urls share the host
    "". Each page votes with at most 1 for its best path, less if it has little
    text, so no single page decides for a host. Where its host's path holds less
    than half of a page's good text, its own path is taken. Null and empty html and pages
    without text give an empty text and no path. Ties between paths go to the
    first by name. Repeated rows vote each and get equal results. An empty table
    gives an empty result. Added columns replace input columns of the same names.
    """
    small_batches(pages.sparkSession)
    pages = pages.drop("host", "path", "text", "n_chars")
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    hosted = pages.withColumn("host", host)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [best_path(read_page(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n and n.key for n, _ in votes], pa.int64()), pa.array([n and n.path for n, _ in votes], pa.string()), pa.array([v / (v + 500.0) for _, v in votes], pa.float64())],
                names=["host", "key", "path", "weight"],
            )

    votes = hosted.select("host", F.col(html_col)).mapInArrow(vote, "host string, key long, path string, weight double").filter("weight > 0")
    counted = votes.groupBy("host", "key").agg(F.round(F.sum("weight"), 6).alias("votes"), F.min("path").alias("path"))
    first = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    winners = counted.withColumn("place", F.row_number().over(first)).filter("place = 1").select("host", F.col("key").alias("winner"))
    # a host may have a third of all pages: they stay on many tasks
    joined = join_spread(hosted, winners, ["host"], [html_col], "left").select(*hosted.columns, "winner")
    n, where = len(hosted.columns), hosted.columns.index(html_col)
    schema = T.StructType([*hosted.schema.fields, T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = [], []
            for page, winner in zip(batch.column(where).to_pylist(), batch.column(n).to_pylist(), strict=True):
                nodes = read_page(page or "")
                sums = held(nodes)[0]
                key = winner
                if sums.get(winner, 0) < max(1, MOST * sums[nodes[0].key]):
                    node = best_path(nodes)[0]
                    key = node.key if node else None
                text = text_on(nodes, key) if key is not None else None
                paths.append(next(n.path for n in nodes if n.key == key) if text else None)
                texts.append(text or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(take, schema)
