"""Main-text extraction by consensus of host paths.

First pass: every page's containers are scored by the running text of their blocks
(characters outside links); from the best one the page climbs to the whole article around it
(``whole``), which votes for its generalised path: tags and classes from the body down,
digits replaced, positions left out.  Votes are summed in Spark
per (host, path) before the shuffle, and a host's winning paths are those with at least
``share`` of its pages (so at most 1/share paths per host).  Second pass: each page is
read again with the most-voted winning path that it has; a page that has none uses its own
best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
left out wherever they lie.  A name or a form alone decides nothing about what is around the article: such an element
stays if a main or article element below it holds a quarter of the page's running text, or if it holds half of it itself
(reader comments never do by length).  Within an article, what is named like a link list but is running text stays.  Character references are decoded, white space becomes one
space, blocks are joined in page order by one space; nothing else is dropped or cut.

Null and empty pages give an empty text.  A null or odd url counts as one host without a
name.  Repeated rows give a row each and vote each.  Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import stored

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote dd dt td th figcaption caption summary".split())
CONTAINERS = frozenset("article main section div td body center".split())
UNWANTED = frozenset("nav footer aside button select dialog menu head label legend".split())
#: An open element of the first kind ends where one of the second kind starts.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])")


#: Class and id names of boilerplate, by what their text looks like.
COMMENTS = _names("comments?|disqus|responses")
ASIDES = _names("ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|banner|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|sidebar|widgets?|login|signup")
LISTS = _names("related|recommend(?:ed|ations)?|share|sharing|social|breadcrumbs?|menus?|nav|navbar|navigation|footer|search|pagination|pager|toolbar|skip")
HEADERS = _names("header|masthead|topbar")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())


#: Doubts about an element, from none to certain.
NONE, LIST, ASIDE, COMMENT, GONE = range(5)
#: An article element that holds this share of the page's running text clears what is around it, as does a list within an
#: article if it has so much of the article's.
SHARE, PART = 0.25, 0.1


class Node:
    __slots__ = ("tag", "path", "parent", "doubt", "skip", "article", "score", "order", "plain", "linked")

    def __init__(self, tag: str, path: str, parent: Node | None, doubt: int, article: bool):
        self.tag, self.path, self.parent, self.doubt, self.article = tag, path, parent, doubt, article
        self.skip, self.score, self.order, self.plain, self.linked = False, 0.0, 0, 0, 0


#: A run of text in an element: (element, text, its characters other than white space); a text of None ends a block or line.
Run = tuple[Node, str | None, int]


def _attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        if m[3]:
            out.setdefault("hidden", "")
        else:
            out.setdefault(m[1].lower(), m[2].strip("\"'"))
    return out


def _doubt(tag: str, a: dict[str, str], in_article: bool) -> int:
    if tag in ("html", "body", "main"):
        return NONE
    names = f"{a.get('class', '')} {a.get('id', '')}".lower() if a else ""
    if tag == "article":
        return COMMENT if COMMENTS.search(names) else NONE
    if tag in UNWANTED or (tag == "header" and not in_article):
        return GONE
    if a and (
        a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
        or "display:none" in a.get("style", "").replace(" ", "").lower()
    ):
        return GONE
    if COMMENTS.search(names):
        return COMMENT
    if tag in ("form", "fieldset") or ASIDES.search(names) or (not in_article and HEADERS.search(names)):
        return ASIDE
    return LIST if LISTS.search(names) else NONE


def settle(nodes: list[Node], flow: list[Run]) -> list[Run]:
    """Decide about doubtful elements by their text; the wanted runs."""
    for node, _, n in flow:
        if n:
            up = node
            while up.tag in INLINE and up.tag != "a":
                up = up.parent
            if up.tag == "a":
                node.linked += n
            else:
                node.plain += n
    cleared: set[int] = set()
    for node in reversed(nodes[1:]):  # children come after their parents
        up = node.parent
        if node.doubt not in (COMMENT, GONE):
            up.plain += node.plain
            up.linked += node.linked + (node.plain if node.tag == "a" else 0)
    page = nodes[0].plain
    for node in nodes:
        if node.tag in ("article", "main") and node.doubt == NONE and node.plain and node.plain >= SHARE * page:
            up = node.parent
            while up is not None and up.order not in cleared:
                cleared.add(up.order)
                up = up.parent
    inside: dict[int, int] = {}  # running text of the enclosing article
    for node in nodes[1:]:
        up = node.parent
        inside[node.order] = node.plain if node.tag in ("article", "main") else inside.get(up.order, 0)
        own = node.doubt == GONE
        if node.doubt in (LIST, ASIDE, COMMENT) and node.order not in cleared:
            most = node.doubt != COMMENT and 2 * node.plain > page
            running = node.doubt == LIST and up.article and node.plain > node.linked and node.plain >= PART * inside[node.order]
            own = not (most or running)
        node.skip = up.skip or own
    return [r for r in flow if not r[0].skip]


def parse(page: str) -> tuple[list[Node], list[Run]]:
    """Elements, and the wanted runs of text in page order."""
    root = Node("", "", None, NONE, False)
    stack, nodes, flow = [root], [root], []

    def close(until: int) -> None:
        del stack[until:]

    at = 0
    while True:
        m = TOKEN.search(page, at)
        top = stack[-1]
        piece = page[at : m.start()] if m else page[at:]
        if piece and top.doubt != GONE:
            text = entities.unescape(piece)
            flow.append((top, text, len("".join(text.split()))))
        if m is None:
            break
        at = m.end()
        if m["raw"] is not None and top.doubt != GONE:
            flow.append((top, m["raw"], len("".join(m["raw"].split()))))
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag not in INLINE:
            flow.append((top, None, 0))
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            if not m["rest"].rstrip().endswith("/"):
                done = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = done.end() if done else len(page)
            continue
        if tag not in INLINE and tag not in VOID:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if tag in SCOPES and stack[k].tag in SCOPES[tag]:
                break
            if stack[k].tag in IMPLIED.get(tag, ()):
                close(k)
                break
        if tag in VOID:
            continue
        top = stack[-1]
        a = _attributes(m["rest"]) if m["rest"].strip(" /") else {}
        step = tag + "".join(f".{c}" for c in sorted(set(re.sub(r"\d+", "#", a.get("class", "")).split())))
        path = step if tag in ("html", "body") else f"{top.path}>{step}"
        doubt = GONE if top.doubt == GONE else _doubt(tag, a, top.article)
        node = Node(tag, path, top, doubt, top.article or tag in ("article", "main"))
        node.order = len(nodes)
        nodes.append(node)
        stack.append(node)
    return nodes, settle(nodes, flow)


def best_container(nodes: list[Node], flow: list[Run]) -> Node | None:
    """The whole article around the container whose blocks hold most running text; the earlier one of a tie."""
    for node, _, n in flow:
        if not n:
            continue
        link, block = False, node
        while block.parent is not None and block.tag in INLINE:
            link = link or block.tag == "a"
            block = block.parent
        if link:
            continue
        up, weight = (block.parent if block.tag in BLOCKS else block), 1.0
        while up is not None and weight >= 0.25:
            if up.tag in CONTAINERS:
                up.score += n * weight
                weight /= 2
            up = up.parent
    found = [x for x in nodes if x.score > 0 and not x.skip]
    return whole(max(found, key=lambda x: (x.score, -x.order)), flow) if found else None


def whole(best: Node, flow: list[Run]) -> Node:
    """The nearest article around a container, or else main; where there is neither, the highest container
    below the body such that none on the way adds mostly links."""
    chain, node = [], best
    while node is not None and node.tag not in ("", "html", "body"):
        chain.append(node)
        node = node.parent
    for tag in ("article", "main"):
        for node in chain:
            if node.tag == tag:
                node.score = max(node.score, best.score)
                return node
    place = {x.order: i for i, x in enumerate(chain)}
    added, links = [0] * len(chain), [0] * len(chain)
    for node, _, n in flow:
        if not n:
            continue
        link = False
        while node is not None and node.order not in place:
            link = link or node.tag == "a"
            node = node.parent
        if node is not None:
            added[place[node.order]] += n
            links[place[node.order]] += n * link
    top = best
    for k, node in enumerate(chain[1:], 1):
        if 2 * links[k] > added[k]:
            break
        if node.tag in CONTAINERS and any(added[place[top.order] + 1 : k + 1]):
            top = node
    top.score = max(top.score, best.score)
    return top


def text_of(flow: list[Run], path: str | None) -> str:
    """Text below the elements of that path (of all elements where it is None)."""
    inside: dict[int, bool] = {}

    def within(node: Node) -> bool:
        trail = []
        while node is not None and node.order not in inside:
            trail.append(node)
            if path is None or node.path == path:
                inside[node.order] = True
                break
            node = node.parent
        found = node is not None and inside[node.order]
        for x in trail:
            inside[x.order] = found
        return found

    return " ".join("".join(" " if text is None else text for node, text, _ in flow if within(node)).split())


def extract(page: str, winners: list[str]) -> str:
    nodes, flow = parse(page)
    paths = {x.path for x in nodes if not x.skip}
    for path in winners:
        if path in paths and (text := text_of(flow, path)):
            return text
    best = best_container(nodes, flow)
    return text_of(flow, best.path) if best is not None else text_of(flow, None)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """One row per host: host, paths (most votes first)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, scores = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html")):
                best = best_container(*parse(page.as_py() or ""))
                if best is not None:
                    hosts.append(host)
                    paths.append(best.path)
                    scores.append(int(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "score"])

    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(vote, "host string, path string, score long")
    summed = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("score").alias("score"))
    summed = summed.withColumn("all", F.sum("votes").over(Window.partitionBy("host"))).where(F.col("votes") >= F.lit(share) * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct("votes", "score", "path")), asc=False)
    return summed.groupBy("host").agg(F.transform(ranked, lambda r: r["path"]).alias("paths"))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    winners = stored(winning_paths(pages, url_col, html_col, share), "paths")
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py() or "", paths or []) for page, paths in zip(batch.column("html"), batch.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"])

    ready = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = ready.join(winners, "host", "left").select("id", "url", "html", "paths")
    out = joined.mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
