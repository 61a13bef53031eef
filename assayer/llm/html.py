"""Main text of web pages by consensus paths: pages score their containers, hosts vote on paths, pages are read again by the winners.

A page's candidate grows from the innermost element that holds most of its plain running text, apart from what its tag or
class marks as furniture: to the outermost article or main around it, or else to the outermost element that adds more plain
text than links at each step. Its path, tags and classes from the root with digits taken out, gets the page's vote; votes
are counted by host in Spark. The path with most votes wins, and so do all with a good share of them (VOTES), for a host may
have several templates. A page gives the text of all its elements on its own candidate's path if that is a winner, else on
the first winning path that it has, or of its own candidate where it has none of them.

What a tag, class or id marks as furniture is still no furniture if it holds most of the page's plain text and its title or an
article, or nearly all of it; and a section of an article whose id may be that of a part of it (SECTIONS), with a heading and few
links, stays unless comments lie in it.

A null or empty html, or an empty table, gives empty text, or no rows. A page without a host votes with all others that have none.
Ties go to the path with more text, then to the one that sorts last. Repeated rows vote each and give the same text. Pages are
read in time in proportion to their length, however long, deep or broken: an unclosed comment or script reaches to the end, what
looks like no tag is text. Other columns of pages, whatever their names, are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Cut, arrow_batches, small, trimmed

#: Share of a page's running text that its container holds at least.
SHARE = 0.85
#: Share of a host's votes, and votes, with which a path wins beside the first.
VOTES, LEAST = 0.05, 2

# Fixed values of HTML: element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("dd dt head html body li option optgroup summary legend tbody td tfoot th thead tr".split())
FURNITURE = frozenset("nav footer aside script style noscript iframe template button select option textarea head title menu dialog search canvas audio video".split())
#: Blocks that are part of a text, and no containers of it.
PARTS = frozenset("p li h1 h2 h3 h4 h5 h6 tr thead tbody tfoot ul ol dl dt dd table td th caption blockquote pre figure figcaption".split())
#: What an element ends if it is still open, and the elements that keep what is around them open.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead")}
SHELTERS = {"ul": {"li"}, "ol": {"li"}, "menu": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th", "tbody", "thead"}, "select": {"option"}}
KEPT_OPEN = frozenset(x for names in CLOSED_BY.values() for x in names)
CELLS = frozenset(("td", "th", "table"))
#: Words of class and id that mark furniture, and roles. A name counts if all its parts are such words or neutral ones.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation topbar toolbar breadcrumb breadcrumbs pager pagination footer foot header masthead cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay subscribe subscription newsletter signup login share sharing social comment comments disqus replies reply respond discussion related recommended recommendations widget widgets copyright skip search form".split()
)
NEUTRAL = frozenset(
    "area aside bar block body bottom box btn button buttons card center column columns container content dialog fixed floating global grid group holder icon icons inner item items layout left link links list main message mobile module outer page panel placeholder policy posts primary right row secondary section site slot sticky text thread title top unit wrap wrapper".split()
)
#: Words that mark furniture beside any others.
STRONG = frozenset("advert advertisement adsense breadcrumb breadcrumbs comments disqus gdpr navbar navigation newsletter sidebar sponsored".split())
#: Words before a mark that speak of something else on the page: has-sidebar, no-sidebar.
ABOUT = frozenset("has no with without hide show".split())
#: Ids of sections that an article may have itself, and marks of readers' comments.
SECTIONS = frozenset("discussion related notices".split())
COMMENTS = frozenset("comment comments disqus replies reply respond discussion".split())
#: Shares of a page's plain running text of what is no furniture, whatever it is called: with a title or article in it, or without.
MOST, NEARLY_ALL = 0.5, 0.85
#: Share of link text that a section of an article stays under.
LINKS = 0.3
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# Quotes count after an equals sign, and only where they are closed. Once no tag can be read so to its end, tags end at the next >.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
_LOOSE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAME = re.compile(r"/?[a-zA-Z]")
_ATTR = re.compile(r"([^\s/>=\"']+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_OWN_SLASH = re.compile(r"=[^\s\"'=]*/\Z")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9/]+")


class Node:
    """An element; nodes are numbered in page order, parents before what they hold. open: the places of what later tags may end."""

    __slots__ = ("no", "tag", "path", "parent", "skip", "mark", "link", "article", "open", "plain", "linked")

    def __init__(self, no: int, tag: str, path: int, parent: Node | None, skip: bool, link: bool, mark: str = ""):
        self.no, self.tag, self.path, self.parent, self.skip, self.link, self.mark = no, tag, path, parent, skip, link, mark
        self.article = parent is not None and (parent.article or tag in ("article", "main"))
        self.plain = self.linked = 0


class Page:
    """The elements, the runs of text in page order (element, text, whether a new block begins before it, characters but white space), and the numbered paths."""

    def __init__(self):
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.nodes, self.runs = [Node(0, "", 0, None, False, False)], []
        self.nodes[0].open = {}

    def path(self, parent: int, step: str) -> int:
        found = self.paths.setdefault((parent, step), len(self.steps))
        if found == len(self.steps):
            self.steps.append((parent, step))
        return found

    def spelled(self, path: int) -> str:
        out = []
        while path > 0:
            path, step = self.steps[path]
            out.append(step)
        return "/".join(["", *reversed(out)])

    def known(self, spelled: str) -> int | None:
        """The number of a path as spelled() gives it; None if the page has no such element."""
        path: int | None = 0
        for step in spelled.split("/")[1:]:
            path = self.paths.get((path, step))
            if path is None:
                return None
        return path


@lru_cache(1 << 14)
def _is_mark(name: str) -> bool:
    """Parts are parted by dashes, digits and capitals: ad-box and adBox are furniture, shadow and share-price are not."""
    parts = _WORDS.findall(_HUMP.sub(" ", name).lower())
    if parts and parts[0] in ABOUT:
        return False
    return any(x in STRONG for x in parts) or any(x in MARKS for x in parts) and all(x in MARKS or x in NEUTRAL or len(x) < 3 for x in parts)


def _marked(tag: str, attrs: str, within: bool) -> tuple[str, bool, str]:
    """The classes as part of a path, whether the element is furniture for sure, and the names that say it may be; a header within an article is part of it."""
    if tag in FURNITURE or tag == "header" and not within:
        return "", True, ""
    mark = "form" if tag == "form" else ""
    if not attrs:
        return "", False, mark
    found: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(attrs):
        found.setdefault(k.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "", True, ""
    names = found.get("class", "").split()
    classes = ".".join(sorted({_DIGITS.sub("", x) for x in found.get("class", "").lower().split()} - {""}))
    if tag in ("html", "body", "main", "h1"):
        return classes, False, ""
    role, own = found.get("role", "").lower(), found.get("id", "")
    names = [x for x in (*names, own) if x and len(x) < 200 and _is_mark(x) and not (within and x.lower() == "header")]
    if within and names == [own] and own.lower() in SECTIONS:
        return classes, False, f"#{own.lower()}"
    return classes, False, " ".join([*names, *([role] if role in ROLES else []), *([mark] if mark else [])])


def _settle(page: Page) -> None:
    """Decides which marked elements are furniture, and drops what lies in them."""
    nodes, count = page.nodes, len(page.nodes)
    plain, linked, told, title, heading, comments = ([0] * count for _ in range(6))
    for node, _, _, n in page.runs:
        (linked if node.link else plain)[node.no] += n
    for node in reversed(nodes[1:]):  # parents come first
        i, up = node.no, node.parent.no
        told[i] = bool(node.mark) and not COMMENTS.isdisjoint(_WORDS.findall(_HUMP.sub(" ", node.mark).lower()))
        plain[up] += plain[i]
        linked[up] += linked[i]
        title[i] |= node.tag in ("h1", "article", "main")
        title[up] |= title[i]
        heading[up] |= heading[i] or node.tag in ("h2", "h3", "h4", "h5", "h6")
        comments[up] |= comments[i] or told[i]
    for node in nodes[1:]:
        i = node.no
        node.skip = node.skip or node.parent.skip
        if node.mark and not node.skip:
            share = plain[i] / max(plain[0], 1)
            if node.mark[0] == "#":
                stays = heading[i] and not comments[i] and linked[i] <= LINKS * (plain[i] + linked[i])
            else:
                stays = not told[i] and (share >= NEARLY_ALL or share >= MOST and title[i])
            node.skip = not stays
    page.runs = [x for x in page.runs if not x[0].skip]


def parse(text: str) -> Page:
    """Reads a page once, in time in proportion to its length: no tag, however broken or deep, is looked for twice."""
    page = Page()
    nodes, runs = page.nodes, page.runs
    stack, total, cells, endless = [nodes[0]], Counter(), [Counter()], set()
    begin = at = 0
    new, strict, last = True, True, text.rfind(">")

    def flush(to: int) -> None:
        nonlocal new
        if begin < to and not stack[-1].skip:
            run = entities.unescape(text[begin:to])
            runs.append((stack[-1], run, new, len("".join(run.split()))))
            new = False

    def pop() -> str:
        node = stack.pop()
        total[node.tag] -= 1
        if node.tag in CELLS:
            cells.pop()
        else:
            cells[-1][node.tag] -= 1
        return node.tag

    while (lt := text.find("<", at)) >= 0:
        c = text[lt + 1 : lt + 2]
        if c in ("!", "?") and lt < last or text.startswith("<!--", lt):
            comment = text.startswith("<!--", lt)
            end = text.find("-->" if comment else ">", lt + 2)
            flush(lt)
            begin = at = len(text) if end < 0 else end + (3 if comment else 1)
            continue
        m = None
        if lt < last and _NAME.match(text, lt + 1):
            m = _TAG.match(text, lt + 1) if strict else None
            if m is None:
                strict = False
                m = _LOOSE.match(text, lt + 1)
        if m is None:
            at = lt + 1
            continue
        flush(lt)
        begin = at = m.end()
        tag = m[2].lower()
        if tag in BLOCK:
            new = True
        if m[1]:
            if total[tag] if tag in BLOCK else cells[-1][tag]:
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            runs.append((stack[-1], " ", False, 0))
            continue
        up = stack[-1].open
        close = up.get("p") if tag in CLOSES_P else min((up[x] for x in CLOSED_BY.get(tag, ()) if x in up), default=None)
        while close is not None and len(stack) > close:
            pop()
        parent = stack[-1]
        classes, skip, mark = _marked(tag, m[3], parent.article)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and not _OWN_SLASH.search(m[3]):
            continue
        node = Node(len(nodes), tag, page.path(parent.path, f"{tag}.{classes}" if classes else tag), parent, parent.skip or skip, parent.link or tag == "a", mark)
        nodes.append(node)
        if tag in RAW and tag not in endless:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at, last + 1)  # beyond the last > no tag ends
            if end or tag in ("script", "style"):
                begin = at = end.end() if end else len(text)
                continue
            endless.add(tag)
        node.open = parent.open
        gone = SHELTERS.get(tag, set()) | ({"p"} if tag in BLOCK else set())
        if not gone.isdisjoint(node.open):
            node.open = {k: v for k, v in node.open.items() if k not in gone}
        if tag == "p" or tag in KEPT_OPEN:
            node.open = {tag: len(stack), **node.open}
        total[tag] += 1
        if tag in CELLS:
            cells.append(Counter())
        else:
            cells[-1][tag] += 1
        stack.append(node)
    flush(len(text))
    if any(node.mark for node in nodes):
        _settle(page)
    return page


def candidate(page: Page) -> tuple[int, int]:
    """The path of the element that holds the main text, and its size; links do not count."""
    nodes = page.nodes
    for node, _, _, n in page.runs:
        if n:
            if node.link:
                node.linked += n
            else:
                node.plain += n
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.linked += node.linked
    whole = nodes[0].plain - nodes[0].linked
    best = nodes[0]
    for node in nodes:  # parents come first
        if node.tag in BLOCK and node.tag not in PARTS and node.plain - node.linked >= SHARE * max(whole, 1):
            best = node
    around, outer = best, None
    while around is not None:
        outer = around if around.tag in ("article", "main") else outer
        around = around.parent
    if outer is not None:
        return outer.path, outer.plain
    around = best.parent
    while around is not None and around.linked - best.linked <= around.plain - best.plain:
        # What adds nothing is no better.
        best = around if around.plain > best.plain else best
        around = around.parent
    return best.path, best.plain


def extracted(page: Page, path: int) -> str:
    """The blocks of all elements on the path, one to a line."""
    inside = [False] * len(page.nodes)
    for node in page.nodes:
        inside[node.no] = node.path == path or node.parent is not None and inside[node.parent.no]
    blocks, pending = [], True
    for node, run, new, _ in page.runs:
        pending = pending or new
        if not inside[node.no]:
            pending = True
            continue
        if pending:
            blocks.append([])
            pending = False
        blocks[-1].append(run)
    lines = [" ".join("".join(b).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


@trimmed
def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's own candidate: its path, size and text."""
    for batch in batches:
        paths, sizes, texts = [], [], []
        for html in batch.column(batch.num_columns - 1).to_pylist():
            page = parse(html or "")
            path, size = candidate(page)
            paths.append(page.spelled(path) if size else None)
            sizes.append(size)
            texts.append(extracted(page, path))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "path", "size", "text"])


@trimmed
def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages by the first of the host's winning paths that gives text, else by their own."""
    for batch in batches:
        texts = []
        for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            page = parse(html or "")
            tried = (extracted(page, path) for path in map(page.known, paths) if path is not None)
            texts.append(next((x for x in tried if x), None) or extracted(page, candidate(page)[0]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1))


def main_text(pages: DataFrame) -> DataFrame:
    """Rows of pages (page_id, url, html): page_id, url, text, n_chars."""
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), F.xxhash64("html").alias("k"), F.col("html").cast("string").alias("html"))
    own = Cut(rows.mapInArrow(_own, "page_id long, url string, host string, k long, path string, size long, text string"), "own").df
    counted = Cut(own.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "votes").df
    vote = F.struct("n", "size", "path")
    hosts = counted.groupBy("host").agg(F.sum("n").alias("total"), F.max(vote).alias("first"))
    others = counted.join(small(hosts), "host").where((vote == F.col("first")) | (F.col("n") >= F.greatest(F.lit(LEAST), VOTES * F.col("total"))))
    won = small(Cut(others.groupBy("host").agg(F.sort_array(F.collect_list(vote), asc=False)["path"].alias("paths")), "paths").df)
    judged = own.join(won, "host", "left").withColumn("again", F.expr("paths is not null and not coalesce(array_contains(paths, path), false)"))
    # Only pages of another make than their host's are read again.
    differ = Cut(judged.where("again").select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("k").alias("_k")).distinct(), "differ").df
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("page_id", "_id"), ("url", "_url"), ("k", "_k"))]
    reread = rows.join(small(differ), same, "left_semi").join(won, "host", "left").select("page_id", "url", "html", "paths")
    texts = judged.where("not again").select("page_id", "url", "text").unionByName(reread.mapInArrow(_again, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
