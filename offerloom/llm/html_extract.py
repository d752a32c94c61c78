"""Main-text extraction from HTML with site style trees.

Each page is read whole into blocks of text under their branch: the path of sectioning
elements with their class names, furniture and main content alike. The pages of a host are
merged by branch into a style tree. A branch's content importance is one minus the mean
entropy of the words it holds itself over the pages (words that every page repeats carry
nothing); its presentation importance is the entropy of the sequences of children
it shows; both are joined as composite importance, content weighing ``DECAY`` to the power
of the number of styles. Both are drawn towards 1 by ``PRIOR_PAGES`` pages that
say nothing, so that few pages never condemn a branch.

A branch is removed from every page of its host if it is low: composite importance below
``LEAST_IMPORTANCE`` and content below half of the host's best. The tree also tells branches outside
article and main elements by the main element's own content: poor ones, below ``RICH`` of it, are removed,
rich ones stay though they lie beside it. For that a branch's content is drawn towards 0 by ``BESIDE_PAGES``
pages, so that it takes many pages to keep what HTML says is not main; no number of pages switches
anything. Beside a main element text that the tree doesn't tell apart goes if
that element holds half or more of the page's words. Never kept, whatever the tree finds, is what HTML itself declares to be no main
text (navigation, forms, roles, ...) and containers whose name has a furniture word as
its head ("left-sidebar", "adSlot2", but not "notice-period"; inside a main element "menu" and "social" name content).

Entropies are sums over (host, branch, word), aggregated before and by the shuffle, so a host
of any size is never in one task; only the verdicts on branches meet the pages.

Cases: null and empty pages have an empty text; unclosed, misnested and unknown elements
are tolerated, a tag without an end is text; very long pages and broken markup take time in
proportion to their length; elements nested deeper than ``DEPTH`` belong to the branch there, but
what they declare or are named still cuts them out; an element that isn't closed ends with its parent, so an unclosed nav takes what follows in it; a page without
article or main element is judged by its branches alone; pages without a host form one site;
repeated rows are extracted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage

DECAY = 0.9
LEAST_IMPORTANCE = 0.5
PRIOR_PAGES = 8
BESIDE_PAGES = 2
RICH = 0.97
DEPTH = 512
BRANCH_DEPTH = 32
LABEL = 60

SCHEMA = "page_id long, url string, text string, n_chars long, host string"

#: Elements by their role in HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BRANCHES = frozenset("article aside body div dl figure footer form header main nav ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOISE = frozenset("nav aside footer form script style noscript template iframe button select option textarea dialog svg canvas object audio video map head title menu".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article main section div nav aside form".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: Elements whose names may tell furniture, the words that do, and words after which the one before is the head.
NAMED = frozenset("div section article aside ul ol dl li table figure span p ins center details fieldset".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promoted promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter newsletters subscribe subscription signup login register menu menus nav navs navbar navigation breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended recommendations share shares sharing social footer masthead topbar toolbar comment comments commentlist reply replies respond disqus copyright pagination pager search skip taboola outbrain".split()
)
FURNITURE_BESIDE = frozenset(("header",))
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words that inside a main element name its own content: the menu of a kitchen, social affairs.
IN_TEXT = frozenset("menu menus social".split())
WRAPPERS = frozenset("box container wrapper wrap block area section list bar panel slot unit inner outer item items holder region group content zone row col top bottom left right side button buttons link links icon icons post posts article articles form thread".split())

HUMP = re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><\"']*)([^<>\"']*)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].encode().lower().decode() if found else ""


def site_of(host: str) -> int:
    """The same value as Spark's xxhash64 of the host."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(host.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@lru_cache(maxsize=1 << 16)
def head_word(name: str) -> str:
    """What a class or id says it is: its last word that is no wrapper; several words that together are a furniture word count as that."""
    words = [w.lower() for w in HUMP.split(name) if w]
    if "".join(words) in FURNITURE:
        return "".join(words)
    while words and words[-1] in WRAPPERS:
        words.pop()
        if "".join(words) in FURNITURE:
            return "".join(words)
    return words[-1] if words else ""


class Scanner:
    """The tags of a page, left to right, in time that grows with its length: each search that can fail fails once."""

    def __init__(self, page: str):
        self.page, self.last_end, self.quoted = page, page.rfind(">"), True
        self.none_after = {'"': False, "'": False}

    def tag(self, at: int) -> tuple[int, str, str, str] | None:
        """(end, slash, name, attributes) of the tag that begins at ``at``; the name is empty for comments; None if it is text."""
        page = self.page
        m = TAG.match(page, at)
        if m:
            return m.end(), m[1], m[2].lower(), m[3]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), "", "", ""
        if at > self.last_end:
            return None
        if page[at + 1 : at + 2] in ("!", "?"):
            return page.find(">", at) + 1, "", "", ""
        name = re.match(r"</?[a-zA-Z]", page[at : at + 3])
        if not name:
            return None
        end = self._end(at)
        found = NAME.match(page, at, end)
        return end, found[1], found[2].lower(), page[found.end() : end - 1]

    def _end(self, at: int) -> int:
        """Behind the first > outside quotes; where quotes don't close, behind the first > at all."""
        page, place = self.page, at
        while self.quoted:
            m = STOP.search(page, place)
            if not m:
                self.quoted = False
                break
            if m[0] == ">":
                return m.end()
            if self.none_after[m[0]]:
                place = m.end()
                continue
            close = page.find(m[0], m.end())
            if close < 0:
                self.none_after[m[0]] = True
                place = m.end()
            else:
                place = close + 1
        return page.find(">", at) + 1


class Element:
    __slots__ = ("tag", "noise", "core", "branch", "depth", "children")

    def __init__(self, tag: str, noise: bool, core: bool, branch: str, depth: int, children: list | None):
        self.tag, self.noise, self.core, self.branch, self.depth, self.children = tag, noise, core, branch, depth, children


def read(page: str, furniture: bool = False, names: bool = True, declared: bool = True) -> tuple[list[tuple[str, bool, str]], dict[str, list[tuple]]]:
    """The blocks (branch, within a main element, text) and the child sequences of each branch; with ``furniture`` those of declared furniture too.

    Without ``names`` class names and ids, without ``declared`` elements and roles say nothing about what is main text.
    """
    blocks: list[tuple[str, bool, str]] = []
    styles: dict[str, list[tuple]] = {}
    parts: list[str] = []
    beside: list[str] = []
    stack = [Element("", False, False, "", 0, None)]
    opened: Counter = Counter()
    deeper: Counter = Counter()
    mute: list = []  # of a noise element below DEPTH its tag and how many of that tag are open there
    scanner, at, size = Scanner(page), 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:  # never from inside noise; an unclosed inline advert may be on top
                here = next(e for e in reversed(stack) if not e.noise)
                blocks.append((here.branch, here.core, text))
        if beside:
            text = " ".join("".join(beside).split())
            beside.clear()
            if text:
                blocks.append((stack[-1].branch, False, text))

    def pop() -> None:
        done = stack.pop()
        opened[done.tag] -= 1
        if done.children is not None:
            styles.setdefault(done.branch, []).append(tuple(done.children))

    def show(text: str) -> None:
        if not (stack[-1].noise or mute):
            parts.append(html.unescape(text))
        elif furniture:
            beside.append(html.unescape(text))

    while at < size:
        start = page.find("<", at)
        if start < 0:
            show(page[at:])
            break
        if start > at:
            show(page[at:start])
        found = scanner.tag(start)
        if found is None:
            show("<")
            at = start + 1
            continue
        at, slash, tag, rest = found
        if not tag:
            continue
        if slash:  # end tag
            if tag in BLOCKS:
                flush()
            if deeper[tag]:
                deeper[tag] -= 1
                if mute and mute[0] == tag:
                    mute[1] -= 1
                    if not mute[1]:
                        flush()
                        mute.clear()
            elif opened[tag]:
                mute.clear()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                if beside or any(e.tag in BLOCKS for e in stack[k:]):
                    flush()
                while len(stack) > k:
                    pop()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", end.end()) + 1 or size) if end else size
            continue
        if tag == "br":
            show(" ")
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        block = tag in BLOCKS
        if block:
            flush()
            if stack[-1].tag in CLOSED_BY_BLOCK:
                pop()
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                pop()
        same = SAME_KIND.get(tag)
        if same and any(opened[t] for t in same):
            k = len(stack) - 1
            while k > 0 and stack[k].tag not in SCOPE and stack[k].tag not in same:
                k -= 1
            if stack[k].tag in same:
                while len(stack) > k:
                    pop()
        attributes = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(rest)} if "=" in rest or "hidden" in rest else {}
        top, role = stack[-1], attributes.get("role", "").lower()
        named = names and bool(attributes) and tag in NAMED and not (tag == "article" and not top.core) and is_furniture(attributes, top.core)
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", "")
        noise = top.noise or named or hidden or (declared and (tag in NOISE or (tag == "header" and not top.core) or role in NOISE_ROLES))
        core = declared and not noise and (top.core or tag in ("article", "main") or role == "main")
        if not (block or noise):
            continue  # inline elements leave no trace, but an inline advert is cut out of its block
        if len(stack) > DEPTH:
            deeper[tag] += 1
            if mute:
                mute[1] += mute[0] == tag
            elif noise and not top.noise:
                flush()
                mute[:] = tag, 1
            continue
        if block and top.children is not None:
            top.children.append(tag)
        if tag in BRANCHES:
            label = shortened(tag + "." + re.sub(r"\d+", "", attributes["class"].lower()).replace("/", "-").replace(" ", ".") if attributes.get("class") else tag)
            path = f"{top.branch}/{label}"
            if top.depth >= BRANCH_DEPTH:
                path = f"{'/main' if top.core else ''}/~{crc32(path.encode()):08x}"  # what is deeper goes by a digest of its path
            stack.append(Element(tag, noise, core, path, top.depth + 1, [] if furniture else None))
        else:
            stack.append(Element(tag, noise, core, top.branch, top.depth, None))
        opened[tag] += 1
        if rest.endswith("/") and not block:
            pop()
    flush()
    while len(stack) > 1:
        pop()
    return blocks, styles


def shortened(label: str) -> str:
    """A label of at most about ``LABEL`` characters; longer ones end in a digest, so that different ones stay different."""
    return label if len(label) <= LABEL else f"{label[:LABEL]}~{crc32(label.encode()):08x}"


def is_furniture(attributes: dict[str, str], core: bool) -> bool:
    """Whether a container's names say that it is furniture; inside a main element classes alone do, ids only for readers' comments."""
    heads = {head_word(c) for c in attributes.get("class", "").split()}
    if core:
        heads -= IN_TEXT
    if not FURNITURE.isdisjoint(heads):
        return True
    own = {head_word(c) for c in attributes.get("id", "").split()}
    return not READERS.isdisjoint(own) if core else not (FURNITURE.isdisjoint(own) and FURNITURE_BESIDE.isdisjoint(heads | own))


def node_of(host: str, branch: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(f"{host}\0{branch}") >> 1


def main_text(page: str | None, host: str = "", removed: frozenset = frozenset(), rich: frozenset = frozenset(), names: bool = True, declared: bool = True) -> str:
    """The blocks of a page that its declared elements and the verdicts on its host's branches leave, joined by blank lines."""
    blocks, _ = read(page or "", names=names, declared=declared)
    inside = sum(len(text) for _, core, text in blocks if core)
    speaks = inside > 0 and 2 * inside >= sum(len(text) for _, _, text in blocks)
    if not (removed or rich):
        return "\n\n".join(text for _, core, text in blocks if core or not speaks)
    node = {branch: node_of(host, branch) for branch in {b for b, _, _ in blocks}}
    return "\n\n".join(text for branch, core, text in blocks if (node[branch] in rich if speaks and not core else node[branch] not in removed))


def style_tree(pages: DataFrame) -> DataFrame:
    """A row per host and branch: node, site, standing (0 outside main elements, 1 inside, 2 the element itself), pages, words, content, importance.

    ``node`` and ``site`` are hashes of host and branch, and of host.
    """
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest

    schema = pa.schema([("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("c", pa.float64()), ("x", pa.float64())])
    core = re.compile(r"/(?:article|main)(?:\.[^/]*)?(/|$)")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[float]] = {}

        def add(key: tuple, c: int, x: float) -> None:
            s = sums.get(key)
            if s is None:
                sums[key] = [c, x]
            else:
                s[0] += c
                s[1] += x

        def rows() -> pa.RecordBatch:
            keys = list(sums)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] if k[1] == 2 else xxh3_64_intdigest(k[2]) >> 1 for k in keys], [v[0] for v in sums.values()], [v[1] for v in sums.values()]]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                blocks, styles = read(page or "", furniture=True)
                words: dict[str, list[str]] = {}
                for branch, _, text in blocks:
                    words.setdefault(branch, []).append(text)
                site = site_of(host)
                for branch in words.keys() | styles.keys():
                    node, m = node_of(host, branch), core.search(branch)
                    add((node, 2, site), 1, 0.0 if m is None else 1.0 if branch[m.end() :] or m[1] else 2.0)  # pages that have the branch
                    for w, c in Counter(" ".join(words.get(branch, ())).encode().split()).items():
                        add((node, 0, w), c, c * math.log(c))
                    for s in {",".join(s) for s in styles.get(branch, ())}:
                        add((node, 1, s.encode()), 1, 0.0)
                if len(sums) > 400_000:
                    yield rows()
        if sums:
            yield rows()

    found = pages.select("url", "html").mapInArrow(features, "node long, kind int, feature long, c double, x double")
    per = found.groupBy("node", "kind", "feature").agg(F.sum("c").alias("c"), F.sum("x").alias("x"))
    # words: entropy of each over pages; styles: terms of the entropy of the branch over styles; pages: their number and site
    word, shown, page = (F.col("kind") == k for k in range(3))
    nodes = per.groupBy("node").agg(
        F.max(F.when(page, F.col("feature"))).alias("site"),
        F.max(F.when(page, (F.col("x") / F.col("c")).cast("int"))).alias("standing"),
        F.max(F.when(page, F.col("c"))).alias("pages"),
        F.count(F.when(word, 1)).alias("words"),
        F.sum(F.when(word, F.log("c") - F.col("x") / F.col("c")).otherwise(0.0)).alias("nats"),
        F.count(F.when(shown, 1)).alias("styles"),
        F.sum(F.when(shown, F.col("c")).otherwise(0.0)).alias("shown"),
        F.sum(F.when(shown, F.col("c") * F.log("c")).otherwise(0.0)).alias("shown_log"),
    )
    several = F.col("pages") > 1
    content = F.when(several & (F.col("words") > 0), 1 - F.col("nats") / F.col("words") / F.log("pages")).otherwise(F.lit(1.0))
    style = F.when(several & (F.col("shown") > 0), F.least((F.log("shown") - F.col("shown_log") / F.col("shown")) / F.log("pages"), F.lit(1.0))).otherwise(F.lit(1.0))
    weight = F.pow(F.lit(DECAY), F.col("styles"))
    return nodes.select("node", "site", "standing", "pages", "words", content.alias("content"), ((1 - weight) * style + weight * content).alias("importance"))


def verdicts(tree: DataFrame) -> DataFrame:
    """(node, site, rich) of the branches that the tree removes (rich false), or keeps though they lie beside a main element."""

    def drawn(column: str):
        return (F.col("pages") * F.col(column) + PRIOR_PAGES) / (F.col("pages") + PRIOR_PAGES)

    beside = F.col("pages") * F.col("content") / (F.col("pages") + BESIDE_PAGES)
    held = tree.where("words > 0").withColumns({"beside": beside, "content": drawn("content"), "importance": drawn("importance")})
    best = held.groupBy("site").agg(F.max("content").alias("most"), F.max(F.when(F.col("standing") > 0, F.col("content"))).alias("main"))
    low = (F.col("standing") < 2) & (F.col("importance") < LEAST_IMPORTANCE) & (F.col("content") < F.col("most") / 2)
    told = (F.col("standing") == 0) & F.col("main").isNotNull()
    rich = told & (F.col("beside") >= RICH * F.col("main"))
    poor = told & (F.col("content") < RICH * F.col("main"))
    return held.join(best, "site").where(low | rich | poor).select("node", "site", (rich & ~low).alias("rich"))


def extract(pages: DataFrame, tree: bool = True, names: bool = True, declared: bool = True) -> DataFrame:
    """page_id, url, text, n_chars, host of every page; ``tree``, ``names`` and ``declared`` are there to measure what each does."""
    import pyarrow as pa

    found = stage(verdicts(stage(style_tree(pages), "style-tree")).where(F.lit(tree)), "verdicts")
    lists = found.groupBy("site").agg(F.collect_list(F.when(~F.col("rich"), F.col("node"))).alias("removed"), F.collect_list(F.when(F.col("rich"), F.col("node"))).alias("rich"))
    if found.count() <= BROADCAST_ROWS:  # counted in branches, not in lists
        lists = F.broadcast(lists)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        for batch in batches:
            text = []
            for page, host, site, removed, rich in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), batch.column(5), batch.column(6)):
                if site not in known:
                    if len(known) > 64:
                        known.clear()
                    known[site] = frozenset(removed.as_py() or ()), frozenset(rich.as_py() or ())
                text.append(main_text(page, host, *known[site], names=names, declared=declared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "host"])

    host = F.coalesce(F.translate(F.regexp_extract("url", HOST.pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    with_site = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")).withColumn("site", F.xxhash64("host"))
    return with_site.join(lists, "site", "left").select("page_id", "url", "html", "host", "site", "removed", "rich").mapInArrow(texts, SCHEMA)
