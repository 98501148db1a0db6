"""Main text of web pages by site style trees.

The pages of a host share templates.  Their trees are merged: container elements with the same path of
tags, classes and places among like siblings are one node of the host's style tree.  A node is important if its pages disagree, in
presentation (the entropy of its child sequences) or in content (how few pages share the texts below
it); a menu, notice or advert that looks and reads alike everywhere has importance near zero, and that
branch is cut from each page.  Only branches on many different pages of the host are judged; copies of a page
are one page, so what they share with each other is no template.  Importance mixes both as ``(1 - g^l) * presentation + g^l * content`` for
``l`` presentations, so one fixed presentation is judged by its content.

Elements that say what they are (``nav``, ``footer``, ``class="cookie-notice"``, ...) are cut whatever
their content.  A class or id says so if all its parts do, if it ends with a place (``site-footer``) or adds
a mere carrier (``ad-slot``); ``has-sidebar`` does not.  It never cuts an outermost article or what holds
one, but for readers' comments; if a page has no text without such names, they are ignored.  A name of which
only a part says so is evidence: the tree decides, with ``DOUBT`` instead of ``LOW``.

The text of a page is that of its ``main`` or of its outermost articles, whichever holds more words; of a
``main``, that of its articles if they hold most of its words.

Nodes are counted per task, added up by a partial aggregation (a host of a third of all pages is one row
per node and task), and joined back as one short list per host; the list is broadcast only if it was
counted to be small, else pages meet it by a join on the host that may be split.  Pages are parsed one
by one with patterns that cannot backtrack over a page.

Defined results: a null or empty page has an empty text; a null or odd address belongs to the host "";
what fewer than
``MIN_PAGES`` different pages of a host or less than ``MIN_SHARE`` of them hold is not cut for its importance; if the cuts would leave
nothing, only named elements are cut; repeated rows are extracted alike; an empty table gives an empty
result; other columns pass through, and columns named like an added one are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm.common import read, schema_with
from leafwright.llm.registry import query
from leafwright.session import stored

MIN_PAGES = 4
MIN_SHARE = 0.1
LOW = 0.35
DOUBT = 0.6  # the same for elements with a name that partly says noise
DECAY = 0.9
DEPTH = 64  # deeper elements count as parts of their ancestor at this depth
SMALL = 200_000  # nodes that may be broadcast

# The roles of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre
    search section summary table tbody td tfoot th thead tr ul caption option optgroup select""".split()
)
CONTAINER = frozenset(
    """aside center details dialog div dl fieldset figure footer form header hgroup menu nav ol
    search section table ul article body main""".split()
)
NEVER_CUT = frozenset("article body main".split())
NOISE = frozenset(
    """head nav footer aside form menu dialog search button select object audio video canvas
    script style textarea title noscript template iframe xmp noembed noframes
    annotation annotation-xml desc metadata defs""".split()
)
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion
    banner banners cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation
    menu menus breadcrumb breadcrumbs pagination pager sidebar footer comment comments disqus respond reply
    replies share sharing social related recommended newsletter subscribe subscription signup login search
    widget toolbar masthead skip""".split()
)
# Parts of names: places that decide alone at a name's end, mere carriers after a noise name, beginnings of
# names that tell about something else, and readers' comments.
PLACES = frozenset("footer menu nav navbar navigation sidebar breadcrumb breadcrumbs toolbar masthead pagination".split())
CARRIERS = frozenset(
    """bar slot area box wrapper wrap container list section block unit panel inner holder links items row group
    buttons button icons posts stories articles zone""".split()
)
ABOUT = frozenset("has no not with without is in category tag type format post single".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
# What an opening tag closes, if it is the innermost open element of the list.
CLOSES = {
    **{t: ("p",) for t in BLOCK - {"option", "optgroup"}},
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("option",),
    "optgroup": ("option", "optgroup"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"),
    "th": ("p", "td", "th"), "tbody": ("p", "td", "th", "tr", "thead", "tbody"), "tfoot": ("p", "td", "th", "tr", "tbody"),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^<>]*+>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)")


def host_of(url: str) -> Column:
    """The host of an address, or the empty one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _HOST.pattern, 1))


class _Open:
    """An open element."""

    __slots__ = (
        "tag", "path", "depth", "noise", "cut", "main", "shape", "texts", "container", "kids", "named", "skip", "doubt",
    )

    def __init__(self, tag, path, depth, noise, cut, main, container, named=None, skip=False, doubt=False):
        # main: 1 in a main element, 2 in an article, 3 in both
        self.tag, self.path, self.depth, self.noise, self.cut, self.main = tag, path, depth, noise, cut, main
        self.shape, self.texts, self.container, self.kids = [], [], container, Counter()
        # innermost element that only a name marks as noise: [has an article, the next one outside, is of
        # comments]; text is not read; a part of its name says noise
        self.named, self.skip, self.doubt = named, skip, doubt


def _said(token: str, main: int) -> tuple[bool, bool, bool]:
    """Whether a class or id marks noise, readers' comments, or a part of it says noise."""
    parts = [w.lower() for w in _NAMES.findall(token)]
    if not parts:
        return False, False, False
    doubt = not NOISE_NAMES.isdisjoint(parts)
    if len(parts) > 1 and parts[0] in ABOUT:
        return False, False, doubt
    noise = (
        NOISE_NAMES.issuperset(parts) or parts[-1] in PLACES or (parts[-1] == "header" and not main)
        or (len(parts) > 1 and parts[-1] in CARRIERS and NOISE_NAMES.issuperset(parts[:-1]))
    )
    comments = parts[0] in COMMENTS or parts[-1] in COMMENTS
    return noise or comments, comments, doubt and not noise


def _named_noise(tag: str, attributes: str, main: int) -> tuple[bool, bool, bool, bool, str]:
    """Whether an element is not main text by its kind, by its name alone, is of comments, may be noise by a
    part of its name, and its class for the path."""
    values = {}
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            values.setdefault(name.lower(), value.strip("\"'") if value else "")
    tokens = " ".join(values.get(a, "") for a in ("class", "id")).split()
    said = [_said(token, main) for token in tokens]
    named, comments, doubt = (any(x[k] for x in said) for k in range(3))
    noise = (
        tag in NOISE or values.get("role", "").lower() in NOISE_ROLES
        or "hidden" in values or values.get("aria-hidden") == "true" or (tag == "header" and not main)
    )
    exempt = tag in ("html", "body", "main")
    named = named and not exempt and (tag != "article" or bool(main & 2) or comments)
    label = " ".join(sorted({w.lower() for token in tokens for w in _NAMES.findall(token)}))
    return noise and not exempt, named, comments and named, doubt and not named, label


def walk(
    page: str | None, low: frozenset[int] = frozenset(), close=None, by_name: bool = True
) -> list[tuple[int, bool, str]]:
    """The blocks of a page: (1 in main, 2 in an article, 3 in both, else 0; cut for its importance; text).

    Text in named noise is left out, unless ``by_name`` is false and a class or id is all that names it.
    ``close`` is called with each container that ends.
    """
    from xxhash import xxh3_64_intdigest

    page = page or ""
    stack = [_Open("", 0, 0, False, False, 0, True)]
    holders = stack[:]  # the open containers
    opened: Counter = Counter()
    blocks: list[tuple[int, bool, str, list | None]] = []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append((top.main, top.cut, text, top.named))
                if close is not None:
                    holders[-1].texts.append(xxh3_64_intdigest(text))

    def end() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        if element.container:
            holders.pop()
            if close is not None:
                close(element)
                if element.named is stack[-1].named or element.named[0]:
                    holders[-1].texts.extend(element.texts)

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at and not (stack[-1].noise or stack[-1].skip):
            buffer.append(entities.unescape(page[at:upto]))
        if not found:
            break
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            continue
        block = tag in BLOCK
        if found.group(1):
            found_open = opened[tag] > 0
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if found_open else 0
            if block:
                flush()
            if depth:
                flush() if any(e.tag in BLOCK for e in stack[depth:]) else None
                while len(stack) > depth:
                    end()
            continue
        if tag == "br":
            buffer.append(" ") if not (stack[-1].noise or stack[-1].skip) else None
            continue
        if block:
            flush()
            closed = CLOSES.get(tag, ())
            while stack[-1].tag in closed or (
                len(stack) > 2 and stack[-1].tag not in BLOCK and stack[-2].tag in closed and stack[-2].tag == "p"
            ):
                end()
        parent = stack[-1]
        if tag in VOID:
            continue
        noise, named, comments, doubt, label = _named_noise(tag, found.group(3), parent.main)
        named, comments = named and by_name, comments and by_name
        if parent.depth < DEPTH:
            parent.kids[tag, label] += 1
            path = xxh3_64_intdigest(f"{tag} {label} {parent.kids[tag, label]}", seed=parent.path)
        else:
            path = parent.path
        if tag in RAW:
            stop = re.compile(f"</{tag}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if close is not None:
            holders[-1].shape.append(tag)
        if found.group(3).rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        noise = noise or parent.noise
        among = comments or bool(parent.named and parent.named[2])  # readers' comments
        outermost = tag == "article" and parent.main < 2 and not noise and not among
        main = parent.main | (2 if outermost else 1 if tag == "main" else 0)
        cut = (parent.cut and not outermost) or (tag not in NEVER_CUT and path in low)
        mark = parent.named if outermost else None
        while mark and not mark[0]:
            mark[0], mark = True, mark[1]
        # names of elements inside a line cut the line, not the block
        skip = not outermost and (parent.skip or (named and not block))
        container = tag in CONTAINER and not noise and not skip and parent.depth < DEPTH
        mark = [False, parent.named, among] if named else parent.named
        stack.append(_Open(tag, path, parent.depth + 1, noise, cut, main, container, mark, skip, doubt))
        opened[tag] += 1
        if container:
            holders.append(stack[-1])
    flush()
    while len(stack) > 1:
        end()
    return [b[:3] for b in blocks if not b[3] or b[3][0]]


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """The main text: blocks of the page's main or articles, else of the page, without the cut ones."""
    blocks = walk(page, low) or walk(page, low, by_name=False)
    size = lambda rows: sum(len(b[2].split()) for b in rows)
    inside, free = [b for b in blocks if b[0] & 1], [b for b in blocks if b[0] == 2]
    kept = (inside if size(inside) >= size(free) else free) or blocks
    inner = [b for b in inside if b[0] == 3]
    if kept is inside and 2 * size(inner) > size(inside):
        kept = inner
    return "\n\n".join(t for _, _, t in [b for b in kept if not b[1]] or kept)


def count_nodes(pages: DataFrame, url: str, html: str) -> DataFrame:
    """host, path, kind, value, pages: on how many different pages a node has a presentation (kind 0), a text
    below it (1), or is there at all (2, the value says whether its name is in doubt).  Path 0 is the host."""
    different = (
        pages.select(host_of(url).alias("host"), F.col(html).alias("html")).filter("html is not null")
        .groupBy("host", F.md5("html")).agg(F.first("html").alias("html")).select("host", "html")
    )

    def run(batches):
        for b in batches:
            total: Counter = Counter()
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                seen: set = {(0, 2, 0)}

                def close(element, seen=seen):
                    if element.tag in NEVER_CUT:
                        return
                    seen.add((element.path, 2, int(element.doubt)))
                    seen.add((element.path, 0, hash_of(" ".join(element.shape))))
                    seen.update((element.path, 1, t) for t in element.texts)

                walk(page, close=close)
                total.update((host, *s) for s in seen)
            keys = list(total)
            columns = list(zip(*keys)) if keys else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.string()),
                    pa.array(np.array(columns[1], np.uint64).view(np.int64)),
                    pa.array(columns[2], pa.int32()),
                    pa.array(np.array(columns[3], np.uint64).view(np.int64)),
                    pa.array([total[k] for k in keys], pa.int64()),
                ],
                ["host", "path", "kind", "value", "pages"],
            )

    return different.mapInArrow(run, "host string, path long, kind int, value long, pages long")


def hash_of(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text)


def importance(nodes: DataFrame) -> DataFrame:
    """host, path, pages, doubt, importance of every container of the style trees."""
    per = nodes.groupBy("host", "path", "kind", "value").agg(F.sum("pages").alias("n"))
    n = F.col("n")
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    sums = per.groupBy("host", "path").agg(
        of(2, n).alias("pages"), (F.max(F.when(F.col("kind") == 2, F.col("value"))) > 0).alias("doubt"),
        of(0, F.lit(1)).alias("shapes"), of(0, n).alias("shaped"), of(0, n * F.log(n)).alias("shape_logs"),
        F.coalesce(of(1, F.lit(1)), F.lit(0)).alias("texts"),
        F.coalesce(of(1, F.log(n)), F.lit(0.0)).alias("text_logs"),
    ).filter(F.col("pages") >= MIN_PAGES)
    spread = F.log(F.col("pages"))
    # A page may show a node in several shapes, so shares are of all showings.
    shape = F.least(F.lit(1.0), (F.log("shaped") - F.col("shape_logs") / F.col("shaped")) / spread)
    content = F.when(F.col("texts") > 0, 1 - F.col("text_logs") / F.col("texts") / spread).otherwise(0.0)
    weight = F.pow(F.lit(DECAY), F.col("shapes"))
    return sums.select("host", "path", "pages", "doubt", ((1 - weight) * shape + weight * content).alias("importance"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    bar = F.when(F.col("doubt"), DOUBT).otherwise(LOW)
    low = stored(
        importance(count_nodes(pages, url, html)).filter((F.col("importance") < bar) | (F.col("path") == 0))
        .select("host", "path", "pages")
    )
    hosts = low.filter("path = 0").select("host", F.col("pages").alias("all"))
    # Only what is on a share of a host's pages is gathered: some ten times the elements of a page.
    nodes = stored(low.filter("path <> 0").join(hosts, "host").filter(F.col("pages") >= MIN_SHARE * F.col("all")))
    per_host = nodes.groupBy(F.col("host").alias("__host")).agg(F.collect_set("path").alias("__low"))
    if nodes.count() <= SMALL:
        per_host = F.broadcast(per_host)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    joined = pages.select(*kept, html).join(per_host, host_of(url) == F.col("__host"), "left").drop("__host")
    schema = schema_with(pages.select(*kept), text="string", n_chars="long")

    def run(batches):
        for b in batches:
            texts = [
                main_text(page, frozenset(np.array(cut or (), np.int64).view(np.uint64).tolist()))
                for page, cut in zip(b.column(html).to_pylist(), b.column("__low").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*kept, "text", "n_chars"],
            )

    return joined.mapInArrow(run, schema)


@query("op9_html_extraction")
def op9(spark, sf_dir):
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
