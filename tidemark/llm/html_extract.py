"""Main-text extraction with site style trees (after Yi, Liu and Li, 2003).

The DOMs of a host are merged into a tree whose nodes are places: a path of elements with their classes. For each
place the tree has the styles in which its children appear (presentation) and the blocks of text that stand in it
(content). Both have an importance by entropy, relative to the pages that have the place: 0 if all pages show the
same, 1 if each shows its own. Pages that are copies of one another, by a min-hash of their text, count once, so that
an article's copies don't make it look like a site's furniture.

A branch is judged as a zone: what stands below a named element (by tag, class or id), without the named elements
inside it, or the rest of the page. A zone's worth is the number of new words that it gives a page, each block
weighed by its entropy, times a weight for its role (MAIN, REST or NOISE); its standing is its worth beside that of
the host's best zone. A zone of low standing is removed. So a name weighs but doesn't settle: a 'search-results'
element that holds all that a site has to say stays, and a list of links beside an article goes. Inside zones that
stay, blocks go that nearly all of the host's pages repeat: the lower the importance of their place, the less
repetition it takes. Both judgements back off to the tree over all hosts, with the weight of BACK_OFF pages, so that
a host with one page is judged as well.

All counts are sums over (place, feature), combined before the shuffle, so a host with a third of all pages is no
heavier than others.

Defined results: a null or blank html gives an empty text; a url that is null or has no host counts to the host '';
rows that repeat a page are one page in the counts and have equal results; a page cut off in mid-tag ends there; of
zones that tie none is preferred, as each is held against a bound; columns of pages other than the three that are
named play no part, whatever their names; an empty table gives an empty result. A page is parsed as one piece, however
long: the tree takes some 20 times its bytes.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_batch, discard, materialise, slices

#: Roles of zones, what a new word weighs in each, and the standing below which a zone goes.
MAIN, REST, NOISE = 0, 1, 2
WEIGHT = (4.0, 1.0, 0.0005)
LEAST_STANDING = (0.01, 0.01, 0.05)
#: Pages of its own that a host's evidence must have to weigh as much as that of all hosts.
BACK_OFF = 20
#: A block goes if its novelty, weighed by the importance of its place, is below LEAST_NOVELTY. Novelty on n of m pages
#: is 1 - log n / log(m + FEW_PAGES): on few pages repetition says little.
LEAST_NOVELTY, FEW_PAGES = 0.1, 8
#: A page's repeated blocks stay if they are this share of a zone's words or more: then the page itself is a copy.
COPY_SHARE = 0.9
#: What is to be removed is broadcast up to so many rows, and joined by page beyond.
BROADCAST_ROWS = 200_000
#: Words in the runs whose least hash marks the copies of a page.
RUN = 4

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
UNSEEN = frozenset("head script style noscript template textarea title iframe datalist object applet audio video map math noembed noframes xmp svg canvas".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCKS - frozenset(["body", "html", "tbody", "tfoot", "thead", "tr"])
MAIN_TAGS = frozenset(["article", "main"])
NOISE_TAGS = frozenset("nav header footer aside form button select option input label fieldset menu dialog".split())
#: Names that speak for noise, alone or as parts of longer ones; names that take the meaning from those beside them.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "related recommended share sharing social comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "search pagination pager toolbar skip skiplink copyright legal disclaimer".split()
)
NOISE_STEMS = ("comment", "sidebar", "advert", "cookie", "breadcrumb", "newsletter", "footer", "navbar", "pagination")
NOT_NOISE = frozenset(["has", "with", "no", "without"])
MAIN_WORDS = frozenset("article main content post entry story".split())
#: Zones of readers and of navigation: an article inside one is part of it.
CLOSED_WORDS = ("comment", "respond", "repl", "disqus", "discussion", "related", "recommended", "sidebar")
CLOSED_TAGS = frozenset(["nav", "footer", "aside"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """An element: its name, its mark (name with classes and id), what stands in it, in order."""

    __slots__ = ("names", "tag", "mark", "inside", "parent")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.inside: list[Node | str] = []
        self.names: frozenset[str] = frozenset()
        label = ""
        if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "CLASS" in attrs or "ID" in attrs):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
            label = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
            self.names = frozenset(_NAMES.findall(label))
        self.mark = f"{tag}.{re.sub('[0-9]+', '0', label)}" if label else tag


def parse(html: str | None) -> Node:
    """A forgiving parse: unknown ends are skipped, a block ends an open p, an end tag ends what is open inside it."""
    root = Node("#page", "", None)
    at, here, n = 0, root, len(html or "")
    html = html or ""
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            here.inside.append(html[at:])
            break
        if m.start() > at:
            here.inside.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            here = _ended(here, tag)
        node = Node(tag, m[3], here)
        here.inside.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        here = node
    return root


def _ended(here: Node, tag: str) -> Node:
    """Where an element opens once those that it ends by rule are closed."""
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
    stop = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("td", "th", "li", "div", "article", "section", "blockquote", "body"))
    up, opens_in = here, here
    while up is not None and up.tag != "#page" and up.tag not in stop:
        if up.tag in same or up.tag == "p" and tag in CLOSES_P:
            opens_in = up.parent
        up = up.parent
    return opens_in


def role_of(node: Node) -> int | None:
    """MAIN or NOISE for an element whose name says so, None for others."""
    if node.tag in ("html", "body", "#page"):
        return None
    said = not node.names & NOT_NOISE and (node.names & NOISE_WORDS or any(stem in n for n in node.names for stem in NOISE_STEMS))
    if node.tag in NOISE_TAGS or said and not (node.tag in MAIN_TAGS and not node.names & {"comment", "comments", "ad", "advert", "sponsored", "promo"}):
        return NOISE
    return MAIN if node.tag in MAIN_TAGS or node.names & MAIN_WORDS and node.tag in BLOCKS else None


def closed(node: Node) -> bool:
    return node.tag in CLOSED_TAGS or any(w in n for n in node.names for w in CLOSED_WORDS)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


class _Paths(dict):
    """(parent's place, mark) to the place: emptied when it has grown large."""

    def __missing__(self, key: tuple[int, str]) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        x = self[key] = xxhash.xxh3_64_intdigest(f"{key[0]:x}/{key[1]}".encode("utf-8", "replace"))
        return x


_PATHS = _Paths()


def path_hash(parent: int, mark: str) -> int:
    return _PATHS[parent, mark]


class Place:
    """Where an element stands: its place on the host and over all hosts, the zone it is in and that zone's role."""

    __slots__ = ("at", "anywhere", "zone", "role", "shut")

    def __init__(self, at: int, anywhere: int) -> None:
        self.at, self.anywhere, self.zone, self.role, self.shut = at, anywhere, at, REST, False

    def of(self, node: Node) -> Place:
        out = Place(path_hash(self.at, node.mark), path_hash(self.anywhere, node.mark))
        said = role_of(node)
        if said is None or self.role == MAIN and (said == MAIN or node.tag == "header"):
            out.zone, out.role, out.shut = self.zone, self.role, self.shut
        else:
            out.role = NOISE if said == NOISE or self.shut else MAIN if self.role != NOISE else REST
            out.shut = self.shut or said == NOISE and closed(node)
        return out


class Block:
    """A line of the page: its pieces of text by zone, in order, and the place of the block element that it is in."""

    __slots__ = ("place", "pieces")

    def __init__(self, place: Place, pieces: list[tuple[Place, str]]) -> None:
        self.place, self.pieces = place, pieces

    def by_zone(self) -> dict[int, str]:
        out: dict[int, list[str]] = {}
        for place, text in self.pieces:
            out.setdefault(place.zone, []).append(text)
        return {z: joined for z, parts in out.items() if (joined := " ".join(entities.unescape("".join(parts)).split()))}


def walk(root: Node, host: str, styles: dict[int, list[str]] | None = None, seen: dict[int, Place] | None = None) -> list[Block]:
    """The blocks of a page in order. styles and seen get the styles and the Place of every place of the page."""
    start = Place(path_hash(0, host), path_hash(0, "#anywhere"))
    blocks: list[Block] = []
    line: list[tuple[Place, str]] = []
    holder = start

    def flush() -> None:
        if line:
            blocks.append(Block(holder, list(line)))
            line.clear()

    todo: list[tuple[Node | str | None, Place]] = [(root, start)]  # depth first without recursion
    while todo:
        x, place = todo.pop()
        if x is None:  # the end of a block element: place is that of the block around it
            flush()
            holder = place
            continue
        if isinstance(x, str):
            line.append((place, x))
            continue
        if x.tag in UNSEEN:
            continue
        if x.parent is not None:
            place = place.of(x)
        if x.tag in BLOCKS:
            flush()
            todo.append((None, holder))
            holder = place
        elif x.tag in ("br", "td", "th"):
            line.append((place, " "))
        if styles is not None:
            marks = [y.mark for y in x.inside if isinstance(y, Node)]
            styles.setdefault(place.at, []).append(",".join(m for i, m in enumerate(marks) if not i or marks[i - 1] != m))
            seen[place.at] = place
            seen.setdefault(start.at, start)
        todo += [(y, place) for y in reversed(x.inside)]
    flush()
    return blocks


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


def block_id(place: int, feature: int) -> int:
    """One number for a block at a place. In Spark: block_ids()."""
    return place ^ (feature << 1 & 2**64 - 1 | feature >> 63)


def block_ids(place: Column, feature: Column) -> Column:
    return place.bitwiseXOR(F.shiftleft(feature, 1).bitwiseOR(F.shiftrightunsigned(feature, 63)))


_RUNS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(RUN)], np.uint64)


def copy_mark(texts: list[str]) -> int:
    """The least hash of the runs of RUN words of a page's text, which copies nearly always share."""
    words = " ".join(texts).split()
    if len(words) < RUN:
        return text_hash(" ".join(words))
    h = np.fromiter(map(hash_of_word.__getitem__, words), np.uint64, len(words))
    n = len(h) - RUN + 1
    runs = np.zeros(n, np.uint64)
    for i, m in enumerate(_RUNS):
        x = (h[i : i + n] ^ m) * m
        runs += x ^ (x >> np.uint64(31))
    return int((runs ^ (runs >> np.uint64(29))).min())


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        x = self[word] = text_hash(word)
        return x


hash_of_word = _Words()

#: Kinds of rows that a page gives: the styles of a place, a block in it, and the place itself.
STYLE, BLOCK, NODE = 0, 1, 2


def features(html: str | None, host: str) -> list[tuple[int, int, int, int, int, int]]:
    """(place, kind, feature, n, mark, root) of a page, each place, block and style once.

    STYLE has a hash of all styles of the place as the feature. BLOCK has a hash of the text, and n words. NODE says
    what the place is: feature is its place over all hosts, n its role, mark its zone and root the host's."""
    styles: dict[int, list[str]] = {}
    places: dict[int, Place] = {}
    blocks = walk(parse(html), host, styles, places)
    held: dict[tuple[int, int], int] = {}
    own: list[str] = []
    every: list[str] = []
    roles = {p.zone: p.role for p in places.values()}
    for b in blocks:
        for zone, text in b.by_zone().items():
            at = b.place.at if zone == b.place.zone else zone
            held[at, text_hash(text)] = len(text.split())
            every.append(text)
            if roles[zone] != NOISE:
                own.append(text)
    mark = copy_mark(own or every)
    root = path_hash(0, host)
    out = [(at, STYLE, text_hash(";".join(sorted(set(s)))), 0, mark, 0) for at, s in styles.items()]
    out += [(at, BLOCK, feature, n, mark, 0) for (at, feature), n in held.items()]
    out += [(p.at, NODE, p.anywhere, p.role, p.zone, root) for p in places.values()]
    return out


def scanned(pages: DataFrame) -> DataFrame:
    """pages (host, html) to the rows of features()."""
    names = ["place", "kind", "feature", "n", "mark", "root"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 8_000_000):
            rows: set[tuple] = set()
            for host, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                rows.update(features(_text(html), host))
            cols = np.array(sorted(rows), np.uint64).reshape(-1, 6).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(cols[:, i])) for i in range(6)], names)

    return pages.mapInArrow(by_batch(run), ", ".join(f"{x} long" for x in names))


class StyleTree:
    """The merged trees of all hosts as tables: places with their importance, zones with their standing, repeated blocks."""

    def __init__(self, pages: DataFrame) -> None:
        rows = materialise(scanned(pages), "tree-rows")
        counted = rows.where(F.col("kind") != NODE).groupBy("place", "kind", "feature").agg(F.countDistinct("mark").alias("pages"), F.max("n").alias("words"))
        self.counted = materialise(counted, "tree-counts")
        nodes = rows.where(F.col("kind") == NODE).groupBy("place").agg(F.first("feature").alias("anywhere"), F.first("n").alias("role"), F.first("mark").alias("zone"), F.first("root").alias("root"))
        self.places = materialise(self._importance(nodes), "tree-places")
        discard(rows)
        self.zones = materialise(self._standing(), "tree-zones")

    def _importance(self, nodes: DataFrame) -> DataFrame:
        """A row a place: pages, and the entropies of its styles and its blocks, with those over all hosts behind them."""
        k, log = F.col("pages").cast("double"), F.log(F.col("pages").cast("double"))
        style, block = F.col("kind") == STYLE, F.col("kind") == BLOCK
        total = lambda of, x: F.coalesce(F.sum(F.when(of, x)), F.lit(0.0))
        sums = self.counted.groupBy("place").agg(
            total(style, k).alias("m"),
            total(style, k * log).alias("style_sum"),
            total(block, k).alias("blocks"),
            total(block, k * log).alias("block_sum"),
            total(block, k * F.col("words")).alias("word_sum"),
            total(block, k * F.col("words") * log).alias("word_log_sum"),
        )
        m, wide = F.col("m"), F.log(F.col("m") + FEW_PAGES)
        at = sums.join(nodes.withColumnRenamed("place", "p"), F.col("place") == F.col("p")).select(
            "place",
            "anywhere",
            "role",
            "zone",
            "root",
            "m",
            F.when(m > 1, (F.log(m) - F.col("style_sum") / m) / F.log(m)).otherwise(1.0).alias("style"),
            F.when(F.col("blocks") > 0, 1 - F.col("block_sum") / F.col("blocks") / wide).otherwise(1.0).alias("content"),
            (F.col("word_sum") - F.col("word_log_sum") / wide).alias("new_words"),
        )
        at = at.withColumn("own", (F.col("style") + F.col("content")) / 2)
        return self._backed_off(at, "own", "importance")

    def _backed_off(self, rows: DataFrame, own: str, name: str) -> DataFrame:
        """With the mean over all hosts that have the place, by pages, weighing as much as BACK_OFF pages."""
        over_all = rows.groupBy(F.col("anywhere").alias("g")).agg((F.sum(F.col(own) * F.col("m")) / F.sum("m")).alias("over_all"))
        both = rows.join(materialise(over_all, "tree-over-all"), F.col("anywhere") == F.col("g"))
        return both.withColumn(name, (F.col(own) * F.col("m") + F.col("over_all") * BACK_OFF) / (F.col("m") + BACK_OFF)).drop("g", "over_all")

    def _standing(self) -> DataFrame:
        """A row a zone: (place, role, worth, standing)."""
        words = self.places.groupBy(F.col("zone").alias("z")).agg(F.sum("new_words").alias("words"))
        weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHT]), (F.col("role") + 1).cast("int"))
        zones = self.places.join(words, F.col("place") == F.col("z")).select("place", "anywhere", "role", "root", "m", (F.col("words") / F.col("m") * weight).alias("worth"))
        zones = materialise(zones, "tree-zone-worth")
        best = materialise(zones.groupBy(F.col("root").alias("r")).agg(F.max("worth").alias("best")), "tree-best")
        own = zones.join(best, F.col("root") == F.col("r")).withColumn("own", F.when(F.col("best") > 0, F.col("worth") / F.col("best")).otherwise(1.0))
        out = materialise(self._backed_off(own, "own", "standing").select("place", "role", "worth", "standing"), "tree-standing")
        discard(zones, best)
        return out

    def removed(self) -> DataFrame:
        """(id): zones of low standing, by their place, and repeated blocks, by block_id()."""
        bound = F.element_at(F.array(*[F.lit(x) for x in LEAST_STANDING]), (F.col("role") + 1).cast("int"))
        zones = self.zones.where(F.col("standing") < bound).select(F.col("place").alias("id"))
        often = self.counted.where((F.col("kind") == BLOCK) & (F.col("pages") > 1)).select(F.col("place").alias("p"), "feature", F.col("pages").alias("n"))
        both = often.join(self.places.select("place", "m", "importance"), F.col("p") == F.col("place"))
        novelty = 1 - F.log(F.col("n").cast("double")) / F.log(F.col("m") + FEW_PAGES)
        low = both.where(novelty * (0.25 + 0.75 * F.col("importance")) < LEAST_NOVELTY)
        return zones.unionByName(low.select(block_ids(F.col("place"), F.col("feature")).alias("id")))


def _text(raw: bytes | None) -> str | None:
    return None if raw is None else raw.decode("utf-8", "replace")


def main_text(html: str | None, host: str = "", removed: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of what is left of the page, one to a line. removed has the ids of StyleTree.removed()."""
    rows: list[tuple[Block, dict[int, tuple[int, bool]]]] = []
    total: dict[int, int] = {}
    again: dict[int, int] = {}
    for b in walk(parse(html), host):
        parts: dict[int, tuple[int, bool]] = {}
        for zone, text in b.by_zone().items():
            if zone in removed:
                continue
            repeated = block_id(b.place.at if zone == b.place.zone else zone, text_hash(text)) in removed
            n = len(text.split())
            parts[zone] = (n, repeated)
            total[zone] = total.get(zone, 0) + n
            again[zone] = again.get(zone, 0) + n * repeated
        if parts:
            rows.append((b, parts))
    out = []
    for b, parts in rows:
        stays = {z for z, (_, repeated) in parts.items() if not repeated or again[z] >= COPY_SHARE * total[z]}
        line = " ".join(entities.unescape("".join(text for place, text in b.pieces if place.zone in stays)).split())
        if line:
            out.append(line)
    return "\n".join(out)


def places_of(html: str | None, host: str) -> set[int]:
    """All ids that the page's zones and blocks can be removed by."""
    out: set[int] = set()
    for b in walk(parse(html), host):
        for zone, text in b.by_zone().items():
            out |= {zone, block_id(b.place.at if zone == b.place.zone else zone, text_hash(text))}
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row of pages."""
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    ready = pages.select(host.alias("host"), F.col(html_col).cast("binary").alias("html"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    tree = StyleTree(ready.select("host", "html"))
    removed = materialise(tree.removed(), "removed")
    discard(tree.counted, tree.places, tree.zones)
    small = removed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    types = f"page_id {ready.schema['page_id'].dataType.simpleString()}, url {ready.schema['url'].dataType.simpleString()}, text string"
    if small:
        ids = spark.sparkContext.broadcast(frozenset(r[0] % 2**64 for r in removed.collect()))
        discard(removed)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for piece in slices(batch, 1, 8_000_000):
                yield _extracted(piece, [ids.value] * piece.num_rows)

        return ready.mapInArrow(by_batch(run), types)

    # Too much to broadcast: each page is sent those of its own ids that are to be removed.
    numbered = materialise(ready.withColumn("row", F.monotonically_increasing_id()), "pages")

    def held(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 8_000_000):
            rows = [(row, _signed(x)) for row, host, html in zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), piece.column(1).to_pylist(), strict=True) for x in places_of(_text(html), host)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["at", "held"])

    pairs = numbered.select("row", "html", "host").mapInArrow(by_batch(held), "at long, held long")
    own = pairs.join(removed, F.col("held") == F.col("id"), "left_semi").groupBy("at").agg(F.collect_set("held").alias("removed"))
    joined = numbered.join(own, F.col("row") == F.col("at"), "left").select("host", "html", "page_id", "url", "removed")

    def run_joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for piece in slices(batch, 1, 8_000_000):
            yield _extracted(piece, [frozenset(x % 2**64 for x in xs or ()) for xs in piece.column(4).to_pylist()])

    return joined.mapInArrow(by_batch(run_joined), types)


def _extracted(piece: pa.RecordBatch, removed: list[frozenset[int]]) -> pa.RecordBatch:
    texts = [main_text(_text(html), host, ids) for host, html, ids in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), removed, strict=True)]
    return pa.RecordBatch.from_arrays([piece.column(2), piece.column(3), pa.array(texts, pa.string())], ["page_id", "url", "text"])
