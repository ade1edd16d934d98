"""Main text of web pages by site style trees: what looks and reads alike on a host's pages is removed."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garderobe.session import stage

DEPTH = 64  # levels below the body that the tree keeps apart; what lies deeper counts as content of the last one
LEAST_IMPORTANCE = 0.4
EVIDENCE = 4  # pages whose weight the assumption has that a host's text is important, so that few pages decide little
OUTSIDE_EVIDENCE, OUTSIDE_PRIOR = 20, 0.05  # the same for text outside the article of pages that mark one: assumed to be none until many pages tell otherwise
MOST_SENT = 20_000  # leaves, two numbers each
MOST_HELD = 2_000_000  # features that a task holds while it counts equal ones
DISCOUNT = 0.9  # weight of a branch's content falls with its number of styles

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr".split())
#: What an element's start ends, within the nearest element of the second set.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
          "thead": ("tr td th thead tbody tfoot", ("table",)), "tbody": ("tr td th thead tbody tfoot", ("table",)), "tfoot": ("tr td th thead tbody tfoot", ("table",)), "option": ("option", ("select", "datalist"))}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that are never the article.
NOT_TEXT = frozenset("script style noscript template head title nav footer aside button select option textarea input iframe svg canvas object embed audio video dialog menu noembed noframes xmp datalist map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Names that say that an element is not the article; a form or an element with such a name may still hold it.
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar aside rail widget widgets
 masthead topbar footer colophon copyright cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular
 comment comments disqus respond reply replies discussion pagination pager toc skip search searchbox form legal disclaimer""".split())
ABOUT = frozenset("with has no without".split())  # "content-with-sidebar" is no sidebar
OF_ARTICLE = frozenset("article entry post story".split())  # "post-header" holds the title
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]++)))?""")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?:[\s/>]|\Z)", re.I) for tag in RAW}
NAME_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
READ = """row_id long, page_id long, url string, host string, page long, blocks array<struct<leaf: long, text: string>>, styles array<struct<key: long, style: long, first: boolean>>,
 leaves array<struct<leaf: long, branch: long, path: array<long>, outside: boolean, at: array<int>>>"""
ARROW = {
    "page": pa.int64(),
    "blocks": pa.list_(pa.struct([("leaf", pa.int64()), ("text", pa.string())])),
    "styles": pa.list_(pa.struct([("key", pa.int64()), ("style", pa.int64()), ("first", pa.bool_())])),
    "leaves": pa.list_(pa.struct([("leaf", pa.int64()), ("branch", pa.int64()), ("path", pa.list_(pa.int64())), ("outside", pa.bool_()), ("at", pa.list_(pa.int32()))])),
}
COUNTED = "host string, leaf long, lot long, feature array<long>, weight array<int>, n array<int>"


def hashed(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - 2**63


class Element:
    """An open element while a page is read. ``doubt``: place of the innermost element around it whose name says that it is no article, or -1."""

    __slots__ = ("tag", "kind", "path", "noise", "doubt", "children", "nested")

    def __init__(self, tag: str, kind: str, path: tuple[int, ...], noise: bool, doubt: int, children: list[list]):
        self.tag, self.kind, self.path, self.noise, self.doubt, self.children, self.nested = tag, kind, path, noise, doubt, children, 0


def never_text(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not in_article) or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return attrs.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def doubtful(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag == "form" or attrs.get("role", "").lower() == "form":
        return True
    if tag in ("html", "body", "article", "main") and not (tag == "article" and in_article):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = {p.lower() for p in NAME_PARTS.split(name)}
        if not parts & ABOUT and (parts & NOISE or "header" in parts and not in_article and not parts & OF_ARTICLE):
            return True
    return False


class Page:
    """What one pass over a page, in time that grows with its length, takes from it.

    ``blocks``: the leaf of the tree and the text of each block. ``styles``: the styles of each element, outermost name first. ``places``:
    for each leaf its branch, the elements above it, whether it is outside the article, and its different texts with the first block of each.

    An element of the tree is a tag with its class under such elements; equal elements of a page are one, and so are elements that lie
    directly in one of their own name. A style is the row of children, where of equal neighbours the number is kept up to powers of two.
    The text directly in an element is a leaf below it. Elements that run text through (``INLINE``) are not in the tree.

    Blocks in elements that are never text are left out. Blocks in a form or under a name that tells of no article are too, unless that
    element holds a first heading and most of the text, or there is no other text and it has a first heading or two paragraphs.
    """

    def __init__(self, source: str):
        self.found: list[tuple[tuple[int, ...], str, int, bool]] = []
        self.styles: dict[tuple[int, int], None] = {}
        self.doubts: list[list[int]] = []  # place of the outer one, characters, first headings, paragraphs
        self.open_tags: Counter[str] = Counter()
        self.pending: list[str] = []
        self.root = hashed("#root")
        self.stack = [Element("#root", "", (self.root,), False, -1, [])]
        self.read(source)
        while len(self.stack) > 1:
            self.end_top()
        self.flush()
        self.note(self.stack[0])
        self.choose()

    def read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if not found:
                self.data(source[at:])
                return
            self.data(source[at : found.start()])
            at = found.end()
            if found["cdata"] is not None:
                self.data(found["cdata"])
            elif found["name"]:
                tag = found["name"].lower()
                if found["close"]:
                    self.close(tag)
                elif tag in RAW:
                    end = RAW_ENDS[tag].search(source, at)
                    self.child(tag, "")
                    at = (source.find(">", end.start()) + 1 or size) if end else size
                else:
                    self.open(tag, found["attrs"])

    def data(self, text: str) -> None:
        if text and not self.stack[-1].noise:
            self.pending.append(text)

    def child(self, tag: str, kind: str) -> None:
        children, name = self.stack[-1].children, f"{tag}.{kind}"
        if children and children[-1][0] == name:
            children[-1][1] += 1
        else:
            children.append([name, 1])

    def in_article(self) -> bool:
        return self.open_tags["article"] + self.open_tags["main"] > 0

    def open(self, tag: str, raw: str) -> None:
        if tag in VOID or raw.endswith("/") and tag not in ENDS_P:
            if tag == "br":
                self.data(" ")
            elif tag == "hr":
                self.flush()
            return
        top = self.stack[-1]
        if tag in INLINE:
            if top.noise:
                top.nested += top.tag == tag
            elif never_text(tag, attributes(raw), True) or doubtful(tag, attributes(raw), True):
                self.push(Element(tag, "", top.path, True, top.doubt, []))
            return
        if tag in ENDS_P and self.open_tags["p"]:
            self.close("p")
        if tag in CLOSES:
            self.close_siblings(*CLOSES[tag])
        self.flush()
        attrs, inside, top = attributes(raw), self.in_article(), self.stack[-1]
        kind = " ".join(sorted(attrs.get("class", "").split())) or attrs.get("role", "")
        noise, doubt = top.noise or never_text(tag, attrs, inside), top.doubt
        if not noise and doubtful(tag, attrs, inside):
            self.doubts.append([doubt, 0, 0, 0])
            doubt = len(self.doubts) - 1
        if tag in ("html", "body") or (tag, kind) == (top.tag, top.kind) and doubt == top.doubt or len(top.path) > DEPTH:
            self.push(Element(tag, kind, top.path, noise, doubt, top.children))
        else:
            self.child(tag, kind)
            self.push(Element(tag, kind, top.path if noise else (*top.path, hashed(top.path[-1], tag, kind)), noise, doubt, []))

    def close_siblings(self, ends: str, within: tuple[str, ...]) -> None:
        wanted = ends.split()
        left = sum(self.open_tags[t] for t in wanted)
        if left:
            lowest = len(self.stack)
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in within or not left:
                    break
                if self.stack[k].tag in wanted:
                    lowest, left = k, left - 1
            while len(self.stack) > lowest:
                self.end_top()

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.open_tags[element.tag] += 1

    def close(self, tag: str) -> None:
        if tag in INLINE:
            top = self.stack[-1]
            if top.tag == tag and top.nested:
                top.nested -= 1
            elif top.tag == tag:
                self.end_top()
        elif self.open_tags[tag]:
            while self.stack[-1].tag != tag:
                self.end_top()
            self.end_top()

    def end_top(self) -> None:
        if self.stack[-1].tag not in INLINE:
            self.flush()
        element = self.stack.pop()
        self.open_tags[element.tag] -= 1
        if len(element.path) > len(self.stack[-1].path) and not element.noise:
            self.note(element)

    def note(self, element: Element) -> None:
        self.styles[(element.path[-1], hashed(*(f"{name}*{n.bit_length()}" for name, n in element.children)))] = None

    def flush(self) -> None:
        if self.pending:
            text = SPACE.sub(" ", references.unescape("".join(self.pending))).strip()
            self.pending = []
            if text:
                top = self.stack[-1]
                self.found.append((top.path, text, top.doubt, self.in_article()))
                if top.doubt >= 0:
                    own = self.doubts[top.doubt]
                    own[1] += len(text)
                    own[2] += self.open_tags["h1"] > 0
                    own[3] += top.tag == "p"

    def choose(self) -> None:
        """Blocks whose doubts are all unfounded, and the leaves that they are in."""
        plain = any(doubt < 0 for _, _, doubt, _ in self.found)
        total = sum(len(text) for _, text, _, _ in self.found)
        for outer, *counts in reversed(self.doubts):  # inner ones come later
            if outer >= 0:
                self.doubts[outer][1:] = [a + b for a, b in zip(self.doubts[outer][1:], counts, strict=True)]
        cleared: list[bool] = []
        for outer, size, headings, paragraphs in self.doubts:
            holds = headings > 0 and 2 * size > total or not plain and outer < 0 and (headings > 0 or paragraphs > 1)
            cleared.append(holds and (outer < 0 or cleared[outer]))
        kept = [(path, text, inside) for path, text, doubt, inside in self.found if doubt < 0 or cleared[doubt]]
        marked = sum(len(text) if inside else -len(text) for _, text, inside in kept) >= 0 and any(inside for _, _, inside in kept)
        self.blocks: list[tuple[int, str]] = []
        self.places: dict[int, tuple[int, tuple[int, ...], bool, dict[str, int]]] = {}
        for at, (path, text, inside) in enumerate(kept):
            outside = marked and not inside
            leaf = hashed(path[-1], "#text", outside)
            self.blocks.append((leaf, text))
            self.places.setdefault(leaf, (path[-2] if len(path) > 2 else path[-1], path, outside, {}))[3].setdefault(text, at)

    @property
    def leaves(self) -> dict[int, tuple[int, tuple[int, ...], bool, set[tuple[str, int]]]]:
        """The places with what their texts say, feature by feature; ``features`` counts the same, a block once with its weight."""
        return {leaf: (*place, {(word, -1) for t in texts for word in words(t)} | {(t, k) for t in texts for k in range((len(words(t)) + 1) // 2)}) for leaf, (*place, texts) in self.places.items()}


def words(text: str) -> set[str]:
    return set(text.lower().split(" "))


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def read_pages(pages: DataFrame) -> DataFrame:
    """One row a page with the ``blocks``, ``styles`` and ``places`` of ``Page``; ``first`` marks one style of each element, ``page`` stands for the blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ARROW}
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                met: set[int] = set()
                out["page"].append(hashed(*(part for block in page.blocks for part in block)))
                out["blocks"].append([{"leaf": leaf, "text": text} for leaf, text in page.blocks])
                out["styles"].append([{"key": key, "style": style, "first": not (key in met or met.add(key))} for key, style in page.styles])
                out["leaves"].append([{"leaf": leaf, "branch": branch, "path": path, "outside": outside, "at": list(texts.values())} for leaf, (branch, path, outside, texts) in page.places.items()])
            kept = ("row_id", "page_id", "url", "host")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(out[c], t) for c, t in ARROW.items())], [*kept, *ARROW])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    keyed = pages.select(F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long"), "url", "html").withColumn("host", host)
    return keyed.mapInArrow(rows, READ)


def distinct_pages(read: DataFrame) -> DataFrame:
    """(host, styles, leaves, blocks), one row for those pages of a host that have the same blocks: copies under several addresses are no boilerplate."""
    marked = read.select("row_id", "host", "page")
    several = marked.groupBy("host", "page").agg(F.min("row_id").alias("kept"), F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    copies = stage(marked.join(several, ["host", "page"]).filter(F.col("row_id") > F.col("kept")).select("row_id"), "copies")
    return read.select("row_id", "host", "styles", "leaves", "blocks").join(copies, "row_id", "left_anti")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal features of a leaf become one with their number, in ``COUNTED`` rows: each has those of a leaf whose hashes begin alike."""
    places: dict[tuple[str, int], int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        place, feature, weight = (np.concatenate(part) for part in zip(*held, strict=True))
        order = np.lexsort((feature, place))
        place, feature, weight = place[order], feature[order], weight[order]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (feature[1:] != feature[:-1])])
        n = np.diff(first, append=len(place)).astype(np.int32)
        place, feature, weight = place[first], feature[first], weight[first]
        lot = feature >> 58
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (lot[1:] != lot[:-1])])
        ends = pa.array(np.append(cut, len(place)), pa.int32())
        hosts, leaves = zip(*places, strict=True)
        at = pa.array(place[cut])
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()).take(at), pa.array(leaves, pa.int64()).take(at), pa.array(lot[cut]), *(pa.ListArray.from_arrays(ends, pa.array(part)) for part in (feature, weight, n))],
            ["host", "leaf", "lot", "feature", "weight", "n"],
        )

    for batch in batches:
        host, leaf, feature, weight = (batch.column(c) for c in ("host", "leaf", "feature", "weight"))
        own = np.array([places.setdefault(key, len(places)) for key in zip(host.to_pylist(), leaf.to_pylist(), strict=True)], np.int64)
        held.append((np.repeat(own, np.diff(feature.offsets.to_numpy())), feature.flatten().to_numpy(), weight.flatten().to_numpy()))
        if sum(len(part) for part, _, _ in held) >= MOST_HELD:
            yield rows()
            places.clear()
            held.clear()
    if any(len(part) for part, _, _ in held):
        yield rows()


def features(pages: DataFrame) -> DataFrame:
    """(host, leaf, feature, weight, n): what n of the pages say in a leaf, each block as a whole and every word of its blocks.

    A word weighs 1, a block half as much as its different words, rounded up; a page's leaf says a text or a word once, in however many blocks.
    """
    hashes = lambda text: F.array_distinct(F.transform(F.split(F.lower(text), " "), lambda word: F.xxhash64(word)))
    part = lambda text: F.struct(F.xxhash64(F.lit("#block"), text).alias("block"), hashes(text).alias("words"))
    parts = F.transform("leaves", lambda leaf: F.struct(leaf["leaf"].alias("leaf"), F.transform(leaf["at"], lambda at: part(F.get("blocks", at)["text"])).alias("parts")))
    said = pages.select("host", F.explode(parts).alias("l")).select("host", "l.leaf", F.col("l.parts.block").alias("blocks"), F.array_distinct(F.flatten("l.parts.words")).alias("words"), F.transform("l.parts.words", F.size).alias("sizes"))
    weights = F.concat(F.transform("sizes", lambda k: F.floor((k + 1) / 2).cast("int")), F.transform("words", lambda _: F.lit(1)))
    alike = said.select("host", "leaf", F.concat("blocks", "words").alias("feature"), weights.alias("weight")).mapInArrow(counted, COUNTED).repartition("host", "leaf", "lot")
    each = alike.select("host", "leaf", "lot", F.inline(F.arrays_zip("feature", "weight", "n")))
    return each.groupBy("host", "leaf", "lot", "feature").agg(F.first("weight").alias("weight"), F.sum("n").alias("n")).drop("lot")


def importance(read: DataFrame) -> DataFrame:
    """(host, leaf, m, content, branch_importance, importance) of every leaf of the hosts' trees.

    Content of a leaf: what its blocks say (see ``features``), each 1 - log n / log m where n of the m distinct pages with the leaf say it:
    1 if no other page does, 0 if all do; their mean by weight and pages. Presentation of an element: the entropy of
    its styles, to the base of its pages. A branch is as important as its presentation and the mean content of all leaves in it, by their
    pages, the latter weighing ``DISCOUNT`` to the number of the branch's styles. A leaf's branch is the element around its own, or its own
    directly below the body. The mean of content and branch is drawn to 1 by the weight of ``EVIDENCE`` pages, outside a marked article to
    ``OUTSIDE_PRIOR`` by that of ``OUTSIDE_EVIDENCE``.
    """
    pages = distinct_pages(read)
    n, m = F.col("n"), F.col("m")
    base = F.log(F.greatest(m, F.lit(2)))
    used = pages.select("host", F.explode("styles").alias("s")).groupBy("host", "s.key", "s.style").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.first").cast("long")).alias("m"))
    shown = used.groupBy("host", "key").agg(F.sum("m").alias("m"), F.sum("n").alias("uses"), F.sum(n * F.log(n)).alias("spread"), F.count(F.lit(1)).alias("n_styles"))
    entropy = F.when(m > 1, F.least((F.log("uses") - F.col("spread") / F.col("uses")) / base, F.lit(1.0))).otherwise(1.0)
    shown = shown.select("host", "key", "n_styles", entropy.alias("presentation"))
    said = pages.select("host", F.explode("leaves").alias("l"))
    leaves = said.groupBy("host", "l.leaf").agg(F.count(F.lit(1)).alias("m"), F.first("l.branch").alias("branch"), F.first("l.path").alias("path"), F.first("l.outside").alias("outside"))
    told = n * F.col("weight")
    read_alike = features(pages).groupBy("host", "leaf").agg(F.sum(told).alias("told"), F.sum(told * F.log(n)).alias("logs"))
    content = F.when(m > 1, 1 - F.col("logs") / F.col("told") / base).otherwise(1.0)
    leaves = stage(leaves.join(read_alike, ["host", "leaf"]).select("host", "leaf", "m", "branch", "path", "outside", content.alias("content")), "leaves")
    below = leaves.select("host", "m", "content", F.explode("path").alias("key")).groupBy("host", "key").agg((F.sum(m * F.col("content")) / F.sum("m")).alias("inner"))
    keep = F.pow(F.lit(DISCOUNT), F.col("n_styles"))
    branches = below.join(shown, ["host", "key"]).select("host", F.col("key").alias("branch"), ((1 - keep) * F.col("presentation") + keep * F.col("inner")).alias("branch_importance"))
    seen, weight = m - 1, F.when(F.col("outside"), OUTSIDE_EVIDENCE).otherwise(EVIDENCE)
    prior = F.when(F.col("outside"), OUTSIDE_PRIOR).otherwise(1.0)
    own = (F.col("content") + F.col("branch_importance")) / 2
    return leaves.join(branches, ["host", "branch"]).select("host", "leaf", "m", "content", "branch_importance", ((seen * own + weight * prior) / (seen + weight)).alias("importance"))


def removed_leaves(read: DataFrame, low: DataFrame) -> tuple[DataFrame, Column]:
    """Table with the removed leaves as ``removed``, and the condition that joins it to the pages.

    Up to ``MOST_SENT`` leaves in all are sent to every executor by host, and no page moves; more are brought to their pages.
    """
    if low.limit(MOST_SENT + 1).count() <= MOST_SENT:
        by_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("low_leaf").alias("removed"))
        return F.broadcast(by_host), F.col("host") == F.col("_host")
    used = read.select("row_id", "host", F.explode("leaves.leaf").alias("leaf"))
    found = used.join(low.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & (F.col("leaf") == F.col("low_leaf")))
    return found.groupBy(F.col("row_id").alias("_row")).agg(F.collect_set("leaf").alias("removed")), F.col("row_id") == F.col("_row")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Elements whose tag or role says that they are no article are left out, and those whose name says so if they do not hold the page's
    text (see ``Page``). Of the rest, leaves whose importance on the host stays under ``LEAST_IMPORTANCE`` are removed; an article or main
    element with at least half of a page's text counts against leaves outside it. The blocks left stand in page order with two line ends
    between them. The scores come from all distinct pages of a host.

    A null or empty page has no text; a null or odd url counts to one nameless host; repeated rows give a row each; a null ``page_id``
    stays null; other columns are left out; an empty table gives an empty result.
    """
    read = stage(read_pages(pages), "pages", compression="zstd")
    low = stage(importance(read).filter(F.col("importance") < LEAST_IMPORTANCE).select("host", F.col("leaf").alias("low_leaf")), "low-leaves")
    joined = read.select("row_id", "page_id", "url", "host", "blocks").join(*removed_leaves(read, low), "left")
    kept = F.filter("blocks", lambda b: F.coalesce(~F.array_contains(F.col("removed"), b["leaf"]), F.lit(True)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``; see ``main_text`` for nulls, copies and empty tables."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
