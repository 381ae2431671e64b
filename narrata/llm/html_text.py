"""Main text of web pages by templates that are deduced from equivalence classes of tokens.

1. Tokens: elements, told apart by their paths of names and classes, and slot texts (what a path directly holds on a
   page). Each token's occurrence vector over its host's pages (how often it is on each) is summed up as a hash of
   (page, count), so vectors are compared without being gathered.
2. Classes: frequent tokens of equal vectors. A token is frequent if it is on half of the host's pages, where each host
   gets ``PRIOR`` pages more that have the token as often as all pages do; so hosts of any size follow one rule. A token
   whose enclosing path isn't as frequent is left out (nesting). A class is valid if its elements come in one order, as
   often as they come, on at least half of the pages that hold it. Nested valid classes are the host's template.
3. Slots: the main slot is the part of the template that holds the article. Candidates are elements of valid classes that
   occur once a page and hold at least half of the host's variable text, which form a chain; the innermost is taken, or
   an outer one that adds nothing but headings. Texts that are tokens of the template don't vary and hardly count
   (``VARIES``); on a host of copies nothing varies, and they decide.
4. Extraction: the text blocks of the host's main slot; on pages without it, those of the main slot of all pages; on
   others, all blocks but template texts and those of elements like nav and form. Element names and class words only
   name what is furniture inside of the slot (forms, adverts, reader comments); they don't find the slot, except that
   furniture is no variable text, and without a slot class words say nothing.

Text inside a main slot stays even where pages share it. Three passes parse the pages; only sums are shuffled.

Defined results: a null or empty page has an empty text; pages without or with null urls share one host; repeated rows
are counted as pages of their own; markup that the end of the page cuts off is dropped; paths are hashes of their
parents' hashes, so deep or long pages take time and memory in proportion; extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, pick, slices, staged

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Fixed values from the HTML standard: elements without end tags, elements whose content is raw text, blocks.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "li", "dd", "dt", "body", "head", "html"}
#: What holds no main text inside of a main slot, by element, and by word of a class, id or role.
FURNITURE = set("nav header footer aside form script style noscript iframe textarea template button select menu dialog head title svg object canvas audio video".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal nav navbar "
    "navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related share sharing social subscribe newsletter login "
    "signup search comment comments respond disqus reply replies pagination pager toolbar legal copyright".split()
)
PLAIN = {"body", "html", "article", "main"}  # what a class of the whole page or article says of furniture doesn't count
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PRIOR = 4  # pages that every host has besides its own: tokens and texts as on all pages
SUPPORT = 0.5  # share of a host's pages that a token of its template is on
MAIN = 0.5  # share of the variable text that the main slot holds
VARIES = 16  # variable text counts as so many times text of the template


def number(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{label}".encode("utf-8", "surrogatepass")) - (1 << 63)


ROOT = 0
WHOLE = 4  # a mark that everything has


class Element(NamedTuple):
    name: str
    path: int
    furniture: bool
    inside: int  # marks of the slots it lies in
    spoilt: int  # marks of the slots inside of which it is furniture


class Page:
    """Elements of a page by path, in their order, and its text blocks. ``slots``: paths of which the inside is marked."""

    def __init__(self, html: str | None, slots: tuple[int | None, ...] = ()):
        self.marks = {path: 1 << k for k, path in reversed(list(enumerate(slots))) if path is not None}
        self.parents: dict[int, tuple[int, int]] = {ROOT: (ROOT, 0)}  # path: parent and depth
        self.order: list[int] = []
        self.blocks: list[tuple[int, str, bool, bool, int, int]] = []  # path, text, heading, furniture, inside, spoilt
        self.stack = [Element("", ROOT, False, WHOLE | self.marks.get(ROOT, 0), 0)]
        self.open: dict[str, int] = {}  # how many elements of a name are open
        self.held = [self.stack[0]]  # the open blocks
        self.text: list[str] = []
        self._read(html or "")

    def _flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                e = self.held[-1]
                self.blocks.append((e.path, text, e.name in HEADINGS, e.furniture, e.inside, e.spoilt))

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
        if name in CLOSES_P:
            self._close_p()
        elif name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            if self.stack[-1].name == name:
                self._pop()
        if name in VOID:
            if name == "br":
                self.text.append(" ")
            return
        said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes else {}
        words = {w for v in said.values() for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())}
        outer = self.stack[-1]
        path = number(outer.path, name + "".join("." + c for c in (said.get("class") or "").split()))
        if path not in self.parents:
            self.parents[path] = (outer.path, self.parents[outer.path][1] + 1)
        self.order.append(path)
        named, labelled = name in FURNITURE, name not in PLAIN and bool(words & FURNITURE_WORDS)
        spoilt = outer.spoilt | (outer.inside if named else outer.inside & ~WHOLE if labelled else 0)
        e = Element(name, path, outer.furniture or named or labelled, outer.inside | self.marks.get(path, 0), spoilt)
        self.stack.append(e)
        self.open[name] = self.open.get(name, 0) + 1
        if name in BLOCKS:
            self.held.append(e)

    def _pop(self) -> None:
        name = self.stack[-1].name
        if name in BLOCKS:
            self._flush()
            self.held.pop()
        self.open[name] -= 1
        self.stack.pop()

    def _close_p(self) -> None:
        """A block ends the paragraph it would lie in."""
        if self.held[-1].name == "p":
            while self.stack[-1] is not self.held[-1]:
                self._pop()
            self._pop()

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self.open.get(name):
            while self.stack[-1].name != name:
                self._pop()
            self._pop()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TOKEN.match(html, at)
            at = m.end()
            end, start, attributes, closed = m.groups()
            if start:
                if not closed:  # cut off
                    break
                name = start.lower()
                self._open(name, attributes)
                if name in RAW:
                    stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else n
            elif end:
                self._close(end.lower())
            else:
                t = m.group()
                if t[0] != "<" or t == "<":
                    self.text.append(t)
        self._flush()

    def slot_texts(self) -> dict[int, int]:
        """Of each path that directly holds text: the token of all that it holds."""
        held: dict[int, list[str]] = {}
        for path, text, *_ in self.blocks:
            held.setdefault(path, []).append(text)
        return {path: number(path, "\n".join(t)) for path, t in held.items()}

    def tokens(self) -> dict[int, tuple[int, int, bool]]:
        """Of each token: how often it is there, the path around it, whether it is a text."""
        out = {path: (n, self.parents[path][0], False) for path, n in Counter(self.order).items()}
        return out | {t: (1, path, True) for path, t in self.slot_texts().items()}

    def volumes(self, fixed: frozenset[int]) -> dict[int, tuple[int, int]]:
        """Of each path: weighted characters of text that isn't furniture, and characters of all text but headings, inside of it."""
        texts, out = self.slot_texts(), {path: [0, 0] for path in self.parents}
        for path, text, heading, furniture, *_ in self.blocks:
            if not furniture:
                out[path][0] += len(text) * (1 if texts[path] in fixed else VARIES)
            if not heading:
                out[path][1] += len(text)
        for path in sorted(self.parents, key=lambda p: -self.parents[p][1]):
            if path != ROOT:
                around = out[self.parents[path][0]]
                around[0] += out[path][0]
                around[1] += out[path][1]
        return {path: (a, b) for path, (a, b) in out.items()}


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    rows = pick(pages, page_id="long", url="string", html="string")
    return rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))


def _summed(sums: dict[tuple, list[int]], schema: pa.Schema) -> pa.RecordBatch:
    keys, values = list(sums), list(sums.values())
    columns = list(zip(*(k + tuple(v) for k, v in zip(keys, values, strict=True)), strict=True)) if keys else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_TOKENS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("around", pa.int64()), ("is_text", pa.bool_()), ("pages", pa.int64()), ("n", pa.int64()), ("vector", pa.int64())])
TOKENS = "host string, token long, around long, is_text boolean, pages long, n long, vector long"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the pages of a slice: how many have a token, how often, and the hash of its part of the vector."""
    for batch in batches:
        for part in slices(batch, 1000, column="html"):
            sums: dict[tuple, list[int]] = {}
            for page_id, host, html in zip(*(part.column(c).to_pylist() for c in ("page_id", "host", "html")), strict=True):
                for token, (n, around, is_text) in (Page(html).tokens() | {ROOT: (1, ROOT, False)}).items():
                    s = sums.setdefault((host, token, around, is_text), [0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] = (s[2] + (xxhash.xxh3_64_intdigest(f"{page_id},{n}") >> 16)) & ((1 << 48) - 1)  # sums of 48-bit words
            yield _summed(sums, _TOKENS)


def tokens(rows: DataFrame) -> DataFrame:
    """(host, token, around, is_text, pages, n, vector) of ``rows`` (host, page_id, html); ROOT stands for the page itself."""
    sums = rows.mapInArrow(_vectors, TOKENS).groupBy("host", "token", "around", "is_text")
    return sums.agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.pmod(F.sum("vector"), F.lit(1 << 48)).alias("vector"))


def frequent(found: DataFrame) -> DataFrame:
    """(host, token, class, is_text) of the frequent nested tokens of each host."""
    total = found.filter(F.col("token") == ROOT).select("host", F.col("pages").alias("all_pages"))
    # a token on under a tenth of the host's own pages can't be frequent, whatever other hosts have
    some = found.join(total, "host").filter(F.col("pages") + PRIOR >= (F.col("all_pages") + PRIOR) * SUPPORT)
    every = found.groupBy("token").agg(F.sum("pages").alias("pool")).filter("pool > 1")
    whole = total.agg(F.sum("all_pages").alias("m")).first()["m"] or 1
    rate = F.coalesce(F.col("pool"), F.lit(1)) / F.lit(whole)
    often = some.join(every.select(apart("token"), "pool"), "token", "left").filter(F.col("pages") + PRIOR * rate >= (F.col("all_pages") + PRIOR) * SUPPORT)
    outer = often.filter("not is_text").select("host", F.col("token").alias("around"), F.col("pages").alias("outer_pages"))
    nested = often.join(outer, ["host", "around"]).filter("outer_pages >= pages")
    return nested.select("host", "token", F.xxhash64("pages", "n", "vector").alias("class"), "is_text")


_SLOTS = pa.schema([("host", pa.string()), ("is_class", pa.bool_()), ("key", pa.int64()), ("value", pa.int64()), ("depth", pa.int64())] + [(c, pa.int64()) for c in ("pages", "n", "held", "total", "raw")])
SLOTS = "host string, is_class boolean, key long, value long, depth long, pages long, n long, held long, total long, raw long"


def orders(sequence: list[int], classes: dict[int, int]) -> dict[int, int]:
    """Of each class on a page: a hash of the order its elements come in again and again, 0 if they don't."""
    rows: dict[int, list[int]] = {}
    for path in sequence:
        if (c := classes.get(path)) is not None:
            rows.setdefault(c, []).append(path)
    out = {}
    for c, seen in rows.items():
        period = len(set(seen))
        same = all(a == b for a, b in zip(seen, seen[period:], strict=False)) and not len(seen) % period
        out[c] = (xxhash.xxh3_64_intdigest(repr(seen[:period])) >> 1 or 1) if same else 0
    return out


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums for each host's classes (how many pages have each order) and elements (the text in them)."""
    known: dict[str, tuple[dict[int, int], frozenset[int]]] = {}
    for batch in batches:
        for part in slices(batch, 1000, column="html"):
            sums: dict[tuple, list[int]] = {}
            layouts = part.column("layout")
            for i, (host, html) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    rows = layouts[i].as_py() or []
                    known[host] = ({r["token"]: r["class"] for r in rows if not r["is_text"]}, frozenset(r["token"] for r in rows if r["is_text"]))
                classes, fixed = known[host]
                page = Page(html)
                for c, order in orders(page.order, classes).items():
                    s = sums.setdefault((host, True, c, order, 0), [0] * 5)
                    s[0] += 1
                counts, volumes = Counter(page.order), page.volumes(fixed)
                for path, (held, raw) in volumes.items():
                    if path in classes:
                        s = sums.setdefault((host, False, path, classes[path], page.parents[path][1]), [0] * 5)
                        for k, x in enumerate((1, counts[path] or 1, held, volumes[ROOT][0], raw)):
                            s[k] += x
            yield _summed(sums, _SLOTS)


def main_slots(rows: DataFrame) -> tuple[DataFrame, int | None]:
    """(host, slot, fixed): the path of each host's main slot and its template's texts; and the main slot of all pages.

    ``rows`` has host, page_id and html.
    """
    found = staged(tokens(rows), "page-tokens")
    layout = frequent(found).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("token", "class", "is_text"))).alias("layout"))
    layout = staged(layout, "page-layouts")
    sums = rows.join(layout, "host").select("host", "html", "layout").mapInArrow(_slots, SLOTS)
    parts = staged(sums.groupBy("host", "is_class", "key", "value", "depth").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "held", "total", "raw")]), "page-slots")
    valid = (
        parts.filter("is_class").groupBy("host", F.col("key").alias("class"))
        .agg(F.max(F.when(F.col("value") != 0, F.col("pages"))).alias("most"), F.sum("pages").alias("all"))
        .filter(F.col("most") >= F.col("all") * SUPPORT).select("host", "class")
    )
    elements = parts.filter("not is_class and n = pages").withColumnRenamed("value", "class").join(valid, ["host", "class"])
    every = elements.groupBy("key").agg(*[F.sum(c).alias(f"all_{c}") for c in ("pages", "held", "total", "raw")], F.max("depth").alias("depth"))
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    shrunk = (F.col("pages") * share("held", "total") + PRIOR * share("all_held", "all_total")) / (F.col("pages") + PRIOR)
    chain = elements.join(every.drop("depth"), "key").filter(shrunk >= MAIN)
    inner = F.struct("held", (-F.col("depth")).alias("up"), "raw", "key")
    least = F.array_min("chain")
    # of the chain: what holds the least, and is deepest; then the outermost that holds no more than that but headings
    outermost = F.array_max(F.transform(F.filter("chain", lambda x: x["raw"] == least["raw"]), lambda x: F.struct(x["up"].alias("up"), x["key"].alias("key"))))["key"]
    slots = chain.groupBy("host").agg(F.collect_list(inner).alias("chain")).select("host", outermost.alias("slot"))
    whole = found.filter(F.col("token") == ROOT).agg(F.sum("pages").alias("m")).first()["m"] or 0
    pooled = every.filter((F.col("all_pages") >= whole * SUPPORT) & (share("all_held", "all_total") >= MAIN))
    pooled = pooled.select(F.col("all_held").alias("held"), "depth", F.col("all_raw").alias("raw"), "key").agg(F.collect_list(inner).alias("chain"))  # a chain: half of the text is in each
    pool = pooled.filter("size(chain) > 0").select(outermost.alias("slot")).first()
    texts = F.transform(F.filter("layout", lambda x: x["is_text"]), lambda x: x["token"])
    return staged(layout.select("host", texts.alias("fixed")).join(slots, "host", "left"), "page-slots"), pool and pool["slot"]


def main_text(html: str | None, slot: int | None, pool: int | None, fixed: frozenset[int]) -> str:
    """The text of the page's main slot, or of what takes its place."""
    page = Page(html, (slot, pool))
    for mark in (1, 2):
        if any(inside & mark for *_, inside, _ in page.blocks):
            return "\n".join(text for _, text, _, _, inside, spoilt in page.blocks if inside & mark and not spoilt & mark)
    texts = page.slot_texts() if fixed else {}
    return "\n".join(text for path, text, _, _, _, spoilt in page.blocks if not spoilt & WHOLE and texts.get(path) not in fixed)


def _extract(pool: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500, column="html"):
                fixed, last, now = part.column("fixed"), None, frozenset()
                texts = []
                for i, (host, html, slot) in enumerate(zip(*(part.column(c).to_pylist() for c in ("host", "html", "slot")), strict=True)):
                    if host != last:
                        last, now = host, frozenset(fixed[i].as_py() or ())
                    texts.append(main_text(html, slot, pool, now))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    rows = with_host(pages)
    slots, pool = main_slots(rows)
    return rows.join(slots, "host", "left").mapInArrow(_extract(pool), "page_id long, url string, text string, n_chars long")
