"""Main text of web pages by site template removal.

Each page's element subtrees are hashed; Spark counts, per host, beside how many different texts a subtree occurs; subtrees
recurring so across a host are its template and are deleted, at every level. A hash covers tags, classes and text, with numbers
alike; not link targets and other attributes. A list of links outside of article and main is hashed by its shape alone, so that
menus whose links differ from page to page are one subtree; shapes that many hosts share are template of hosts too small to tell.
Pages of one host with equal text, before anything is deleted, are copies and count once.

Elements that HTML itself declares to be no main text (nav, footer, form and so on, hidden ones, landmark roles) and those whose class
or id is, as a whole, the usual name of a menu, header, footer, sidebar, notice, advert or comment are left out before. Of the article and main elements
the one that holds most of their remaining text is the article; an article inside an article is a comment unless it holds most of it.

Inside article and main, running text, and what holds more text than links, is never taken for template, since near copies of an article recur as well.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, small

#: A subtree is template if at least so many pages of its host, copies counted once, and this share of them, hold it.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: A list of so many links goes by its shape: it must be on this share of its host's pages; for hosts of fewer than MIN_PAGES pages on so many hosts.
LINKS, SHAPE_SHARE, MIN_HOSTS = 3, 0.5, 10

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
#: Elements whose content is no markup; all of them are left out.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style textarea noscript iframe noframes noembed xmp title".split()}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav header footer aside form search button select option menu dialog template svg math canvas object audio video map applet fieldset datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tr body html article section div nav".split())
#: What an implied end tag does not reach beyond; a cell's reaches through divs.
_SAME_SCOPE = {t: _SCOPE - set(same) - ({"div"} if t in ("td", "th") else set()) for t, same in _SAME.items()}
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Running text too, where more of it is outside links than in them.
_HOLDING = frozenset("ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption details summary div section center address".split())
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NUMBER = re.compile(r"\d+")
#: Roles of landmarks and widgets that are no main text.
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Whole classes and ids, lower case with hyphens: those of adverts and comments, which count for any element, and those of menus, headers, footers, sidebars and notices, which count for any but an article or main itself.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising ad-box adbox adsbygoogle banner-ad sponsored comment comments comment-list comments-area comments-section reader-comments respond disqus-thread".split())
_AROUND = _ADVERTS | frozenset("menu nav navbar navigation breadcrumb breadcrumbs header site-header masthead footer site-footer page-footer sidebar notice notices cookies cookie-notice cookie-banner cookie-consent consent gdpr".split())


def _marks(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """(dropped, main landmark, classes in order) by an element's attributes."""
    names: set[str] = set()
    main = False
    classes = ""
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, ""
        if name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "role":
            roles = set(value.lower().split())
            main |= "main" in roles
            if roles & _ROLES:
                return True, False, ""
        elif name in ("class", "id"):
            tokens = value.lower().replace("_", "-").split()
            names.update(tokens)
            if name == "class":
                classes = ".".join(sorted(set(tokens)))
    return bool(names & (_ADVERTS if tag in ("article", "main") else _AROUND)), main, classes


class _Element:
    __slots__ = ("tag", "depth", "first", "last", "drop", "landmark", "holds", "kind", "parts", "shapes", "shape", "size", "plain", "linked", "links", "running", "hash", "up")

    def __init__(self, tag: str, up: _Element | None, attrs: str = ""):
        self.tag, self.up, self.parts, self.shapes, self.size, self.running, self.hash = tag, up, [], set(), 0, tag in _RUNNING, 0
        self.plain = self.linked = self.links = 0
        self.depth, self.first, self.last = up.depth + 1 if up else 0, -1, -1
        dropped, main, classes = _marks(tag, attrs) if attrs and not attrs.isspace() else (False, False, "")
        self.kind = f"{tag}.{classes}"
        self.drop = tag in _DROPPED or (dropped and tag not in ("html", "body")) or bool(up and up.drop)
        self.landmark = up.landmark if up else -1  # number of the nearest one
        self.holds = not self.drop and (tag == "article" or (self.landmark < 0 and (tag == "main" or main)))

    def close(self) -> None:
        """Hashes the subtree; what is left out counts for nothing."""
        if self.drop:
            return
        if self.tag == "a":
            self.plain, self.linked, self.links = 0, self.plain + self.linked, self.links + 1
        self.shape = f"{self.kind}({','.join(sorted(self.shapes))})"
        if len(self.shape) > 64:
            self.shape = f"{self.kind}({xxhash.xxh3_64_hexdigest(self.shape.encode('utf-8', 'surrogatepass'))})"
        listed = self.landmark < 0 and self.links >= LINKS and self.linked > self.plain
        said = self.shape if listed else "\x00".join([self.kind, *self.parts])
        # the last bit tells shapes from the rest
        self.hash = ((xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) | 1) ^ (not listed)) - (1 << 63)
        self.running |= self.tag in _HOLDING and self.plain > self.linked
        if self.up:
            up = self.up
            up.plain += self.plain
            up.linked += self.linked
            up.links += self.links
            up.parts.append(str(self.hash))
            up.shapes.add(self.shape)
            up.size += self.size
            up.running |= self.running
            up.holds |= self.holds


class _TagEnds:
    """Finds the ends of a page's tags, all of them in time linear in the page."""

    def __init__(self, page: str):
        self.page, self.open, self.none = page, set(), {"'": len(page), '"': len(page)}

    def after(self, at: int) -> int:
        """Behind the > that ends a tag, not one in quotes; a quote without an end is an ordinary character. -1 if the page ends first."""
        page, seen = self.page, []
        while at not in self.open and (m := _STOP.search(page, at)):
            if m[0] == ">":
                return m.end()
            close = page.find(m[0], m.end()) if m.end() < self.none[m[0]] else -1
            if close < 0:
                self.none[m[0]] = min(self.none[m[0]], m.end())  # no such quote from here on
                return page.find(">", m.end()) + 1 or -1
            seen.append(at)
            at = close + 1
        self.open.update(seen, (at,))  # from none of these does a tag end
        return -1


def _tokens(page: str) -> Iterator[tuple[str | None, str, str]]:
    """(text, '', '') or (None, tag name with a leading slash if it ends, attributes); comments and raw elements are skipped. Linear in the page."""
    at, n, ends = 0, len(page), _TagEnds(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield page[at:lt], "", ""
        if lt == n:
            return
        m = _NAME.match(page, lt + 1)
        if m:
            at = ends.after(m.end())
            if at < 0:  # no tag ends any more, or only one in an open quote
                at = page.find(">", m.end()) + 1
                if not at:
                    return
            name = m[0].lower()
            if name in _RAW:
                close = _RAW[name].search(page, at)
                at = close.end() if close else n
            else:
                yield None, name, page[m.end() : at - 1]
        elif page.startswith("<!--", lt):
            at = page.find("-->", lt + 2) + 3
            at = at if at > 2 else n
        elif page.startswith("<![CDATA[", lt):
            at = page.find("]]>", lt) + 3
            at = at if at > 2 else n
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            at = page.find(">", lt) + 1 or n
        else:
            yield "<", "", ""
            at = lt + 1


#: What is known of a page: its blocks' texts; of each block the nearest article or main element; of these elements, in page order, the
#: number of the one around (-1: none) and whether it is an article; of each block the subtrees, as (hash, number of the last block), that begin with it and may be deleted.
Page = tuple[list[str], list[int], list[int], list[bool], list[list[tuple[int, int]]]]


def parse(page: str | None) -> tuple[Page, list[int]]:
    """The page, and all subtree hashes of it that count towards its host's template.

    Linear in the page: open elements are kept by tag, and a subtree is a range of blocks.
    """
    root = _Element("#page", None)
    top, block, blocks, done = root, [], [], []
    opened: dict[str, list[_Element]] = {}
    inner: list[_Element] = []  # open block elements
    around: list[int] = []
    articles: list[bool] = []

    def end_block() -> None:
        if block:
            text = " ".join("".join(t for t, _ in block).split())
            if text:
                blocks.append((text, block[0][1]))
            block.clear()

    def pop() -> None:
        nonlocal top
        top.close()
        if not top.drop:
            done.append(top)
        opened[top.tag].pop()
        if top.tag in _BLOCK:
            inner.pop()
        top = top.up

    def nearest(tags) -> _Element:
        """The innermost open element of these tags, or the root."""
        return max((opened[t][-1] for t in tags if opened.get(t)), key=lambda e: e.depth, default=root)

    def close_to(at: _Element) -> None:
        while top is not at:
            pop()
        pop()

    for text, tag, attrs in _tokens(page or ""):
        if text is not None:
            if top.drop:
                continue
            text = _html.unescape(text)
            said = " ".join(text.split())
            if said:
                top.parts.append(_NUMBER.sub("0", said))
                top.size += len(said)
                top.plain += len(said)
            if block and block[0][1] is not top and said and block[0][0].isspace():
                block[0] = (block[0][0], top)
            block.append((text, top))
            continue
        end, tag = tag[0] == "/", tag.lstrip("/")
        if tag in _BLOCK:
            end_block()
        if end:
            at = nearest((tag,))
            if tag not in _BLOCK and inner and inner[-1].depth > at.depth:  # an inline end tag closes nothing beyond its block
                at = root
            if at is not root:
                close_to(at)
            continue
        if tag in _CLOSES_P and opened.get("p"):
            at = nearest(("p",))
            if at.depth > nearest(_SCOPE).depth:
                close_to(at)
        if tag in _SAME:
            at = nearest(_SAME[tag])
            if at.depth > nearest(_SAME_SCOPE[tag]).depth:
                close_to(at)
        if tag in _VOID:
            if not top.drop:
                top.parts.append(tag)
            continue
        top = _Element(tag, top, attrs)
        if top.holds:
            around.append(top.landmark)
            articles.append(tag == "article")
            top.landmark = len(around) - 1
        opened.setdefault(tag, []).append(top)
        if tag in _BLOCK:
            inner.append(top)
    end_block()
    while top is not root:
        pop()

    total = sum(len(t) for t, _ in blocks)

    def template_like(e: _Element) -> bool:
        """Whether a subtree may be template: holds no article or main, is not running text of one, and not most of the page."""
        return e.tag in _BLOCK and not e.holds and e.tag not in ("html", "body", "br", "hr") and not (e.landmark >= 0 and e.running) and 0 < 2 * e.size <= total

    begun: list[list[tuple[int, int]]] = [[] for _ in blocks]
    for i, (_, e) in enumerate(blocks):
        e.last = i
        while e is not root and e.first < 0:
            e.first, e = i, e.up
    for e in done:  # inner ones come first
        if e.first >= 0:
            e.up.last = max(e.up.last, e.last)
            if template_like(e):
                begun[e.first].append((e.hash, e.last))
    return ([t for t, _ in blocks], [e.landmark for _, e in blocks], around, articles, begun), list({e.hash for e in done if template_like(e)})


def bound(page: Page) -> bool:
    """Whether no deletion can change the page's main text: no block that may belong to it can be deleted."""
    texts, of, _, _, begun = page
    marked = any(m >= 0 for m in of)
    return not any(b and (m >= 0 or not marked) for m, b in zip(of, begun, strict=True))


def chosen(page: Page, gone: set[int]) -> tuple[list[str], int]:
    """(blocks of the article, number of blocks deleted): those that no deleted subtree covers, of the article or main element with most of the text.

    From outside inwards the element with more than half of the remaining text around it is gone into. Where none has more, all there
    stay but articles inside an article. Without text in any such element all of the page stays.
    """
    texts, of, around, articles, begun = page
    left, to = [], -1
    for i, subtrees in enumerate(begun):
        if gone:
            to = max([to, *[last for h, last in subtrees if h in gone]])
        if i > to:
            left.append(i)
    size = [0] * len(around)
    for i in left:
        if of[i] >= 0:
            size[of[i]] += len(texts[i])
    inside: dict[int, list[int]] = {}
    for m in range(len(around) - 1, -1, -1):  # inner ones come later
        inside.setdefault(around[m], []).append(m)
        if around[m] >= 0:
            size[around[m]] += size[m]
    here, whole = -1, sum(size[m] for m in inside.get(-1, ()))
    deleted = len(texts) - len(left)
    if not whole:
        return [texts[i] for i in left], deleted
    while here in inside:
        best = max(inside[here], key=lambda m: size[m])
        if 2 * size[best] <= whole:
            break
        here, whole = best, size[best]
    stays: list[bool] = []
    for m, up in enumerate(around):
        stays.append(m == here or (here < 0 and up < 0) or (up >= 0 and stays[up] and not (articles[m] and articles[up])))
    return [texts[i] for i in left if of[i] >= 0 and stays[of[i]]], deleted


_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_BEGUN = pa.list_(pa.list_(pa.struct([("hash", pa.int64()), ("last", pa.int32())])))
_LISTS = {"texts": pa.list_(pa.string()), "of": pa.list_(pa.int32()), "around": pa.list_(pa.int32()), "articles": pa.list_(pa.bool_()), "begun": _BEGUN, "hashes": pa.list_(pa.int64())}
PARSED = "page_id bigint, url string, host string, digest string, main bigint, texts array<string>, of array<int>, around array<int>, articles array<boolean>, begun array<array<struct<hash: bigint, last: int>>>, hashes array<bigint>, bound boolean"


def parsed(pages: DataFrame) -> DataFrame:
    """What :func:`parse` finds of every page; main: hash of its text before anything is deleted. Of bound pages, whose text is known at once, only that text's blocks are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            urls, pages_ = b.column("url").to_pylist(), b.column("html").to_pylist()
            cols: dict[str, list] = {c: [] for c in _LISTS}
            digest, main, known = [], [], []
            for u, p in zip(urls, pages_, strict=True):
                page, hashes = parse(p)
                text = chosen(page, set())[0]
                digest.append(xxhash.xxh3_128_hexdigest(f"{u}\x00{p}".encode("utf-8", "surrogatepass")))
                main.append(xxhash.xxh3_64_intdigest("\x00".join(text).encode("utf-8", "surrogatepass")) - (1 << 63))
                known.append(bound(page))
                if known[-1]:
                    page = (text, [], [], [], [])
                for c, v in zip(_LISTS, (*page[:4], [[{"hash": h, "last": z} for h, z in x] for x in page[4]], hashes), strict=True):
                    cols[c].append(v)
            lists = {c: pa.array(cols[c], t) for c, t in _LISTS.items()}
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array([host_of(u) for u in urls], pa.string()), pa.array(digest, pa.string()), pa.array(main, pa.int64()), *lists.values(), pa.array(known, pa.bool_())],
                ["page_id", "url", "host", "digest", "main", *lists, "bound"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PARSED)


def templates(rows: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """(host, hash) of subtrees that recur on many pages of their host, pages of equal text counted once; on hosts with too few pages, of link lists that many hosts have.

    A host's rows spread by hash and text.
    """
    pages = rows.select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    held = rows.select("host", "main", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    held = materialise(held, "held")
    shape = F.col("hash").bitwiseAND(1) == 1
    often = held.where(F.col("n") >= min_pages).join(pages, "host").where(F.col("n") >= F.when(shape, F.lit(SHAPE_SHARE)).otherwise(F.lit(min_share)) * F.col("pages"))
    shapes = held.where(shape)
    wide = broadcast_if_small(shapes.groupBy("hash").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= min_hosts).select("hash"), "wide")
    few = shapes.join(wide, "hash").join(pages.where(F.col("pages") < min_pages), "host")
    return often.select("host", "hash").union(few.select("host", "hash"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars and n_template (blocks that the template has taken) of every row of ``pages`` (page_id, url, html).

    A null html counts as empty and gives ''; a null or odd url belongs to host ''. Repeated rows and ids give a row each; ties between
    elements go to the first. Pages are parsed once, whole, however long, in time linear in the page; the texts of those that
    depend on their host's template join the deleted subtrees, others do not move.
    """
    rows = materialise(parsed(pages), "parsed")
    free = rows.where("not bound")
    found = free.select("digest", "host", F.explode(F.array_distinct(F.transform(F.flatten("begun"), lambda b: b["hash"]))).alias("hash")).distinct()
    gone = found.join(templates(rows, min_pages, min_share, min_hosts), ["host", "hash"]).groupBy("digest").agg(F.collect_set("hash").alias("gone"))  # subtrees of one page
    gone = materialise(gone, "gone")  # a join of two plain shuffles, so the rows of a very common page can be split

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = [
                chosen((texts, of, around, articles, [[(x["hash"], x["last"]) for x in s] for s in begun]), set(out or ()))
                for texts, of, around, articles, begun, out in zip(*[b.column(c).to_pylist() for c in ("texts", "of", "around", "articles", "begun", "gone")], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([" ".join(t) for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["page_id", "url", "text", "n_template"])

    free = free.join(gone, "digest", "left").select("page_id", "url", "texts", "of", "around", "articles", "begun", "gone").mapInArrow(choose, "page_id bigint, url string, text string, n_template bigint")
    texts = free.union(rows.where("bound").select("page_id", "url", F.array_join("texts", " ").alias("text"), F.lit(0).cast("long").alias("n_template")))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
