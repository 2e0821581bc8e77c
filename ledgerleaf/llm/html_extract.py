"""Main text of web pages by differencing each page with its nearest pages on the host.

1. A page becomes text lines (blocks), menus, adverts and all; only scripts, styles and the like are left out.
2. Pages are ordered by host and URL path. From a page outward, the page whose path
   shares the longer beginning comes first (the earlier one on ties), and the first three pages that share lines outside
   articles are its partners. Copies of one page with small changes (most of either is shared, and of the rest the
   words agree or one has none) say nothing of the template, so the search goes on over them.
3. The lines of page and partner are aligned by a longest common subsequence. Lines shared with two partners are the
   host's template and deleted; the second partner keeps passages that two articles share. Where only one page of the
   host shares lines, these go. Lines inside an ``article`` or ``main`` are content by the page's own word and stay.
4. Adverts and menus made anew for each page are never shared. So of the lines that are left, those go which lie in an element
   that states its part (``nav``, ``aside``, ``footer``, forms, a class or id that is the name of such a part), and lines that
   consist of links. Where a page has an ``article`` or ``main``, its text is what lies inside, without teasers: further
   articles whose heading is a link.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import by_slices, saved, slices, spread_join

#: Pages that share more of their characters are copies, if so much of their other words agrees.
MOST_SHARED, MOST_AGREED = 0.5, 0.5
#: Words of a line, those of the least hashes, by which lines are compared that are not equal.
SKETCH = 3
#: Range partitions for ordering: pages per partition, about, and pages that are looked at on either side of a page.
SORT_ROWS, HALO = 1_000, 16
#: Partners of a page, and how many of them must share a line (one, where there is one).
PARTNERS, AGREEING = 3, 2

# a tag that the page ends in, also within a quote, takes the rest of the page, as in browsers
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

# Elements by their part in a page.
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas audio video head".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Names of parts of a page that are not its text, and what may stand beside one in a class or id of such a part.
_PARTS = (
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer dialog disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert"
)
PARTS = frozenset(_PARTS.split())
_BESIDE = (
    "area bar block bottom box btn button buttons col column container content count entry field footer form global head holder icons inner input item items "
    "left link links list main mobile module news notification outer page panel post posts primary reader region right section site slot sponsored sticky "
    "story stories thread top unit user wrap wrapper"
)
BESIDE = frozenset(_BESIDE.split())
#: Class and id names that speak of a layout or of a part of the content.
_NO_PART = re.compile(r"(?:has|with|without|no|section|article|post|entry)[-_]")
#: Elements that may wrap a whole page, and names of what never does.
_WRAPS = frozenset(("form", "fieldset"))
_NO_WRAP = re.compile(r"comment|repl(?:y|ies)|disqus|cookie|consent|gdpr|\bnav|\bmenu|footer", re.I)
#: What a start tag ends besides an open paragraph, where end tags are omitted.
_ENDS = {"li": frozenset(["li"]), **dict.fromkeys(("dt", "dd"), frozenset(["dt", "dd"])), **dict.fromkeys(("td", "th"), frozenset(["td", "th"])), "tr": frozenset(["td", "th", "tr"]), **dict.fromkeys(("tbody", "tfoot"), frozenset(["td", "th", "tr", "tbody", "thead"]))}
#: Names of the sets above whose start leaves a paragraph open.
_INLINE = frozenset("br button label select caption tbody td th tr".split()) - frozenset(_ENDS)


@dataclass
class Line:
    """A text line: ``article`` numbers the innermost article or main around it (0 for none), ``aside``: lies in a part that is not text."""

    text: str
    article: int = 0
    aside: bool = False
    links: bool = False
    heading: bool = False


def _states_part(name: str, attrs: str) -> bool:
    """Whether an element says that it is not the page's text: by its name, or by a class, id or role made of the names of parts."""
    if name in ASIDE:
        return True
    if name in ("html", "body", "article", "main") and "omment" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            if not _NO_PART.match(token) and any(w in PARTS for w in words) and all(w in PARTS or w in BESIDE for w in words):
                return True
    return False


def _ended(stack: list[str], name: str) -> int:
    """How many open elements stay where a start tag ends others, by the rules for omitted end tags."""
    ends = _ENDS.get(name, frozenset())
    stay = len(stack)
    if not ends and name not in BLOCKS and name not in ASIDE or name in _INLINE:
        return stay
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == "p" or stack[k] in ends:
            stay = k
        elif stack[k] in BLOCKS and not (stack[k] in ("div", "address") and name in ("li", "dt", "dd")):
            break
    return stay


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class _Open:
    name: str
    part: int = 0  # number of the element if it states a part
    article: int = 0


def lines_of(page: str | None) -> list[Line]:
    """All text blocks of a page in order; white space inside a block is one space.

    An element that a class, id or form marks as a part but that holds most of the page's text wraps the content and
    marks nothing. Inside an article, parts around it that only a class or id names don't count (they were left
    open), nor do its own ``header``'s headings.
    """
    page = page or ""
    lines: list[Line] = []
    around: list[tuple[int, ...]] = []  # parts around each line
    stack: list[_Open] = []
    wraps: set[int] = set()  # parts that may wrap a page
    strong: set[int] = set()  # parts by the name of the element
    headers: set[int] = set()
    articles: dict[int, tuple[int, ...]] = {}  # parts around each article
    block: list[str] = []
    linked: list[str] = []
    count, link = 0, False
    at, end = 0, len(page)

    def close_block() -> None:
        if text := " ".join(html.unescape("".join(block)).split()):
            article = next((e.article for e in reversed(stack) if e.article), 0)
            heading = any(e.name in HEADINGS for e in stack)
            lines.append(Line(text, article, links=len(" ".join(html.unescape("".join(linked)).split())) * 5 >= len(text) * 4, heading=heading))
            around.append(tuple(e.part for e in stack if e.part))
        block.clear()
        linked.clear()

    def leave(size: int) -> None:
        if len(stack) > size:
            close_block()
            del stack[size:]

    while at < end:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else end]
        block.append(piece)
        if link:
            linked.append(piece)
        if m is None:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name, closing, attrs = m["name"].lower(), bool(m["close"]), m["attrs"]
        if name in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                shut = re.compile(rf"</{re.escape(name)}\s*>|<body\b" if name == "head" else rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end if shut is None else shut.start() if shut[0][1] != "/" else shut.end()
            continue
        if name == "a":
            link = not closing
        if closing:
            names = [e.name for e in stack]
            if name in BLOCKS:
                close_block()
            if name in names:
                leave(len(names) - 1 - names[::-1].index(name))
            continue
        leave(_ended([e.name for e in stack], name))
        states = name not in VOID and _states_part(name, attrs)
        if name in BLOCKS or states:
            close_block()
        if name in VOID or not (name in BLOCKS or name in ASIDE or states):
            continue
        opened = _Open(name)
        if states:
            count += 1
            opened.part = count
            if name == "header":
                headers.add(count)
            if name in _WRAPS or name not in ASIDE and not _NO_WRAP.search(attrs):
                wraps.add(count)
            if name in ASIDE and name not in _WRAPS:
                strong.add(count)
        elif name in ("article", "main"):
            count += 1
            opened.article = count
            articles[count] = tuple(e.part for e in stack if e.part)
        stack.append(opened)
    close_block()
    sizes: dict[int, int] = {}
    for line, parts in zip(lines, around, strict=True):
        for k in parts:
            sizes[k] = sizes.get(k, 0) + len(line.text)
    total = sum(len(x.text) for x in lines)
    spared = set() if articles else {k for k in wraps if 2 * sizes.get(k, 0) > total}
    clean = {k for k, parts in articles.items() if not parts}
    for line, parts in zip(lines, around, strict=True):
        outer = articles.get(line.article, ())
        left = [k for k in parts if k not in spared and not (k in outer and k not in strong and not clean)]
        # a heading in an article's own header is the article's
        line.aside = bool([k for k in left if not (line.heading and line.article and k in headers and k not in outer)])
    return lines


def common_lines(a: list, b: list) -> tuple[list[int], list[int]]:
    """Positions in ``a`` and ``b`` of a longest common subsequence, in rows of bits: |a| steps on numbers of |b| bits."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    x, y = a[first : len(a) - last], b[first : len(b) - last]
    masks: dict = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, []
    for v in x:  # a zero bit: the subsequence is one longer from here on
        u = row & masks.get(v, 0)
        row = (row + u | row - u) & full
        rows.append(row)
    i, j, of_a, of_b = len(x), len(y), [], []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            of_a.append(first + i)
            of_b.append(first + j)
    head = list(range(first))
    return (
        [*head, *reversed(of_a), *range(len(a) - last, len(a))],
        [*head, *reversed(of_b), *range(len(b) - last, len(b))],
    )


def sketch(text: str) -> list[int]:
    """The least hashes of a line's words, 31 bits each."""
    return sorted({xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 for w in text.split()})[:SKETCH]


def shared_lines(mine: dict, other: dict) -> list[int] | None:
    """Positions of a page's lines, outside articles, that another page shares; None if the two are copies.

    Both have ``lines`` (digests), ``chars``, ``inside``, ``aside`` and ``words`` (sketches). Whether pages are copies
    is judged by what is not a stated part, as adverts may differ between copies.
    """
    if set(mine["lines"]).isdisjoint(other["lines"]):
        return []
    at, their = common_lines(mine["lines"], other["lines"])
    sides = [(mine, set(at)), (other, set(their))]
    text = [sum(n for n, a in zip(x["chars"], x["aside"], strict=True) if not a) for x, _ in sides]
    both = [sum(x["chars"][k] for k in gone if not x["aside"][k]) for x, gone in sides]
    if any(b > MOST_SHARED * t for b, t in zip(both, text, strict=True)):
        a, b = ({w for k, ws in enumerate(x["words"]) if k not in gone and not x["aside"][k] for w in ws} for x, gone in sides)
        if not a or not b or len(a & b) >= MOST_AGREED * min(len(a), len(b)):
            return None
    return [k for k in at if not mine["inside"][k]]


def _path_start(a: str, b: str) -> int:
    """Segments that two paths have in common at their beginning."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def partners(pages: list[dict], i: int, most: int) -> tuple[dict[int, list[int]], bool]:
    """What page ``i`` shares with its partners, by their ``key``, and whether copies kept it from finding enough.

    ``pages`` are in the order of hosts and paths. At most ``most`` pages are looked at.
    """
    me, before, after, found, copies = pages[i], i - 1, i + 1, {}, False
    for _ in range(most):
        b = pages[before] if before >= 0 and pages[before]["host"] == me["host"] else None
        a = pages[after] if after < len(pages) and pages[after]["host"] == me["host"] else None
        if a is None and b is None or len(found) >= PARTNERS:
            break
        if b is None or a is not None and _path_start(me["path"], a["path"]) > _path_start(me["path"], b["path"]):
            other, after = a, after + 1
        else:
            other, before = b, before - 1
        t = shared_lines(me, other)
        copies |= t is None
        if t:
            found[other["key"]] = t
    return found, copies and len(found) < AGREEING


def template_of(found: Collection[list[int]]) -> list[int]:
    """Lines shared with enough partners."""
    met = Counter(k for t in found for k in set(t))
    need = min(AGREEING, len(found))
    return sorted(k for k, n in met.items() if n >= need)


def text_lines(lines: list[Line], template: set[int]) -> list[int]:
    """Positions of the lines that differencing and the parts of the page leave."""
    left = [k for k, x in enumerate(lines) if k not in template and not x.aside]
    held = [k for k in left if lines[k].article]
    if not held:
        return [k for k in left if not lines[k].links or lines[k].heading]
    sizes: dict[int, int] = {}
    heads: dict[int, Line] = {}
    for k in held:
        x = lines[k]
        sizes[x.article] = sizes.get(x.article, 0) + len(x.text)
        if x.heading:
            heads.setdefault(x.article, x)
    largest = max(sizes, key=lambda a: (sizes[a], -a))
    return [k for k in held if lines[k].article == largest or not (lines[k].article in heads and heads[lines[k].article].links)]


def main_text(lines: list[Line], template: set[int]) -> str:
    return " ".join(lines[k].text for k in text_lines(lines, template))


def flags(lines: list[Line]) -> list[int]:
    """Per line its characters and, in the last three bits, whether it is inside an article, in a stated part, and left where there is no template."""
    live = set(text_lines(lines, set()))
    return [min(len(x.text), 1 << 27) << 3 | (k in live) << 2 | x.aside << 1 | bool(x.article) for k, x in enumerate(lines)]


_STORED = ["lines", "sizes", "words"]
_ARRAYS = "lines array<bigint>, sizes array<int>, words array<array<int>>"
_KINDS = {"key": pa.int64(), "host": pa.string(), "path": pa.string(), "lines": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "words": pa.list_(pa.list_(pa.int32()))}
_FOUND = {"partners": pa.list_(pa.int64()), "found": pa.list_(pa.list_(pa.int32())), "template": pa.list_(pa.int32()), "done": pa.bool_()}
_ANSWER = "key bigint, host string, partners array<bigint>, found array<array<int>>, template array<int>, done boolean"
#: Answers, and pages near an edge of a range, which the second pass answers with both sides in sight.
_OUT = {"key": _KINDS["key"], "host": _KINDS["host"], **_FOUND, "edge": pa.int32(), "near": pa.bool_(), "side": pa.int32(), "nth": pa.int32(), **{k: _KINDS[k] for k in ("path", *_STORED)}}


def _as_pages(rows: list[dict]) -> list[dict]:
    for r in rows:
        r["inside"], r["aside"] = [bool(n & 1) for n in r["sizes"]], [bool(n & 2) for n in r["sizes"]]
        r["live"], r["chars"] = [bool(n & 4) for n in r["sizes"]], [n >> 3 for n in r["sizes"]]
    return rows


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def _answer(r: dict, found: dict, done: bool) -> dict:
    """What was found for a page; of the template, the lines that the parts of the page don't delete anyway."""
    template = [k for k in template_of(found.values()) if r["live"][k]]
    return {"key": r["key"], "host": r["host"], "partners": [] if done else list(found), "found": [] if done else list(found.values()), "template": template, "done": done}


def _inside_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of pages in order: those with HALO pages on either side are answered, the others passed on to its two edges."""
    part, pages = TaskContext.get().partitionId(), []
    for batch in batches:
        for piece in slices(batch):
            for r in piece.to_pylist():
                if not pages or pages[-1]["key"] != r["key"]:  # repeated rows
                    pages.append(r)
    _as_pages(pages)
    n, made = len(pages), []
    for i, r in enumerate(pages):
        first, last = i < HALO, i >= n - HALO
        if i < 2 * HALO:
            made.append({**r, "edge": part, "near": first, "side": 1, "nth": i})
        if i >= n - 2 * HALO:
            made.append({**r, "edge": part + 1, "near": last and not first, "side": 0, "nth": i})
        if not first and not last:
            found, kept_off = partners(pages, i, 2 * HALO)
            made.append(_answer(r, found, not kept_off))
        if len(made) >= 512:
            yield _batch(made, _OUT)
            made = []
    yield _batch(made, _OUT)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages around each edge, in order."""
    answers = {k: t for k, t in _OUT.items() if k in ("key", "host", *_FOUND)}

    def flush(pages: list[dict]) -> pa.RecordBatch:
        _as_pages(pages)
        made = []
        for i, r in enumerate(pages):
            if r["near"]:
                found, kept_off = partners(pages, i, 2 * HALO)
                made.append(_answer(r, found, not kept_off))
        return _batch(made, answers)

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[-1]["edge"] != r["edge"]:
                yield flush(held)
                held = []
            held.append(r)
    if held:
        yield flush(held)


def _with_unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages that copies kept from finding partners, each with some unlike pages of its host."""
    for batch in batches:
        for part in slices(batch, 64):
            made = []
            for r in _as_pages(part.to_pylist()):
                found = dict(zip(r["partners"], r["found"], strict=True))
                for other in sorted(_as_pages(r["pages"]), key=lambda p: -_path_start(r["path"], p["path"])):
                    if len(found) < PARTNERS and other["key"] not in (r["key"], *found) and (t := shared_lines(r, other)):
                        found[other["key"]] = t
                made.append(_answer(r, found, True))
            yield _batch(made, {"key": _KINDS["key"], "host": _KINDS["host"], **_FOUND})


def templates(digests: DataFrame) -> DataFrame:
    """``key, template``: of the lines that a page's parts leave, those that are its host's template; a row a key or none.

    ``digests``: ``key, host, path, lines, sizes, words``, a row a page, written. Pages are dealt by ranges of host and
    path, so a host of any size is spread over tasks, and searched in order; the pages at the edges of ranges are
    searched once more with both sides in sight. Pages that copies keep from finding partners in reach (long runs of
    copies) are also compared with six pages of the host that are as unlike as can be: the first and last by
    path, of the fewest and most lines, of the least and greatest first word hash.
    """
    ranges = max(1, digests.count() // SORT_ROWS)
    order = ["host", "path", "key", F.monotonically_increasing_id()]  # the last deals rows that repeat
    sorted_ = digests.repartitionByRange(ranges, *order).sortWithinPartitions("host", "path", "key")
    arrays = f"edge int, near boolean, side int, nth int, path string, {_ARRAYS}"
    first = saved(sorted_.mapInArrow(_inside_ranges, f"{_ANSWER}, {arrays}"))
    edges = first.where("edge is not null").select("key", "host", "path", *_STORED, "edge", "near", "side", "nth").repartition("edge").sortWithinPartitions("edge", "side", "nth")
    answers = saved(first.where("edge is null").select("key", "host", *_FOUND).unionByName(edges.mapInArrow(_at_edges, _ANSWER)))
    left = answers.where("not done")
    every = answers.where("done")
    hosts = left.groupBy("host").agg(F.count("*").alias("n_rows"))
    if not left.isEmpty():
        word = F.coalesce(F.array_min(F.flatten("words")), F.lit(0))
        keys = [pick(F.struct(by.alias("by"), F.col("key"))) for by in (F.col("path"), F.size("lines"), word) for pick in (F.min, F.max)]
        chosen = digests.join(saved(hosts.select("host")), "host").groupBy("host").agg(F.array_distinct(F.transform(F.array(*[k["key"] for k in keys]), lambda k: k)).alias("keys"))
        chosen = saved(chosen.select(F.explode("keys").alias("key")).distinct())
        unlike = digests.join(chosen, "key").groupBy("host").agg(F.array_distinct(F.collect_list(F.struct("key", "path", *_STORED))).alias("pages")).join(hosts, "host")
        open_ = spread_join(left.select("key", "partners", "found", "host"), saved(unlike), "host", "key").join(digests.select("key", "path", *_STORED), "key")
        every = every.unionByName(open_.mapInArrow(_with_unlike, _ANSWER))
    return every.where("size(template) > 0").groupBy("key").agg(F.min("template").alias("template"))


def extract(pages: DataFrame, differencing: bool = True) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A null html counts as empty and gives an empty text. Pages without a url or without a different page on their
    host are not differenced. Equal rows are treated alike; an empty table gives an empty result. Other columns,
    whatever their names, are not read. ``differencing``: False leaves steps 2 and 3 out, to show what they do.
    """
    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    url = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")

    def digest(x: dict) -> dict:
        found = [lines_of(p) for p in x["html"]]
        return {
            "key": x["key"], "host": x["host"], "path": x["path"],
            "lines": [[xxhash.xxh64_intdigest(v.text.encode("utf-8", "surrogatepass")) >> 1 for v in f] for f in found],
            "sizes": [flags(f) for f in found],
            "words": [[sketch(v.text) for v in f] for f in found],
        }

    kinds = f"key bigint, host string, path string, {_ARRAYS}"

    def finish(x: dict) -> dict:
        texts = [main_text(lines_of(p), set(t or [])) for p, t in zip(x["html"], x["template"], strict=True)]
        return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    merged = rows.withColumn("template", F.lit(None).cast("array<int>"))
    if differencing:
        placed = rows.select("key", url.alias("host"), path.alias("path"), "html").where("host <> ''")
        digests = saved(placed.mapInArrow(by_slices(digest, pa.schema(list(_KINDS.items()))), kinds))
        # one row a key, written first so that Spark sees its size
        merged = rows.join(saved(templates(digests)), "key", "left")
    return merged.select("page_id", "url", "html", "template").mapInArrow(by_slices(finish, out), "page_id bigint, url string, text string, n_chars bigint")
