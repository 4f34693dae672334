"""Main text of web pages by wrappers, union-free regular expressions of token streams.

A page becomes a stream of tags and text slots. The different streams of all
pages of a host are aligned one after another: repeats are folded into X+,
what one side lacks becomes an optional group X?, and texts become slots. The
result, the host's wrapper, has no alternatives and accepts every page of the
host. Each page is matched against it, so that each of its texts has a
position in the wrapper, and only texts of content positions come out. A
position is none if the elements around it say that it is a menu, a footer, an
advert and the like, if it is outside the article of a page that has one, or if
its texts are the same on all pages that have it, three different pages at
least: then it is the host's boilerplate, in an article or out of it. A block
is left out when all its texts are boilerplate. A page of which nothing would
stay keeps its boilerplate.

Streams and texts of every page count, whatever the host's size. Pages count
as different by their texts outside menus, footers and adverts. Null and empty
pages have empty text. Null urls share one host, the empty one. Repeated rows
give equal rows, and rows that repeat a page_id with other html each their own;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastleg.llm.common import Written, map_batches, to_batch

#: Characters of wrappers up to which they are broadcast; beyond it they are joined by shuffles.
BROADCAST_CHARS = 8_000_000
#: Different pages that a position must have before equal texts make it boilerplate.
LEAST_PAGES = 3
#: Streams of a host that one task aligns, on average.
GROUP = 32
#: Entries that a worker's tables may hold before they are emptied or passed on.
HELD = 20_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form script style noscript template button select option textarea iframe svg title dialog menu object embed canvas audio video label input".split())
#: Of the dropped elements, those that are no part of an article that they hold: a form may wrap a whole page.
AROUND = frozenset("head nav footer aside script style noscript template".split())
#: Words before one of the next that turn its meaning round, as in "no-sidebar" or "layout-with-sidebar".
TURNING = frozenset("has have no not with without hide hidden show is".split())
ARTICLE_NAMES = frozenset("main article articlebody article-body".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def _signature(name: str, attrs: str) -> str:
    """The element's name with its classes, id and role, each as its words of letters joined by hyphens."""
    found = set()
    for key, x, y, z in ATTRIBUTE.findall(attrs) if attrs else ():
        for token in (x or y or z).lower().split():
            if words := [w for w in re.split(r"[^a-z]+", token) if w]:
                found.add(("#" if key.lower() == "id" else ".") + "-".join(words))
    return name + "".join(sorted(found))


def _name(signature: str) -> str:
    return re.split(r"[.#]", signature, maxsplit=1)[0]


def tokens_of(page: str) -> list[tuple[str, str, str]]:
    """(kind, value, path): kind is "open", "close", "text" or "gap"; path lists the open elements."""
    stack: list[str] = []
    names: list[str] = []
    out: list[tuple[str, str, str]] = []

    def close(upto: int) -> None:
        while len(stack) > upto:
            out.append(("close", names[-1], "/".join(stack)))
            stack.pop()
            names.pop()

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            out.append(("text", text, "/".join(stack)))
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                if name in names:
                    close(len(names) - 1 - names[::-1].index(name))
            elif name in VOID:
                out.append(("open" if name in BLOCK else "gap", name, "/".join(stack)))
            else:
                for k in range(len(names) - 1, -1, -1):
                    if name in CLOSED_BY.get(names[k], ()):
                        close(k)
                        break
                    if names[k] in BLOCK and names[k] not in ("p",):
                        break
                stack.append(_signature(name, m["attrs"]))
                names.append(name)
                out.append(("open", name, "/".join(stack)))
    close(0)
    return out


# -- wrapper inference -------------------------------------------------------


def stream_of(tokens: list[tuple[str, str, str]]) -> tuple[list, list[int]]:
    """Symbols of a page: "+tag", "-tag", and ("#", path) for a slot that holds text; and each token's slot in them, or -1."""
    out: list = []
    places: list[int] = []
    for kind, value, path in tokens:
        place = -1
        if kind == "text":
            if value.strip():
                if not out or out[-1] != ("#", path):
                    out.append(("#", path))
                place = len(out) - 1
        elif kind != "gap":
            out.append(("+" if kind == "open" else "-") + path.rpartition("/")[2])
        places.append(place)
    return out, places


def fold(symbols: list) -> list:
    """Replace X X ... X by X+, the shortest X first, until nothing repeats."""
    changed = True
    while changed:
        changed = False
        for width in range(1, min(24, len(symbols) // 2) + 1):
            out, at = [], 0
            while at < len(symbols):
                piece, end = symbols[at : at + width], at + width
                while symbols[end : end + width] == piece and len(piece) == width:
                    end += width
                if end > at + width or (width == 1 and isinstance(piece[0], tuple) and piece[0][0] == "+"):
                    if end > at + width:
                        out.append(piece[0] if width == 1 and isinstance(piece[0], tuple) and piece[0][0] == "+" else ("+", tuple(piece)))
                        changed = True
                    else:
                        out.append(piece[0])
                    at = end
                else:
                    out.append(symbols[at])
                    at += 1
            symbols = out
            # X+ followed or led by a plain X is still X+
            k = 0
            while k < len(symbols):
                s = symbols[k]
                if isinstance(s, tuple) and s[0] == "+":
                    inner = list(s[1])
                    if symbols[k + 1 : k + 1 + len(inner)] == inner:
                        del symbols[k + 1 : k + 1 + len(inner)]
                        changed = True
                        continue
                    if k >= len(inner) and symbols[k - len(inner) : k] == inner:
                        del symbols[k - len(inner) : k]
                        k -= len(inner)
                        changed = True
                k += 1
    return symbols


def _parts(symbol) -> tuple:
    """(X, optional, repeated) of X, X?, X+ and their nestings."""
    optional = repeated = False
    while isinstance(symbol, tuple) and symbol[0] != "#" and len(symbol[1]) == 1:
        optional, repeated, symbol = optional or symbol[0] == "?", repeated or symbol[0] == "+", symbol[1][0]
    return symbol, optional, repeated


def _lift(symbols: list, other: list) -> list:
    """``symbols`` with X Y replaced by (X Y)+ where ``other`` has that."""
    for group in sorted({x for x in (_parts(s)[0] for s in other) if isinstance(x, tuple) and x[0] == "+"}, key=lambda x: (-len(x[1]), repr(x))):
        inner, out, at = list(group[1]), [], 0
        while at < len(symbols):
            if symbols[at] == inner[0] and symbols[at : at + len(inner)] == inner:
                if not out or out[-1] != group:
                    out.append(group)
                at += len(inner)
            else:
                out.append(symbols[at])
                at += 1
        symbols = out
    return symbols


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, by the bits of the rows of its table."""
    at: dict = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    mask = (1 << len(b)) - 1
    row, rows = mask, []
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & mask
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def align(wrapper: list, sample: list) -> list:
    """The least wrapper for both: common parts stay, mismatches become optional or repeated groups."""
    wrapper, sample = _lift(wrapper, sample), _lift(sample, wrapper)
    a, b = [_parts(x) for x in wrapper], [_parts(x) for x in sample]
    out, i, j = [], 0, 0

    def put(core, optional: bool, repeated: bool) -> None:
        core = ("+", (core,)) if repeated and not (isinstance(core, tuple) and core[0] == "+") else core
        out.append(("?", (core,)) if optional else core)

    for x, y in [*common([p[0] for p in a], [p[0] for p in b]), (len(a), len(b))]:
        for core, _, repeated in a[i:x] + b[j:y]:
            put(core, True, repeated)
        if x < len(a):
            put(a[x][0], a[x][1] or b[y][1], a[x][2] or b[y][2])
        i, j = x + 1, y + 1
    return fold(out)


def merge(streams: list[str]) -> str:
    """The wrapper of streams or wrappers, all as JSON; their order doesn't matter."""
    wrapper: list | None = None
    for text in sorted(set(streams), key=lambda t: (len(t), t)):
        stream = read(text)
        wrapper = stream if wrapper is None else align(wrapper, stream)
    return written(wrapper or [])


def written(symbols: list) -> str:
    return json.dumps(symbols, ensure_ascii=False, separators=(",", ":"))


def read(text: str) -> list:
    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list) else x

    return list(map(tuples, json.loads(text)))


class Matcher:
    """Positions of a page's symbols in a wrapper: its automaton, entering groups rather than passing them by."""

    def __init__(self, wrapper: list):
        self.symbol: list = []
        self.out: list[list[int]] = []
        self.met: dict[tuple, list[int]] = {}
        self.start = self._build(wrapper, self._node("", []))
        paths = {s[1] for s in self.symbol if isinstance(s, tuple)}
        by_path = {p: (not dropped_by_path(p), in_article(p)) for p in paths}
        #: For each position that holds text: whether it may be main text, and whether it is in an article.
        self.role = [by_path[s[1]] if isinstance(s, tuple) else (False, False) for s in self.symbol]

    def _node(self, symbol, out: list[int]) -> int:
        self.symbol.append(symbol)
        self.out.append(out)
        return len(self.out) - 1

    def _build(self, symbols, after: int) -> int:
        for s in reversed(symbols):
            if not isinstance(s, tuple) or s[0] == "#":
                after = self._node(s, [after])
            elif s[0] == "?":
                after = self._node(None, [self._build(s[1], after), after])
            else:
                again = self._node(None, [])
                entry = self._build(s[1], again)
                self.out[again] += [entry, after]
                after = entry
        return after

    def _next(self, node: int, symbol) -> list[int]:
        key = (node, symbol)
        if key not in self.met:
            if len(self.met) >= HELD:
                self.met.clear()
            stack, seen, found = [node], set(), []
            while stack:
                n = stack.pop()
                if n not in seen:
                    seen.add(n)
                    if self.symbol[n] is None:
                        stack += self.out[n][::-1]
                    elif self.symbol[n] == symbol:
                        found.append(n)
            self.met[key] = found
        return self.met[key]

    def accepted(self, symbols: list) -> list[int]:
        at = self.positions(symbols)
        if at is None:
            raise ValueError("a wrapper doesn't accept a page that it was made from")
        return at

    def positions(self, symbols: list) -> list[int] | None:
        """A position for each symbol; None if the wrapper doesn't accept them."""
        now, steps = [-1], []
        for s in symbols:
            step: dict[int, int] = {}
            for n in now:
                for m in self._next(self.out[n][0] if n >= 0 else self.start, s):
                    step.setdefault(m, n)
            steps.append(step)
            now = list(step)
        last = [n for n in now if self._next(self.out[n][0] if n >= 0 else self.start, "")]
        if not last:
            return None
        out, n = [], last[0]
        for step in reversed(steps):
            out.append(n)
            n = step[n]
        return out[::-1]


def _telltale(token: str, inside: bool) -> bool:
    """Whether a class, id or role names a part that is no main text; in an article, its header is part of it."""
    turned = False
    for word in token.split("-"):
        turned = turned or word in TURNING
        if word in DROPPED_WORDS and not turned and not (inside and word == "header"):
            return True
    return False


def dropped_by_path(path: str) -> bool:
    """Whether an element on the path is no main text by its name, class, id or role.

    An element that holds an article (or main) isn't dropped by class, id or
    role, nor is the article itself.
    """
    elements = [re.split(r"[.#]", s) for s in path.split("/")]
    last = max((k for k, e in enumerate(elements) if e[0] in ("article", "main")), default=-1)
    inside = False
    for k, (name, *tokens) in enumerate(elements):
        if name in (AROUND if k < last else DROPPED) or (name == "header" and not inside and k > last):
            return True
        if k > last and name not in ("html", "body") and any(_telltale(t, inside) for t in tokens):
            return True
        inside = inside or name in ("article", "main")
    return False


def in_article(path: str) -> bool:
    return any(name in ("article", "main") or not ARTICLE_NAMES.isdisjoint(tokens) for name, *tokens in (re.split(r"[.#]", s) for s in path.split("/")))


def texts_by_position(page: str, matcher: Matcher) -> dict[int, str]:
    """What a page has at each position of its host's wrapper that may be main text."""
    tokens = tokens_of(page)
    symbols, places = stream_of(tokens)
    at = matcher.accepted(symbols)
    found: dict[int, list[str]] = {}
    for (_, value, _), place in zip(tokens, places, strict=True):
        if place >= 0 and matcher.role[at[place]][0]:
            found.setdefault(at[place], []).append(" ".join(value.split()))
    return {n: "\x1f".join(v) for n, v in found.items()}


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Tally:
    """For each host and position: least and greatest hash of its text, and the least hashes of different pages, as many as matter."""

    def __init__(self):
        self.rows: dict[tuple[str, int], tuple[int, int, list[int]]] = {}

    def add(self, host: str, texts: dict[int, str]) -> None:
        page = _hash("\x1e".join(t for _, t in sorted(texts.items())))
        for n, text in texts.items():
            value = _hash(text)
            low, high, pages = self.rows.get((host, n), (value, value, []))
            if page not in pages:
                pages = sorted([*pages, page])[:LEAST_PAGES]
            self.rows[host, n] = (min(low, value), max(high, value), pages)


def infer(pages: list[str]) -> dict:
    """The wrapper of one host's pages, its boilerplate positions, and the expression."""
    wrapper = read(merge([written(fold(stream_of(tokens_of(p))[0])) for p in pages if p]))
    matcher, tally = Matcher(wrapper), Tally()
    for p in pages:
        tally.add("", texts_by_position(p, matcher))
    constant = {n for (_, n), (low, high, different) in tally.rows.items() if low == high and len(different) >= LEAST_PAGES}
    return {"wrapper": wrapper, "constant": constant, "expression": render(wrapper)}


def render(wrapper) -> str:
    out = []
    for s in wrapper:
        if isinstance(s, str):
            out.append(f"<{'/' if s[0] == '-' else ''}{s[1:]}>")
        elif s[0] == "#":
            out.append("#")
        else:
            out.append(f"({render(s[1])}){s[0]}")
    return "".join(out)


def main_text(page: str, matcher: Matcher, constant: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the wrapper's content positions, in page order, joined by an empty line."""
    tokens = tokens_of(page)
    symbols, places = stream_of(tokens)
    at = matcher.accepted(symbols)
    roles = [matcher.role[at[k]] if k >= 0 else (False, False) for k in places]
    any_article = (True, True) in roles
    blocks: list[tuple[str, bool]] = []
    now: list[str] = []
    own = False  # whether the block has a text that isn't boilerplate

    def end() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            blocks.append((text, own))
        now.clear()

    for (kind, value, _), place, role in zip(tokens, places, roles, strict=True):
        if kind == "text":
            if place < 0:
                now.append(" ")  # white space between two elements
            elif role[0] and (role[1] or not any_article):
                now.append(value)
                own = own or at[place] not in constant
        elif kind == "gap":
            now.append(" ")
        elif value in BLOCK:
            end()
            own = False
    end()
    return "\n\n".join([t for t, other in blocks if other] or [t for t, _ in blocks])


# -- Spark -------------------------------------------------------------------


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


_matchers: dict[str, Matcher] = {}


def matcher_of(wrapper: str) -> Matcher:
    """One automaton for each worker and wrapper, a bounded number of them."""
    if wrapper not in _matchers:
        if len(_matchers) >= 200:
            _matchers.clear()
        _matchers[wrapper] = Matcher(read(wrapper))
    return _matchers[wrapper]


def wrappers(pages: DataFrame, work: Written) -> DataFrame:
    """(host, wrapper): the wrapper of all pages of each host, as JSON.

    A host's different streams are merged in groups of about ``GROUP``, and
    the results again, until one is left: no task holds a host.
    """
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T.StructType.fromDDL("host string, stream string"))

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded: dict[tuple, str] = {}
        met: set[tuple[str, str]] = set()
        for batch in batches:
            new = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                symbols = tuple(stream_of(tokens_of(page or ""))[0])
                if not symbols:
                    continue
                if len(folded) >= HELD:
                    folded.clear()
                if symbols not in folded:
                    folded[symbols] = written(fold(list(symbols)))
                key = (host, folded[symbols])
                if key not in met:
                    if len(met) >= HELD:
                        met.clear()
                    met.add(key)
                    new.append(key)
            yield to_batch({"host": [h for h, _ in new], "stream": [t for _, t in new]}, target)

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"host": [table["host"][0].as_py()], "stream": [merge(table["stream"].to_pylist())]})

    left = work.table(pages.select("host", "html").mapInArrow(streams, "host string, stream string").distinct(), "streams")
    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 1
        if most == 1:
            return left.withColumnRenamed("stream", "wrapper")
        # hosts with one stream are done; the others are few against the pages
        parts = left.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("n") / GROUP)))
        left = work.table(parts.groupBy("host", "part").applyInArrow(merged, "host string, stream string").distinct(), "streams")


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, constant): positions of boilerplate from every row of (host, wrapper, html); hosts without any are absent."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = "host string, position int, low bigint, high bigint, pages array<bigint>"
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def out() -> pa.RecordBatch:
            rows = [(h, n, *v) for (h, n), v in tally.rows.items()]
            tally.rows.clear()
            return to_batch({f.name: [r[k] for r in rows] for k, f in enumerate(target)}, target)

        for batch in batches:
            for host, wrapper, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if page and wrapper:
                    tally.add(host, texts_by_position(page, matcher_of(wrapper)))
                if len(tally.rows) >= HELD:
                    yield out()
        yield out()

    rows = pages.select("host", "wrapper", "html").mapInArrow(count, schema)
    # a task gives a position few rows, so lists are as long as there are tasks
    seen = rows.groupBy("host", "position").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("n"))
    return seen.where((F.col("low") == F.col("high")) & (F.col("n") >= LEAST_PAGES)).groupBy("host").agg(F.sort_array(F.collect_list("position")).alias("constant"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    work = Written(pages.sparkSession)
    made = work.table(wrappers(plain, work), "wrappers")
    few = (made.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS

    def with_wrappers(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table) if few else table, "host", "left")

    made = work.table(made.join(boilerplate(with_wrappers(plain, made)), "host", "left"), "roles")
    work.drop(keep=1)

    def run(batch: pa.RecordBatch):
        texts = []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("html", "wrapper", "constant"))
        for page, wrapper, constant in zip(*columns, strict=True):
            # a host without a wrapper has only empty pages
            texts.append(main_text(page, matcher_of(wrapper), frozenset(constant or ())) if page and wrapper else "")
        yield {"page_id": batch.column(batch.schema.get_field_index("page_id")), "url": batch.column(batch.schema.get_field_index("url")), "text": texts, "n_chars": [len(t) for t in texts]}

    joined = with_wrappers(plain, made).select("page_id", "url", "html", "wrapper", "constant")
    return map_batches(joined, run, "page_id bigint, url string, text string, n_chars bigint", rows=500)
