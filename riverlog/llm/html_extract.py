"""Main texts of web pages, with the template of each host deduced from its pages.

A page is read into blocks, each with the path of its open elements.  What the
elements themselves name as menus, headers, footers, sidebars, notices, adverts,
forms or comments is left out; what is left, with the page's tags, are tokens in
page order: a path, or a path and the text of a block.  Tokens that occur equally
often on the same pages of a host have one occurrence vector and are an
equivalence class, if it is on nearly all of the host's pages, has two tokens or
more, and one of them is a tag.

A class is ordered if on every page its tokens come in one order, again and again;
tokens that break it are taken out of the class.  Classes are nested if their spans
(first to last token) do not cross, and those of one class all stand after the same
tokens of the classes around it; a class that is not, of two that cross the one on
fewer pages or of fewer tokens, is no valid one.  A valid class tells the roles of
other tokens apart: one between its second and third token is another token than
the same one after its end.  With the roles the classes are sought again, until a
round finds the same ones.  Valid classes are the host's template: text of theirs
is dropped, and what stands between their tokens is the page's own text.

A vector is compared by a sum of hashes of (page, count) over the pages, which
adds up in parts, so no host's pages are ever gathered, however many it has; the
order sought of a class is that of its tokens' places, added up likewise.  Roles
are not kept but made again on each page from the valid classes of the rounds.
A role is on no more pages than its token, so only tokens on nearly all pages
enter the rounds, and only hosts that have such a text; pages with one sequence of
these tokens are read as one there.  What a host's classes hold
is no more than 1 / ``LEAST_SHARE`` times the tokens of its average page.
Pages of the same text count as one, so an article copied within a host does not
become its template.

Results for odd input: a null or empty html gives an empty text; hosts of fewer
than ``LEAST_PAGES`` different pages, and pages without a host, have no deduced
template; repeated rows are each returned; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import written

LEAST_PAGES = 5
LEAST_SHARE = 0.8
LEAST_TOKENS = 2
# Parts that a host's pages are dealt into when they meet its template.
SALTS = 64
# Pages read at a time.
SLICE_ROWS = 256
# Hosts whose classes a task holds at a time.
HELD_HOSTS = 256
# The host in a url, with or without a scheme and a user.
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul video audio".split()
)
UNSEEN = frozenset("head title script style noscript template iframe object canvas svg math".split())
ASIDE = frozenset("nav header footer aside form menu dialog button select textarea fieldset label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of a class or id that name something beside the article.
NAMED = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "sidebar side aside rail menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar toolbar footer "
    "bottombar colophon copyright legal comment comments reply replies respond disqus discussion share sharing social "
    "related recommended recommendations widget widgets search pagination pager skip hidden".split()
)
WHOLE = frozenset("html body main article".split())
# Elements that end at the start of another one, by what starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(frozen=True)
class _Open:
    """An open element: the path of blocks down to it, as a hash, and whether it
    is left out, in the article, in a link."""

    tag: str
    path: int
    out: bool
    article: bool
    linked: bool


class _Page(HTMLParser):
    """Blocks of a page: (path, text, inside the article, share of linked text, place)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.count: Counter[str] = Counter()  # open elements by tag
        self.tokens: list[int | None] = []  # of tags in page order, None where a block begins
        self.blocks: list[tuple[int, str, bool, float, int]] = []
        self._parts: list[str] = []
        self._linked = 0
        self._top = _Open("", 0, False, False, False)
        self._at = self._top
        self._place = 0

    def _state(self) -> _Open:
        return self.open[-1] if self.open else self._top

    def flush(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append((self._at.path, text, self._at.article, self._linked / len(text), self._place))
        self._parts, self._linked = [], 0

    def _cut(self, depth: int) -> None:
        self.count.subtract(element.tag for element in self.open[depth:])
        del self.open[depth:]

    def _add(self, text: str) -> None:
        """Text of the block that is open; its place is where it begins."""
        state = self._state()
        if state.out:
            return
        if not self._parts:
            self._at, self._place = state, len(self.tokens)
            self.tokens.append(None)
        self._parts.append(text)
        if state.linked:
            self._linked += len(text.strip())

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self.flush()
            if any(element.tag == "p" for element in self.open[-3:]) and tag not in ("option",):
                self._close("p")
        for other in ENDS.get(tag, ()):
            if any(element.tag == other for element in self.open[-4:]):
                self._close(other)
        if tag == "br":
            self._add(" ")
        above = self._state()
        if tag in VOID:
            self.tokens.append(_hash(f"{above.path}/{tag}") | 1)
            return
        out, article = above.out, above.article
        named = dict(attrs)
        words = set(re.findall(r"[a-z]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower()))
        if tag in UNSEEN or (tag in ASIDE and not (tag == "header" and article)):
            out = True
        elif tag not in WHOLE and (words & NAMED or (named.get("role") or "").lower() in ROLES):
            out = True
        elif tag == "article" and words & {"comment", "comments", "reply"}:
            out = True
        if "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", ""):
            out = True
        if not out and (tag in ("article", "main") or (named.get("role") or "").lower() == "main"):
            article = True
        name = tag if tag in BLOCKS else ""
        if name and words:
            name += "." + ".".join(sorted(words))
        path = _hash(f"{above.path}/{name}") if name else above.path
        self.open.append(_Open(tag, path, out, article, above.linked or tag == "a"))
        self.count[tag] += 1
        self.tokens.append((path if name else _hash(f"{path}/{tag}")) | 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            if self.open[i].tag in ("article", "table", "ul", "ol", "body") and tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.count[tag] > 0:
            depth = len(self.open) - 1
            while self.open[depth].tag != tag:
                depth -= 1
            self._cut(depth)

    def handle_data(self, data: str) -> None:
        self._add(data)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def read_page(html: str) -> tuple[list[tuple[int, str]], list[int]]:
    """(token, text) of the blocks that may be main text, and the page's tokens in page order.

    Tokens of tags are odd and those of texts even, one a block; token 1 is the page itself.
    """
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    blocks = [b for b in page.blocks if b[2]]
    if not blocks:  # no article is marked: all but lists of links
        blocks = [b for b in page.blocks if b[3] < 0.8]
    kept = []
    for path, text, _, _, place in blocks:
        page.tokens[place] = token = _hash(f"{path}\0{text}") & ~1
        kept.append((token, text))
    return kept, [1, *(token for token in page.tokens if token is not None)]


class Classes:
    """Classes of a host, strongest first, each as its roles in order; per role the
    number of its class and its own number in that."""

    def __init__(self, classes: list[list[int]]) -> None:
        self.classes = classes
        self.member = {role: (c, i) for c, roles in enumerate(classes) for i, role in enumerate(roles)}


def roles(tokens: list[int], rounds: list[Classes]) -> list[int]:
    """The tokens of a page as the roles that the valid classes of the rounds tell apart.

    A token of no class gets its role from the innermost span that it stands in and
    the last token before it there.
    """
    for known in rounds:
        classes, member, out, spans, opened = known.classes, known.member, [], [], set()
        for token in tokens:
            if token not in member:
                c, i = spans[-1] if spans else (None, 0)
                out.append(token if c is None else _hash(f"{token}/{classes[c][0]}/{i}") & ~1 | token & 1)
                continue
            c, i = member[token]
            while c in opened:
                opened.discard(spans.pop()[0])
            if i + 1 < len(classes[c]):
                spans.append((c, i))
                opened.add(c)
            out.append(token)
        tokens = out
    return tokens


def _out_of_order(wanted: list[int]) -> Iterator[int]:
    """Which places a longest increasing subsequence leaves out."""
    ends, at, before = [], [], []
    for place, value in enumerate(wanted):
        k = bisect_left(ends, value)
        before.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(value)
            at.append(place)
        else:
            ends[k], at[k] = value, place
    kept, place = set(), at[-1] if at else -1
    while place >= 0:
        kept.add(place)
        place = before[place]
    return (place for place in range(len(wanted)) if place not in kept)


def violations(tokens: list[int], known: Classes) -> tuple[set[int], set[int], dict[int, set[int]]]:
    """Of a page's roles: those out of the order of their class; the numbers of classes
    that cross a stronger one (they come strongest first); per class the spans and
    places around its own spans, as hashes."""
    classes, member = known.classes, known.member
    tokens = [token for token in tokens if token in member]
    seen: Counter[int] = Counter()
    own: dict[int, list[tuple[int, int]]] = {}
    for token in tokens:
        c, i = member[token]
        own.setdefault(c, []).append((seen[token] * len(classes[c]) + i, token))
        seen[token] += 1
    moved = {found[place][1] for found in own.values() for place in _out_of_order([value for value, _ in found])}
    last = {c: max((i for i, role in enumerate(classes[c]) if role not in moved), default=0) for c in own}

    crossed: set[int] = set()
    around: dict[int, set[int]] = {}
    spans: list[tuple[int, int]] = []
    opened: set[int] = set()
    for token in tokens:
        c, i = member[token]
        if token in moved or c in crossed:
            continue
        if c in opened:
            while spans[-1][0] != c and c not in crossed:
                weaker = max(c, spans[-1][0])
                crossed.add(weaker)
                spans = [span for span in spans if span[0] != weaker]
            if c in crossed:
                continue
            spans.pop()
            opened.discard(c)
        else:
            around.setdefault(c, set()).add(_hash("/".join(f"{classes[other][0]}.{k}" for other, k in spans)))
        if i < last[c]:
            spans.append((c, i))
            opened.add(c)
    return moved, crossed, around


_READ = (
    "page_id bigint, url string, host string, salt int, page bigint, content bigint, tokens array<bigint>, "
    "blocks array<string>"
)
_READ_TYPE = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("host", pa.string()),
        ("salt", pa.int32()),
        ("page", pa.int64()),
        ("content", pa.int64()),
        ("tokens", pa.list_(pa.int64())),
        ("blocks", pa.list_(pa.string())),
    ]
)
_OFTEN = pa.schema([("host", pa.string()), ("tokens", pa.list_(pa.int64()))])
_ROLES = pa.schema([("host", pa.string()), ("page", pa.int64()), ("weight", pa.int64()), ("role", pa.int64()), ("n", pa.int32()), ("place", pa.int64())])
_VERDICTS = pa.schema([("host", pa.string()), ("id", pa.int64()), ("moved", pa.int64()), ("crossed", pa.bool_()), ("around", pa.int64())])
_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _slices(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """The rows of the batches, few at a time: what is read of them is held as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield list(zip(*(part.column(name).to_pylist() for name in names), strict=True))


def _with_rounds(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """As ``_slices``, with the classes of the ``rounds`` of the row's host put before, read once a host."""
    held: dict[str, list[Classes]] = {}
    for batch in batches:
        hosts, rounds, start = batch.column("host").to_pylist(), batch.column("rounds"), 0
        for rows in _slices(iter([batch]), *names):
            out = []
            for at, row in enumerate(rows, start):
                host = hosts[at]
                if host not in held:
                    if len(held) >= HELD_HOSTS:
                        held.clear()
                    held[host] = [Classes(classes) for classes in rounds[at].as_py() or ()]
                out.append((held[host], *row))
            start += len(rows)
            yield out


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _slices(batches, "page_id", "url", "host", "salt", "html"):
        out = []
        for page_id, url, host, salt, html in rows:
            blocks, tokens = read_page(html or "")
            texts = [text for _, text in blocks]
            out.append(
                {
                    "page_id": page_id, "url": url, "host": host, "salt": salt, "page": _hash(html or ""), "content": _hash("\0".join(texts)),
                    "tokens": [] if host is None else tokens, "blocks": texts,  # nothing is deduced without a host
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=_READ_TYPE)


def _often_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _slices(batches, "host", "tokens", "often"):
        out = []
        for host, tokens, often in rows:
            known = frozenset(often)
            out.append({"host": host, "tokens": [token for token in tokens if token in known]})
        yield pa.RecordBatch.from_pylist(out, schema=_OFTEN)


def _role_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _with_rounds(batches, "host", "page", "weight", "tokens"):
        columns: list[list] = [[] for _ in _ROLES.names]
        for rounds, host, page, weight, tokens in rows:
            counts, places = Counter(), Counter()
            for place, role in enumerate(roles(tokens, rounds)):
                counts[role] += 1
                places[role] += place
            same = ([value] * len(counts) for value in (host, page, weight))
            for column, values in zip(columns, (*same, counts, counts.values(), places.values()), strict=True):
                column.extend(values)
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, _ROLES, strict=True)], schema=_ROLES)


def _verdict_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last round of a host holds the classes that are judged."""
    for rows in _with_rounds(batches, "host", "tokens"):
        out = set()
        for (*rounds, found), host, tokens in rows:
            moved, crossed, around = violations(roles(tokens, rounds), found)
            out.update((host, found.classes[found.member[role][0]][0], role, False, None) for role in moved)
            out.update((host, found.classes[c][0], None, True, None) for c in crossed)
            out.update((host, found.classes[c][0], None, False, place) for c, places in around.items() for place in places)
        yield pa.RecordBatch.from_pylist([dict(zip(_VERDICTS.names, row, strict=True)) for row in out], schema=_VERDICTS)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _with_rounds(batches, "page_id", "url", "blocks", "tokens"):
        out = []
        for rounds, page_id, url, blocks, tokens in rows:
            if rounds:
                at = [role for role in roles(tokens, rounds[:-1]) if role & 1 == 0]
                blocks = [text for text, role in zip(blocks, at, strict=True) if role not in rounds[-1].member]
            out.append({"page_id": page_id, "url": url, "text": "\n\n".join(blocks)})
        yield pa.RecordBatch.from_pylist(out, schema=_TEXTS)


def _copies(hosts: DataFrame, *columns: str) -> DataFrame:
    """What is known of a host, once for each part that its pages are dealt into."""
    return hosts.select("host", *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _contents(read: DataFrame) -> DataFrame:
    """Of pages of a host with one content, one stands for all."""
    return read.groupBy("host", "content").agg(F.min_by("tokens", "page").alias("tokens"))


def _hosts(read: DataFrame) -> DataFrame:
    """Per host with a text on nearly all of its pages: its pages, and the tokens so often met."""
    tokens = _contents(read).select("host", F.explode(F.array_distinct("tokens")).alias("token"))
    support = tokens.groupBy("host", "token").agg(F.count("*").alias("support")).where(F.col("support") >= LEAST_PAGES)
    # token 1 is on every page, so the greatest support is the number of pages
    pages = support.groupBy("host").agg(F.max("support").alias("pages"))
    often = support.join(pages, "host").where(F.col("support") >= LEAST_SHARE * F.col("pages"))
    return often.groupBy("host", "pages").agg(F.collect_list("token").alias("often")).where("exists(often, t -> t & 1 = 0)")


def _classes(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Equivalence classes of roles on nearly all pages: host, id, support, vector, members."""
    seen = pages.join(_copies(known, "rounds"), ["host", "salt"]).select("host", "page", "weight", "tokens", "rounds")
    seen = seen.mapInArrow(_role_rows, "host string, page bigint, weight bigint, role bigint, n int, place bigint")
    part = F.xxhash64("page", "n").cast("decimal(20,0)")
    vectors = (
        seen.groupBy("host", "role")
        .agg(F.sum("weight").alias("support"), F.sum(part).alias("vector"), F.sum("place").alias("place"))
    )
    vectors = vectors.join(known.select("host", "pages"), "host").where((F.col("support") >= LEAST_PAGES) & (F.col("support") >= LEAST_SHARE * F.col("pages")))
    found = vectors.groupBy("host", "support", "vector").agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("members"))
    return _sizable(found).withColumn("id", F.expr("members[0].role"))


def _sizable(classes: DataFrame) -> DataFrame:
    return classes.where((F.size("members") >= LEAST_TOKENS) & F.expr("exists(members, m -> m.role & 1 = 1)"))


def _by_host(classes: DataFrame) -> DataFrame:
    """Per host the roles of its classes, strongest class first, and a hash of what they hold."""
    found = classes.select("host", F.struct(-F.col("support"), -F.size("members"), F.col("members.role").alias("roles")).alias("c"), F.xxhash64("support", "vector", "members.place").alias("h"))
    return found.groupBy("host").agg(F.array_sort(F.collect_list("c")).getField("roles").alias("classes"), F.bit_xor("h").alias("state"))


def _longer() -> Column:
    return F.concat("rounds", F.array("classes"))


def _valid(pages: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """The classes without tokens out of order, and without classes that are not nested."""
    rules = written(_by_host(found).join(known, "host").select("host", _longer().alias("rounds")), "host-classes")
    met = pages.join(_copies(rules, "rounds"), ["host", "salt"]).select("host", "tokens", "rounds")
    rows = met.mapInArrow(_verdict_rows, "host string, id bigint, moved bigint, crossed boolean, around bigint")
    verdicts = rows.groupBy("host", "id").agg(
        F.collect_set("moved").alias("moved"), F.max("crossed").alias("crossed"), F.min("around").alias("least"), F.max("around").alias("most")
    )
    nested = found.join(verdicts, ["host", "id"]).where("NOT crossed AND least = most")
    return _sizable(nested.withColumn("members", F.expr("filter(members, m -> NOT array_contains(moved, m.role))")))


def templates(read: DataFrame) -> DataFrame:
    """Per ``host`` with template text the ``rounds``: in each the valid classes, a class as its roles in order."""
    read = read.where("host IS NOT NULL")
    hosts = written(_hosts(read), "template-hosts")
    pages = _contents(read.join(hosts, "host", "semi")).withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
    pages = pages.join(_copies(hosts, "often"), ["host", "salt"]).select("host", "tokens", "often")
    # pages of one sequence of tokens have the same roles in the same places: one is read for all
    pages = pages.mapInArrow(_often_rows, "host string, tokens array<bigint>").groupBy("host", "tokens").agg(F.count("*").alias("weight"))
    pages = pages.withColumn("page", F.xxhash64("tokens")).withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int"))
    pages = written(pages, "template-pages")
    known = hosts.select("host", "pages", F.expr("cast(array() as array<array<array<bigint>>>)").alias("rounds"), F.lit(None).cast("bigint").alias("state"))
    settled = known.where("false")
    while not known.isEmpty():
        found = written(_classes(pages, known), "template-classes")
        valid = _by_host(_valid(pages, known, found))
        then = known.withColumnRenamed("state", "before").join(valid, "host").withColumn("rounds", _longer())
        then = written(then.select("host", "pages", "rounds", "state", "before"), "host-templates")
        settled = settled.unionByName(then.where("state <=> before").drop("before"))
        known = then.where("NOT state <=> before").drop("before")
    return settled.where("exists(flatten(try_element_at(rounds, -1)), r -> r & 1 = 0)").select("host", "rounds")


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text (blocks joined by an empty line) and n_chars.

    A page is read once; its blocks are written.  Blocks meet the template of
    their host dealt into ``SALTS`` parts, each with a copy of the template, so no
    host is one task.  Pages without a host have no template and meet nothing.
    """
    host = F.lower(F.regexp_extract("url", HOST, 1))
    narrow = pages.select(
        F.col("page_id").cast("bigint"),
        F.col("url").cast("string"),
        F.nullif(host, F.lit("")).alias("host"),
        F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int").alias("salt"),
        "html",
    )
    read = written(narrow.mapInArrow(_page_rows, _READ), "page-blocks")
    known = written(templates(read), "templates")
    blocks = read.select("page_id", "url", "host", "salt", "blocks", "tokens")
    joined = blocks.where("host IS NOT NULL").join(_copies(known, "rounds"), ["host", "salt"], "left")
    joined = joined.unionByName(blocks.where("host IS NULL"), allowMissingColumns=True)
    texts = joined.select("host", "page_id", "url", "blocks", "tokens", "rounds").mapInArrow(_text_rows, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
