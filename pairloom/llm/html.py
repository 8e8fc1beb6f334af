"""Main text of pages by template deduction.

Pages of one host share a template. Every page is cut into tokens: tags (with class, id and role) and text pieces. For each host and
token, Spark sums over all distinct pages how often the token occurs and a hash of (page, occurrences); tokens with equal sums have equal
occurrence vectors and form an equivalence class. Elements that can be a slot are also tokens by their place (names around
them, and number among such), which tells an article from teasers of the same name. Classes that occur once on nearly every page of the
host are its template. Elements of the template nest; the innermost one that still holds most of the host's text outside menus and the
like is the slot of the article (an `article` or `main` element, where the template has one). Text pieces of the template are fixed text
and left out, unless they would be most of the host's text. What remains of the slot is the article. A form is outside of it, except one
that encloses it.

Defined results: a null or empty page has an empty text; on a host with few pages, or a page that does not fit its host's template,
the page's own `article`, `main` or `body` is the slot; a null url is a host of its own; copies
of a page (equal text outside of menus and the like) each get their text, but count as one page of their host. A tag whose quotes stay
open ends at the next ``>``; one without any is text. Very long pages are read in one pass, whatever is unclosed or nested in them.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, staged

#: Share of a host's pages that hold a template token, pages below which no template is deduced, and the share of the host's text
#: that the slot of the article holds.
SUPPORT, LEAST_PAGES, MASS = 0.8, 5, 0.6
#: Share that is enough for an article element with at least twice the text of every other one in its template, as among teasers.
LEAST = 0.3
#: Templates are a row for each host; beyond this many hosts the join is left to a shuffle.
BROADCAST_HOSTS = 20_000

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_REST = re.compile(r"((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>")
#: Elements whose content is no text, up to their end tag.
UNREAD = "script style noscript template textarea select svg iframe object canvas annotation annotation-xml".split()
_END_TAGS = {name: re.compile(rf"</{name}\s*>", re.I) for name in UNREAD}
_ZEROS, _LONG_NUMBER = re.compile(r"&#0{8,}"), re.compile(r"&#[1-9]\d{7,}")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that interrupt a line, that need no end, and that are not part of an article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math semantics maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none".split())
SLOTS = set("article main section div td".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("nav header footer aside form button head title menu dialog fieldset audio video".split())
_OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|banners?|promos?|cookies?|consent|notices?|gdpr|comments?|replies|disqus|discussion|sidebar|menu|nav|navbar|navigation|breadcrumbs?|header|footer|masthead|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup|modal|widget|toolbar|pagination|pager|copyright)(?:$|[\s_-])",
    re.I,
)
_TOKENS = pa.list_(pa.struct([("token", pa.string()), ("count", pa.int32()), ("mass", pa.int64())]))
_OUTSIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


def unescaped(text: str) -> str:
    """The text without character references; a number of any length is beyond the last character."""
    if "&" not in text:
        return text
    return references.unescape(_LONG_NUMBER.sub("&#1114112", _ZEROS.sub("&#0", text)))


class Ends:
    """Where tags end: at the first ``>`` outside of quotes or, where quotes stay open, at the first ``>``; in one pass over a page."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.table: tuple[list[int], list[int]] | None = None

    def rest(self, at: int) -> tuple[str, int, bool]:
        """What stands between ``at`` and the end of the tag, where the tag ends, and whether its quotes are closed."""
        if self.table is None:
            if found := _TAG_REST.match(self.source, at):
                return found[1], found.end(), True
            self.table = self._of_all()  # one broken tag: further ones look theirs up, since each could be searched to the end of the page
        marks, ends = self.table
        end = ends[bisect_left(marks, at)]
        if end >= 0:
            return self.source[at:end], end + 1, True
        end = self.source.find(">", at)
        return self.source[at:end], end + 1, False

    def _of_all(self) -> tuple[list[int], list[int]]:
        """Positions of ``>`` and quotes, and the end of a tag whose next mark is that one (-1: none), from the last to the first."""
        marks = [m.start() for m in re.finditer("[>\"']", self.source)]
        ends = [-1] * (len(marks) + 1)
        later: dict[str, int] = {}
        for k in range(len(marks) - 1, -1, -1):
            kind = self.source[marks[k]]
            if kind == ">":
                ends[k] = marks[k]
            else:
                closing = later.get(kind)
                ends[k] = -1 if closing is None else ends[closing + 1]
                later[kind] = k
        return marks, ends


def markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, lower-case name (empty: no element), whether it is an end tag, and attributes of all markup of a page, in order."""
    ends, at = Ends(source), 0
    while (start := source.find("<", at)) >= 0:
        at = start + 1
        if source.startswith("<!--", start):
            closing = source.find("-->", start + 4)
            at = closing + 3 if closing >= 0 else len(source)
            yield start, at, "", False, ""
        elif start > ends.last:  # no tag can end here any more
            if (at := source.find("<!--", start)) < 0:
                return
        elif source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            yield start, at, "", False, ""
        elif found := _NAME.match(source, start + 1):
            attributes, at, closed = ends.rest(found.end())
            name = found[2].lower()
            if not closed:
                name = ""
            elif not found[1] and name in _END_TAGS:
                if not (name == "svg" and attributes.endswith("/")):
                    closing = _END_TAGS[name].search(source, at)
                    at = closing.end() if closing else len(source)
                name = ""
            yield start, at, name, bool(found[1]), attributes


class Page:
    """Text pieces of a page in order, each with its block, the innermost element around it, and whether it is outside of any article.

    Elements know the one around them, so time and memory grow with the page alone, however deep elements nest.
    """

    def __init__(self, source: str):
        self.pieces: list[tuple[int, str, int, bool]] = []  # element -1: none, -2: only white space
        self.tags: list[str] = []  # the name with class, id and role, of each element that began
        self.roles: list[str | None] = []  # for elements that can be a slot: the name with the names around it and its number among such
        self.around: list[int] = []  # the element around each (-1: none), which always began before it
        self.ends: Counter[str] = Counter()
        forms: set[int] = set()
        paths: list[int] = []
        numbers: Counter[int] = Counter()
        open_: list[tuple[str, int, bool]] = []  # name, element, whether it or one around it is outside of articles
        names: Counter[str] = Counter()
        block, at = 0, 0
        for start, end, name, is_end, attributes in chain(markup(source), [(len(source), len(source), "", False, "")]):
            text = source[at:start]
            if text and not text.isspace():
                self.pieces.append((block, unescaped(text), open_[-1][1] if open_ else -1, bool(open_) and open_[-1][2]))
            elif text and self.pieces:
                self.pieces.append((block, " ", -2, True))
            at = end
            if not name:
                continue
            if name not in INLINE:
                block += 1
            if is_end:
                self.ends[name] += 1
                if names[name]:
                    while True:
                        last = open_.pop()[0]
                        names[last] -= 1
                        if last == name:
                            break
            elif name not in VOID and not attributes.endswith("/"):
                found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
                outside = name in OUTSIDE and name != "form" or found.get("role", "").lower() in _OUTSIDE_ROLES or any(_OUTSIDE_WORDS.search(found.get(k, "")) for k in ("class", "id"))
                if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and open_ and open_[-1][0] == name:
                    names[open_.pop()[0]] -= 1
                number, parent, beyond = len(self.tags), open_[-1][1] if open_ else -1, bool(open_) and open_[-1][2]
                self.tags.append(name + "".join(f" {k}={found[k]}" for k in sorted(found)))
                self.around.append(parent)
                paths.append(xxhash.xxh64_intdigest(f"{paths[parent] if parent >= 0 else 0} {name}") >> 1)
                role = None
                if name in SLOTS and not (outside and name not in ("article", "main")) and not beyond:
                    numbers[paths[-1]] += 1
                    role = f"{name} @{paths[-1]} {numbers[paths[-1]]}"
                self.roles.append(role)
                if name == "form":
                    forms.add(number)
                open_.append((name, number, beyond or outside and name not in ("html", "body", "article", "main")))
                names[name] += 1

        if forms:
            self._forms(forms)

    def within(self, elements: set[int]) -> list[bool]:
        """Of each element, and last of no element (twice), whether it is one of these or inside of one."""
        inside = [False] * (len(self.tags) + 2)
        for k, parent in enumerate(self.around):
            inside[k] = k in elements or parent >= 0 and inside[parent]
        return inside

    def summed(self, own: list[int]) -> list[int]:
        """Sums of each element's own number and those of all elements inside of it."""
        total = own[:]
        for k in range(len(self.around) - 1, -1, -1):
            if self.around[k] >= 0:
                total[self.around[k]] += total[k]
        return total

    def _own_sizes(self) -> list[int]:
        own = [0] * len(self.tags)
        for _, piece, element, outside in self.pieces:
            if not outside and element >= 0:
                own[element] += len(piece)
        return own

    def _forms(self, forms: set[int]) -> None:
        """Forms are outside of articles, except those that enclose one: by its name or, where the page names none, by nearly all the text."""
        named = [int(tag.split(" ", 1)[0] in ("article", "main")) for tag in self.tags]
        if any(named):
            held = self.summed(named)
            around_article = {k for k in forms if held[k]}
        else:
            own = self._own_sizes()
            held, all_ = self.summed(own), sum(own)
            around_article = {k for k in forms if held[k] >= SUPPORT * all_}
        closed = self.within(forms - around_article)
        self.pieces = [(block, piece, element, outside or closed[element]) for block, piece, element, outside in self.pieces]

    def text(self, elements: set[int] | None, fixed: frozenset[int] = frozenset()) -> str:
        """Words of the pieces within one of the elements (None: all), block by block."""
        blocks: list[list[str]] = []
        inside = None if elements is None else self.within(elements)
        last = None
        for block, piece, element, outside in self.pieces:
            if piece == " " and element < 0:
                if blocks and last == block:
                    blocks[-1].append(" ")
                continue
            if outside or inside is not None and not inside[element] or fixed and piece_hash(piece) in fixed:
                continue
            if block == last:
                blocks[-1].append(piece)
            else:
                blocks.append([piece])
            last = block
        return " ".join(filter(None, (" ".join("".join(x).split()) for x in blocks)))

    def occurrences(self) -> list[tuple[str, int, int]]:
        """Tokens of the page, with how often they occur and the text that they hold; the token '' stands for the page."""
        mass = self.summed(self._own_sizes())
        pieces: Counter[str] = Counter()
        counts: Counter[str] = Counter()
        for _, piece, element, outside in self.pieces:
            if element >= 0:
                token = f"#{piece_hash(piece)}"
                counts[token] += 1
                pieces[token] += 0 if outside else len(piece)
        by_tag: Counter[str] = Counter()
        for k, tag in enumerate(self.tags):
            by_tag[tag] += mass[k]
        found = [(tag, count, by_tag[tag]) for tag, count in Counter(self.tags).items()]
        found += [(role, 1, mass[k]) for k, role in enumerate(self.roles) if role]
        found += [("/" + name, count, 0) for name, count in self.ends.items()]
        found += [(piece, count, pieces[piece]) for piece, count in counts.items()]
        return [*found, ("", 1, sum(pieces.values()))]

    def slot(self, token: str | None, fixed: frozenset[int]) -> set[int] | None:
        """Elements of the article: those of the template's token, or the page's own where it does not fit the template."""
        found = {k for k, (tag, role) in enumerate(zip(self.tags, self.roles, strict=True)) if token in (tag, role)} if token else set()
        if found and " @" in token:  # one of several alike: a page that has most of its text elsewhere is of another kind
            inside = self.within(found)
            sizes = [(len(piece), inside[element]) for _, piece, element, outside in self.pieces if not outside and piece_hash(piece) not in fixed]
            if sum(n for n, held in sizes if held) < LEAST * sum(n for n, _ in sizes):
                found = set()
        return found or self.own_slot()

    def own_slot(self) -> set[int] | None:
        """Elements of the article, by the page's own names."""
        for name in ("article", "main", "body"):
            if found := {k for k, tag in enumerate(self.tags) if tag.split(" ", 1)[0] == name}:
                return found
        return None


def piece_hash(piece: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(piece.split()).encode()) >> 1


def _occurrences(pages: DataFrame) -> DataFrame:
    """host, token, pages, v1, v2 (the occurrence vector, as two sums), once, mass: sums over the distinct pages of each host.

    Pages of one host with the same text outside of menus and the like are copies and count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, int], tuple[int, list]] = {}
            for url, source in zip(*(batch.column(c).to_pylist() for c in ("url", "html")), strict=True):
                host, page = host_of(url), Page(source or "")
                text = xxhash.xxh64_intdigest("\n".join(" ".join(p.split()) for _, p, _, outside in page.pieces if not outside).encode()) >> 1
                vote = xxhash.xxh64_intdigest((source or "").encode("utf-8", "surrogatepass")) >> 1
                if (host, text) not in votes or vote < votes[host, text][0]:
                    votes[host, text] = vote, page.occurrences()
            if votes:
                hosts, texts = zip(*votes, strict=True)
                firsts, tokens = zip(*votes.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(texts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(tokens, _TOKENS)], ["host", "page", "first", "tokens"])

    found = pages.mapInArrow(run, "host string, page long, first long, tokens array<struct<token: string, count: int, mass: long>>")
    distinct = found.groupBy("host", "page").agg(F.min(F.struct("first", "tokens"))["tokens"].alias("tokens"))
    rows = distinct.select("host", "page", F.inline("tokens"))
    h = F.xxhash64(F.concat_ws(" ", F.col("page").cast("string"), F.col("count").cast("string")))
    rows = rows.select("host", "token", F.lit(1).alias("pages"), h.bitwiseAND(F.lit(0x3FFFFFFF)).alias("v1"), F.shiftrightunsigned(h, 34).alias("v2"), (F.col("count") == 1).cast("long").alias("once"), "mass")
    return rows.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "v1", "v2", "once", "mass")])


def templates(pages: DataFrame) -> DataFrame:
    """host, slot (a tag) and fixed (hashes of text pieces): from the equivalence classes of each host's tokens.

    Tokens of a template occur on nearly every page of their host, so a host has at most 1 / SUPPORT times the tokens of a page.
    """
    found = staged(_occurrences(pages))
    hosts = found.where("token = ''").select("host", F.col("pages").alias("of"), F.col("mass").alias("text"))
    tokens = found.where("token <> ''").join(hosts, "host").where((F.col("of") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("of")))
    classes = tokens.groupBy("host", "pages", "v1", "v2").agg(F.first("of").alias("of"), F.first("text").alias("text"), F.min(F.col("once") == F.col("pages")).alias("once"), F.collect_list(F.struct("token", "mass")).alias("tokens"))
    valid = classes.where((F.size("tokens") >= 3) & F.col("once")).withColumn("token", F.explode("tokens")).select("host", "text", F.col("token")["token"].alias("token"), F.col("token")["mass"].alias("mass"))
    valid = staged(valid)
    name, role = F.substring_index("token", " ", 1), F.col("token").contains(" @")
    is_tag = ~F.substring("token", 1, 1).isin("#", "/") & ~name.isin("html", "body", "head", "p", "h1", "title")
    slots = valid.where(is_tag & (F.col("mass") >= MASS * F.col("text")) & (F.col("text") > 0))
    articles = valid.where((name == "article") & role).groupBy("host").agg(F.first("text").alias("text"), F.sort_array(F.collect_list(F.struct("mass", "token")), False).alias("all"))
    first, second = F.col("all")[0], F.get("all", F.lit(1))
    lead = articles.where((first["mass"] >= LEAST * F.col("text")) & (F.col("text") > 0) & (first["mass"] >= 2 * F.coalesce(second["mass"], F.lit(0))))
    slots = slots.unionByName(lead.select("host", "text", first["token"].alias("token"), first["mass"].alias("mass")))
    # an article or main element first; otherwise the innermost one, which holds the least text beyond the share
    wanted = F.when(name == "article", 0).when(name == "main", 1).otherwise(2)
    slot = slots.groupBy("host").agg(F.min(F.struct(wanted.alias("wanted"), "mass", role.alias("role"), "token")).alias("best")).select("host", F.col("best")["token"].alias("slot"))
    # where fixed text would be most of the text, the pages are near copies, and it cannot be told from articles
    fixed = valid.where(F.col("token").startswith("#")).groupBy("host").agg(F.collect_list(F.substring("token", 2, 20).cast("long")).alias("fixed"), F.sum("mass").alias("mass"), F.first("text").alias("text"))
    return slot.join(fixed.where(F.col("mass") <= MASS * F.col("text")).select("host", "fixed"), "host", "full")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text of every page."""
    kind = pages.select(column(id_col)).dtypes[0][1]
    rows = pages.select(column(id_col).alias("id"), column(url_col).cast("string").alias("url"), column(html_col).alias("html"))
    found = staged(templates(rows).select(F.col("host").alias("of"), "slot", "fixed"))
    side = F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:.*?://)?(?:[^/?#]*@)?([^/?#]*)", 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, slot, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "slot", "fixed")), strict=True):
                page = Page(source or "")
                drop = frozenset(fixed or ())
                texts.append(page.text(page.slot(slot, drop), drop))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    joined = rows.withColumn("host", host).join(side, F.col("host") == F.col("of"), "left").select("id", "url", "html", "slot", "fixed")
    return joined.mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def vector_sums(counts: np.ndarray) -> tuple[int, int]:
    """The two sums of one occurrence vector (rows are pages), for tests."""
    hashes = [xxhash.xxh64_intdigest(f"{row} {count}", seed=42) for row, count in enumerate(counts.tolist()) if count]
    return sum(h & 0x3FFFFFFF for h in hashes), sum(h >> 34 for h in hashes)
