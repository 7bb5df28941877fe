"""Operator 1: main text of web pages by equivalence-class template deduction.

Pages of one host are read in batches of ``BATCH``. A token is a tag in its role (name, class,
id and the structural elements around it) or a text of at least ``WORDS`` words in its place.
Each token has an occurrence vector, its count on every different page of the batch; tokens of
equal vectors form an equivalence class. A class is valid if its tokens occur at most once a
page, on at least half of the pages, and in one order on all of them. Valid classes nest into
one template: the tokens of the class on all pages, with those of narrower classes (parts that
some pages lack) between them. What lies between two template tokens is a slot.

What repeats is boilerplate, what varies is content: texts that belong to the template are
left out wherever they stand, and of the slots those are read that lie in the article region
of the template or, where it has none, in the element that holds the most varying text.
Within these slots elements that are no text by the HTML standard (nav, aside, form, ...) are
left out. Words in a class or id only break ties: an element so marked goes if it belongs to
the template, or if its whole mark says that it is an advert, comments or the like.
A batch of fewer than ``FEW`` different pages shows no repetition, and a page that lacks the
template's content slots is read by its own tokens alone: both rest on elements and marks.
Texts that repeat on near copies of one page alone (revisions of an article) are content, and where
most of the region's text repeats, the pages are copies, and all of it is read. Marks never leave a page
empty: elements that hold most of its text are opened then, whatever they are called.

Scale: pages are dealt by host, hosts of over ``DEALT`` pages by host and content (at most 4,096
such hosts, so their table is bounded); within, pages are read in the order of a hash of their
content, so neither the order of the rows nor the number of partitions says which are read
together. A task streams its pages, one batch in memory. One shuffle of the pages. A page costs time and memory linear in its length,
however deep it nests.

Edge cases: null or empty html gives empty text; a null url is a host of its own; repeated
rows are pages of their own; attributes are read by the states of the HTML standard, a quote
that never closes ends with its tag, a tag cut by the end of the page is none; very long pages
are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

BATCH = 64
#: Pages of a host that are dealt together; more are dealt by host and content.
DEALT = 512
FEW = 3
WORDS = 3

_VALUE = r"\"(?:[^\"]*+\"|[^>]*+)|'(?:[^']*+'|[^>]*+)|[^\s>\"'][^\s>]*+"
_REST = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|textarea|iframe|template|svg|select|button|object|math)\b{_REST}(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+")

#: Fixed vocabulary of the HTML standard, by what the elements are for.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form head title dialog menu fieldset option".split())
STRUCTURE = frozenset("html head body main article section div nav header footer aside form ul ol table dl".split())
#: Words of a class, id or role: those that name boilerplate by themselves, those that do so
#: only on an element of the template, and those that may stand beside either.
_SURE = frozenset("ad ads advert advertisement adsense sponsor sponsored promo nav navigation menu breadcrumb breadcrumbs footer masthead sidebar related recommended share sharing comment comments respond disqus cookie cookies consent newsletter subscribe signup login popup modal overlay pagination pager complementary contentinfo banner".split())
_UNSURE = frozenset("social reply replies discussion notice notices alert search copyright legal disclaimer hidden skip widget widgets topbar toolbar".split())
_BESIDE = frozenset("area article bar block body bottom box buttons container content entry form footer group header inner item items left link links list main page panel post right section site story thread title top wrap wrapper".split())
_MAIN_WORD = re.compile(r"(?:^|[\s_-])(?:article|articlebody|main|content|post|entry|story)(?:$|[\s_-]|body|text|content)", re.I)


class Paths:
    """Structural positions as numbers; a child's is greater than its parent's."""

    def __init__(self):
        self.parent, self.known, self.article = [0], {}, [False]

    def child(self, at: int, name: str, mark: str) -> int:
        key = (at, name, mark)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.parent)
            self.parent.append(at)
            self.article.append(self.article[at] or name in ("article", "main"))
        return found

    def below(self, top: int) -> list[bool]:
        """Which positions lie at or below ``top``."""
        out = [False] * len(self.parent)
        for p in range(top, len(out)):
            out[p] = p == top or (p > 0 and out[self.parent[p]])
        return out


class Token:
    """``role`` of a tag: (name, mark, path), closing ones with a mark of "/..."; of a text:
    (None, text, path), None where it is short. ``sure`` and ``unsure``: marks of boilerplate."""

    __slots__ = ("close", "main", "name", "path", "role", "sure", "text", "unsure")

    def __init__(self, name, path, close=False, role=None, text=None, sure=False, unsure=False, main=False):
        self.name, self.path, self.close, self.role, self.text, self.sure, self.unsure, self.main = name, path, close, role, text, sure, unsure, main


def marks_of(rest: str) -> tuple[str, bool, bool, bool]:
    """(mark, sure, unsure, main) from a tag's attributes."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value
        found.setdefault(name.lower(), value)
    named = " ".join(found.get(a, "") for a in ("class", "id", "role", "itemprop"))
    sure = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    unsure = False
    for a in ("class", "id", "role"):
        for one in found.get(a, "").lower().split():
            words = [w for w in re.split(r"[\W\d_]+", one) if w]
            said = [w for w in words if w in _SURE or w in _UNSURE]
            unsure = unsure or bool(said)
            sure = sure or any(w in _SURE for w in words) and all(w in _SURE or w in _UNSURE or w in _BESIDE for w in words)
    return re.sub(r"\d+", "#", found.get("class", "") + "." + found.get("id", "")), sure, unsure, bool(_MAIN_WORD.search(named))


def tokens(page: str, paths: Paths | None = None) -> list[Token]:
    """Tags and texts of a page in order; scripts, styles and comments are dropped here."""
    paths = paths or Paths()
    out, stack, open_, seen = [], [(0, "", "")], {}, {}
    for m in _TOKEN.finditer(page):
        name, at = m["name"], stack[-1][0]
        if name is None:
            if m["raw"] is None and not m[0].startswith(("<!", "<?")):
                words = m[0].split()
                out.append(Token(None, at, text=m[0], role=(None, " ".join(words), at) if len(words) >= WORDS else None))
            continue
        if m.end() == len(page) and not m[0].endswith(">"):
            continue  # cut by the end of the page
        name, close = name.lower(), bool(m["close"])
        if close:
            role = (name, "/", at)
            if name in STRUCTURE and open_.get(name):
                while stack[-1][1] != name:
                    open_[stack.pop()[1]] -= 1
                _, _, mark = stack.pop()
                open_[name] -= 1
                at = stack[-1][0]
                role = (name, "/" + mark, at)
            out.append(Token(name, at, True, role))
            continue
        found = seen.get(m["rest"])
        if found is None:
            found = seen[m["rest"]] = marks_of(m["rest"])
        mark, sure, unsure, main = found
        plain = name in ("article", "main", "body", "html")
        main = name in ("article", "main") or main and not sure and name in ("div", "section", "td")
        boiler = name in BOILER or name == "header" and not paths.article[at]
        out.append(Token(name, at, False, (name, mark, at), sure=boiler or sure and not plain, unsure=unsure and not plain, main=main))
        if name in STRUCTURE and not m["rest"].endswith("/"):
            stack.append((paths.child(at, name, mark), name, mark))
            open_[name] = open_.get(name, 0) + 1
    return out


def occurrences(pages: list[list[Token]]) -> dict[tuple, dict[int, int]]:
    """The occurrence vector of every role: its count by page."""
    count: dict[tuple, dict[int, int]] = {}
    for i, page in enumerate(pages):
        for t in page:
            if t.role is not None:
                vector = count.setdefault(t.role, {})
                vector[i] = vector.get(i, 0) + 1
    return count


def template(pages: list[list[Token]], count: dict | None = None) -> list[tuple]:
    """Roles of the template tokens in order, from the valid equivalence classes."""
    n, count = len(pages), count or occurrences(pages)
    where = {(t.role, i): at for i, page in enumerate(pages) for at, t in enumerate(page) if t.role is not None}
    classes: dict[tuple, list[tuple]] = {}
    for role, vector in count.items():
        if 2 * len(vector) >= n and max(vector.values()) == 1 and (role[0] is not None or n >= FEW):
            classes.setdefault(tuple(vector), []).append(role)
    out: list[tuple] = []
    for members, roles in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):  # the widest class is the outermost
        i = members[0]
        mine = sorted(roles, key=lambda r: where[r, i])
        in_order = lambda rs, j: all(where[a, j] < where[b, j] for a, b in zip(rs[:-1], rs[1:], strict=True))
        if not all(in_order(mine, j) for j in members):
            continue
        merged = sorted([*(r for r in out if (r, i) in where), *mine], key=lambda r: where[r, i])
        if all(in_order([r for r in merged if (r, j) in where], j) for j in members):
            # its tokens keep their places among the outer ones on every page
            rest = [r for r in out if (r, i) not in where]
            out = merged if not rest else _weave(out, merged)
    return out


def _weave(outer: list[tuple], inner: list[tuple]) -> list[tuple]:
    """``outer`` with the new roles of ``inner`` set after the role that they follow."""
    have, after, last = set(outer), {}, None
    for r in inner:
        if r in have:
            last = r
        else:
            after.setdefault(last, []).append(r)
    out = list(after.get(None, []))
    for r in outer:
        out.append(r)
        out += after.get(r, [])
    return out


class Host:
    """What the different pages of a batch tell: template, repeated texts, content slots."""

    def __init__(self, pages: list[list[Token]], paths: Paths, opened: bool = False):
        self.paths, self.opened, n = paths, opened, len(pages)
        count = occurrences(pages)
        self.often = {r for r, v in count.items() if n >= FEW and 2 * len(v) >= n}
        family = family_texts([self._own(p) for p in pages], {r for r in self.often if len(count[r]) == n}) if n >= FEW else frozenset()
        self.often -= family
        self.roles = [r for r in template(pages, count) if r not in family]
        self.place = {r: k for k, r in enumerate(self.roles)}
        self.slots = self._content(pages)
        inside = [t for p in pages for a, b in self.ranges(p) for t, gone in zip(p[a:b], self.hidden(p)[a:b], strict=True) if t.text and not gone]
        size = lambda ts: sum(len(t.text.strip()) for t in ts)
        self.copies = 2 * size([t for t in inside if t.role in self.often]) > size(inside)

    def _own(self, page: list[Token]) -> dict[tuple, int]:
        """Texts (roles) of a page that are not hidden, of its article element if it has one, and their lengths;
        the short ones, which have no role, together under None."""
        seen = [t for t, gone in zip(page, self.hidden(page), strict=True) if t.text and not gone]
        inside = [t for t in seen if self.paths.article[t.path]] or seen
        return {t.role: len(t.text) for t in inside if t.role is not None} | {None: sum(len(t.text.strip()) for t in inside if t.role is None)}

    def _content(self, pages: list[list[Token]]) -> set[int]:
        """Slots (k: from template token k to the next) that hold the content."""
        kinds: dict[tuple, Token] = {}
        for page in pages:
            for t, gone in zip(page, self.hidden(page), strict=True):
                if t.role is not None and not gone:
                    kinds.setdefault(t.role, t)
        regions = []  # from an article's opening token to its closing one
        for k, role in enumerate(self.roles):
            t = kinds.get(role)
            if t is not None and t.main and not t.close:
                end = self.place.get((role[0], "/" + role[1], role[2]), len(self.roles))
                regions.append((t.name == "article", t.name == "main", k, end if end > k else len(self.roles)))
        if regions:
            best = max(r[:2] for r in regions)
            return {j for r in regions if r[:2] == best for j in range(r[2], r[3])}
        # without such a region: the structural element with the most varying text of its own
        own: dict[int, int] = {}
        slots: dict[int, set[int]] = {}
        for page in pages:
            k = -1
            for t, gone in zip(page, self.hidden(page), strict=True):
                k = self.place.get(t.role, k) if t.role is not None else k
                if t.text and not gone and t.role not in self.often:
                    own[t.path] = own.get(t.path, 0) + len(t.text.strip())
                    slots.setdefault(t.path, set()).add(k)
        best = max(own, key=lambda p: (own[p], -p), default=0)
        below = self.paths.below(best)
        return {k for p, ks in slots.items() if below[p] for k in ks}

    def hidden(self, page: list[Token]) -> list[bool]:
        """True for tokens inside an element that is no text; an article or main opening ends one.

        With ``opened`` elements that hold more than half of the page's text count as text.
        """
        out, depth, name = [], 0, ""
        wrappers = wrapping(page) if self.opened else frozenset()
        for i, t in enumerate(page):
            if depth and (t.name in ("article", "main") and not t.close or name == "p" and t.name in BLOCKS and not (t.name == "p" and t.close)):
                depth = 0
            if depth:
                if t.name == name:
                    depth += -1 if t.close else 1
                out.append(True)
                continue
            hides = not t.close and t.name is not None and t.name not in VOID and (t.sure or t.unsure and t.role in self.often) and i not in wrappers
            if hides:
                depth, name = 1, t.name
            out.append(hides)
        return out

    def ranges(self, page: list[Token]) -> list[tuple[int, int]]:
        """Token ranges of the content slots; slot -1 is what stands before the template."""
        out: list[tuple[int, int]] = []
        k, begin = -1, None
        for i, t in enumerate(page):
            k = self.place.get(t.role, k) if t.role is not None else k
            if k in self.slots:
                begin = i if begin is None else begin
            elif begin is not None:
                out.append((begin, i))
                begin = None
        if begin is not None:
            out.append((begin, len(page)))
        return out

    def text(self, page: list[Token]) -> str:
        """Blocks of the content slots without hidden elements and repeated texts."""
        use, hide = self.ranges(page), self.hidden(page)
        return text_of(page, use, hide, frozenset() if self.copies else self.often)


def wrapping(page: list[Token]) -> set[int]:
    """Opening tokens whose element holds more than half of the page's text."""
    total, before, open_, out = sum(len(t.text.strip()) for t in page if t.text), 0, {}, set()
    for i, t in enumerate(page):
        if t.text:
            before += len(t.text.strip())
        elif t.close:
            begun = open_.get(t.name)
            if begun:
                at, held = begun.pop()
                if 2 * (before - held) > total:
                    out.add(at)
        elif t.name not in VOID:
            open_.setdefault(t.name, []).append((i, before))
    # one that is never closed reaches to the end of the page
    return out | {at for begun in open_.values() for at, held in begun if 2 * (total - held) > total}


def family_texts(own: list[dict[tuple, int]], common: set) -> set:
    """Repeated texts that stand on near copies of one page alone: content, however often they occur.

    ``own``: texts of each page and their lengths. A page is a near copy of another if it has seven tenths or
    more of its texts, by length, and two at least; texts that all pages have (``common``) do not count, they are the template's.
    """
    on: dict[tuple, list[int]] = {}
    for i, texts in enumerate(own):
        for r in texts:
            if r is not None and r not in common:
                on.setdefault(r, []).append(i)
    out = {r for r, pages in on.items() if len(pages) > 1}
    for texts in own:
        mine = {r: n for r, n in texts.items() if r in on}
        shared, number = [0] * len(own), [0] * len(own)
        for r, n in mine.items():
            for j in on[r]:
                shared[j] += n
                number[j] += 1
        total = sum(mine.values()) + texts.get(None, 0)
        out -= {r for r in mine if r in out and any(10 * shared[j] < 7 * total or number[j] < 2 for j in on[r])}
    return out


def text_of(page: list[Token], use: list[tuple[int, int]], hide: list[bool], repeated=frozenset()) -> str:
    """Blocks of the token ranges ``use``; hidden tokens and ``repeated`` texts are left out."""
    blocks, now = [], []

    def end():
        words = " ".join(entities.unescape("".join(now)).split())
        if words:
            blocks.append(words)
        now.clear()

    for a, b in use:
        for t, hidden in zip(page[a:b], hide[a:b], strict=True):
            if t.name in BLOCKS:
                end()
            elif hidden:
                continue
            elif t.name == "br":
                now.append(" ")
            elif t.text is not None and t.role not in repeated:
                now.append(t.text)
        end()
    return "\n\n".join(blocks)


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host. Their order does not matter.

    A page whose text would be empty is read by itself, then with elements that hold most of its text opened
    whatever their marks, at last whole: a page with text outside scripts and styles never comes out empty.
    """
    paths = Paths()
    known = {p: tokens(p, paths) for p in sorted({p for p in pages if p})}
    host = Host(list(known.values()), paths) if known else None
    done = {p: host.text(page) for p, page in known.items()}
    empty = [p for p, text in done.items() if not text]
    for p in empty:
        alone = Host([known[p]], paths)
        done[p] = alone.text(known[p]) if len(known) > 1 else ""
        done[p] = done[p] or text_of(known[p], [(0, len(known[p]))], alone.hidden(known[p]))
    empty = [p for p in empty if not done[p]]
    opened = Host([known[p] for p in empty], paths, True) if empty else None
    for p in empty:
        page = known[p]
        alone = Host([page], paths, True)
        done[p] = opened.text(page) or alone.text(page) or text_of(page, [(0, len(page))], alone.hidden(page)) or text_of(page, [(0, len(page))], [False] * len(page))
    return [done.get(p, "") if p else "" for p in pages]


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    counts = d.groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    few = max(DEALT, -(-total // 4096))
    hot = counts.filter(F.col("n") > few).select("host", F.ceil(F.col("n") / few).cast("int").alias("salts"))  # 4,096 hosts at most
    # by content: neither the number of partitions nor the order of the rows says which pages are read together
    d = d.withColumn("key", F.xxhash64("html")).join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod(F.col("key"), F.coalesce("salts", F.lit(1))))
    d = d.repartition(4 * partitions(spark), "host", "salt").sortWithinPartitions("host", "salt", "key", "page_id").select("host", "page_id", "url", "html", "salt", "key")

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        group, last, different, size = None, None, 0, 0

        def done():
            texts = extract([r[3] for r in held])
            rows = [[r[1] for r in held], [r[2] for r in held], texts, [len(t) for t in texts]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = row[5] != last or row[3] != held[-1][3] if held else True
                # copies of a page stay in its batch, as one text
                if held and ((row[0], row[4]) != group or new and (different == BATCH or size > 1 << 24)):
                    yield done()
                    held, different, size = [], 0, 0
                    new = True
                if new:
                    different, size = different + 1, size + len(row[3] or "")
                else:
                    row = (*row[:3], held[-1][3], *row[4:])
                group, last = (row[0], row[4]), row[5]
                held.append(row)
        if held:
            yield done()

    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
SQL: dict[str, str] = {}
