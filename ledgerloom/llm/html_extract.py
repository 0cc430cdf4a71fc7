"""Main text of web pages: equivalence classes of tokens make a template for each host."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field as attribute
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import field, map_arrow, map_batches, materialize, plain
from .url_filter import split_url

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no part of an article.
ASIDE = frozenset("head script style title noscript template iframe object svg canvas nav menu aside footer form button select textarea dialog audio video".split())
#: Words in class, id or role that say the same of any element.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer comment comments"
    " reply replies disqus newsletter subscribe subscription cookie cookies consent gdpr notice popup modal overlay share sharing social related"
    " breadcrumb breadcrumbs pagination pager widget complementary contentinfo".split()
)
#: Words beside them in one name that change nothing: "main-nav" is a menu, "social-policy" isn't.
FILLERS = frozenset(
    "area bar block bottom box col column container content fixed form global group header inner item items js left link links list main mobile outer page post posts"
    " primary right row secondary section signup site slot sticky top unit widget wrap wrapper".split()
)
#: Parts of an article that are no asides whatever they are called.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure".split())
ROOTS = frozenset(("article", "main"))
#: Elements that can be the one that holds an article.
HOLDERS = frozenset("html body div section article main center table tbody tr td form dialog details".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text is no page text.
HARD = ASIDE - {"nav", "menu", "aside", "footer", "form", "dialog"}
#: An open element in the first set ends when one in the second begins.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "option", "optgroup"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option", "optgroup")), "head": frozenset(("body",)),
}
#: Elements beyond which an implied end tag doesn't reach.
SCOPE = frozenset("table td th button article section div body html ul ol blockquote".split())

_ALL = (1 << 64) - 1
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of open tags, close tags and text runs, in page order.
    Linear in the page's length, whatever is left unclosed in it."""
    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        if page[at] != "<":
            cut = page.find("<", at)
            cut = end if cut < 0 else cut
            yield "text", page[at:cut], ""
            at = cut
        elif page.startswith("<!--", at):
            cut = page.find("-->", at + 4)
            at = end if cut < 0 else cut + 3
        elif at > last:
            yield "text", page[at:], ""
            at = end
        elif page[at + 1 : at + 2] in ("!", "?"):
            at = page.find(">", at) + 1
        elif (m := _TAG.match(page, at)) is None:
            yield "text", "<", ""
            at += 1
        else:
            closing, name, rest = m[1], m[2].lower(), m[3]
            at = m.end()
            for quote in "\"'":
                if rest.count(quote) % 2 and rest.rstrip().rpartition(quote)[0].rstrip().endswith("="):
                    cut = page.find(quote, at)  # a quoted value that holds a >
                    if 0 <= cut < last:
                        rest += page[m.end() - 1 : cut + 1]
                        at = page.find(">", cut) + 1
                    break
            yield ("close" if closing else "open"), name, rest
            if not closing and name in RAW and not rest.endswith("/"):
                found = _CLOSE[name].search(page, at)
                at = found.start() if found else end


@dataclass
class Element:
    name: str
    path: int
    aside: bool
    root: bool
    within: bool = False  # in the template's content element
    hard: bool = False
    mark: Mark | None = None
    article: bool = False


class Mark:
    """An element that a word or ``form`` makes an aside, the one around it, and what it holds: text
    in articles, in roots, and all."""

    def __init__(self, outer: Mark | None):
        self.outer = outer
        self.held = [0, 0, 0]


@dataclass
class Template:
    """What the pages of a host share: ``skeleton`` has the tag tokens of the valid classes that stand
    once on a page, in order; ``content`` the open token of the innermost of them that holds the
    varied text (0: none); ``texts`` the text tokens that are part of the template; ``repeated``
    the slots, as paths, filled again and again from a small stock of texts; ``pages`` how many
    pages say so."""

    skeleton: list[int] = attribute(default_factory=list)
    content: int = 0
    texts: frozenset[int] = frozenset()
    repeated: frozenset[int] = frozenset()
    pages: int = 0

    def allows(self, left: int, whole: int) -> bool:
        """Whether a template of so many pages may leave ``left`` of ``whole`` characters of a page.
        Two pages that share most of their text may be copies of one another, a hundred hardly:
        the share that must stay falls as 2 / (pages + 2)."""
        return left > 0 and left * (self.pages + 2) >= 2 * whole


def _hidden(attributes: str) -> bool:
    return any(m[1].lower() == "hidden" and m[2] is None and m[3] is None and m[4] is None for m in _ATTRIBUTE.finditer(attributes))


def _is_marked(name: str, attributes: str, inside: bool) -> bool:
    """Whether a name in class, id or role says aside: one of ASIDE_WORDS, alone or with FILLERS."""
    if name == "form":
        return True
    if not attributes or name in ("html", "body", "article", "main") or inside and name in PROSE:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() != "hidden":
            for one in (m[2] or m[3] or m[4] or "").lower().split():
                words = set(filter(None, _PARTS.split(re.sub(r"[0-9]+", "", one))))
                if words <= ASIDE_WORDS | FILLERS and (words & ASIDE_WORDS or "header" in words and not inside):
                    return True
    return False


def walk(page: str, content: int = 0) -> Iterator[tuple[str, int, str, Element | None]]:
    """(kind, token, text, element) along a page. A token is a hash of what stands there and of the
    path of open elements, so equal tags in other roles are other tokens. Kinds: open, close, text,
    and break where a block begins or ends. What is around the element of the token ``content``
    makes it no aside."""
    stack = [Element("", 0, False, False)]
    opened: Counter = Counter()
    digest = xxhash.xxh64_intdigest

    def pop_to(name: str) -> Iterator[tuple[str, int, str, Element | None]]:
        while True:
            gone = stack.pop()
            opened[gone.name] -= 1
            if gone.name in BLOCK:
                yield "break", 0, "", None
            if gone.name == name:
                return

    for kind, name, rest in scan(page):
        top = stack[-1]
        if kind == "text":
            yield "text", digest(" ".join(name.split()), top.path), name, top
        elif kind == "open":
            for old, by in CLOSED_BY.items():
                if opened[old] > 0 and name in by:
                    for element in reversed(stack):
                        if element.name == old:
                            yield from pop_to(old)
                            break
                        if element.name in SCOPE:
                            break
            top = stack[-1]
            path = digest(name, top.path)
            yield "open", path, name, top
            if name in BLOCK:
                yield "break", 0, "", None
            elif name == "br":
                yield "text", 0, " ", top
            if name not in VOID and not rest.endswith("/"):
                hard = top.hard or name in HARD or "hidden" in rest.lower() and _hidden(rest)
                aside, mark = hard, None
                if path != content:
                    aside = hard or top.aside or name in ASIDE and name != "form" or name == "header" and not top.root
                    mark = Mark(top.mark) if _is_marked(name, rest, top.root) else top.mark
                stack.append(Element(name, path, aside, top.root or name in ROOTS or "role=\"main\"" in rest, top.within or path == content, hard, mark, top.article or name == "article"))
                opened[name] += 1
        elif opened[name] > 0:
            yield "close", digest("/", next(e.path for e in reversed(stack) if e.name == name)), name, None
            yield from pop_to(name)


def tokens_of(page: str) -> tuple[list[int], list[tuple[int, int, int]], dict[int, int]]:
    """Tag tokens of a page and (token, path, characters) of its texts, in order; and the path around
    each element's."""
    tags, texts, ups = [], [], {}
    for kind, token, text, element in walk(page):
        if kind == "open":
            tags.append(token)
            ups[token] = element.path
        elif kind == "close":
            tags.append(token)
        elif kind == "text" and token and not element.hard and (size := len(text.strip())):
            texts.append((token, element.path, size))
    return tags, texts, ups


def deduce(rows: Iterable[tuple], pages: int, support: float = 0.5) -> Template:
    """A host's template from (token, kind, pages, occurrences, two sums of hashes, mean place, path
    around it, characters in it).

    Tokens with one occurrence vector (same pages, same counts on each: same sums) are one
    equivalence class. A class is valid if it has at least two tokens, as an element has, on at
    least ``support`` of the pages. The valid classes of tokens that stand once on a page are the
    skeleton. A text token, which has its path in it, is the template's if it is on more than
    ``support`` of the pages and one page besides, however often it stands on one.

    Slots are chosen by the text that varies. The content is the innermost element of the skeleton
    that can hold an article, reached from the page's root by going on to one that holds half of
    the host's varied characters, up to an article or main element, and not where that would leave
    a varied first heading behind. A slot is repeated if each of its characters stands on the host
    twice as often at least as in the slot with the most distinct text.
    """
    classes: dict[tuple[int, int, int, int], list[tuple[float, int]]] = {}
    texts, slots = [], []
    up: dict[int, int] = {}
    varied: dict[int, int] = {}
    fixed: dict[int, int] = {}
    for token, kind, seen, occurrences, high, low, place, around, chars in rows:
        if kind == 0:
            classes.setdefault((seen, occurrences, high, low), []).append((place, token))
            if around is not None:
                up[token], varied[token] = around, chars
        elif kind == 3:
            slots.append((token, chars, high))
        elif seen > support * (pages + 1):
            texts.append(token)
            fixed[around] = fixed.get(around, 0) + chars
    for path, chars in fixed.items():
        while path in up:
            varied[path] -= chars
            path = up[path]
    valid = {k: v for k, v in classes.items() if len(v) >= 2 and k[0] >= support * pages}
    skeleton = [t for _, t in sorted(x for k, v in valid.items() if k[0] == k[1] for x in v)]

    below: dict[int, list[int]] = {}
    for token in skeleton:
        if token in up:
            below.setdefault(up[token], []).append(token)
    digest = xxhash.xxh64_intdigest
    total = sum(n for path, n in varied.items() if up[path] == 0)
    content, at = 0, 0
    while total > 0:
        holders = {digest(name, at) for name in HOLDERS}
        held, best = max(((varied[t], t) for t in below.get(at, ()) if t in holders), default=(0, 0))
        titles = [digest("h1", p) for p in (at, digest("header", at))]
        if 2 * held < total or any(varied.get(t, 0) > 0 and t != best for t in titles):
            break
        content, around, at = best, at, best
        if best in [digest(name, around) for name in ROOTS]:
            break
    _, often = max(((fresh, chars / fresh) for _, chars, fresh in slots if fresh), default=(0, 1.0))
    repeated = frozenset(path for path, chars, fresh in slots if path in up and chars >= 2 * often * fresh)
    return Template(skeleton, content, frozenset(texts), repeated, pages)


def _standing(marks: Iterable[Mark], held: list[int]):
    """Tells whether a mark, or one around it, makes an aside. What marks hold is summed outwards."""
    every: dict[Mark, None] = {}
    for mark in marks:
        chain = []
        while mark is not None and mark not in every:
            chain.append(mark)
            mark = mark.outer
        every.update(dict.fromkeys(reversed(chain)))
    for mark in reversed(every):
        if mark.outer is not None:
            mark.outer.held = [a + b for a, b in zip(mark.outer.held, mark.held, strict=True)]
    ground = next((i for i in range(3) if held[i]), 2)
    asides: set[Mark] = set()
    for mark in every:  # outer ones first
        if mark.outer in asides or 2 * mark.held[ground] <= held[ground]:
            asides.add(mark)
    return lambda mark: mark in asides


def extract(page: str, template: Template | None = None) -> tuple[str, int, int]:
    """(main text, template tokens found in order, text slots that hold the main text).

    What lies between template tokens are the slots. Those in the template's content element, if
    the page has it with text, are the main text; of them, or without it of all, those in an
    article or main element, if there is one, and outside all asides, unless nothing but asides has
    text. An element that its class, id or role (or being a form) marks as aside is none if it holds
    more than half of the text in articles; without such, in roots; without such, of all. A
    template's text and that of repeated slots, headings not counted, are left out of blocks that
    consist half or more of them. Where that leaves less than ``Template.allows``, the content
    element is not relied on, and then not the template's texts. Slots are parted where blocks
    begin and end.
    """
    template = template or Template()
    skeleton, at = template.skeleton, 0
    place = {t: i for i, t in enumerate(skeleton)}
    # where (content, root), whether in an aside by tag, mark; whole block, block without template text, its gaps
    kept: list[tuple[tuple, str, str, list[int]]] = []
    whole: list[str] = []
    own: list[str] = []
    gaps: list[int] = []
    where: tuple = (False, False, False, None)
    roots: list[tuple[bool, Mark | None]] = []
    held = [0, 0, 0]

    def flush() -> None:
        text = " ".join(html.unescape("".join(whole)).split())
        if text:
            part = " ".join(html.unescape("".join(own)).split())
            kept.append((where, text, text if 2 * len(part) > len(text) else part, gaps.copy()))
        whole.clear()
        own.clear()
        gaps.clear()

    for kind, token, text, element in walk(page, template.content):
        if kind == "break":
            flush()
        elif kind == "text":
            if element.hard:
                continue
            now = (element.within, element.root, element.aside, element.mark)
            if now != where:
                flush()
                where = now
            whole.append(text)
            if not element.aside:
                size = len(text.strip())
                for sums in (held, *([element.mark.held] if element.mark else ())):
                    sums[0] += size * element.article
                    sums[1] += size * element.root
                    sums[2] += size
            if token not in template.texts and (element.path not in template.repeated or element.name in HEADINGS):
                own.append(text)
                if text.strip():
                    gaps.append(at)
        else:
            if kind == "open" and element is not None and not element.aside and text in ROOTS:
                roots.append((element.within, element.mark))
            if place.get(token, -1) >= at:
                at = place[token] + 1
    flush()
    stands = _standing({id(w[3]): w[3] for w, *_ in kept if w[3]}.values(), held)
    free = [k for k in kept if not k[0][2] and not stands(k[0][3])]
    any_root = any(not stands(mark) for _, mark in roots)

    def chosen(inner: bool) -> list[tuple[tuple, str, str, list[int]]]:
        rooted = any_root and any(w[1] and w[0] >= inner for w, *_ in free)
        return [k for k in free if k[0][0] >= inner and k[0][1] >= rooted] or kept

    every = chosen(False)
    whole_size = sum(len(full) for _, full, *_ in every)
    within = any(w[0] and part for w, _, part, _ in free)
    for blocks, column in ([(chosen(True), 2)] if within else []) + [(every, 2), (every, 1)]:
        left = [b[column] for b in blocks if b[column]]
        if column == 1 or template.allows(sum(map(len, left)), whole_size):
            break
    return "\n\n".join(left), at, len({g for *_, own_gaps in blocks for g in own_gaps})


def host_of(url: str | None) -> str:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return split_url(url)[0]


def _host(url_col: str) -> Column:
    """``host_of`` as an expression."""
    url = F.col(f"`{url_col}`")
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), ascii_uppercase, ascii_lowercase)


def occurrence_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str, max_hosts: int = 20_000, max_runs: int = 1 << 17) -> DataFrame:
    """(host, token, kind, pages, occurrences, high, low, place, up, chars) summed over each task's
    pages. up is the path around an element or text, null for end tags; chars the characters in it.

    Kind 0: tag tokens, 1: text tokens, 2: the host's number of pages, empty ones left out. high and
    low sum two 32-bit hashes of (page, count): equal sums stand for equal occurrence vectors. All
    text tokens are counted; a task hands on what it holds at ``max_runs`` of them and begins anew.
    """
    long = T.LongType()
    names = ("token", "kind", "pages", "occurrences", "high", "low")
    schema = T.StructType([field("host", T.StringType()), *[field(n, long) for n in names], field("place", T.DoubleType()), field("up", long), field("chars", long)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            rows = [(host, 0, 2, n, n, 0, 0, 0.0, None, 0) for host, (n, *_) in hosts.items()]
            for host, (_, tags, texts, ups) in hosts.items():
                inside = dict.fromkeys(ups, 0)
                for _, _, path, size in texts.values():
                    if path in inside:
                        inside[path] += size
                for path in reversed(ups):  # an element is met before those in it
                    if ups[path] in inside:
                        inside[ups[path]] += inside[path]
                rows += [(host, t, 0, *v, ups.get(t), inside.get(t, 0)) for t, v in tags.items()]
                rows += [(host, t, 1, n, all_, 0, 0, 0.0, path, size) for t, (n, all_, path, size) in texts.items()]
            columns = list(zip(*rows)) or [()] * 10  # noqa: B905
            tokens = pa.array(np.array(columns[1], np.uint64).view(np.int64))
            ups = pa.array([None if u is None else u - (u >> 63 << 64) for u in columns[8]], pa.int64())
            ints = [pa.array(c, pa.int64()) for c in columns[2:7]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), tokens, *ints, pa.array(columns[7], pa.float64()), ups, pa.array(columns[9], pa.int64())], names=schema.names)

        held = 0
        for batch in batches:
            at = batch.schema.get_field_index
            for key, url, page in zip(batch.column(at(id_col)).to_pylist(), batch.column(at(url_col)).to_pylist(), batch.column(at(html_col)).to_pylist(), strict=True):
                if not page or page.isspace():
                    continue
                tags, texts, ups = tokens_of(page)
                number = xxhash.xxh64_intdigest(f"{key}\0{url}\0{page}")
                known = None if held >= max_runs else hosts.get(host_of(url))
                if known is None:
                    if len(hosts) >= max_hosts or held >= max_runs:
                        yield out()
                        hosts.clear()
                        held = 0
                    known = hosts[host_of(url)] = [0, {}, {}, {}]
                known[0] += 1
                for path, up in ups.items():
                    known[3].setdefault(path, up)
                places: dict[int, float] = {}
                for i, t in enumerate(tags):
                    places.setdefault(t, i / len(tags))
                for t, n in Counter(tags).items():
                    mark = xxhash.xxh64_intdigest(str(n), number)
                    v = known[1].get(t)
                    if v is None:
                        known[1][t] = [1, n, mark >> 32, mark & 0xFFFFFFFF, places[t]]
                    else:
                        v[0] += 1
                        v[1] += n
                        v[2] += mark >> 32
                        v[3] += mark & 0xFFFFFFFF
                        v[4] += places[t]
                for (t, path, size), n in Counter(texts).items():
                    v = known[2].get(t)
                    if v is None:
                        known[2][t] = [1, n, path, n * size]
                        held += 1
                    else:
                        v[0] += 1
                        v[1] += n
                        v[3] += n * size
        yield out()

    return map_arrow(plain(pages, id_col, url_col, html_col), run, schema)


_TEMPLATE = T.StructType(
    [field("host", T.StringType()), field("pages", T.LongType()), field("skeleton", T.ArrayType(T.LongType())), field("content", T.LongType())]
    + [field(n, T.ArrayType(T.LongType())) for n in ("texts", "repeated")]
)


def _signed(token: int) -> int:
    return token - (token >> 63 << 64)


def _template(pages: int, skeleton: list[int], content: int, texts: list[int], repeated: list[int]) -> Template:
    return Template([t & _ALL for t in skeleton], content & _ALL, frozenset(t & _ALL for t in texts), frozenset(t & _ALL for t in repeated), pages)


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5) -> DataFrame:
    """(host, pages, skeleton, content, texts, repeated) as ``deduce`` finds them, for hosts of two
    pages or more; of one page nothing repeats. Sums are pre-aggregated in each task, so a host with
    a third of all pages is no hot key; what meets for a host is what is on ``support`` of its pages."""
    sums = [F.sum(c).alias(c) for c in ("pages", "occurrences", "high", "low", "place")]
    summed = occurrence_rows(pages, id_col, url_col, html_col).groupBy("host", "token", "kind").agg(*sums, F.max("up").alias("up"), F.sum("chars").alias("chars"))
    summed = materialize(summed)
    total = summed.filter((F.col("kind") == 2) & (F.col("pages") > 1)).select("host", F.col("pages").alias("n"))
    some = summed.filter((F.col("kind") == 0) | (F.col("kind") == 1) & (F.col("pages") >= 2))  # no template text is on fewer
    fresh = F.sum((F.col("chars") / F.col("occurrences")).cast("long")).alias("high")
    slots = summed.filter("kind = 1").groupBy("host", F.col("up").alias("token")).agg(F.lit(3).cast("long").alias("kind"), F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), fresh, F.sum("chars").alias("chars"))
    some = some.unionByName(slots.withColumns({"low": F.lit(0).cast("long"), "place": F.lit(0.0), "up": F.lit(None).cast("long")}))
    near = some.join(total, "host").filter(F.col("pages") >= support * F.col("n"))
    row = F.struct("token", "kind", "pages", "occurrences", "high", "low", (F.col("place") / F.col("pages")).alias("place"), "up", "chars")
    gathered = near.groupBy("host").agg(F.max("n").alias("pages"), F.collect_list(row).alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(_TEMPLATE)
        for batch in batches:
            out = []
            for host, n, rows in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                made = deduce([(r["token"] & _ALL, r["kind"], r["pages"], r["occurrences"], r["high"], r["low"], r["place"], None if r["up"] is None else r["up"] & _ALL, r["chars"]) for r in rows], n, support)
                out.append({"host": host, "pages": n, "skeleton": [_signed(t) for t in made.skeleton], "content": _signed(made.content), "texts": [_signed(t) for t in sorted(made.texts)], "repeated": [_signed(t) for t in sorted(made.repeated)]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return map_arrow(gathered, run, _TEMPLATE)


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5, max_bytes: int = 32 << 20
) -> DataFrame:
    """page_id, url, text (main text; empty if none), n_template and n_slots of every row.

    Tokens that share an occurrence vector over a host's pages make up its template; text slots
    of the article that are not part of it are joined by two newlines, a block's white space
    turned into single spaces and character references decoded.

    A null html is empty and has an empty text; empty pages are no pages of their host; a null url
    has the host "" ; null ids and repeated rows stay (each counts as a page); an empty table gives none; other columns are not read. A
    host of one page has no template: then elements and their classes alone tell slots apart.

    Templates reach all tasks only if they measure less than ``max_bytes``; beyond that each
    page meets its host's template in a join.
    """
    made = materialize(templates(pages, id_col, url_col, html_col, support))
    size = 8 * (made.agg(F.sum(F.size("skeleton") + F.size("texts") + F.size("repeated") + 8)).first()[0] or 0)
    source = plain(pages, id_col, url_col, html_col)
    text, long = T.StringType(), T.LongType()
    added = [field("text", text), field("n_template", long), field("n_slots", long)]
    parts = [f.name for f in _TEMPLATE.fields[1:]]

    def arrays(found: list[tuple[str, int, int]]) -> list[pa.Array]:
        return [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]

    if size <= max_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[p] for p in parts) for r in made.collect()})

        def make():
            known = {host: _template(*t) for host, t in sent.value.items()}

            def run(batch: pa.RecordBatch) -> list[pa.Array]:
                at = batch.schema.get_field_index
                both = zip(batch.column(at(url_col)).to_pylist(), batch.column(at(html_col)).to_pylist(), strict=True)
                return arrays([extract(page or "", known.get(host_of(url))) for url, page in both])

            return run

        return map_batches(source, added, make, [id_col, url_col])

    own = made.withColumnsRenamed({f.name: f"__{f.name}" for f in _TEMPLATE.fields})
    joined = source.join(own, _host(url_col) == F.col("__host"), "left")

    def make_joined():
        last: tuple[str | None, Template | None] = (None, None)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal last
            at = batch.schema.get_field_index
            hosts, found = batch.column(at("__host")).to_pylist(), []
            for i, (host, page) in enumerate(zip(hosts, batch.column(at(html_col)).to_pylist(), strict=True)):
                if host != last[0]:
                    last = (host, None if host is None else _template(*[batch.column(at(f"__{p}"))[i].as_py() for p in parts]))
                found.append(extract(page or "", last[1]))
            return arrays(found)

        return run

    return map_batches(joined, added, make_joined, [id_col, url_col])
