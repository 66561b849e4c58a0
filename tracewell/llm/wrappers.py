"""Main text of web pages through wrappers inferred per host (operator 6).

The token streams of a host's pages are folded and aligned into one union-free regular expression:
repeats become groups, parts that some pages lack become optional, and text that differs becomes a
slot. Pages are not matched against that expression: lists of element, class and id names decide which
of a page's paths hold the article, less the words that nearly all pages of the host share.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracewell.llm.common import batch_of

SALT = 32
HELD_WRAPPERS = 20_000
# A frame is on this part of a host's distinct pages, at least so many.
NEARLY_ALL = 0.9
STORIES = 4
LONGEST_REPEAT = 24

# Elements inside a line of text, elements without an end, elements whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|textarea|template|iframe|svg|select|object|math|canvas|title"
# Elements beside the article, and words of class and id names that say the same.
BESIDE = frozenset("nav header footer aside form button menu dialog head title select noscript script style".split())
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond "
    "disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget "
    "pagination pager toolbar copyright legal disclaimer".split())
OWN_HEADER = frozenset("article entry post story content".split())
#: An element of this kind ends an open one of the same kind.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = frozenset("article aside blockquote body button div fieldset figure footer form header html main nav ol section table td th ul dl".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("text", characters), ("+", element), ("-", name), ("=", name of an element without content)."""
    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            yield "text", page[at:found.start()]
        at = found.end()
        name = found["name"]
        if name is None:
            if found["raw"]:
                yield "=", found["raw"].lower()
            continue
        name = name.lower()
        if found["end"]:
            yield "-", name
        elif name in VOID:
            yield "=", name
        else:
            own = [f"{'#' if m[1].lower() == 'id' else '@' if m[1].lower() == 'role' else '.'}{w}" for m in NAMED.finditer(found["rest"])
                   for w in (m[2] or m[3] or m[4] or "").lower().split()] if found["rest"] else []
            yield "+", name + "".join(sorted(own))
    if at < len(page):
        yield "text", page[at:]


def element_name(element: str) -> str:
    return re.split(r"[.#@]", element, maxsplit=1)[0]


class Elements:
    """The open elements while a stream is read; missing ends are supplied as a browser would."""

    def __init__(self):
        self.open: list[tuple[str, str]] = []
        self.path: tuple[str, ...] = ()

    def _pop(self, place: int) -> None:
        del self.open[place:]
        self.path = tuple(e for _, e in self.open)

    def start(self, element: str) -> None:
        name = element_name(element)
        if name in INLINE and name != "a":
            return
        ended = CLOSES.get(name, ()) + (("p",) if name in ENDS_PARAGRAPH else ())
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] in ended:
                self._pop(place)
                break
            if self.open[place][0] in HOLDS:
                break
        self.open.append((name, element))
        self.path += (element,)

    def end(self, name: str) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place][0] == name:
                self._pop(place)
                return


# Wrapper nodes [kind, value, optional]: "T" a text slot, "E" a token, "+" a repeated group of nodes.

def shape(nodes: list) -> str:
    """The wrapper written out; equal shapes are equal wrappers."""
    def one(node: list) -> str:
        kind, value, optional = node
        return ("T" if kind == "T" else value if kind == "E" else f"({shape(value)})+") + "?" * optional

    return " ".join(map(one, nodes))


def _key(node: list) -> str:
    """What aligns: slots with slots, equal tokens, groups that begin alike."""
    kind, value, _ = node
    return "T" if kind == "T" else value if kind == "E" else "(" + (_key(value[0]) if value else "")


def folded(page: str) -> list:
    """The page as a wrapper of its own: adjacent repeats become groups, the shortest first.

    A lone occurrence of what is repeated elsewhere on the page is that group too.
    """
    letters: dict[str, str] = {}
    nodes: dict[str, list] = {}
    groups: dict[str, str] = {}

    def letter(key: str, node: list) -> str:
        if key not in letters:
            letters[key] = chr(0xF0000 + len(letters))
            nodes[letters[key]] = node
        return letters[key]

    def group(found: re.Match) -> str:
        inner = found[1]
        if len(inner) == 1 and nodes[inner][0] == "+":
            return inner
        groups[inner] = letter(f"({inner})+", ["+", [nodes[c] for c in inner], False])
        return groups[inner]

    line = []
    for kind, value in tokens(page):
        if kind == "text":
            if value.strip() and (not line or line[-1] != letter("T", ["T", None, False])):
                line.append(letter("T", ["T", None, False]))
        elif kind == "=" or not (element_name(value) in INLINE and element_name(value) != "a"):
            line.append(letter(kind + value, ["E", kind + value, False]))
    stream, before = "".join(line), ""
    while stream != before:
        before = stream
        stream = re.sub(rf"(?s)(.{{1,{LONGEST_REPEAT}}}?)\1+", group, stream)
        for inner, own in groups.items():
            stream = stream.replace(inner, own)
    return [nodes[c] for c in stream]


def _grouped(nodes: list, groups: list[list]) -> list:
    """Lone runs of a repeated group's nodes written as the group."""
    keys = [_key(n) for n in nodes]
    for group in groups:
        inner = [_key(n) for n in group[1]]
        at = 0
        while len(inner) > 1 and at + len(inner) <= len(keys):
            if keys[at:at + len(inner)] == inner:
                nodes[at:at + len(inner)] = [["+", merged(group[1], nodes[at:at + len(inner)]), False]]
                keys[at:at + len(inner)] = [_key(group)]
            at += 1
    return nodes


def merged(left: list, right: list) -> list:
    """Align two wrappers of a host; the result accepts the pages of both.

    A mismatch of a group and a lone run becomes the group, all others become optional.
    """
    if left == right:
        return left
    left, right = (_grouped(list(mine), [n for n in other if n[0] == "+"]) for mine, other in ((left, right), (right, left)))
    out: list = []
    for kind, a, b, c, d in SequenceMatcher(None, [_key(n) for n in left], [_key(n) for n in right], autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(left[a:b], right[c:d]):
                out.append([x[0], merged(x[1], y[1]) if x[0] == "+" else x[1], x[2] or y[2]])
        else:
            out += [[n[0], n[1], True] for n in (*left[a:b], *right[c:d])]
    return out


def expression(nodes: list, letter) -> str:
    """The wrapper as a regular expression over one letter per token."""
    def one(node: list) -> str:
        kind, value, optional = node
        inner = re.escape(letter("T" if kind == "T" else value)) if kind in "TE" else f"(?:{expression(value, letter)})+"
        return f"(?:{inner})?" if optional else inner

    return "".join(map(one, nodes))


def beside(element: str) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, comments: by the element or its names."""
    name = element_name(element)
    if name in BESIDE:
        return True
    words = set(re.split(r"[^a-z0-9]+", element[len(name):]))
    return bool(words & BESIDE_WORDS) or "header" in words and not words & OWN_HEADER or bool(words & {"contentinfo", "complementary"})


def _is_main(element: str) -> bool:
    return element_name(element) in ("article", "main") or "@main" in element


def slot_kind(path: tuple[str, ...]) -> str:
    """Where a slot lies: main, main within a side element (inner), body, body within a container
    that only its names call a side element (rest), or beside."""
    place = next((k for k, e in enumerate(path) if _is_main(e)), None)
    if place is None:
        if any(element_name(e) in BESIDE for e in path):
            return "beside"
        return "rest" if any(map(beside, path)) else "body"
    if any(map(beside, path[place:])):
        return "beside"
    return "inner" if any(map(beside, path[:place])) else "main"


def _digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def _read(page: str) -> tuple[list[tuple[tuple[str, ...] | None, str]], bool]:
    """The page's texts with their paths, a space without path at each element's edge, and whether it has a main element."""
    elements, pieces = Elements(), []
    has_main = False
    for kind, value in tokens(page):
        if kind == "text":
            pieces.append((elements.path, value))
        else:
            if kind == "+":
                elements.start(value)
                has_main = has_main or _is_main(value) and slot_kind(elements.path) == "main"
            elif kind == "-":
                elements.end(value)
            if element_name(value) not in INLINE:
                pieces.append((None, " "))
    return pieces, has_main


def _words(pieces: list[tuple[tuple[str, ...] | None, str]]) -> dict[tuple[str, ...], str]:
    """The words at each path of the body."""
    found: dict[tuple[str, ...], list[str]] = {}
    for path, value in pieces:
        if path is not None and value.strip():
            found.setdefault(path, []).append(value)
    return {path: " ".join(" ".join(own).split()) for path, own in found.items() if slot_kind(path) == "body"}


Words = dict[str, tuple[str, int, int]]


def words_of(page: str) -> Words:
    """(digest, pages, characters) of the words at each path of a page's body, of all its body at the empty path.

    Nothing for a page with a main element, whose body is not read.
    """
    pieces, has_main = _read(page)
    own = {} if has_main else _words(pieces)
    if not own:
        return {}
    return {" ".join(path): (_digest(text), 1, len(text)) for path, text in own.items()} | {
        "": (_digest(json.dumps([[" ".join(path), text] for path, text in own.items()])), 1, sum(map(len, own.values())))}


def frame_of(words: Words) -> dict[str, str]:
    """Paths of a host's frame and the digest of the words there, from counts over its distinct pages.

    A frame is on nearly all of at least ``STORIES`` different pages in the same words and is not the
    larger part of their text: where it is, the pages are near copies and the equal part is the story.
    """
    _, pages, characters = words.get("", ("", 0, 0))
    same = {path: own for path, own in words.items() if path and own[1] >= NEARLY_ALL * pages}
    if pages < STORIES or 2 * sum(own[2] for own in same.values()) > characters:
        return {}
    return {path: own[0] for path, own in same.items()}


def slots_of(wrapper: list) -> set[tuple[str, ...]]:
    """Paths of the wrapper's text slots."""
    found: set[tuple[str, ...]] = set()
    elements = Elements()

    def walk(nodes: list) -> None:
        for kind, value, _ in nodes:
            if kind == "T":
                found.add(elements.path)
            elif kind == "+":
                walk(value)
            elif value[0] == "+":
                elements.start(value[1:])
            elif value[0] == "-":
                elements.end(value[1:])

    walk(wrapper)
    return found


def plan_of(wrapper: list, words: Words) -> dict[str, str]:
    """The kind of each slot by its path; for paths of the host's frame "frame" and the digest of its words.

    Outside an article links are left out, and so are words that are the same on nearly all pages.
    """
    return {" ".join(path): _read_kind(path) for path in slots_of(wrapper)} | {path: f"frame {digest}" for path, digest in frame_of(words).items()}


def _read_kind(path: tuple[str, ...]) -> str:
    kind = slot_kind(path)
    return "beside" if kind in ("body", "rest") and any(element_name(e) == "a" for e in path) else kind


def text_of(page: str, plan: dict[str, str]) -> str:
    """The words of the page's article slots.

    A page with a main element has only that. Without one the body counts, or a main element found
    within a side element if that holds more; containers that only their names call side elements
    are the last resort. The page's own paths count whether or not the plan has them: in a wrapper
    whose optional parts exclude each other a slot's path need not be any page's.
    """
    pieces, has_main = _read(page)
    words = {} if has_main else _words(pieces)
    own = {path for path, value in pieces if path is not None and value.strip()}

    def kind_of(path: tuple[str, ...]) -> str:
        kind = _read_kind(path)
        around = tuple(e for e in path if element_name(e) != "a")
        if kind == "beside" and around != path:
            # A slot within a link belongs to the text around it.
            path, kind = around, _read_kind(around) if around in own or plan.get(" ".join(around), "beside") != "beside" else "beside"
        # Only the very words of the frame are left out.
        framed = kind == "body" and path in words and plan.get(" ".join(path)) == f"frame {_digest(words[path])}"
        return "beside" if framed else kind

    kinds = {path: kind_of(path) for path in {path for path, _ in pieces if path is not None}}
    parts = {"main": [], "inner": [], "body": [], "rest": []}
    for path, value in pieces:
        if path is None:
            for part in parts.values():
                part.append(value)
        elif kinds[path] != "beside":
            parts[kinds[path]].append(entities.unescape(value))
    main, inner, body, rest = (" ".join("".join(part).split()) for part in parts.values())
    return main if has_main else max(body, inner, key=len) or rest


def _joined(own: list[list]) -> list:
    """All wrappers of a host in one, the longest first so that short pages meet a full frame."""
    wrapper, *others = sorted(own, key=lambda x: (-len(x), shape(x)))
    for other in others:
        wrapper = merged(wrapper, other)
    return wrapper


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task one wrapper of each host, given out early when there are many."""
    held: dict[str, dict[str, list]] = {}

    def give() -> pa.RecordBatch:
        rows = [(host, _joined(list(own.values()))) for host, own in held.items()]
        return batch_of({"host": (pa.string(), [r[0] for r in rows]), "wrapper": (pa.string(), [json.dumps(r[1]) for r in rows])})

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = folded(page)
            shapes = held.setdefault(host, {})
            shapes[shape(own)] = own
            if len(shapes) > 64:
                whole = _joined(list(shapes.values()))
                held[host] = {shape(whole): whole}
        if len(held) > HELD_WRAPPERS:
            yield give()
            held.clear()
    if held:
        yield give()


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, page, path, digest, characters) of the body words of pages without a main element."""
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(page)
            rows += [(host, words[""][0], path, digest if path else "", n) for path, (digest, _, n) in words.items()]
        yield batch_of({name: (kind, [r[k] for r in rows]) for k, (name, kind) in enumerate(
            [("host", pa.string()), ("page", pa.string()), ("path", pa.string()), ("digest", pa.string()), ("characters", pa.int64())])})


def frames(held: DataFrame) -> DataFrame:
    """Rows (host, words as JSON) from columns host and html: for each path the words on nearly all distinct pages of the host."""
    spoken = held.mapInArrow(_spoken, "host string, page string, path string, digest string, characters long").distinct()
    counted = spoken.groupBy("host", "path", "digest").agg(F.count("*").alias("pages"), F.sum("characters").alias("characters"))
    whole = counted.where("path = ''").select("host", F.col("pages").alias("all pages")).where(F.col("all pages") >= STORIES)
    often = counted.join(whole, "host").where(F.col("pages") >= NEARLY_ALL * F.col("all pages"))

    @F.arrow_udf("string")
    def told(own: pa.Array) -> pa.Array:
        return pa.array([json.dumps({x["path"]: (x["digest"], x["pages"], x["characters"]) for x in row}) for row in own.to_pylist()], pa.string())

    return often.groupBy("host").agg(F.collect_list(F.struct("path", "digest", "pages", "characters")).alias("own")).select("host", told("own").alias("words"))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, wrapper, words as JSON): one wrapper over all pages of each host, and the words that most of its pages share.

    Pages are aligned within their tasks first, so a host with many pages sends one wrapper per task.
    """
    def joined(group: pa.Table) -> pa.Table:
        return pa.table({"host": group.column("host").slice(0, 1), "wrapper": [json.dumps(_joined([json.loads(w) for w in group.column("wrapper").to_pylist()]))]})

    held = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    wrappers = held.mapInArrow(_inferred, "host string, wrapper string").groupBy("host").applyInArrow(joined, "host string, wrapper string")
    return wrappers.join(frames(held), "host", "left").withColumn("words", F.coalesce("words", F.lit("{}")))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages with their main text in ``out_col``; an earlier column of that name is replaced.

    NULL and empty html give an empty text. Pages without a host in their url share one wrapper.
    Wrappers are sent to ``SALT`` parts of each host, so a host with many pages is spread.
    """
    @F.arrow_udf("string")
    def plans(wrapper: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([json.dumps(plan_of(json.loads(w), json.loads(d))) for w, d in zip(wrapper.to_pylist(), words.to_pylist())], pa.string())

    @F.arrow_udf("string")
    def texts(html: pa.Array, plan: pa.Array) -> pa.Array:
        read: dict[str, dict] = {}
        out = []
        for page, own in zip(html.to_pylist(), plan.to_pylist()):
            if len(read) > 4096:
                read.clear()
            if own not in read:
                read[own] = json.loads(own)
            out.append(text_of(page, read[own]) if page else "")
        return pa.array(out, pa.string())

    host, part, plan = "wrapper host", "wrapper part", "wrapper plan"
    wrappers = infer(pages, url_col, html_col).select(F.col("host").alias(host), plans("wrapper", "words").alias(plan)) \
        .withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    held = pages.drop(out_col).withColumn(host, host_of(F.col(url_col))).withColumn(
        part, F.pmod(F.xxhash64(F.coalesce(url_col, F.lit("")), F.length(html_col)), F.lit(SALT)).cast("int"))
    return held.join(wrappers, [host, part], "left").withColumn(out_col, texts(F.col(html_col), F.coalesce(plan, F.lit("{}")))).drop(host, part, plan)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
