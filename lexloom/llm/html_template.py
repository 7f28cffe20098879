"""HTML extraction by equivalence-class template deduction (operator 6).

A page is read as a sequence of tokens: structural tags, differentiated by their path of open
elements, and whole text nodes at their path. Over the pages of a host, each token has an occurrence
vector: how often each page has it. Tokens with equal vectors form an equivalence class; vectors are
compared by an exclusive-or of hashes of (page, count), so they are a partial aggregate and no
host's pages are ever gathered. A class is valid if it has two tokens or more and enough of the
host's pages. Valid classes nest into the host's template: each tag token hangs on the nearest
element above it that is in the template as well; those that every page has once are its frame, in
the order of their mean places.

Where a page's tokens follow the frame, its slots are what lies below the template's elements. The
template says of each slot what it is: text that is a template token itself is the host's; an
element that is a fixture of the host's pages and holds little but links is a menu; one that is a
fixture and is named like an advert or a sidebar is one. What remains is the page's. Elements settle
what the template leaves open: menus, headers, footers, asides, forms and reader comments are never
main text, and where slots lie in articles or mains, those are taken alone.

Text that a host repeats inside its main slots counts as its own only if all of ``SURE_PAGES`` pages
or more have it and it is the lesser part (``LESSER``), so that copies of an article do not take each
other for a template; and a page keeps its slots if nothing else would remain.

Defined results: null or empty html, or html without text, gives the empty text; a page of a host
with few pages, or that does not follow its frame, is read by its own structure alone; unclosed
elements, comments and scripts end with the page; a null url counts as one host; rows with a null or
repeated id are pages like others, one result each; an empty table gives an empty result; columns
other than the three named may have any name.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import lean, pieces
from lexloom.llm.storage import materialise

LEAST_PAGES = 3
LEAST_SHARE = 0.3
SURE_PAGES = 8
LESSER = 0.3
LINKS = 0.6
#: Letters of a path beyond which it goes on from a hash, so that deep pages stay linear.
DEEP = 2000
#: Shares of a page's text above which an element stays although a word of its class, the whole class
#: name, or being a form says otherwise; where reader comments are named as such, no share does.
BY_WORD, BY_NAME, BY_FORM, BY_COMMENT = 0.25, 0.5, 0.5, 1.0
#: Templates with up to this many tokens in all are broadcast; larger ones are joined by host. This
#: changes the cost, not a result.
BROADCAST_TOKENS = 200_000

#: HTML element names by what they mean here.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
OUTSIDE = frozenset("head nav header footer aside dialog menu select button object audio video canvas fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar sidebar side aside footer foot header masthead"
    " comments comment respond disqus cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended recommendations breadcrumb breadcrumbs"
    " newsletter subscribe subscription signup login toolbar pagination pager disclaimer copyright search widget widgets".split()
)
#: Of these, those that say enough as a whole class name where no template is there to confirm them.
STRONG = frozenset("ad ads adv advert adverts advertisement banner sponsored promo sidebar newsletter subscribe related pagination breadcrumb breadcrumbs share sharing social cookie popup".split())
COMMENTS = frozenset("comment comments respond disqus".split())
#: Of reader comments, whole class names or ids.
COMMENT_NAMES = frozenset("comment comments respond disqus disqus_thread comment-list comments-list commentlist comments-area comments-section comment-body comment-content".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

#: An attribute: a quote opens a value only right after the equals sign; anywhere else it is a character
#: like others, and the tag ends at the next angle.
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+))?+)?+"""
_ANY = re.sub(r"\((?![?])", "(?:", _ATTRIBUTE)
_token = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ANY})*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_attribute = re.compile(_ATTRIBUTE, re.S)
_space = re.compile(r"\s+")
_host = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)")


@dataclass(slots=True)
class Doubt:
    """An element outside articles that may not be main text: a form, or one whose class says so. Its
    text decides, when the page is read: it stays if it holds more than ``most`` of the page's text
    and not mostly links. above: the next such element that it is in."""

    most: float
    above: Doubt | None
    chars: int = 0
    linked: int = 0
    gone: bool = False


@dataclass(slots=True)
class Element:
    name: str
    path: str
    above: Element | None
    outside: bool = False  # never main text
    container: int = -1  # number of the article or main that it is in
    named: Element | None = None  # the innermost element inside a container that is named like an advert
    strong: bool = False
    kind: int = 0
    token: int | None = None
    doubt: Doubt | None = None  # the innermost element that its name or being a form makes doubtful

    def lost(self) -> bool:
        return self.doubt is not None and self.doubt.gone

    def hash(self) -> int:
        if self.token is None:
            self.token = token_hash(self.path)
        return self.token


#: What a token is: text, an article or main, named like an advert, in a container, never main text.
TEXT, CONTAINER, NAMED, INSIDE, OUTER = 1, 2, 4, 8, 16


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _space.sub(" ", "".join(self.parts)).strip()


def host_of(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


def _about(attributes: str) -> tuple[str, set[str], set[str], str]:
    """Signature of class and id, their names, the words of these, and the role."""
    if "=" not in attributes and "hidden" not in attributes:
        return "", set(), set(), ""
    found: dict[str, str] = {}
    for m in _attribute.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", named)) - {""}
    role = found.get("role", "").lower()
    if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or "hidden" in found:
        role = "menu"
    if found.get("itemprop", "").lower() == "articlebody":
        role = "article"
    return "." + re.sub(r"\d+", "#", named.strip()) if named.strip() else "", set(named.split()), words, role


class Page:
    """Blocks and tokens of one page."""

    def __init__(self, source: str | None):
        self.blocks: list[Block] = []
        self.tokens: list[tuple[str, Element, int]] = []  # spelled, its element or the one that it is in, kind
        self.containers: list[str] = []
        self._stack = [Element("", "", None)]
        self._doubts: list[Doubt] = []
        self._open: Block | None = None
        self._link = False
        at, source = 0, source or ""
        while m := _token.search(source, at):
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\s*>|\Z", re.I).search(source, at)
                at = end.end() if end else len(source)
                self.tokens.append((f"{self._stack[-1].path}/{name}", self._stack[-1], OUTER))
                continue
            self._start(name, m[3])
        self._text(source[at:])
        self._flush()
        self._settle()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        if self._open is None:
            self._open = Block(self._stack[-1])
        self._open.parts.append(entities.unescape(raw) if "&" in raw else raw)
        if self._link:
            self._open.linked += len(raw)

    def _flush(self) -> None:
        if self._open is not None and (text := self._open.text()):
            self._open.parts = [text]
            self.blocks.append(self._open)
            e = self._open.element
            self.tokens.append((f"{e.path}\t{text}", e, TEXT | (e.kind & (INSIDE | OUTER)) | (INSIDE if e.container >= 0 else 0)))
        self._open = None

    def _start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name == "br":
                self._text(" ")
            elif name == "a":
                self._link = True
            return
        self._flush()
        close = CLOSES.get(name, ("p",) if name in ENDS_P else ())
        while len(self._stack) > 1 and self._stack[-1].name in close:
            self._stack.pop()
        top = self._stack[-1]
        signature, names, words, role = _about(attributes)
        above = top.path if len(top.path) < DEEP else f"#{token_hash(top.path)}"
        e = Element(name, f"{above}/{name}{signature}", top, top.outside, top.container, top.named, top.strong, doubt=top.doubt)
        comment = bool(names & COMMENT_NAMES) and name != "main"
        if (name in ("article", "main") or role in ("article", "main")) and not comment:
            if top.container < 0 or self.containers[top.container].startswith("main"):
                if not any(x.name in OUTSIDE for x in self._stack):
                    e.outside = False
                while e.doubt is not None and e.doubt.most < BY_COMMENT:
                    e.doubt = e.doubt.above
                e.container = len(self.containers)
                self.containers.append(("article" if name == "article" or role == "article" else "main") + e.path)
                e.kind |= CONTAINER
        elif name in OUTSIDE and not (name == "header" and top.container >= 0) or role in ROLES:
            e.outside = True
        elif name in ("html", "body"):
            pass
        elif comment or words & COMMENTS and words <= COMMENTS:
            self._doubted(e, BY_COMMENT)
        elif name == "form" or role == "form":
            self._doubted(e, BY_FORM)
        elif words & WORDS:
            if top.container >= 0:
                e.named, e.strong = e, bool(names & STRONG)
                e.kind |= NAMED
            else:
                self._doubted(e, BY_NAME if names & STRONG else BY_WORD)
        e.kind |= (INSIDE if top.container >= 0 else 0) | (OUTER if e.outside else 0)
        self.tokens.append((e.path, e, e.kind))
        if name not in VOID:
            self._stack.append(e)

    def _doubted(self, e: Element, most: float) -> None:
        e.doubt = Doubt(most, e.doubt)
        self._doubts.append(e.doubt)

    def _settle(self) -> None:
        """Decide what the doubtful elements are, now that their text is known."""
        if not self._doubts:
            return
        page = 0
        for b in self.blocks:
            if not b.element.outside:
                n = len(b.parts[0])
                page += n
                if b.element.doubt is not None:
                    b.element.doubt.chars += n
                    b.element.doubt.linked += min(n, b.linked)
        for d in reversed(self._doubts):  # inner ones come later than those that they are in
            if d.above is not None:
                d.above.chars += d.chars
                d.above.linked += d.linked
        for d in self._doubts:
            own = d.chars <= d.most * page and (d.chars < page or d.most < BY_COMMENT) or d.linked > LINKS * d.chars
            d.gone = own or d.above is not None and d.above.gone
        if not any(not b.element.outside and not b.element.lost() for b in self.blocks):
            for d in self._doubts:  # nothing else is there
                d.gone = False
        self.tokens = [(t, e, kind | OUTER if e.lost() else kind) for t, e, kind in self.tokens]

    def _close(self, name: str) -> None:
        if name in INLINE:
            if name == "a":
                self._link = False
            return
        self._flush()
        self._link = False
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].name == name:
                self.tokens.append((f"{self._stack[k].path}>", self._stack[k], self._stack[k].kind))
                del self._stack[k:]
                return

    def main_text(self, template: Template | None = None) -> str:
        """Main blocks in page order, one to a line."""
        if template is not None and not template.fits(self):
            template = None
        if template is None:
            own = [b for b in self.blocks if not b.element.outside and not b.element.lost() and not (b.element.named and b.element.strong)]
            own = own or [b for b in self.blocks if not b.element.outside and not b.element.lost()]
        else:
            own = [b for b in self.blocks if not b.element.outside and not b.element.lost() and template.slot(b.element) == PAGES]
        slots = [b for b in own if b.element.container >= 0] or own
        if template is not None:
            theirs = [template.sure_texts, template.texts]
            page = [b for b in slots if token_hash(f"{b.element.path}\t{b.parts[0]}") not in theirs[b.element.container < 0]]
            slots = page or slots
        return "\n".join(b.parts[0] for b in slots)


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


#: What the slots below an element of the template are.
PAGES, MENU, ADVERT = 0, 1, 2


@dataclass
class Template:
    """A host's valid classes, nested: the frame in its order, what the slots below each element
    are, and texts that are the host's."""

    frame: list[int]
    slots: dict[int, int]
    texts: frozenset[int]
    sure_texts: frozenset[int]

    def fits(self, page: Page) -> bool:
        """Whether the frame's tokens come once each, in order."""
        rank = {t: i for i, t in enumerate(self.frame)}
        seen = [rank[h] for t, _, _ in page.tokens if (h := token_hash(t)) in rank]
        return len(seen) >= 0.8 * len(rank) and all(a < b for a, b in zip(seen, seen[1:], strict=False))

    def slot(self, element: Element | None) -> int:
        """What the slot is that lies below the nearest element of the template."""
        while element is not None:
            if (found := self.slots.get(element.hash())) is not None:
                return found
            element = element.above
        return PAGES


_MEMBERS = ("vector", "pages", "total", "place", "kind", "above", "chars", "linked")


def _vectors(pages: DataFrame) -> DataFrame:
    """Per host and token: its occurrence vector's hash, pages, total, mean place, kind, the element
    above it, and the characters of text below it, of which some are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found: dict[tuple[str, int], list] = {}
            for page, url, source in zip(batch.column("page").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, read = host_of(url), Page(source)
                counts: dict[str, list] = {}
                for i, (t, e, kind) in enumerate(read.tokens):
                    c = counts.setdefault(t, [0, i, kind, e, 0, 0])
                    c[0] += 1
                for b in read.blocks:
                    n, e = len(b.parts[0]), b.element
                    counts[f"{e.path}\t{b.parts[0]}"][4] += n
                    while e.above is not None:
                        c = counts[e.path]
                        c[4] += n
                        c[5] += min(n, b.linked)
                        e = e.above
                for t, (n, place, kind, e, chars, linked) in counts.items():
                    v = xxhash.xxh64_intdigest(f"{page}:{n}") - (1 << 63)
                    own = e.path == t and e.above is not None
                    f = found.setdefault((host, token_hash(t)), [0, 0, 0, 0.0, kind, (e.above if own else e).hash(), 0, 0])
                    f[0] ^= v
                    f[1] += 1
                    f[2] += n
                    f[3] += place / len(read.tokens)
                    f[6] += chars
                    f[7] += linked
            if found:
                keys, values = list(found), list(found.values())
                for v in values:
                    v[0] -= (1 << 64) if v[0] >= 1 << 63 else 0
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([v[j] for v in values], kind) for j, kind in enumerate(kinds))], names=["host", "token", *_MEMBERS])

    rows = pages.mapInArrow(lean(run), "host string, token long, vector long, pages long, total long, place double, kind int, above long, chars long, linked long")
    sums = (F.sum(c).alias(c) for c in ("pages", "total", "place", "chars", "linked"))
    return rows.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), *sums, F.bit_or("kind").alias("kind"), F.min("above").alias("above"))


def deduce(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """Per host with a template: host, classes: an array of the tokens of its valid equivalence
    classes (see ``_vectors``). Its length is bounded by the tokens of a page."""
    slim = pages.select(F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col)).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    tokens = _vectors(slim)
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    sizes = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("all"))
    common = tokens.where(F.col("pages") >= least_pages).join(sizes, "host").where(F.col("pages") >= least_share * F.col("all"))
    member = F.struct("token", "vector", "pages", "total", (F.col("place") / F.col("pages")).alias("place"), "kind", "above", "chars", "linked")
    classes = common.groupBy("host", "vector", "pages", "total").agg(F.collect_list(member).alias("members")).where(F.size("members") >= 2)
    return classes.groupBy("host").agg(F.flatten(F.collect_list("members")).alias("classes"))


def template_of(classes: list | None, sure_pages: int = SURE_PAGES, lesser: float = LESSER, links: float = LINKS) -> Template | None:
    """The valid classes of a host, nested."""
    if not classes:
        return None
    tags = {c["token"]: c for c in classes if not c["kind"] & TEXT}
    texts = [c for c in classes if c["kind"] & TEXT]
    single = [c for c in tags.values() if c["pages"] == c["total"]]
    most = max((c["pages"] for c in single), default=0)
    frame = sorted((c["place"], c["token"]) for c in single if c["pages"] == most)
    fixed = {c["token"] for c in single}
    slots: dict[int, int] = {}

    def slot(token: int) -> int:
        """An element's own, or that of the one above it in the template."""
        if token not in slots:
            c = tags[token]
            above = slot(c["above"]) if c["above"] in tags and c["above"] != token else PAGES
            few = c["kind"] & CONTAINER or c["linked"] <= links * c["chars"] or c["kind"] & INSIDE and not c["pages"] == most >= sure_pages
            slots[token] = above or (ADVERT if token in fixed and c["kind"] & NAMED else MENU if token in fixed and not few else PAGES)
        return slots[token]

    for token in tags:
        slot(token)
    # in the main slots, only what all pages have, and only if it is the lesser part of them
    main = sum(c["chars"] for c in tags.values() if c["kind"] & CONTAINER and not c["kind"] & INSIDE)
    inner = [c for c in texts if c["kind"] & INSIDE and not c["kind"] & OUTER and c["pages"] == c["total"] == most >= sure_pages]
    sure = inner if sum(c["chars"] for c in inner) <= lesser * main else []
    return Template([t for _, t in frame], slots, frozenset(c["token"] for c in texts if not c["kind"] & INSIDE), frozenset(c["token"] for c in sure))


OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = BROADCAST_TOKENS, **how) -> DataFrame:
    """Per page: id, url, text of the main slots, n_chars."""
    spark = pages.sparkSession
    templates, _ = materialise(deduce(pages, id_col, url_col, html_col, **how), "templates")
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = T.StructType([slim.schema["id"], slim.schema["url"], *OUT.fields])
    small = (templates.agg(F.sum(F.size("classes"))).first()[0] or 0) <= broadcast_tokens
    shared = spark.sparkContext.broadcast({r.host: template_of(r.classes) for r in templates.collect()} if small else {})
    if small:
        source = slim
    else:
        host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
        source = slim.withColumn("host", host).join(templates, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            urls = batch.column("url").to_pylist()
            found = [shared.value.get(host_of(u)) for u in urls] if small else [template_of(c) for c in batch.column("classes").to_pylist()]
            texts = [Page(h).main_text(t) for h, t in zip(batch.column("html").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return source.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)
