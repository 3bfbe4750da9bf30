"""Main text of pages by template deduction over pages of a host.

Every element of a page is a token, the path of block elements that lead to it,
with labels and without; so is every text block, by its path and its words.
Tokens of one host that occur equally often on each of its pages share an
occurrence vector and form an equivalence class.  Vectors are never gathered:
two order-free sums over (page, count) stand for them, so classes come from one
aggregation with partial sums, however many pages a host has, and only tokens
that recur over its pages meet per host.

The class with one occurrence on every page is the root of the template; the
other classes nest in the slots its paths leave.  A text block on half of the
pages is the template's if it occurs equally often on each of those, or as often
as the elements of a class in its slot.  The article's slot is the deepest that
holds most of the text that is not the template's, widened to the article or
main element around it; the template's text in it goes.  An element named by a
listed word (menus, adverts, comments ...) goes only if it recurs on a tenth of
the pages; elements whose tag or role says so always go.  A host of fewer than
SUPPORT pages is read by tags and listed words, and a page that lacks the slot by
its own article or main element, or else by its body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.staging import stage

# Element roles.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option "
    "p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe template svg math object video audio canvas".split())
REJECT_TAGS = set("head nav footer aside form menu dialog button select fieldset".split())
REJECT_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar note".split())
REJECT_WORDS = set(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar related widget share sharing social comment comments reply replies respond disqus discussion pagination pager toolbar footer masthead login signup search skip".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "body": {"head"},
}
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd pre blockquote figure figcaption tr tbody thead tfoot th address details summary".split())
WALLS = set("table ul ol dl article section main body div nav aside select form".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
ARTICLE = re.compile(r"/article(?=[./#]|$)")
MARK = re.compile(r"[.#][^/]*")
NUMBERS = re.compile(r"[\d/]+")


class Element:
    """An open element; `bare` is its path without labels, `left` the depth of the innermost element around it, or itself, whose role is to be left out."""

    __slots__ = ("tag", "path", "bare", "role", "depth", "left", "parent")

    def __init__(self, tag: str, label: str, role: str, rejected: bool, parent: Element | None):
        self.tag, self.role, self.parent = tag, role, parent
        self.path, self.bare, self.depth = (f"{parent.path}/{label}", f"{parent.bare}/{tag}", parent.depth + 1) if parent else ("", "", 0)
        self.left = self.depth if rejected else parent.left if parent else 0


def _label(tag: str, rest: str) -> tuple[str, str, bool]:
    """Token name of an element, without digits (they number pages), the listed words in its class and id, and whether its tag or role is one to leave out."""
    names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in NAMED.finditer(rest)} if rest else {}
    words = {w for k in ("class", "id") for w in PARTS.split(names.get(k, ""))} & REJECT_WORDS if names and tag not in ("html", "body", "main") else ()
    mark = "." + names["class"].split()[0] if names.get("class", "").split() else "#" + names["id"] if names.get("id") else ""
    return tag.replace("/", "") + NUMBERS.sub("", mark)[:40], " ".join(sorted(words)), tag in REJECT_TAGS or names.get("role") in REJECT_ROLES


def parse(html: str, furniture: frozenset | None = None) -> Iterator[tuple[str, Element | None, str, bool]]:
    """("open", element, "", False), ("break", element, "", False) and ("text", element, decoded text, inside a link) in page order; never fails.

    Listed words reject an element if it is among `furniture`, or if there is none to ask.
    """
    stack = [Element("", "", "", False, None)]
    links, place, n = 0, 0, len(html)
    while place < n:
        m = MARKUP.search(html, place)
        upto = m.start() if m else n
        if upto > place:
            yield "text", stack[-1], unescape(html[place:upto]), links > 0
        if not m:
            return
        place = m.end()
        if m[0].startswith("<![CDATA["):
            yield "text", stack[-1], m[0][9:].removesuffix("]]>"), links > 0
            continue
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if m["end"] or m["end2"]:
            if tag == "a":
                links = max(0, links - 1)
            if any(e.tag == tag for e in stack[1:]):
                yield "break", stack[-1], "", False
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, place)
            place = end.end() if end else n
            continue
        if tag == "br":
            yield "text", stack[-1], " ", False
            continue
        label, words, rejected = _label(tag, rest)
        if tag == "a":
            links += 1
        if tag in BLOCKS:
            yield "break", stack[-1], "", False
            if stack[-1].tag == "p":
                stack.pop()
            shut = CLOSES.get(tag, ())
            depth = len(stack) - 1
            while depth > 0 and stack[depth].tag not in shut and stack[depth].tag not in WALLS:
                depth -= 1
            if depth > 0 and stack[depth].tag in shut:
                del stack[depth:]
                while len(stack) > 1 and stack[-1].tag in shut:
                    stack.pop()
        if tag in VOID or rest.endswith("/"):
            continue
        role = f"{stack[-1].bare}/{tag}:{words}" if words else ""
        rejected = rejected or (bool(words) and (furniture is None or role in furniture))
        if tag in BLOCKS or rejected:
            stack.append(Element(tag, label, role, rejected, stack[-1]))
            yield "open", stack[-1], "", False


def host_of(url: str | None) -> str:
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


def _runs(html: str, furniture: frozenset | None = None) -> Iterator[tuple[Element, str | None, int]]:
    """(element, None, 0) where one opens, (element, text, characters outside links) for a run of its text, in page order."""
    part, plain, at = [], 0, None
    for what, e, text, linked in parse(html, furniture):
        if what == "text":
            part.append(text)
            plain += 0 if linked else len("".join(text.split()))
            at = e
            continue
        if part:
            yield at, "".join(part), plain
            part, plain = [], 0
        if what == "open":
            yield e, None, 0
    if part:
        yield at, "".join(part), plain


def _role(e: Element) -> bool:
    """Whether a token counts as left out; an article is judged by itself, whatever its wrappers are called."""
    return e.left == e.depth if e.tag in ("article", "main") else e.left > 0


def _digest(e: Element, text: str) -> int:
    """Token of a text block, 0 for blank text: the path of its element without labels, and its words."""
    words = " ".join(text.split())
    return xxhash.xxh64_intdigest(f"{e.bare} {words}") >> 1 if words else 0


def _tokens(html: str) -> dict[str, list]:
    """Of each token: occurrences, characters outside links in it and below, whether all of it is left out, its tag, a path where it is, depth of what leaves it out.

    Tokens are paths, paths without labels (marked *), elements with listed words
    (marked !), and text blocks (marked =).  The page itself is the empty path.
    """
    found: dict[str, list] = {"": [1, 0, False, "", None, 0]}
    for e, text, plain in _runs(html):
        if text is None:
            for key in (e.path, "*" + e.bare, *(("!" + e.role,) if e.role else ())):
                t = found.setdefault(key, [0, 0, True, e.tag, None, 0])
                t[0] += 1
                t[2] &= _role(e)
            continue
        if e.parent and (digest := _digest(e, text)):
            t = found.setdefault(f"={digest}", [0, 0, False, "", e.path, e.left])
            t[0] += 1
            t[1] += plain
        if plain:
            left = e.left
            while e.parent:
                if left <= e.depth:
                    found[e.path][1] += plain
                    found["*" + e.bare][1] += plain
                e = e.parent
            if not left:
                found[""][1] += plain
    return found


TOKEN_SCHEMA = "host string, path string, tag string, rejected boolean, pages bigint, least bigint, most bigint, v1 bigint, v2 bigint, plain bigint, at string, left bigint"
RECURS = 10  # tokens on less than one in so many of a host's pages are not looked at
SUPPORT = 5  # fewer pages are no evidence that a text belongs to the template; tags and words decide there


def occurrence_vectors(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): pages with the token, its fewest and most occurrences, two sums that stand for its occurrence vector, and the text below it."""

    def work(batches):
        for batch in batches:
            sums: dict[tuple, list] = {}
            for i, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                host, drawn = host_of(url), {}
                for path, (count, plain, rejected, tag, at, left) in _tokens(html or "").items():
                    if count not in drawn:
                        drawn[count] = [xxhash.xxh64_intdigest(f"{i}:{count}", seed=s) >> 32 for s in (1, 2)]
                    a, b = drawn[count]
                    s = sums.setdefault((host, path, tag), [rejected, 0, count, count, 0, 0, 0, at, left])
                    s[:] = [s[0] and rejected, s[1] + 1, min(s[2], count), max(s[3], count), s[4] + a, s[5] + b, s[6] + plain, min(s[7] or "", at or "") or None, min(s[8], left)]
            rows = [(*k, *v) for k, v in sums.items()]
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in TOKEN_SCHEMA.split(", ")]), preserve_index=False)

    each = pages.select(id_col, url_col, html_col).mapInArrow(work, TOKEN_SCHEMA)
    return each.groupBy("host", "path", "tag").agg(
        F.min("rejected").alias("rejected"), F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"), F.sum("plain").alias("plain"),
        F.min("at").alias("at"), F.min("left").alias("left"),
    )


def recurring(vectors: DataFrame) -> DataFrame:
    """Tokens of hosts of several pages that are on several of them and on one in RECURS at least: no more than RECURS times the tokens of a page, however many pages a host has."""
    several = stage(vectors.where("pages > 1"), "page-tokens")
    return several.join(several.where("path = ''").select("host", F.col("pages").alias("n")), "host").where(F.col("pages") * RECURS >= F.col("n"))


def _below(at: str, path: str) -> bool:
    if path[:1] == "*":
        at, path = MARK.sub("", at), path[1:]
    return at == path or at.startswith(path + "/")


def _by_tag(kept: pd.DataFrame, roots: set[str], n: int) -> str:
    """Path of the article, or else main, on most pages; empty if half of the pages have none."""
    for tag in ("article", "main"):
        some = kept[(kept.tag == tag) & (kept.pages * 2 >= n)]
        if len(some):
            return min((-p, q not in roots, q[0] == "*", -m, q.count("/"), q) for p, m, q in zip(some.pages, some.plain, some.path))[-1]
    return ""


def _widest(paths, masses, total: int) -> str:
    """The deepest path with 70% of the text; of two at one depth, the one with labels."""
    return max(((q.count("/"), q[0] != "*", q) for q, m in zip(paths, masses) if total and m * 10 >= total * 7), default=("",))[-1]


def _by_text(kept: pd.DataFrame, static: pd.DataFrame, total: int, n: int, tagged: str) -> str:
    """Path of the slot with the text that is not the template's, widened to the article or main around it; empty if there is no such text."""
    some = kept[(kept.most == 1) & (kept.pages * 2 >= n) & ~kept.tag.isin(TEXTUAL)]
    fixed = list(zip(static["at"], static.left, static.plain))
    mass = {q: m - sum(c for at, left, c in fixed if left <= q.count("/") and _below(at, q)) for q, m in zip(kept.path, kept.plain)}
    main = _widest(some.path, map(mass.get, some.path), total - sum(c for _, left, c in fixed if not left))
    around = next((m for m in (re.match(rf".*?/{tag}(?=[./#]|$)[^/]*", main) for tag in ("article", "main")) if m), None)
    if around:
        return around[0]
    return tagged if main and tagged and mass[tagged] * 2 >= mass[main] else main


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of one host, nested into its template, the path of the slot with the article, and what is the template's in it."""
    n, total = int(rows["n"].iloc[0]), int(rows.plain[rows.path == ""].sum())
    host, rows = rows.host.iloc[0], rows[rows.path != ""].sort_values("path", ignore_index=True)
    texts, roles, rows = rows[rows.path.str.startswith("=")], rows[rows.path.str.startswith("!")], rows[rows.path.str.match(r"[/*]")]
    once = rows[(rows.pages == n) & (rows.least == 1) & (rows.most == 1)]
    labelled = rows[rows.path.str.startswith("/")]
    roots = set(once.path)

    def slot(path: str) -> str:
        while path and path not in roots:
            path = path.rpartition("/")[0]
        return path

    nested, classes = 0, set()
    for key, same in labelled[~labelled.path.isin(roots)].groupby(["pages", "v1", "v2"]):
        slots = {slot(p) for p in same.path}
        nested += len(slots) == 1
        classes |= {(key, s) for s in slots}  # a class over several slots counts as one in each
    kept = rows[~rows.rejected.astype(bool)]
    main = _by_tag(kept, roots, n)
    if n >= SUPPORT:
        # Texts on half of the pages: as often on each as on the other, or as often as the elements of a class in their slot.
        texts = texts[(texts.pages >= SUPPORT) & (texts.pages * 2 >= n)]
        valid = [a == b or ((p, v, w), slot(at)) in classes for a, b, p, v, w, at in zip(texts.least, texts.most, texts.pages, texts.v1, texts.v2, texts["at"])]
        texts = texts[pd.Series(valid, texts.index, dtype=bool)]
        main = _by_text(kept, texts, total, n, main) or main
    else:
        texts = texts[:0]
    if not main:
        some = kept[kept.path.isin(roots)]
        main = _widest(some.path, some.plain, total)
    return pd.DataFrame({
        "host": [host], "main": [main], "pages": [n], "root_tokens": [sum(p[0] == "/" for p in roots)], "nested_classes": [nested],
        "texts": [[int(p[1:]) for p in texts.path]], "furniture": [[p[1:] for p in roles.path] if n >= SUPPORT else None],
    })


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host of several pages: path of the article's slot (empty if none stands out), pages, tokens in the root class, valid nested classes, text blocks of the template, and elements with listed words that recur (null if pages are too few to tell).

    What meets in one group is the recurring tokens of a host, not its pages or their own paths.
    """
    met = recurring(occurrence_vectors(pages, id_col, url_col, html_col))
    return met.groupBy("host").applyInPandas(_template, "host string, main string, pages bigint, root_tokens bigint, nested_classes bigint, texts array<bigint>, furniture array<string>")


def _within(e: Element, slot: str) -> bool:
    path, slot = (e.bare, slot[1:]) if slot[:1] == "*" else (e.path, slot)
    return path == slot or path.startswith(slot + "/")


def _own(runs: list, slot: str) -> str:
    """Path without labels of the page's own article, or else main, with the most text in the slot; empty if that is not half of what is in the slot."""
    depth, inside = slot.count("/"), 0
    own: dict[str, dict[str, int]] = {"article": {}, "main": {}}
    for e, text, _ in runs:
        size = len(text) - text.count(" ") if text else 0
        if not size or not _within(e, slot):
            continue
        inside += size if e.left <= depth else 0
        left, outer = e.left, {}
        while e.depth > depth:
            if e.tag in own and left <= e.depth and e.left != e.depth:
                outer[e.tag] = e.bare
            e = e.parent
        for tag, path in outer.items():
            own[tag][path] = own[tag].get(path, 0) + size
    for found in own.values():
        best = max(found, key=lambda k: (found[k], k), default="")
        if best and found[best] * 2 >= inside:
            return "*" + best
    return ""


def _slot_text(runs: list, slot: str, texts: frozenset) -> str:
    """Text in the slot without that of the template; all of it where nothing else is (copies of one page)."""
    depth = slot.count("/")
    held = [(e, text) for e, text, _ in runs if text and e.left <= depth and _within(e, slot)]
    for some in ([(e, t) for e, t in held if _digest(e, t) not in texts] if texts else held, held):
        blocks = [b for b in (" ".join(t.split()) for _, t in some) if b]
        if blocks:
            return "\n".join(blocks)
    return ""


def main_text(html: str, main: str, texts: frozenset = frozenset(), furniture: frozenset | None = None) -> str:
    """Text of the slot at path `main`, or of the page's own article in it, without the template's `texts`; blocks are joined by a line feed."""
    runs = list(_runs(html, furniture))
    whole = main and not ARTICLE.search(main)
    for slot in filter(None, (_own(runs, main) if whole else "", main, _own(runs, ""))):
        found = _slot_text(runs, slot, texts)
        if found:
            return found
    return _slot_text(runs, "", texts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null or empty html gives an empty text; pages with a null url are one host;
    repeated pages and null ids get a row each; an empty table gives none;
    broken markup is read as far as it goes; other columns are not read.
    """
    found = stage(templates(pages, id_col, url_col, html_col).select("host", "main", "texts", "furniture"), "page-templates")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#]*)", 1))
    met = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host")).join(found, "host", "left")

    def work(batches):
        for batch in batches:
            held = zip(*(batch.column(c).to_pylist() for c in ("html", "main", "texts", "furniture")))
            texts = [main_text(h or "", m or "", frozenset(t or ()), None if f is None else frozenset(f)) for h, m, t, f in held]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    out = met.select("id", "url", "html", "main", "texts", "furniture").mapInArrow(work, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
