"""Main text of web pages by removal of site templates.

Each page is read once into blocks of text and a tree of elements with a hash of
every subtree.  Spark counts on how many pages of a host each subtree occurs;
pages with the same article count once, so that copies of an article do not make
it a template.  Subtrees on many pages are deleted; prose inside an article may be
a passage that articles rightly share, so it goes only if it stands on most pages of
its host.  What lies outside the article, or in an element marked as a menu, notice,
advert and the like, goes too, since such parts often differ from page to page; a
mark by class or id never cuts the article, nor what holds most of a page without one.
Only pages whose article lies in an element that may be a template wait for the counts.
"""

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilframe.llm import common

MIN_PAGES = 5             # a template is on at least so many different pages of its host
MIN_SHARE = 0.01          # and on this share of them
PROSE_PAGES, PROSE_SHARE = 10, 0.5      # prose of an article is a template on at least so many pages, and on this share of them
SALT = 16                 # parts into which the pages of one subtree are dealt

#: Elements whose text nobody reads as text.
RAW = set("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
CUT = RAW | set("head nav footer aside form button select option datalist dialog menu object audio video canvas map label fieldset".split())
CUT_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
#: Words of class and id that mark what is not the article.
CUT_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices notification alert newsletter subscribe subscription signup sidebar widget widgets related recommended share sharing social breadcrumb
breadcrumbs menu nav navbar navigation footer masthead comment comments commentlist reply replies respond disqus popup modal overlay login
pagination pager toolbar skip""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub
sup time tt u var wbr br""".split())
#: Elements that hold prose.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead caption figcaption figure".split()) | INLINE
WHOLE = {"html", "body", "article", "main"}
#: What may stand in a head; all else ends it.
IN_HEAD = set("head base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = set("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu
nav ol p pre section table ul""".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
              "option": ("select",), "p": ("table", "td", "th", "button", "object")}

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))""", re.S)
_MARK = re.compile(r"""(?:^|[\s/"'])(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_MASK = (1 << 64) - 1
_IN_CUT, _IN_ARTICLE, _IN_MAIN, _IN_HEADER, _IN_HEADING = 1, 2, 4, 8, 16


class _Page:
    """Elements (parent, subtree hash, flags) and blocks (text, innermost element) of one page."""

    def __init__(self, text: str):
        self.parent, self.hash, self.name, self.flags = [-1], [0], ["#"], [0]
        self.blocks: list[tuple[str, int]] = []
        self.marked: list[int] = []
        self.at, self.open, self.count = 0, [0], {}
        self.parts: list[str] = []
        end = 0
        raw = ""
        raw_end = None
        for m in iter(lambda: (raw_end or _TAG).search(text, end), None):
            if raw:                                     # up to the end of a script or the like
                end, raw, raw_end = m.start(), "", None
                continue
            self._text(text[end:m.start()])
            end = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self._close(name)
            else:
                self._start(name, m[3])
                if name in RAW and not m[3].endswith("/"):
                    raw, raw_end = name, re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I)
        if not raw:
            self._text(text[end:])
        self._break()
        while len(self.open) > 1:
            self._pop()
        self._cut_marked()

    def _text(self, text: str) -> None:
        if text:
            if self.count.get("head") and not text.isspace():
                self._end_head()
            self.parts.append(html.unescape(text))

    def _break(self) -> None:
        """End of a block: its text goes to the innermost element and into the hashes."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((text, self.at))
                self._mix(self.at, xxhash.xxh64_intdigest(_DIGITS.sub("0", text)))

    def _mix(self, element: int, value: int) -> None:
        h = (self.hash[element] * 0x9E3779B97F4A7C15 + value + 1) & _MASK
        self.hash[element] = h ^ (h >> 29)

    def _end_head(self) -> None:
        while self.count.get("head"):
            self._close("head")

    def _start(self, name: str, attributes: str) -> None:
        if name not in IN_HEAD:
            self._end_head()
        if name == "br":
            self.parts.append(" ")
        if name in VOID:
            if name == "hr":
                self._break()
            return
        if name in CLOSES_P and self.count.get("p"):
            self._close_in_scope(("p",), KEEPS_OPEN["p"])
        if name in CLOSES_SAME:
            self._close_in_scope(CLOSES_SAME[name], KEEPS_OPEN[name])
        flags = self.flags[self.at]
        marks = {k.lower(): (a or b or c).lower() for k, a, b, c in _MARK.findall(attributes)} if attributes else {}
        words = set(_WORD.split(f"{marks.get('class', '')} {marks.get('id', '')}")) if marks else ()
        role = marks.get("role", "")
        inner = flags & (_IN_ARTICLE | _IN_MAIN)
        cut = name in CUT or role in CUT_ROLES or "hidden" in marks or marks.get("aria-hidden") == "true" or name == "header" and not inner
        named = CUT_WORDS.intersection(marks.get("class", "").split()) if name == "article" else name not in WHOLE and CUT_WORDS.intersection(words)
        flags |= _IN_CUT * cut | _IN_ARTICLE * (not named and name == "article" or marks.get("itemprop") == "articlebody") | _IN_MAIN * (name == "main" or role == "main") \
            | _IN_HEADER * (name == "header") | _IN_HEADING * (name in HEADINGS)
        cut = cut or bool(named)
        if name in INLINE and not cut and not self.count.get(name):
            return                                      # part of its block
        self._break()
        self.parent.append(self.at), self.hash.append(xxhash.xxh64_intdigest(f"{name} {marks.get('class', '')}")), self.name.append(name)
        self.flags.append(flags)
        self.at = len(self.parent) - 1
        if named and not flags & _IN_CUT:
            self.marked.append(self.at)
        self.open.append(self.at)
        self.count[name] = self.count.get(name, 0) + 1

    def _close_in_scope(self, names: tuple[str, ...], walls: tuple[str, ...]) -> None:
        if any(self.count.get(n) for n in names):
            for e in reversed(self.open):
                if self.name[e] in names:
                    self._close(self.name[e])
                    return
                if self.name[e] in walls:
                    return

    def _close(self, name: str) -> None:
        if self.count.get(name):
            self._break()
            while self.name[self.open[-1]] != name:
                self._pop()
            self._pop()
        elif name == "p":
            self._break()

    def _pop(self) -> None:
        element = self.open.pop()
        self.at = self.open[-1]
        self.count[self.name[element]] -= 1
        self._mix(self.at, self.hash[element])

    def _cut_marked(self) -> None:
        """Cut what a class or id marks, but not the only article, nor what holds most of the text of a page without another."""
        if not self.marked:
            return
        size, article = [0] * len(self.parent), [0] * len(self.parent)
        for text, e in self.blocks:
            if not self.flags[e] & _IN_CUT:
                size[e] += len(text)
                article[e] += len(text) * bool(self.flags[e] & (_IN_ARTICLE | _IN_MAIN))
        for e in range(len(self.parent) - 1, 0, -1):
            size[self.parent[e]] += size[e]
            article[self.parent[e]] += article[e]
        # an article around a marked part is outside of it
        gone = {e for e in self.marked if article[0] > article[e] or self.flags[self.parent[e]] & (_IN_ARTICLE | _IN_MAIN) or not article[e] and 2 * size[e] <= size[0]}
        for e in range(1, len(self.parent)):
            if e in gone or self.flags[self.parent[e]] & _IN_CUT:
                self.flags[e] |= _IN_CUT

    def kept(self) -> list[tuple[str, int]]:
        """Blocks of the article: of article elements if they hold text, else of main, else of the page."""
        free = [b for b in self.blocks if not self.flags[b[1]] & _IN_CUT and self.flags[b[1]] & (_IN_HEADER | _IN_HEADING) != _IN_HEADER]
        for where in (_IN_ARTICLE, _IN_MAIN):
            if own := [b for b in free if self.flags[b[1]] & where]:
                return own
        return free

    def candidates(self) -> list[int]:
        """Signed subtree hashes, odd for prose inside an article; 0 for what is never a template: whole pages, empty elements and most of an article."""
        out, texts = [], [0] * len(self.parent)
        for text, e in self.blocks:
            texts[e] += len(text)
        for e in range(len(self.parent) - 1, 0, -1):
            texts[self.parent[e]] += texts[e]
        for e, (name, flags) in enumerate(zip(self.name, self.flags)):
            article = flags & (_IN_ARTICLE | _IN_MAIN) and not flags & _IN_CUT
            never = name in WHOLE or not e or not texts[e] or article and 2 * texts[e] > texts[0]
            h = 0 if never else self.hash[e] & ~1 | bool(article and name in PROSE)
            out.append(h - (1 << 64) if h >> 63 else h)
        return out


def _read_pages(pages: DataFrame) -> DataFrame:
    kinds = dict(pages.dtypes)

    def make():
        def f(piece):
            out = {k: [] for k in ("digest", "seen", "text", "hashes", "parents", "texts", "places")}
            for text in piece.column("html_").to_pylist():
                page = _Page(text or "")
                kept = page.kept()
                out["digest"].append(xxhash.xxh64_intdigest("\n".join(t for t, _ in kept)) - (1 << 63))
                hashes = page.candidates()
                out["seen"].append(sorted({h for h in hashes if h}))
                under = [h != 0 for h in hashes]
                for e in range(1, len(under)):
                    under[e] = under[e] or under[page.parent[e]]
                bound = any(under[e] for _, e in kept)          # else no template can touch the article
                around = [False] * len(under)                   # elements around the article's blocks: no other is asked about
                for _, e in kept:
                    while e > 0 and not around[e]:
                        around[e], e = True, page.parent[e]
                out["text"].append(None if bound else "\n\n".join(t for t, _ in kept))
                out["hashes"].append([h if a else 0 for h, a in zip(hashes, around)] if bound else None)
                out["parents"].append(page.parent if bound else None)
                out["texts"].append([t for t, _ in kept] if bound else None)
                out["places"].append([e for _, e in kept] if bound else None)
            kinds_of = {"digest": pa.int64(), "seen": pa.list_(pa.int64()), "text": pa.string(), "hashes": pa.list_(pa.int64()), "parents": pa.list_(pa.int32()),
                        "texts": pa.list_(pa.string()), "places": pa.list_(pa.int32())}
            return {c: piece.column(c) for c in ("uid", "page_id", "url", "host")} | {k: pa.array(v, kinds_of[k]) for k, v in out.items()}
        return f
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url")), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    texts = common.with_row_id(pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html_")))
    return common.map_pieces(texts, "html_", make, f"uid bigint, page_id {kinds['page_id']}, url {kinds['url']}, host string, digest bigint, seen array<bigint>, "
                             "text string, hashes array<bigint>, parents array<int>, texts array<string>, places array<int>")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars and n_template (template subtrees deleted from the article) of every page.

    ``pages`` has page_id, url and html; other columns are left alone.  Null and
    empty pages have an empty text, and pages of any length are read whole.  Pages
    without a host count as one host.  Rows that share a page_id stay rows of their
    own, and repeated rows count as one page.  Of a header inside an article the
    headings stay.
    """
    read = common.stage(_read_pages(pages), "pages")
    seen = read.select("uid", "host", "digest", F.explode("seen").alias("h"))
    counts = seen.select("host", "h", "digest").distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    sizes = read.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    prose = F.col("h").bitwiseAND(1) == 1
    enough = F.when(prose, (F.col("n") >= PROSE_PAGES) & (F.col("n") >= PROSE_SHARE * F.col("pages"))).otherwise(F.col("n") >= min_share * F.col("pages"))
    templates = counts.join(sizes, "host").where(enough) \
        .select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    bound = read.where("text is null")
    asked = F.array_remove(F.array_distinct("hashes"), F.lit(0).cast("bigint"))
    found = bound.select("uid", "host", F.explode(asked).alias("h")).withColumn("salt", F.pmod("uid", F.lit(SALT)).cast("int")).join(templates, ["host", "h", "salt"], "left_semi") \
        .groupBy("uid").agg(F.collect_set("h").alias("templates"))
    found = common.stage(found, "touched")
    few = common.small(found, "sum(8 * size(templates) + 64)")      # mostly few articles are touched: then no text moves
    kinds = dict(read.dtypes)

    def make():
        def f(piece):
            texts, cut = [], []
            for hashes, parents, blocks, places, templates in zip(*(piece.column(c).to_pylist() for c in ("hashes", "parents", "texts", "places", "templates"))):
                gone, marked = [0] * len(parents), set(templates or ())          # the template that an element is in
                if marked:
                    for e, (h, parent) in enumerate(zip(hashes, parents)):      # parents come first
                        gone[e] = e and gone[parent] or (e if h in marked else 0)
                texts.append("\n\n".join(t for t, e in zip(blocks, places) if not gone[e]))
                cut.append(len({gone[e] for e in places} - {0}))
            return {"page_id": piece.column("page_id"), "url": piece.column("url"), "text": pa.array(texts, pa.string()), "n_template": pa.array(cut, pa.int32())}
        return f
    merged = bound.select("uid", "page_id", "url", "hashes", "parents", "texts", "places").join(found if few is None else few, "uid", "left").withColumn("all", F.array_join("texts", ""))
    out = common.map_pieces(merged, "all", make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_template int")
    out = read.where("text is not null").select("page_id", "url", "text", F.lit(0).alias("n_template")).unionByName(out)
    return out.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_template")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract(common.read(spark, sf_dir, "pages", "page_id", "url", "html"))
