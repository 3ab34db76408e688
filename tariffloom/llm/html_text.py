"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags.

A page is read as a sequence of words and tags. Words score positive, tags
negative; a linear scan finds the contiguous stretch of largest sum. The scores
come from labelled pages, here pages that mark their article themselves: a tag
costs the more, the more often it stands outside the marked text. Elements that
never show text or never hold an article (scripts, menus, asides ...) are barred.
Elements that look like noise by their class, id or role are left out whatever
their share of the page, unless the page's main article stands in them or they are
its only text; an article among comments is a comment. Forms, and names that only
hint at noise, are kept if they hold most of the page. Words of noise cost a little
and are left out of the text, so an advert inside the article doesn't tear it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textops import slices

#: Element names of HTML, by what they mean here.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
BARRED = RAW | frozenset("head nav footer aside button select dialog menu object video audio canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul".split())
KNOWN = BARRED | INLINE | VOID | BLOCK
#: Start tags that end an open paragraph, and elements that end an open one of the same group in the same list or table.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
LISTS = frozenset("ul ol menu dl table select".split())
GROUP = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Words in class, id and role names that hint at noise; words that only describe a box; words that describe a state of it.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments complementary contentinfo cookie cookies consent discussion disqus footer login masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination popup promo promos promotion related replies reply responses search share sharing sidebar signup skip social sponsor sponsored subscribe talkback toolbar widget".split())
TALK = frozenset("comment comments commentlist disqus discussion replies reply responses talkback".split())
BOX = frozenset("area bar block body box button buttons container content group holder inner item items link links list panel section slot text top bottom wrap wrapper".split())
STATE = frozenset("has with no is without enabled disabled open closed visible hidden active on off".split())
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\S+")
#: The share of a page's words above which a form, and an element whose name only hints at noise, count as content; others never do.
FORM, HINT, CLEAR, TALKING = 0.5, 0.9, 2.0, 3.0


@dataclass(slots=True)
class Token:
    tag: str  # "p", "/p" ...; empty for text
    text: str
    element: int  # the element that holds it, or whose bound it is
    words: int = 0


@dataclass(slots=True)
class Element:
    parent: int
    name: str
    barred: bool
    penalty: float
    words: int = 0  # in it, without barred elements


def name_penalty(attributes: str) -> float:
    """0, HINT, CLEAR or TALKING: how much class, id and role names hint at noise; a name counts clearly if the last but its describing parts does, and one of comments wherever it says so."""
    worst = 0.0
    for m in NAMES.finditer(attributes):
        for name in (m.group(1) or m.group(2) or m.group(3) or "").split():
            parts = [p.lower() for p in PARTS.findall(name)]
            if not NOISE.intersection(parts) or STATE.intersection(parts):
                continue
            telling = [p for p in parts if p not in BOX]
            worst = max(worst, TALKING if TALK.intersection(telling) else CLEAR if telling and telling[-1] in NOISE else HINT)
    return worst


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(tag name, attributes, text) in order, in one linear scan; comments, declarations and an unfinished last tag leave nothing."""
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield "", "", page[at:start]
        if start == size:
            return
        if page.startswith(("<!--", "<![CDATA["), start):
            mark = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(mark, start + 4)
            at = size if end < 0 else end + len(mark)
            continue
        m = NAME.match(page, start + 1)
        if m is None:
            if page.startswith(("<!", "<?", "</"), start):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
            else:
                yield "", "", "<"
                at = start + 1
            continue
        end = page.find(">", m.end())
        if end < 0:
            return
        whole = ATTRIBUTES.match(page, m.end())  # a quote that never closes ends with the tag
        at = whole.end() if whole else end + 1
        name = m.group().lower()
        yield name, page[m.end() : at - 1], ""
        if name in RAW and page[at - 2] != "/":
            found = _raw_end(name).search(page, at)
            at = found.start() if found else size


_RAW_ENDS = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}


def _raw_end(name: str) -> re.Pattern:
    return _RAW_ENDS[name]


def tokens(page: str) -> tuple[list[Token], list[Element]]:
    """A page's tags and texts in order, each with the element that holds it; ends that HTML lets out are put in."""
    out: list[Token] = []
    elements = [Element(0, "", False, 0.0)]
    stack, open_names, groups = [0], Counter(), [Counter()]

    def pop() -> str:
        name = elements[stack.pop()].name
        open_names[name] -= 1
        if name in LISTS:
            groups.pop()
        elif name in GROUP:
            groups[-1][name] -= 1
        return name

    for name, attributes, text in _pieces(page):
        if not name:
            top = elements[stack[-1]]
            n = 0 if top.barred else sum(1 for _ in WORD.finditer(text))
            top.words += n
            out.append(Token("", text, stack[-1], n))
        elif name[0] == "/":
            bare = name[1:]
            if bare in INLINE:  # others end with the block around them
                out.append(Token(name, "", stack[-1]))
                if elements[stack[-1]].name == bare:
                    pop()
            else:
                while open_names[bare] and elements[stack[-1]].name != bare:
                    pop()
                out.append(Token(name, "", stack[-1]))
                if open_names[bare]:
                    pop()
        else:
            if name in ENDS_P and open_names["p"]:
                while pop() != "p":
                    pass
            rivals = GROUP.get(name, ())
            while any(groups[-1][r] for r in rivals):
                pop()
            parent = stack[-1]
            out.append(Token(name, "", parent))
            if name in VOID or attributes.endswith("/"):
                continue
            up = elements[parent]
            inside = open_names["article"] or open_names["main"]
            barred = up.barred or name in BARRED or (name == "header" and not inside)
            penalty = 0.0 if name in ("html", "body", "article", "main") else max(name_penalty(attributes), FORM if name == "form" else 0.0)
            if name in INLINE and not penalty:
                continue
            out[-1].element = len(elements)
            elements.append(Element(parent, name, barred, penalty))
            stack.append(len(elements) - 1)
            open_names[name] += 1
            if name in LISTS:
                groups.append(Counter())
            elif name in GROUP:
                groups[-1][name] += 1
    for e in reversed(elements[1:]):
        elements[e.parent].words += e.words
    return out, elements


def _main_article(elements: list[Element]) -> int:
    """The article or main part with the most words outside noise; else one in noise that holds more words than all that is outside, but none among comments. 0 if there is none."""
    worst, own, best = [0.0], [e.words for e in elements], {True: (0, 0), False: (0, 0)}
    for k, e in enumerate(elements[1:], 1):
        worst.append(max(worst[e.parent], e.penalty if e.penalty >= CLEAR else 0.0))
        own[e.parent] -= e.words
        if e.name in ("article", "main") and not e.barred and worst[k] < TALKING and e.words > best[not worst[k]][0]:
            best[not worst[k]] = e.words, k
    outside = sum(n for n, w in zip(own, worst, strict=True) if not w)
    return best[True][1] or (best[False][1] if best[False][0] > outside else 0)


def noisy(elements: list[Element]) -> list[bool]:
    """Which elements are left out: barred ones, noise, and all in them; noise around the main article stays, and all noise of a page that has no other text."""
    spared, at = set(), _main_article(elements)
    while at:
        spared.add(at)
        at = elements[at].parent
    total, out, own = max(1, elements[0].words), [False], [e.words for e in elements]
    for k, e in enumerate(elements[1:], 1):
        out.append(out[e.parent] or e.barred or (e.penalty > 0 and k not in spared and e.words <= e.penalty * total))
        own[e.parent] -= e.words
    if not any(n for n, left in zip(own, out, strict=True) if not left):
        out = [False]
        for e in elements[1:]:
            out.append(out[e.parent] or e.barred)
    return out


@dataclass
class Weights:
    """Scores of a word and of tags; tags that were never seen cost ``other``, words and tags of noise ``noise``."""

    word: float
    tags: dict[str, float]
    other: float = -4.0
    noise: float = -0.02

    def of(self, token: Token, noise: bool) -> float:
        if noise:
            return self.noise * (1 if token.tag else token.words)
        if token.tag:
            return self.tags.get(token.tag, self.other)
        return self.word * token.words


#: For tags of which the labelled pages show none outside barred elements: inline and paragraph tags cost little, others more.
PLAIN = Weights(1.0, {x: w for names, w in ((BLOCK, -1.0), (INLINE, -0.2), (("p", "br", "h1", "h2", "h3", "blockquote"), -0.5)) for n in names for x in (n, f"/{n}")})


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous stretch of largest positive sum, the first of equals; (0, 0) if there is none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best stretch, one a line, references decoded and white space collapsed."""
    parts, elements = tokens(page)
    out = noisy(elements)
    a, b = best_stretch([weights.of(t, out[t.element]) for t in parts])
    blocks: list[str] = []
    now: list[str] = []
    for t in parts[a:b]:
        if not t.tag:
            if not out[t.element]:
                now.append(html.unescape(t.text))
        elif t.tag == "br" or t.tag == "/br":
            now.append(" ")
        elif t.tag.lstrip("/") not in INLINE:
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(y.split()) for y in blocks) if x)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, inside, n) of pages with just one article element; words count as the tag ``word``."""
    for batch in batches:
        for part in slices(batch, "html"):
            counts: Counter[tuple[str, bool]] = Counter()
            for page in part.column("html").to_pylist():
                parts, elements = tokens(page or "")
                if sum(t.tag == "article" for t in parts) != 1:
                    continue
                out, inside = noisy(elements), False
                for t in parts:
                    if out[t.element]:
                        continue
                    inside = inside and t.tag != "/article"
                    name = t.tag if t.tag.lstrip("/") in KNOWN else "other"
                    counts[name if t.tag else "word", inside] += 1 if t.tag else t.words
                    inside = inside or t.tag == "article"
            rows = [(tag, yes, n) for (tag, yes), n in counts.items()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["tag", "inside", "n"])


def learn_weights(pages: DataFrame, most: int = 2000) -> Weights:
    """Weights from at most ``most`` pages, those whose address has the least hash.

    Only the hashes of addresses are sorted; the pages below the bound are then
    counted where they lie, by known element name, so no page moves.
    """
    address = F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    hashes = pages.select(address.alias("o")).distinct().orderBy("o").limit(most).agg(F.max("o").alias("o")).first()
    if hashes["o"] is None:
        return PLAIN
    rows = pages.where(address <= hashes["o"]).select("html").mapInArrow(_counted, "tag string, inside boolean, n long").groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("n")).collect()
    share = {r.tag: (r.yes + 0.5) / (r.n + 1) for r in rows}
    if not any(r.tag == "article" for r in rows):
        return PLAIN
    tags = {t: -0.1 - 40 * (1 - s) ** 2 for t, s in share.items() if t != "word"}
    return Weights(1.0, PLAIN.tags | tags, tags.get("other", PLAIN.other))


def _extracted(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h or "", weights) for h in part.column("html").to_pylist()]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(sizes)], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page; a page without words, or null, has an empty text.

    Pages are judged alone, whatever their order, repeats or other columns; an
    empty table gives no rows. A very long page is read whole, in one linear scan
    whose tokens a task holds.
    """
    weights = learn_weights(pages) if weights is None else weights
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extracted(weights), "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
