"""Main text of web pages: the maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.frames import pick

#: A tag inside a marked article costs so much, one elsewhere up to ten times that.
LEAST_COST = -0.1
#: Added to every share of words.
LEAST_SHARE = 0.01
#: About so many pages with one `article` element are read for the weights, besides the pages below.
LABELLED_PAGES = 2_000

# Fixed values of HTML: elements inside a line of text, whose contents are no markup, that have no end.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: An element that is implicitly ended only inside the nearest of these.
SCOPE = frozenset("ul ol dl table tbody thead tfoot article section main body nav aside header footer form div blockquote".split())
#: Blocks that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
#: Blocks that hold running text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption".split())
# Elements, roles and words of class and id that hold no article text.
SIDE_TAGS = frozenset("nav aside form script style noscript template button select svg math object audio video canvas dialog menu datalist fieldset".split())
EDGE_TAGS = frozenset("header footer".split())
SIDE_ROLES = frozenset("navigation complementary search form dialog alertdialog alert menu menubar toolbar".split())
EDGE_ROLES = frozenset("banner contentinfo".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted"
    " comment comments commentlist disqus respond reply replies"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer paywall"
    " sidebar aside rail widget widgets related recommended recommendations teaser teasers"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager skip"
    " share sharing social newsletter subscribe subscription signup login search form".split()
)
EDGE_WORDS = frozenset("header footer masthead topbar copyright colophon".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: "has-sidebar" names a page with a sidebar, not the sidebar.
QUALIFIERS = frozenset("has with no without".split())

# Pages labelled by hand: what `article` holds is the article, but for the containers above.
LABELLED = (
    "<body><header><h2>Daily Site</h2></header><nav><ul><li><a>Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul></nav>"
    "<article><h1>Late trains on the coast line</h1><p>Trains on the coast line ran late for most of the morning, the operator said.</p>"
    "<p>A broken signal near the harbour held up <a>three services</a>, and a fourth was taken out.</p><ul><li>Two trains were turned back.</li>"
    "<li>One was cancelled.</li></ul><p>Repairs took four hours.</p></article><aside><p>Most read this week</p></aside>"
    "<footer>Copyright Daily Site. All rights reserved.</footer></body>",
    "<body><div>Sign in</div><div><a>Start</a> <a>Shop</a> <a>Help</a></div><article><h2>How to prune a pear tree</h2>"
    "<div>Prune in winter, when the tree rests. Cut above a bud that points outward, and keep the middle open to light.<br>"
    "Burn what was ill.</div><blockquote>A sharp knife is half of the work.</blockquote></article>"
    "<div><a>Next</a> <a>Previous</a></div><div>Terms | Privacy</div></body>",
    "<body><table><tr><td><a>Index</a></td><td><a>Contact</a></td></tr></table><article><h1>Opening hours</h1>"
    "<table><tr><td>Weekdays we open at nine and close at six.</td></tr><tr><td>On Sundays we are closed.</td></tr></table>"
    "<pre>ring twice after dark</pre></article><div><small>Last change: Monday</small></div><div>Powered by a small engine</div></body>",
    "<body><ul><li><a>Top</a></li><li><a>Map</a></li></ul><article><p>No heading here, only a paragraph of plain words that says"
    " what there is to say and then ends.</p><figure><img><figcaption>The bridge before the flood</figcaption></figure><dl><dt>Length</dt>"
    "<dd>Two hundred metres between the banks</dd></dl></article><ul><li><a>More of this</a></li><li><a>Tags</a></li></ul></body>",
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Piece:
    """A tag (`tag` set) or a run of text between two tags, with where it lies; `side` is not article text, `buried` lies inside such."""

    tag: str | None
    text: str = ""
    words: int = 0
    block: str = "body"
    link: bool = False
    side: bool = False
    article: int = 0
    main: bool = False
    buried: bool = False


@dataclass
class Element:
    name: str
    side: bool
    article: int
    main: bool
    link: bool
    block: str


def side_element(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element holds something else than the article, and whether it holds reader comments.

    Headers and footers count as such only outside an article.
    """
    if name in SIDE_TAGS or (name in EDGE_TAGS and not inside):
        return True, False
    if not attributes or name in ("html", "body"):
        return False, False
    words: set[str] = set()
    for found in ATTRIBUTE.finditer(attributes):
        key, value = found.group(1).lower(), found.group(2) or found.group(3) or found.group(4) or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return True, False
        if key == "role":
            if value.lower() in SIDE_ROLES or (value.lower() in EDGE_ROLES and not inside):
                return True, False
        elif key in ("class", "id"):
            for single in value.split():
                parts = [p.lower() for p in NAME_PART.findall(single)]
                words.update(p for before, p in zip([""] + parts, parts, strict=False) if before not in QUALIFIERS)
    comments = bool(words & COMMENT_WORDS)
    if name in ("article", "main"):
        return comments, comments
    return bool(words & SIDE_WORDS) or (bool(words & EDGE_WORDS) and not inside), comments


def pieces_of(html: str) -> list[Piece]:
    """Tags and runs of text of a page in order; contents of scripts, styles and the like are dropped."""
    out: list[Piece] = []
    stack: list[Element] = []
    base = Element("", False, 0, False, False, "body")
    articles = 0
    raw: str | None = None
    at = 0

    def text(upto: int) -> None:
        if upto > at:
            run = unescape(html[at:upto])
            top = stack[-1] if stack else base
            out.append(Piece(None, run, len(run.split()), top.block, top.link, top.side, top.article, top.main))

    end = len(html)
    while at < end:
        found = TOKEN.search(html, at)
        if found is None:
            text(end)
            break
        text(found.start())
        at = found.end()
        name = (found.group(2) or found.group(5) or "").lower()
        if not name:
            continue
        closing, attributes = found.group(1) or found.group(4), found.group(3) or found.group(6) or ""
        if closing:
            side = bool(stack) and stack[-1].side
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name == name:
                    side = stack[depth].side
                    del stack[depth:]
                    break
            top = stack[-1] if stack else base
            out.append(Piece("/" + name, side=side, buried=top.side, article=top.article))
            continue
        ended = ENDS.get(name) or ({"p"} if name in ENDS_P else None)
        if ended:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name in ended:
                    del stack[depth:]
                    break
                if stack[depth].name in SCOPE:
                    break
        top = stack[-1] if stack else base
        side, comments = side_element(name, attributes, top.article > 0 or top.main)
        article, main = top.article, top.main or name == "main"
        if name == "article":
            articles += 1
            article = top.article or articles
        # An article opened inside a page's header, banner or advert that was never closed is an article all the same.
        within = top.side and not (name == "main" or (name == "article" and not any(e.name == "aside" for e in stack)))
        if name == "article" and comments:
            within, article = True, top.article
        out.append(Piece(name, side=side or within, buried=within, article=top.article))
        if name in VOID:
            continue
        if name in RAW:
            raw = name
            closed = re.compile(rf"</{raw}\s*(?:[\s/][^>]*)?(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = closed.end() if closed else end
            continue
        block = top.block if name in INLINE else name
        stack.append(Element(name, side or within, article, main, top.link or name == "a", block))
    return out


def evidence(piece: Piece, section: str) -> tuple[str, ...]:
    """What speaks for or against a run of words: the section if the page marks one, else its block and link.

    The length counts only in blocks that say little by themselves.
    """
    if section != "none":
        return (f"section {section}",)
    kind = "link" if piece.link else "text"
    if piece.block in TEXT_BLOCKS:
        return (f"block {piece.block} {kind}",)
    length = "short" if piece.words < 4 else "middle" if piece.words < 10 else "long"
    return (f"block {piece.block} {kind}", f"length {length} {kind}")


def section_of(piece: Piece, best: int, has_main: bool) -> str:
    if best:
        return "inside" if piece.article == best else "outside"
    if has_main:
        return "main" if piece.main else "beside"
    return "none"


def longest_article(pieces: list[Piece]) -> int:
    """Number of the article with the most words, 0 without one."""
    words: Counter[int] = Counter()
    for piece in pieces:
        if piece.tag is None and piece.article and not piece.side:
            words[piece.article] += piece.words
    return max(words, key=lambda a: (words[a], -a)) if words else 0


def label_counts(html: str) -> Counter[tuple[str, bool]]:
    """Words per evidence and tags, inside and outside the one article of a page; nothing for other pages.

    Each page counts three times: as it is, with `main` in place of the article
    and with neither, so that pages of those kinds get weights too.
    """
    counts: Counter[tuple[str, bool]] = Counter()
    pieces = pieces_of(html)
    if sum(p.tag == "article" for p in pieces) != 1 or sum(p.tag == "/article" for p in pieces) != 1:
        return counts
    inside = False
    for piece in pieces:
        if piece.tag in ("article", "/article"):
            inside = piece.tag == "article"
        elif piece.tag:
            if not piece.side:
                counts[f"tag {piece.tag.lstrip('/')}", inside] += 1
        elif piece.words and not piece.side:
            for section in ("inside" if inside else "outside", "main" if inside else "beside", "none"):
                for name in evidence(piece, section):
                    counts[name, inside] += piece.words
    return counts


@dataclass(frozen=True)
class Weights:
    """Score of a word by its evidence, and of a tag (never positive)."""

    words: dict[str, float]
    tags: dict[str, float]

    def word(self, names: tuple[str, ...]) -> float:
        """Probability of lying in the article, less a half."""
        odds = sum(self.words.get(name, 0.0) for name in names)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - 0.5

    def tag(self, name: str) -> float:
        return self.tags.get(name.lstrip("/"), 3 * LEAST_COST)


def shares(counts: Counter[tuple[str, bool]]) -> dict[tuple[str, bool], float]:
    """Share of each name among the names of its kind and side."""
    totals: Counter[tuple[str, bool]] = Counter()
    for (name, inside), n in counts.items():
        totals[name.split(" ", 1)[0], inside] += n
    return {(name, inside): n / totals[name.split(" ", 1)[0], inside] for (name, inside), n in counts.items()}


def weights_of(by_hand: Counter[tuple[str, bool]], marked: Counter[tuple[str, bool]]) -> Weights:
    """Log odds of the mean share in both kinds of labelled pages; a tag costs a tenth to one, by how often it lies outside.

    The two kinds weigh the same, so that a million pages of one layout do not
    decide what other layouts look like.
    """
    found = [shares(by_hand), shares(marked)]
    words, tags = {}, {}
    for name in {n for n, _ in [*by_hand, *marked]}:
        within, out = (sum(share.get((name, inside), 0.0) for share in found) / 2 for inside in (True, False))
        if name.startswith("tag "):
            tags[name[4:]] = LEAST_COST - 0.9 * out / (out + within)
        else:
            words[name] = math.log((within + LEAST_SHARE) / (out + LEAST_SHARE))
    return Weights(words, tags)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and past-last place of the contiguous run with the largest positive sum; the first and longest of several."""
    best, total, start = 0.0, 0.0, 0
    found = (0, 0)
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best or (total == best and found[0] == start and best > 0):
            best, found = total, (start, i + 1)
    return found


def main_text(html: str | None, weights: Weights) -> str:
    """Text of the best run of a page: words that speak for an article, without containers of other things.

    Words in such containers score nothing and are left out, so an advert in the
    middle of an article costs its tags and does not cut the article.
    """
    if not html:
        return ""
    pieces = pieces_of(html)
    best = longest_article(pieces)
    has_main = any(p.main for p in pieces)
    scores: list[float] = []
    for piece in pieces:
        if piece.tag:
            free = piece.buried or piece.tag.lstrip("/") in INLINE
            scores.append(0.0 if free else LEAST_COST if best and piece.article == best else weights.tag(piece.tag))
        elif piece.side or not piece.words:
            scores.append(0.0)
        else:
            scores.append(piece.words * weights.word(evidence(piece, section_of(piece, best, has_main))))
    first, last = best_run(scores)
    kept: list[str] = []
    for piece in pieces[first:last]:
        if piece.tag:
            if piece.tag.lstrip("/") not in INLINE:
                kept.append(" ")
        elif not piece.side:
            kept.append(piece.text)
    return " ".join("".join(kept).split())


def fitted_weights(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> Weights:
    """Weights from the labelled pages above and about `labelled_pages` pages that mark their article.

    Pages are drawn by a hash of page_id and html. Tasks count, so the driver gets
    one row per evidence or tag and side.
    """
    rows = pick(pages, "page_id", "html")
    share = labelled_pages / max(1, rows.count())
    drawn = F.pmod(F.xxhash64("page_id", "html"), F.lit(1_000_000)) < min(1.0, share) * 1_000_000

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                counts.update(label_counts(html))
        yield pa.RecordBatch.from_pydict(
            {
                "name": pa.array([name for name, _ in counts], pa.string()),
                "inside": pa.array([inside for _, inside in counts], pa.bool_()),
                "n": pa.array(list(counts.values()), pa.int64()),
            }
        )

    # Tag names are whatever pages invent; the most frequent 5,000 rows come to the driver.
    seen = rows.filter(drawn & F.col("html").isNotNull()).select("html").mapInArrow(counted, "name string, inside boolean, n long")
    table = seen.groupBy("name", "inside").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name", "inside").limit(5_000)
    by_hand: Counter[tuple[str, bool]] = Counter()
    for page in LABELLED:
        by_hand.update(label_counts(page))
    return weights_of(by_hand, Counter({(row.name, row.inside): row.n for row in table.collect()}))


def main_texts(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> DataFrame:
    """Main text of every page: page_id, url, text (empty if none) and n_chars, its code points.

    Words score by the odds, on labelled pages, of their section, block, link and
    length; tags score negative; one linear scan finds the contiguous run with
    the largest sum. Menus, forms, adverts, notices, comments and the like inside
    the run are left out. Character references are decoded, white space becomes
    one space. A null html counts as empty, null ids and urls stay, repeated rows
    are answered each, an empty table gives no rows, further columns are ignored;
    nothing is cut, whatever the length of a page.
    """
    rows = pick(pages, "page_id", "url", "html")
    weights = fitted_weights(pages, labelled_pages)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, weights) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return rows.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(
        extracted, "page_id long, url string, text string, n_chars long"
    )
