"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags.  Every block has
shallow features: its words and link density, those of the blocks before and
after it, and the kind of container it stands in.  Boilerplate containers known by
their tag, role, being hidden or holding comments weigh more than those known by
another class name or id.  A named container may wrap the whole page: long text
of few links in it counts only where little such text stands outside named
containers, and none in a ``main`` or ``article``.  A name does not count inside a
``main``, nor inside the page's first ``article`` if that holds more text than
stands outside.  A decision tree (Gini splits), trained on the small labelled
table below, tells content from boilerplate; content blocks make the text.

Defined results: a null or empty page, and one without content blocks, has an
empty text; broken markup (unclosed tags, stray ends, open comments) is read
to its end; a quote opens a value only behind an equals sign; only an unclosed script, style, title or textarea reaches to the
page's end, as HTML reads it, and any other element without text of the page
(``APART``) is left out from its start to its own end, or is read like any
other where that end is missing; null and repeated ids are ordinary rows; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How HTML reads tags, and names that containers of boilerplate commonly bear.
RAW = "script style textarea title".split()
APART = set("noscript template svg iframe object canvas select math audio video".split())
FOREIGN = ("svg", "math")
# Tags that end an svg or math standing around them, but for those inside its points of HTML.
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_POINTS = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var img wbr".split()
)
NOISE_TAGS = set("nav header footer aside form button menu dialog head fieldset".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = set(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar toolbar widget login signup search hidden".split()
)
NOISE_NAMES |= set(
    "ad-banner ad-container ad-slot ad-unit ad-wrapper google-ad sponsored-content cookie-banner cookie-bar cookie-consent cookie-message cookie-notice cookie-popup "
    "gdpr-banner gdpr-consent consent-banner privacy-notice newsletter-form newsletter-signup newsletter-box subscribe-form subscribe-box signup-form login-form search-form search-box "
    "share-bar share-buttons share-links sharing-buttons social-bar social-buttons social-icons social-links social-media social-share related-articles related-content related-links "
    "related-posts related-stories recommended-articles recommended-posts left-sidebar right-sidebar side-bar sidebar-left sidebar-right primary-sidebar secondary-sidebar "
    "widget-area footer-widgets nav-bar nav-links nav-menu main-menu main-nav site-nav top-nav post-navigation breadcrumb-nav page-footer page-header site-footer site-header top-bar "
    "modal-dialog popup-overlay".split()
)
COMMENT_NAMES = set(
    "comment comments commentlist disqus reply replies respond comment-body comment-form comment-list comments-area comments-list comments-section user-comments".split()
)
MAIN_NAMES = set(
    "article content main post story entry article-body article-content article-text content-body content-main entry-content main-content page-content post-body post-content post-text story-body story-content".split()
)

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<[!?/][^>]*+>?"
    r"|<[a-zA-Z][^<>]*+>",
    re.S | re.I,
)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "noise", "main", "heading")

# The labelled table: the features in order, then 1 for content, 0 for boilerplate.
# Blocks judged by hand on pages of common layouts; densities in percent; noise
# is 1 in a container of boilerplate by its names (or a form), 2 by its tag, its role or being hidden.
LABELLED = """
 1 100   0   0   1 100 1 0 0 0
 1 100   1 100   1 100 1 0 0 0
 2 100   1 100   9   0 1 0 0 0
 3   0   2 100  40   0 1 0 1 0
12   0   1 100  10   0 1 0 0 0
45   0   2 100  60   0 1 0 0 0
80   0  60   0  12   0 1 0 0 0
60  10  90   0   0   0 1 1 0 0
30   0 120   0  20   0 1 1 0 0
 2   0  80   0   6  50 1 1 0 0
15  20  90   0   8  90 1 0 0 0
 9   0  12   0  60   0 0 1 1 1
 4   0   0   0  90   0 0 1 1 1
 6   0 100   0  80   0 0 1 1 1
70   0   9   0  50   0 0 1 0 1
55   5  70   0  60   0 0 1 0 1
90   2  55   5   3   0 0 1 0 1
 2   0  70   0  60   0 0 1 0 1
 1   0   3   0   2   0 0 1 0 1
 3   0   1   0 100   0 0 1 0 1
 8   0  40   0   4   0 0 1 0 1
12  25  60   0  60   0 0 1 0 1
20  40  30   0  30   0 0 1 0 1
 4   0  90   0   9   0 0 1 0 1
 5   0   0   0   0   0 0 1 0 1
 3 100  70   0   3 100 0 1 0 0
 5 100  50   0  40   0 0 1 0 0
 8  90  20 100   6 100 0 1 0 0
 1 100   1 100   1 100 0 1 0 0
90   0   6   0  70   0 0 0 0 1
60   8  80   0  50   0 0 0 0 1
35   0  60   0  45   0 0 0 0 1
40  15   2 100  70   0 0 0 0 1
25   0  40   0  30   0 0 0 0 1
18   0  60   0   2 100 0 0 0 1
 7   0   3 100  90   0 0 0 1 1
 5   0  60   0  80   0 0 0 1 1
 6   0  45   0  50   0 0 0 0 1
 3   0  70   0  60   0 0 0 0 1
 4   0   1 100   2 100 0 0 0 0
 5   0   2 100   3   0 0 0 0 0
 9   0   4   0   1 100 0 0 0 0
 3   0   5   0   0   0 0 0 0 0
10  60   8  70   9  80 0 0 0 0
15  80  20  60  60   0 0 0 0 0
 2 100  60   0  50   0 0 0 0 0
 1 100   1 100   1 100 0 0 0 0
 3 100   2 100   4 100 0 0 0 0
30  90  40   0   5 100 0 0 0 0
 4   0   6   0   2 100 0 0 1 0
160   0   0   0   0   0 1 0 0 1
180   3  60   0  12   0 1 0 0 1
240   0   3   0   2 100 1 1 0 1
300   5 200   0 180   2 1 1 0 1
200   0   1 100  40   0 1 0 0 1
100   0  80   0  90   0 1 0 0 1
 90   2 120   0  75   0 1 1 0 1
180  60  80  20  70  40 1 0 0 0
 90  70  90  50  85  80 1 0 0 0
 45   0  40   0  50   0 1 0 0 0
200   0 150   0 180   0 2 0 0 0
160   0   0   0 300   0 2 1 0 0
 80   0  90   0  85   0 2 0 0 0
 25   0  10   0   8   0 2 0 0 0
  2 100   1 100   1 100 2 0 0 0
  3   0   1 100 120   0 2 0 0 0
 12   0   0   0 150   0 2 0 0 0
 75   0   3   0 120   0 2 0 0 0
 70   0   1   0  60   0 2 1 0 0
 10   0   2 100 200   0 1 0 0 0
 45   0   3   0 120   0 1 0 0 0
  5   0 150   0 140   0 1 0 0 0
 40   0   1   0 300   0 1 1 0 0
 70   0   2 100   9   0 1 0 0 0
 75   0   3   0 100   0 1 0 0 0
"""

MIN_LEAF = 1
MAX_DEPTH = 6


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0) -> tuple | int:
    """(feature, threshold, tree below or at it, tree above it), or a label; splits lower the Gini impurity most, the first of equals."""
    label = int(2 * y.sum() >= len(y))
    if depth == MAX_DEPTH or y.min() == y.max():
        return label
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            sides = [y[low], y[~low]]
            if min(map(len, sides)) < MIN_LEAF:
                continue
            impurity = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, float(cut)
    if best is None:
        return label
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth + 1), grow(x[~low], y[~low], depth + 1)


def train(table: str = LABELLED) -> tuple | int:
    rows = np.array([line.split() for line in table.strip().splitlines()], float)
    rows[:, [1, 3, 5]] /= 100
    return grow(rows[:, :-1], rows[:, -1].astype(int))


def classify(tree: tuple | int, features: tuple) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(values: dict[str, str]) -> set[str]:
    """Whole class names and the id, in lower case with hyphens."""
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    return {CAMEL.sub("-", x).lower().replace("_", "-") for x in names} | {x.lower() for x in names}


# Noise while a page is read: none, by name (or a form), by kind, and by name around the page's first article.
NAMED, HARD, AROUND_ARTICLE = 1, 2, 3


def _kind(tag: str, attrs: str, kind: tuple[int, bool], first: bool) -> tuple[int, bool]:
    """(noise, main) inside a tag that stands in a container of ``kind``; ``first``: no article or main outside hard noise came before."""
    noise, main = kind
    if tag == "main" or tag == "article":
        main = True
        if noise == NAMED and (first or tag == "main"):
            noise = 0 if tag == "main" else AROUND_ARTICLE
    if tag in NOISE_TAGS:
        noise = HARD if tag != "form" else noise or NAMED
    if attrs and noise != HARD:
        values = _attributes(attrs)
        role = values.get("role", "").strip().lower()
        names = _names(values) if "class" in values or "id" in values else set()
        named = bool(names & NOISE_NAMES)
        comments = bool(names & COMMENT_NAMES) and tag not in ("html", "body", "main")
        main = main or (not noise and (role in ("main", "article") or bool(names & MAIN_NAMES) and not named))
        if comments or role in NOISE_ROLES or "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or "display:none" in "".join(values.get("style", "").lower().split()):
            noise = HARD
        elif named and tag not in ("html", "body", "main"):
            noise = NAMED
    return noise, main


def blocks(html: str) -> list[tuple[str, int, float, int, bool, bool]]:
    """Flat text blocks: (text, words, link density, noise, main, heading)."""
    out: list[tuple[str, int, float, int, bool, bool]] = []
    stack: list[tuple[str, tuple[int, bool], bool, tuple | None]] = []
    places: dict[str, list[int]] = {}  # where the elements of a tag stand in the stack
    blocks_at: list[int] = []  # where those stand that are not inline
    parts = None  # the open block's texts, last first: (texts before, text)
    state = [(0, False), False, 0, 0]  # kind, heading, open links, link words
    foreign = 0  # svg and math elements open
    first = True  # no article or main outside noise so far

    def text(raw: str) -> None:
        nonlocal parts
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts = parts, raw
            if state[2]:
                state[3] += len(raw.split())

    def flush() -> None:
        nonlocal parts
        texts = []
        while parts:
            parts, raw = parts
            texts.append(raw)
        words = "".join(reversed(texts)).split()
        if words:
            out.append((" ".join(words), len(words), min(1.0, state[3] / len(words)), *state[0], state[1]))
        state[3] = 0

    def enter(kind: tuple[int, bool], heading: bool) -> None:
        if (kind, heading) != (state[0], state[1]):
            flush()
            state[0], state[1] = kind, heading

    def push(tag: str, kind: tuple[int, bool], heading: bool, saved: tuple | None = None) -> None:
        nonlocal foreign
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks_at.append(len(stack))
        foreign += tag in FOREIGN
        stack.append((tag, kind, heading, saved))

    def close(at_open: int) -> None:
        nonlocal foreign
        while len(stack) > at_open:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag not in INLINE:
                blocks_at.pop()
            foreign -= tag in FOREIGN

    def last(tags) -> int:
        """Where the innermost open element of these tags stands, or -1."""
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def leave_out(at_open: int) -> None:
        """Go back to the state before an element that is left out."""
        nonlocal parts
        kept, parts, old = stack[at_open][3]
        del out[kept:]
        state[:] = old
        close(at_open)

    at = 0
    while m := TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            if not (foreign and m[0].endswith("/>")):
                end = RAW_END[m["raw"].lower()].search(html, at)
                at = end.end() if end else len(html)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        end, inline = bool(m["end"]), tag in INLINE
        if foreign and not end and tag in BREAKOUT:
            at_open = last(FOREIGN)
            if last(HTML_POINTS) < at_open:
                leave_out(at_open)
        if tag in APART:
            at_open = last((tag,))
            if end and at_open >= 0:
                leave_out(at_open)
            elif not end and not (m["attrs"].endswith("/") and (foreign or tag in FOREIGN)):
                push(tag, state[0], state[1], (len(out), parts, list(state)))
            continue
        if tag == "a":
            state[2] = 0 if end else 1
        if tag == "br":
            parts = parts, " "
            continue
        if not inline:
            flush()
        if tag in VOID:
            continue
        if end:
            at_open = last((tag,))
            if at_open >= 0 and not (inline and blocks_at and blocks_at[-1] > at_open):
                close(at_open)
                enter(*(stack[-1][1:3] if stack else ((0, False), False)))
            continue
        if not inline:
            state[2] = 0
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd", "option")):
                close(len(stack) - 1)
        kind, heading = stack[-1][1:3] if stack else ((0, False), False)
        kind = _kind(tag, m["attrs"], kind, first)
        first = first and not (tag in ("article", "main") and kind[0] != HARD)
        heading = heading or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        push(tag, kind, heading)
        enter(kind, heading)
    text(html[at:])
    flush()
    return _weighed(out)


LINK_POOR = 1 / 3
TEXT_WORDS = 8
OUTSIDE_WORDS = 25
OUTSIDE_SHARE = 0.05


def _weighed(found: list[tuple[str, int, float, int, bool, bool]]) -> list[tuple[str, int, float, int, bool, bool]]:
    """Blocks with noise 0, 1 (a name around most of the page's text) or 2, judged by the link-poor text in and out of named containers."""
    words, main_outside = [0, 0, 0, 0], False
    for _, n, density, noise, main, heading in found:
        if n >= TEXT_WORDS and density <= LINK_POOR and not heading:
            words[noise] += n
            main_outside = main_outside or main and not noise
    article = words[AROUND_ARTICLE] > words[0]
    named = words[NAMED] + (0 if article else words[AROUND_ARTICLE])
    wrapper = not article and not main_outside and words[0] < max(OUTSIDE_WORDS, OUTSIDE_SHARE * named)
    weigh = (0, NAMED if wrapper else HARD, HARD, 0 if article else NAMED if wrapper else HARD)
    return [(*b[:3], weigh[b[3]], *b[4:]) for b in found]


def main_text(html: str | None, tree: tuple | int) -> str:
    found = blocks(html or "")
    kept = []
    for i, (text, words, density, noise, main, heading) in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        around = [v for b in (before, after) for v in ((b[1], b[2]) if b else (0, 0.0))]
        if classify(tree, (words, density, *around, noise, main, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: tuple | int | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars.  No shuffle; a task holds one page's blocks at a time."""
    tree = train() if tree is None else tree
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
