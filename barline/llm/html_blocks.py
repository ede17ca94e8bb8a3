"""The main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at its block-level tags. Each block has its words, the share of them that
are links, both of its neighbours' too, whether it is a heading, where it stands to the page's
content element and whether it lies in furniture (menus, headers, footers, sidebars, notices,
adverts, forms, comments: by element, role, or a word of class or id). A decision tree grown from
`LABELLED`, a small table of labelled blocks, decides which blocks are main text.

One pass of a linear tokeniser reads a page: comments, declarations, quoted attributes and raw
elements (scripts, styles) as browsers do; an unclosed comment or script ends with the page.

Defined results: a null or empty html, or one without main text, gives an empty text; pages are read
whole whatever their length; every input row gives one row, ties and repeats alike; null ids and
urls stay null; an empty table has no rows. Columns other than the page's html and those kept are
not read. Breaks and table cells separate words, rows of a table and list items are blocks.
"""

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")}
SKIPPED = frozenset("noscript template svg math select button object canvas audio video datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same set when they begin.
SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "option": {"option"}}
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or an id that name furniture, and such as only hint at it.
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager "
    "pagination popup promo promotion replies reply respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar".split()
)
HINTS = frozenset("info links more related teaser widget".split())
CONTENT = frozenset("article-body article-content entry-content post-body post-content story-body".split())
#: A content element counts from this share of the page's words outside furniture.
LEAST_SHARE = 0.25

#: Labelled blocks of typical pages, a page a line: words, linked words, heading, content level (2 article,
#: 1 main, 0 neither), furniture (2 yes, 1 hinted at, 0 no), main text.
LABELLED = """
1 1 0 0 2 0 | 2 2 0 0 2 0 | 1 1 0 0 2 0 | 8 0 0 0 2 0 | 9 0 1 2 0 1 | 60 2 0 2 0 1 | 1 0 0 2 0 1 | 3 0 0 2 0 1 | 140 0 0 2 0 1 | 12 0 0 0 2 0
5 0 1 0 2 0 | 40 0 0 0 2 0 | 7 0 1 2 0 1 | 2 0 0 2 0 1 | 25 25 0 2 0 1 | 33 1 0 2 0 1 | 4 0 1 2 0 1 | 80 0 0 2 0 1 | 30 0 0 2 2 0 | 55 0 0 2 2 0 | 6 1 0 0 2 0
12 0 1 2 0 1 | 1 0 0 2 0 1 | 1 0 0 2 0 1 | 55 0 0 2 0 1 | 2 0 0 2 0 1 | 90 0 0 2 2 0 | 3 3 0 2 2 0 | 50 0 0 0 0 0 | 2 2 0 0 0 0
6 0 1 2 0 1 | 70 3 0 2 0 1 | 2 2 0 2 0 0 | 3 3 0 2 0 0 | 2 2 0 2 0 0 | 4 4 0 2 0 0 | 5 5 0 2 0 0 | 110 0 0 0 0 0
8 0 1 2 0 1 | 45 0 0 2 0 1 | 3 3 0 2 0 1 | 38 0 0 2 0 1 | 20 0 0 2 1 0 | 7 7 0 2 1 0 | 20 1 0 2 0 1 | 16 8 0 2 0 1
9 0 1 1 0 1 | 66 2 0 1 0 1 | 4 0 0 1 0 1 | 71 5 0 1 0 1 | 14 0 0 0 0 0 | 9 9 0 0 0 0 | 85 0 0 0 0 0 | 11 1 0 0 2 0
11 0 1 2 0 1 | 50 0 0 2 0 1 | 14 0 0 1 0 0 | 60 0 0 1 0 0 | 9 9 0 1 0 0 | 5 0 1 1 0 0
1 1 0 0 0 0 | 2 2 0 0 0 0 | 1 1 0 0 0 0 | 3 3 0 0 0 0 | 8 0 1 0 0 1 | 42 1 0 0 0 1 | 3 0 0 0 0 1 | 57 0 0 0 0 1 | 1 0 0 0 0 1 | 64 0 0 0 0 1 | 4 4 0 0 0 0 | 5 5 0 0 0 0 | 5 0 0 0 0 0
2 2 0 0 0 0 | 2 2 0 0 0 0 | 6 0 1 0 0 1 | 21 0 0 0 0 1 | 35 2 0 0 0 1 | 19 0 0 0 0 1 | 30 0 0 0 2 0 | 15 0 0 0 2 0 | 3 1 0 0 0 0 | 4 2 0 0 0 0
3 0 0 0 0 0 | 2 2 0 0 0 0 | 4 0 0 0 0 0 | 7 7 0 0 0 0 | 12 10 0 0 0 0 | 10 0 1 0 0 1 | 75 6 0 0 0 1 | 14 3 0 0 0 1 | 82 0 0 0 0 1 | 18 14 0 0 0 0 | 22 20 0 0 0 0 | 6 5 0 0 0 0
5 0 1 0 0 1 | 28 0 0 0 0 1 | 2 0 0 0 0 1 | 17 0 0 0 0 1 | 40 0 0 0 1 0 | 2 2 0 0 1 0
14 0 0 0 0 1 | 31 0 0 0 0 1 | 26 0 0 0 0 1
120 0 0 0 0 1
9 0 1 2 0 1
7 0 1 2 0 1 | 3 0 0 2 0 1 | 20 0 0 2 0 1 | 6 6 0 2 0 1 | 2 0 0 2 0 1 | 40 0 0 2 0 1 | 1 0 0 2 0 1 | 9 9 0 2 0 1 | 15 0 0 2 0 1 | 2 2 0 2 0 1 | 4 0 0 2 0 1
3 0 0 2 0 1 | 30 0 0 2 0 1 | 2 2 0 2 0 0 | 1 1 0 2 0 0 | 3 3 0 2 0 0 | 1 0 0 2 0 1 | 3 2 0 2 0 1 | 44 4 0 2 0 1 | 12 12 0 2 0 1 | 70 0 0 2 0 1
4 4 0 2 0 0 | 3 3 0 2 0 0 | 2 0 0 2 0 1 | 60 0 0 2 0 1 | 5 4 0 2 0 1 | 8 0 0 2 0 1 | 5 5 0 2 0 0 | 6 6 0 2 0 0
5 0 1 2 0 1 | 12 0 0 2 0 1 | 1 0 0 2 0 1
9 0 1 2 0 1 | 14 0 0 2 0 1 | 40 0 0 2 0 1 | 8 0 0 2 0 1
60 0 0 2 0 1 | 25 0 0 2 0 1 | 3 0 0 2 0 1
6 0 1 1 0 1 | 15 0 0 1 0 1 | 2 0 0 1 0 1
11 0 1 1 0 1 | 50 0 0 1 0 1 | 6 0 0 1 0 1
5 0 1 0 0 1 | 36 0 0 0 0 1 | 22 0 0 0 0 1 | 3 0 0 0 0 0
7 0 1 0 0 1 | 19 0 0 0 0 1 | 48 0 0 0 0 1 | 16 0 0 0 0 1 | 40 0 0 0 2 0 | 4 0 0 0 0 0
2 2 0 0 0 0 | 13 0 1 0 0 1 | 90 0 0 0 0 1 | 29 1 0 0 0 1 | 1 0 0 0 0 1 | 17 0 0 0 0 1 | 6 0 0 0 0 0
10 0 1 0 0 1 | 24 0 0 0 0 1 | 33 0 0 0 0 1 | 2 2 0 0 0 0 | 2 2 0 0 0 0
2 2 0 0 0 0 | 44 0 0 0 0 1 | 2 0 0 0 0 1 | 27 0 0 0 0 1 | 3 3 0 0 0 0 | 4 0 0 0 0 0
5 3 0 0 0 0 | 4 0 1 0 0 1 | 30 0 0 0 0 1 | 26 2 0 0 0 1 | 9 5 0 0 0 0
6 4 0 0 0 0 | 29 1 0 0 0 1 | 34 0 0 0 0 1 | 5 3 0 0 0 0 | 7 4 0 0 0 0
6 0 1 2 0 1 | 10 5 0 2 0 1 | 6 4 0 2 0 1 | 31 18 0 2 0 1 | 8 4 0 2 0 1
6 0 0 0 0 1
1 0 0 2 0 1 | 1 0 0 2 0 1
2 0 0 2 0 1
"""
FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "heading", "place", "furniture")
DEPTH = 8


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _within(tag: str, text: str, level: int, furniture: int) -> tuple[int, int, bool]:
    """Content level, furniture and whether text is hidden, inside an element that begins here."""
    if tag == "article":
        level = 2
    elif tag == "main":
        level = max(level, 1)
    if tag in FURNITURE:
        furniture = 2
    if not text.strip(" \t\r\n\f/") or tag in ("html", "body"):
        return level, furniture, False
    given = _attributes(text)
    named = f"{given.get('class', '')} {given.get('id', '')}".lower()
    role = given.get("role", "").lower()
    if role in ("article", "main"):
        level = max(level, 2 if role == "article" else 1)
    if "articlebody" in given.get("itemprop", "").lower() or CONTENT.intersection(named.split()):
        level = 2
    if role in ROLES:
        furniture = 2
    if tag != "main":
        for name in named.split():
            parts = re.split(r"[^a-z0-9]+", name)
            if parts[0] in ("has", "with", "no", "without") or "with" in parts:
                continue
            if NAMES.intersection(parts):
                furniture = 2
            elif HINTS.intersection(parts):
                furniture = max(furniture, 1)
    style = re.sub(r"\s", "", given.get("style", "").lower())
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in style
    return level, furniture, hidden


def blocks(page: str) -> list[tuple]:
    """(text, words, linked words, heading, content level, furniture) of a page's blocks, in its order."""
    found: list[tuple] = []
    # open elements: name, content level, furniture, hidden, inside a heading, furniture only as a header of the content
    stack: list[tuple] = [("", 0, 0, False, False, False)]
    names: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    link_depth = 0  # open elements where the open link began

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            _, level, furniture, _, heading, own_header = stack[-1]
            words = text.count(" ") + 1
            found.append((text, words, min(words, len("".join(linked).split())), heading, level, 0 if own_header and heading else furniture))
        parts.clear()
        linked.clear()

    def pop():
        nonlocal link_depth
        names[stack.pop()[0]] -= 1
        if link_depth > len(stack):
            link_depth = 0

    def add(text: str):
        if text and not stack[-1][3]:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link_depth:
                linked.append(text)

    at = 0
    while (token := TOKEN.search(page, at)) is not None:
        add(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, ends, attrs = tag.lower(), token["end"], token["attrs"]
        if tag in RAW:
            if not ends:
                close = RAW[tag].search(page, at)
                if close is not None:
                    at = close.start()
                elif tag not in ("title", "textarea"):
                    at = len(page)
        elif tag == "a":
            link_depth = 0 if ends else len(stack)
            linked.append(" ")
        elif tag in ("br", "td", "th"):
            parts.append(" ")
            linked.append(" ")
        elif tag in BLOCKS or tag in SKIPPED:
            if tag in BLOCKS:
                flush()
            if ends:
                if names.get(tag):
                    while True:
                        last = stack[-1][0]
                        pop()
                        if last == tag:
                            break
            elif tag != "hr":
                if tag in BLOCKS and stack[-1][0] == "p":
                    pop()
                if stack[-1][0] in SIBLINGS.get(tag, ()):
                    pop()
                _, level, furniture, hidden, heading, own_header = stack[-1]
                inner_level, inner, hides = _within(tag, attrs, level, furniture)
                header = own_header or tag == "header" and level == 2 and furniture == 0
                if tag not in SKIPPED or not attrs.rstrip().endswith("/"):
                    stack.append((
                        tag, inner_level, inner, hidden or hides or tag in SKIPPED, heading or tag in HEADINGS,
                        header and (tag == "header" or tag in HEADINGS or tag in ("div", "hgroup")),
                    ))
                    names[tag] = names.get(tag, 0) + 1
    add(page[at:])
    flush()
    return found


def features(described: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """FEATURES of blocks described by (words, linked words, heading, content level, furniture), in page order."""
    words, linked, heading, level, furniture = described.T.astype(np.float64)
    links = linked / np.maximum(words, 1)
    n_pages = int(pages[-1]) + 1 if len(pages) else 0
    free = np.where(furniture < 2, words, 0)
    total = np.bincount(pages, free, n_pages)
    least = np.zeros(n_pages)
    for step in (1, 2):
        held = np.bincount(pages, np.where(level >= step, free, 0), n_pages)
        least = np.where((held > 0) & (held >= LEAST_SHARE * total), step, least)
    wanted = least[pages] if n_pages else np.zeros(0)
    place = np.where(wanted == 0, 1, np.where(level >= wanted, 2, 0))
    sides = []
    for step in (1, -1):
        same = np.roll(pages, step) == pages
        if len(same):
            same[0 if step == 1 else -1] = False
        sides += [np.where(same, np.roll(words, step), 0), np.where(same, np.roll(links, step), 0)]
    return np.stack([words, links, *sides, heading, place, furniture], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A decision tree by least Gini impurity: a label, or (feature, threshold, tree up to it, tree above)."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return bool(2 * ones >= len(y))
    best = None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, hits = x[order, feature], np.cumsum(y[order])
        for cut in np.flatnonzero(np.diff(values)):
            left, up = cut + 1, hits[cut]
            right, down = len(y) - left, ones - up
            impurity = up * (left - up) / left + down * (right - down) / right
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, (values[cut] + values[cut + 1]) / 2
    if best is None:
        return bool(2 * ones >= len(y))
    _, feature, threshold = best
    low = x[:, feature] <= threshold
    return feature, float(threshold), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    feature, threshold, low, high = tree
    below = x[:, feature] <= threshold
    out = np.empty(len(x), bool)
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


def labelled(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a table like `LABELLED`."""
    pages = [[[int(v) for v in block.split()] for block in page.split("|")] for page in text.strip().split("\n")]
    rows = np.array([block for page in pages for block in page])
    numbers = np.repeat(np.arange(len(pages)), [len(page) for page in pages])
    return features(rows[:, :5], numbers), rows[:, 5].astype(bool)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """`keep` with the main text of `column`, its code points, and the page's blocks and those kept."""
    bound_batches(pages.sparkSession)
    tree = grow(*labelled())
    kept = ", ".join(f"`{name}` {kind}" for name, kind in pages.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            found = [blocks(page) if page else [] for page in batch.column(len(keep)).to_pylist()]
            numbers = np.repeat(np.arange(len(found)), [len(f) for f in found])
            described = np.array([block[1:] for f in found for block in f], np.int64).reshape(-1, 5)
            good = iter(classify(tree, features(described, numbers)).tolist())
            chosen = [[block[0] for block in f if next(good)] for f in found]
            texts = ["\n".join(lines) for lines in chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))]
                + [pa.array(texts, pa.string())]
                + [pa.array(values, pa.int64()) for values in (map(len, texts), map(len, found), map(len, chosen))],
                [*keep, "text", "n_chars", "n_blocks", "n_kept"],
            )

    source = pages.select(*[pages[f"`{c}`"] for c in keep], pages[f"`{column}`"].alias("html"))
    return source.mapInArrow(run, f"{kept}, text string, n_chars bigint, n_blocks bigint, n_kept bigint")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: What the given pages' markup comes to: their one article, cut at headings and paragraphs.
SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages),
cut AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(body, '</?(h1|p)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) AS parts FROM inner_html),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(
    regexp_replace(p, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS lines FROM cut),
joined AS (SELECT page_id, url, list_filter(lines, lambda x: x <> '') AS lines FROM plain)
SELECT page_id, url, coalesce(array_to_string(lines, chr(10)), '') AS text, length(coalesce(array_to_string(lines, chr(10)), ''))::BIGINT AS n_chars FROM joined
"""
