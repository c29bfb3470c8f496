"""Main-text extraction from HTML by tag-path ratios.

A page is read once into text blocks, each with its path of open tags (with their class and id) from the root.  Text
length, blocks, punctuation and link text are summed per tag path.  The text-to-tag ratio and the punctuation ratio of a
path are smoothed over its neighbours in page order and fused by their product, times the share of text outside links,
times a prior: paths in ``article`` or ``main`` weigh more, paths under a telling class or id less.  Paths whose fused
ratio reaches a share of the page's best are content paths.  The element that holds most of their text is the article:
blocks of content paths in it are kept, and so is what stands among them - headings, lists, captions - unless it is
link text, or stands in an element with a telling name whose own text is not content for the better part.  In an article
a name never decides alone: it is a factor of the ratio.

Only what a page never shows, and elements and names that say what the contract leaves out whatever the text is like
(``nav``, ``footer``, ``form``, reader comments), is settled before the ratios.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read_table, slices

# Elements without content of their own, elements whose text is never shown, elements that are never part
# of an article, elements that end a block, elements that can hold an article, and the words of class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
UNSEEN = RAW | frozenset("head svg canvas object audio video".split())
APART = frozenset("nav footer aside form button select option menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
HOLDERS = frozenset("html body main article section div center table tbody tr td".split())
BARRIERS = frozenset("article div section table ul ol main body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
TELLING = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebars?|footer|foot|masthead|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"signup|login|recommend\w*|widgets?|toolbar|pagination|pager|copyright|disclaimer)\d*"
)
#: Words that name a page's furniture as often as a part of an article: in one they only lower its ratio a little.
DOUBTFUL = re.compile(r"(?:side|share|sharing|social|related|legal|search|skip|tags?|meta|header)\d*")
PLAIN = frozenset("site page global top bottom left right main primary secondary inner outer box wrap wrapper container content list item items section block area bar panel slot unit row col links link text body the and user users reader readers visitor guest post posts article articles story stories entry".split())
COMMENT = re.compile(r"(?:comments?|commentlist|disqus|respond|replies|reply)\d*")
#: Elements that implicitly end an open element of the same kind.
SELF_CLOSING = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

#: Fused ratio, as a share of the page's best path, from which on a path is content, and the least that is.
SHARE, LEAST = 0.25, 1.0
#: Factors of the prior: in an article, under a name that only tells, under one that tells among other words.
IN_ARTICLE, TOLD, HINTED = 4.0, 1 / 400, 1 / 6
#: Factor of a doubtful name in an article, and the part of a named element's text that must be content for the rest of it to stay.
DOUBTED, BORNE_OUT = 1 / 2, 0.5
#: Part of the content paths' text that the article's element holds, and of link text from which on a block is links.
HELD, LINKED = 0.85, 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。、，]")
WORDS = re.compile(r"[a-z0-9]+")


def prior_of(tag: str, attributes: dict[str, str], inside: bool) -> float:
    """1 for an element that says nothing, 0 for one that is left out whatever it holds, else a factor of its paths.

    ``inside``: it stands in an article or main element, where a header is that of the article, the name of a heading is
    taken from its words, and a doubtful name says little.
    """
    if tag in UNSEEN or tag in APART or (tag == "header" and not inside):
        return 0.0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return 0.0
    if attributes.get("role", "").lower() in ROLES:
        return 0.0
    prior = 1.0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        spelled = WORDS.findall(name.lower())
        words = [w for w in spelled if w not in PLAIN]
        if words and COMMENT.fullmatch(words[0]) and all(map(COMMENT.fullmatch, words)):
            return 0.0
        if tag in ("html", "body") or inside and tag in HEADINGS:
            continue
        sure, doubtful = [bool(TELLING.fullmatch(w)) for w in words], [bool(DOUBTFUL.fullmatch(w)) for w in words]
        # Several words that are all doubtful or plain, as social-share or related-posts, leave no doubt.
        if inside and not any(sure) and not (len(spelled) > 1 and all(doubtful) and "header" not in words):
            if any(d and w != "header" for d, w in zip(doubtful, words, strict=True)):
                prior = min(prior, DOUBTED)
        elif any(sure) or any(doubtful):
            prior = min(prior, TOLD if all(s or d or COMMENT.fullmatch(w) for s, d, w in zip(sure, doubtful, words, strict=True)) else HINTED)
    return prior


@dataclass
class Page:
    """Elements in the order of their start tags (the root is number 0), and blocks of text in page order."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    paths: list[int] = field(default_factory=lambda: [0])
    priors: list[float] = field(default_factory=lambda: [1.0])
    inside: list[bool] = field(default_factory=lambda: [False])
    #: The outermost element, itself included, whose name tells; 0 for none.
    named: list[int] = field(default_factory=lambda: [0])
    #: (element, text, characters of link text)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def read(html: str) -> Page:
    """Reads a page in one pass; the work for a tag does not depend on how deep it stands."""
    page = Page()
    numbers: dict[tuple, int] = {(): 0}  # (path of the parent, name) -> path
    stack: list[int] = []
    at_of: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of each tag
    splits_to, blocks_to, barriers_to = [0], [0], [0]  # of the first k open elements: those that end a block, blocks, barriers
    held: list[str] = []
    links = at = 0

    def flush() -> None:
        nonlocal links
        if held:
            text = " ".join(unescape("".join(held)).split())
            element = stack[-1] if stack else 0
            if text and page.priors[element] > 0:
                page.blocks.append((element, text, min(links, len(text))))
            held.clear()
        links = 0

    def close(k: int) -> None:
        if splits_to[-1] > splits_to[k]:
            flush()
        for element in stack[k:]:
            at_of[page.tags[element]].pop()
        del stack[k:], splits_to[k + 1 :], blocks_to[k + 1 :], barriers_to[k + 1 :]

    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            held.append(text)
            if at_of["a"]:
                links += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if at_of[tag] and (tag in BLOCK or blocks_to[-1] == blocks_to[at_of[tag][-1]]):
                close(at_of[tag][-1])
            elif tag in BLOCK:
                flush()
            continue
        for open_tag, ended_by in SELF_CLOSING.items():
            if tag in ended_by and at_of[open_tag] and barriers_to[-1] == barriers_to[at_of[open_tag][-1] + 1]:
                close(at_of[open_tag][-1])
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        found = {f[1].lower(): unescape(f[2] or f[3] or f[4] or "") for f in ATTRIBUTE.finditer(m[3])} if m[3] else {}
        parent = stack[-1] if stack else 0
        prior = min(page.priors[parent], prior_of(tag, found, page.inside[parent]))
        split = tag in BLOCK or prior < page.priors[parent]
        if split:
            flush()
        name = (page.paths[parent], tag, found.get("class", ""), found.get("id", ""))
        page.parents.append(parent)
        page.tags.append(tag)
        page.paths.append(numbers.setdefault(name, len(numbers)))
        page.priors.append(prior)
        page.inside.append(page.inside[parent] or tag in ("article", "main"))
        page.named.append(page.named[parent] or (len(page.tags) - 1 if prior < 1 else 0))
        at_of[tag].append(len(stack))
        stack.append(len(page.tags) - 1)
        splits_to.append(splits_to[-1] + split)
        blocks_to.append(blocks_to[-1] + (tag in BLOCK))
        barriers_to.append(barriers_to[-1] + (tag in BARRIERS))
    flush()
    return page


def path_sums(page: Page) -> dict[int, list[int]]:
    """Path -> characters, blocks, punctuation marks and characters of link text, in page order."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for element, text, link in page.blocks:
        s = sums[page.paths[element]]
        for i, v in enumerate((len(text), 1, len(PUNCTUATION.findall(text)), link)):
            s[i] += v
    return sums


def _smooth(v: list[float]) -> list[float]:
    """Half a path's own value, half the mean of its neighbourhood of three."""
    return [0.5 * x + 0.5 * sum(near) / len(near) for x, near in ((x, v[max(0, i - 1) : i + 2]) for i, x in enumerate(v))]


def fused_ratios(page: Page, sums: dict[int, list[int]]) -> dict[int, float]:
    """Path -> smoothed text ratio x (1 + smoothed punctuation ratio) x share outside links x prior."""
    weight: dict[int, float] = {}
    for element, _, _ in page.blocks:
        weight[page.paths[element]] = page.priors[element] * (IN_ARTICLE if page.inside[element] else 1.0)
    text = _smooth([(s[0] - s[3]) / s[1] for s in sums.values()])
    marks = _smooth([s[2] / s[1] for s in sums.values()])
    return {p: t * (1 + k) * (1 - s[3] / s[0]) * weight[p] for (p, s), t, k in zip(sums.items(), text, marks, strict=True)}


def _article(page: Page, content: set[int]) -> tuple[int, int]:
    """First and last element of the smallest element that holds most text of the content paths; never below an article."""
    n = len(page.tags)
    mass, last = [0] * n, list(range(n))
    for element, text, _ in page.blocks:
        if page.paths[element] in content:
            mass[element] += len(text)
    heaviest: list[int] = [-1] * n
    for e in range(n - 1, 0, -1):  # children come after their parents
        up = page.parents[e]
        mass[up] += mass[e]
        last[up] = max(last[up], last[e])
        if page.tags[e] in HOLDERS and (heaviest[up] < 0 or mass[e] >= mass[heaviest[up]]):
            heaviest[up] = e
    at = 0
    while page.tags[at] != "article" and heaviest[at] >= 0 and mass[heaviest[at]] >= HELD * mass[0]:
        at = heaviest[at]
    return at, last[at]


def extract(html: str | None) -> str:
    """The main text of a page, blocks joined by one space; empty for null, empty and content-free pages."""
    page = read(html or "")
    if not page.blocks:
        return ""
    sums = path_sums(page)
    fused = fused_ratios(page, sums)
    least = max(LEAST, SHARE * max(fused.values()))
    content = {p for p, v in fused.items() if v >= least}
    if not content:
        return ""
    first, last = _article(page, content)
    above, up = set(), first
    while up >= 0:
        above.add(up)
        up = page.parents[up]
    seeds = [i for i, (e, _, _) in enumerate(page.blocks) if page.paths[e] in content and first <= e <= last]
    loose = page.tags[first] in ("", "html", "body")  # nothing holds the article: only what stands among its blocks is of it
    # A named element whose text is content for the better part is one of the article, whatever its name.
    borne: dict[int, float] = defaultdict(float)
    for element, text, _ in page.blocks:
        borne[page.named[element]] += len(text) * (1 - BORNE_OUT if page.paths[element] in content else -BORNE_OUT)
    kept = []
    for i, (element, text, link) in enumerate(page.blocks):
        path, heading = page.paths[element], page.tags[element] in HEADINGS
        if first <= element <= last and path in content:
            kept.append(text)
        elif page.named[element] and borne[page.named[element]] < 0 or sums[path][3] > LINKED * sums[path][0]:
            continue
        elif first <= element <= last and (not loose or seeds[0] < i < seeds[-1] or heading and i < seeds[-1]):
            kept.append(text)
        elif heading and element < first and page.parents[element] in above:
            kept.append(text)
    return " ".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) per row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a very long page is read whole, in time linear in its tags; of paths with equal
    ratios all are content or none; rows that repeat give equal rows; an empty table gives an empty result;
    other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
