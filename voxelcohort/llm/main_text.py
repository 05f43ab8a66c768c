"""Main text of web pages by the maximum-scoring contiguous run of words and tags.

A page is a sequence of words and tags. Words score positive, tags negative with weights learned from pages that mark
their content themselves (``article`` or ``main``); words of disliked containers or of links score negative. One linear
scan finds the best contiguous run; the text of the run, without menus, headers, footers, sidebars, notices, adverts,
forms and comments, is returned in blocks.

Marks are whole class tokens, ids and role values, and compound classes; they are believed wherever they leave a text in
paragraphs, so a long thread of comments or a long list never becomes the article. A link in a paragraph counts half
for it; lists of links count against a run up to ``BRIDGE`` and are kept where both sides outweigh them.

Defined results: null, empty and text-free pages give ""; very long pages are scanned whole; of equal runs the first is
taken; a ``br`` is white space inside its block; repeated rows are extracted alike; empty tables give empty results; other
columns are ignored; an unclosed comment or script runs to the end of the page.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of the labelled sample and of the table of learned weights.
SAMPLE_PAGES = 2_000
WEIGHT_KEYS = 5_000
BRIDGE = -12.0

# Element names and words in class, id or role attributes that mark what is not content.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|button|canvas|video|audio"
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split())
CONTAINERS = BLOCKS - frozenset("p hr h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot html body legend caption".split())
SEMANTIC = frozenset("nav footer aside form header menu head dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DISLIKED = re.compile(
    r"^(?:nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|topbar|sidebar|aside|rail|ads?|adverts?|advertisements?|adsense|"
    r"sponsor(?:ed)?|promos?|promotion|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|search|form|comments?|commentlist|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommended|"
    r"recommendations|pagination|pager|widgets?|copyright|legal|disclaimer|toolbar|skip|contentinfo|complementary|hidden)$")
# Compound classes outside marked content: "site-footer", "comment-list"; but "has-sidebar" says something about what stands around it.
SHAPES = re.compile(r"^(?:area|bar|block|body|box|buttons?|card|container|content|items?|links?|list|panel|posts?|row|section|wrap|wrapper)$")
STATES = frozenset("has with no without non layout overflow".split())
# Disliked words that also name parts of an article; as an id inside marked content they say nothing.
TOPICS = frozenset("discussion legal search form notice notices alert promotion subscription copyright disclaimer consent reply skip social overlay".split())
# Classes that take a single paragraph, list item or phrase out of its block.
ADVERT = frozenset("ad ads advert adverts advertisement advertisements adsense sponsored promo hidden newsletter".split())
PHRASES = frozenset("p li span small strong em b i".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in paragraphs that marks have to leave; if they leave fewer, what holds most of the page is no side matter.
PROSE = 10
# What may hold most of a page without being its text.
LENGTHY = re.compile(r"^(?:comments?|commentlist|replies|reply|respond|disqus|discussion|cookies?|consent|gdpr|legal|disclaimer|hidden)$")
LINKED = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/])(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*(?<=/)>|"
    rf"<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>",
    re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[^a-z0-9]+")


def _marks(attributes: str) -> list[str]:
    """Lower-case words of the class, id and role attributes; "hidden" for elements that are not shown."""
    found = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() in ("class", "id", "role"):
            for token in value.split():
                found += [token, *PART.split(token)]
        elif name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            found.append("hidden")
    return [x for x in dict.fromkeys(found) if x]


def _drops(attributes: str, name: str, inside: bool) -> list[str]:
    """What the marks of a container hold against it: whole class tokens, ids and role values, compound classes of a disliked
    word and a shape; inside marked content ids that name a topic do not count. Marked elements fall to comments, related
    and hidden only."""
    found = []
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind not in ("class", "id", "role"):
            found += _marks(f'{kind}="{value}"')
        else:
            for token in value.split():
                parts = [x for x in PART.split(token) if x]
                if DISLIKED.match(token):
                    found += [] if kind == "id" and inside and token in TOPICS else [token]
                elif kind == "class" and len(parts) > 1 and not STATES.intersection(parts):
                    found += [x for x in (parts[-1], parts[0] if SHAPES.match(parts[-1]) else "") if DISLIKED.match(x)][:1]
    return [x for x in found if x.startswith(("comment", "related", "hidden"))] if name in LINKED else found


def _spared(page: str, tokens: list[re.Match]) -> set[int]:
    """Containers, by their number in page order, that nothing drops: those around a main or around an article with a first
    heading; a header with the only first heading beside the text it heads; and, if marks leave less than ``PROSE`` words
    in paragraphs, containers of most words of the page. Words of links and of SEMANTIC elements do not count."""
    stack: list[int] = []
    names, parents, words, found, bad, lengthy, heads = [], [], [], [], [], [], []
    linked = apart = total = prose = within = at = firsts = 0
    for m in [*tokens, None]:
        end = m.start() if m else len(page)
        if end > at and not linked and not apart:
            n = len(page[at:end].split())
            total += n
            if within and not any(bad[i] for i in stack):
                prose += n
            if stack:
                words[stack[-1]] += n
        if m is None:
            break
        at = m.end()
        name = (m[3] or "").lower()
        if name == "a":
            linked = not m[2]
        elif name == "p":
            within = not m[2]
        elif name == "h1" and not m[2]:
            firsts += 1
            if stack and names[stack[-1]] == "header" and apart == 1 and not bad[stack[-1]]:
                heads.append(stack[-1])
            if not apart:
                for i in stack[:next((k for k, i in enumerate(stack) if names[i] == "article"), 0)]:
                    found[i] = True
        elif name in CONTAINERS and m[2]:
            within = 0
            depth = next((k for k in range(len(stack) - 1, -1, -1) if names[stack[k]] == name), None)
            if depth is not None:
                apart -= sum(names[i] in SEMANTIC for i in stack[depth:])
                del stack[depth:]
        elif name in CONTAINERS and not m[4].endswith("/"):
            within = 0
            if name == "main" and not apart:
                for i in stack:
                    found[i] = True
            if name in ("nav", "form", "menu"):  # a header with a menu is the site's
                heads = [i for i in heads if i not in stack]
            parents.append(stack[-1] if stack else -1)
            stack.append(len(names))
            names.append(name)
            words.append(0)
            found.append(False)
            drops = _drops(m[4], name, False) if m[4] else []
            bad.append(bool(drops))
            lengthy.append(any(LENGTHY.match(x) for x in drops))
            apart += name in SEMANTIC
    for i in range(len(names) - 1, -1, -1):
        if parents[i] >= 0:
            words[parents[i]] += words[i]
    headers = {i for i in heads if firsts == 1 and parents[i] >= 0 and words[parents[i]] > 0}
    return headers | {i for i, n in enumerate(words) if found[i] or prose < PROSE and n * 10 > total * (9 if lengthy[i] else 5)}


def _items(page: str):
    """("text", raw, kind of its block, depth of disliked containers, inside article) and ("tag", name, closing, marks, inside
    article) in page order; the kind is 0, 1 in a link, 2 in a link of a paragraph, 3 in a heading."""
    stack: list[tuple[str, bool, bool]] = []
    disliked = linked = marked = opened = muted = 0
    mute = block = ""
    at = 0
    tokens = list(TOKEN.finditer(page))
    spared = _spared(page, tokens)

    def kind() -> int:
        return (2 if block == "p" else 1) if linked else 3 if block in HEADINGS else 0

    for m in tokens:
        if m.start() > at:
            yield "text", page[at:m.start()], kind(), disliked + (muted > 0), marked > 0
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            block = "" if m[2] else name
            if mute in BLOCKS and (not m[2] or name == mute or name in CONTAINERS) or muted and m[2] and name in CONTAINERS:
                muted, mute = 0, ""
        elif name == mute and name not in VOID:
            muted += -1 if m[2] else 1
            mute = mute if muted else ""
        if m[2]:
            if name == "a":
                linked = 0
            if name in CONTAINERS:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if depth is not None:
                    disliked -= sum(bad for _, bad, _ in stack[depth:])
                    marked -= sum(good for _, _, good in stack[depth:])
                    del stack[depth:]
            yield "tag", name, True, (), marked > 0
            continue
        marks = _marks(m[4]) if m[4] else []
        if name == "a":
            linked = 1
        if not muted and marks and name in PHRASES and any(x in ADVERT for _, *v in ATTRIBUTE.findall(m[4]) if _.lower() == "class" for x in "".join(v).lower().split()):
            muted, mute = 1, name
        if name in CONTAINERS and not m[4].endswith("/"):
            bad = name in SEMANTIC and not (name == "header" and (marked or opened in spared))
            bad = bad or opened not in spared and bool(m[4]) and bool(_drops(m[4], name, marked > 0))
            opened += 1
            good = name in LINKED and not bad and not disliked  # comments and teasers are no content, whatever their element
            stack.append((name, bad, good))
            disliked += bad
            marked += good
        yield "tag", name, False, tuple(marks), marked > 0
    if at < len(page):
        yield "text", page[at:], kind(), disliked + (muted > 0), marked > 0


def _keys(name: str, marks: tuple[str, ...]) -> list[str]:
    return [name, *[f"{name}.{x}" for x in marks]]


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, key: str = "page_id", page: str = "html") -> dict[str, float]:
    """Weight of each tag kind: log-odds of standing inside marked content, at most 0, from a bounded sample of pages
    that mark their content. Tags that were never seen weigh ``default``."""
    marked = pages.filter(F.col(page).rlike("(?i)<(article|main)[\\s>]"))
    chosen = marked.select(key).distinct().orderBy(F.xxhash64(key), key).limit(sample_pages)  # bounded, so small enough to broadcast
    sample = pages.join(F.broadcast(chosen), key).select(F.col(page).cast("string"))

    def counted(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for kind, name, closing, marks, marked in _items(text or ""):
                    if kind == "tag" and not closing:
                        (inside if marked else outside).update(_keys(name, marks))
        names = list(inside | outside)
        yield pa.RecordBatch.from_pydict({"key": pa.array(names, pa.string()), "inside": pa.array([inside[k] for k in names], pa.int64()), "outside": pa.array([outside[k] for k in names], pa.int64())})

    rows = (
        sample.mapInArrow(counted, "key string, inside long, outside long")
        .groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
        .orderBy(F.desc(F.col("inside") + F.col("outside")), "key").limit(WEIGHT_KEYS).collect()
    )
    weights = {r["key"]: max(-3.0, min(-0.05, log((r["inside"] + 1) / (r["outside"] + 1)) / 2)) for r in rows}
    return weights | {"default": -0.3}


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the best run: scan once, keeping the start of the best run that ends here."""
    items = list(_items(page))
    # a mark around headings alone marks no article
    has_content = any(kind == "text" and marked and not disliked and shape != 3 and entities.unescape(value).split() for kind, value, shape, disliked, marked in items)
    default = weights.get("default", -0.3)
    best = run = 0.0
    first, span, debt = 0, (0, 0), 0.0
    for k, (kind, value, flag, extra, marked) in enumerate(items):
        if kind == "tag":
            gain = 0.0 if flag else min((weights.get(x, default) for x in _keys(value, extra)), default=default)
            gain = max(gain, -0.01) if marked else gain
        else:
            n = len(value.split())
            if extra:
                gain = 0.0 if marked else max(-1.0 * n, BRIDGE - debt)
                debt = debt + gain
            elif not marked and not has_content and flag == 1:
                gain = max(-1.0 * n, BRIDGE - debt)  # a list of links may stand between two parts of an article
                debt = debt + gain
            else:
                gain = float(n)
                debt = 0.0 if n else debt
                if not marked and has_content:
                    gain = -gain
                elif not marked and flag == 2:
                    gain = gain / 2
        if run <= 0 and not (marked and run > -1):
            run, first = 0.0, k
        run += gain
        if run > best:
            best, span = run, (first, k + 1)
    blocks: list[str] = []
    held: list[str] = []

    def close():
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for kind, value, _, extra, _ in items[span[0]:span[1]]:
        if kind == "text":
            held.append(value if not extra else "")
        elif value == "br":
            held.append(" ")
        elif value in BLOCKS:
            close()
    close()
    return "\n".join(blocks)


def main_text(pages: DataFrame, weights: dict[str, float], keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points); one pass over the pages, no shuffle."""
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep]

    def extracted(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [extract(x, weights) if x else "" for x in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"])

    return pages.select(*keep, page).mapInArrow(extracted, ", ".join([*kinds, "text string", "n_chars long"]))
