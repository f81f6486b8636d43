"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into blocks: runs of text between block-level tags, inline markup merged, scripts, styles and the head
left out. Each block has features of its ancestors (tags, words of class and id), apart for those around and those inside
the nearest article or main element and without html and body, of itself and of its text. The chain's two labels are article and other; weights come from maximum likelihood on labelled pages, labels from Viterbi.

The labelled pages are drawn here by a seeded rule (``labelled_pages``): containers, menus, notices, adverts, forms,
comments, sidebars and footers in the usual spellings, with made-up text that is alike in all of them. Other
labelled pages can be given to ``train`` instead.

Very long and hostile pages (unclosed tags and quotes, deep nesting) take time linear in their length.

Defined results: null, empty and textless pages give the empty text; repeated rows are extracted one by one; null ids and
urls stay; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelab.llm.common import pick, spread

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template noscript svg iframe title".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold an article; features tell what is inside the nearest one from what is around it.
HOLDERS = frozenset(["article", "main"])
OPENING = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: The next attribute of a tag or its end. A quote counts only right after the equals sign, and only if it is closed.
ATTRIBUTE = re.compile(r"([\s/]*+)(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+)")
NAMING = frozenset(["class", "id", "role"])
#: A class word with one of these tells of the whole page's state, not of the element ("has-sidebar", "comments-open").
STATES = frozenset("has have with without no is not open opened closed fixed sticky enabled disabled on off layout theme left right template".split())

#: Words of class and id that the labelled pages use; others count as unknown.
GOOD_NAMES = "content article post entry body text main story prose page".split()
BAD_NAMES = (
    "nav navbar menu breadcrumb breadcrumbs header masthead top footer bottom copyright legal sidebar side widget related "
    "recommended notice cookie cookies consent banner alert popup modal newsletter subscribe signup login search form ad ads "
    "advert advertisement sponsored sponsor promo promotion comment comments reply replies discussion respond share social tags "
    "pagination pager skip toolbar"
).split()
KNOWN_NAMES = frozenset(GOOD_NAMES + BAD_NAMES)
TAGS = sorted(BLOCK_TAGS | {"a", "b", "span", "em", "strong"})
NAME_LIST = sorted(KNOWN_NAMES)
TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS) if t != "html"}
NAME_BIT = {n: 1 << i for i, n in enumerate(NAME_LIST)}


@dataclass
class Open:
    """An open element with sets, as bits, of what it and the elements around it are: ``outer`` and ``inner`` tags (up to and below the
    nearest holder of an article) and, in the same way, names; ``block`` is the place of the nearest block-level element."""

    tag: str
    block: int
    held: bool
    outer: int
    inner: int
    far: int
    near: int


@dataclass
class Block:
    text: str
    tag: str
    place: Open
    links: float


def _names(value: str) -> int:
    bits = 0
    for token in value.split():
        words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", token).lower())
        if STATES.isdisjoint(words):
            for word in words:
                bits |= NAME_BIT.get(word, 0)
    return bits


def _attributes(page: str, at: int) -> tuple[int, int, bool]:
    """Where a tag ends that has its name before ``at`` (-1: nowhere), the names in it, and whether it closes itself."""
    names = 0
    while match := ATTRIBUTE.match(page, at):
        at = match.end()
        if match[2]:
            return at, names, "/" in match[1]
        if match[3].lower() in NAMING:
            names |= _names(match[4] or match[5] or match[6] or "")
    return -1, names, False


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order; character references are decoded, runs of white space are one blank.

    One pass, linear in the page: a tag whose end lies in a quote that swallows the rest of the page ends at its first ``>``, and so do
    all later ones; where no ``>`` follows at all, the rest is text.
    """
    out: list[Block] = []
    stack = [Open("body", 0, False, 0, 0, 0, 0)]
    opened: Counter = Counter()
    texts: list[str] = []
    linked = at = 0
    quotes, last = True, page.rfind(">")

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(texts).split())
        if text:
            out.append(Block(text, stack[stack[-1].block].tag, stack[-1], linked / len(text)))
        texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            texts.append(text)
            if opened["a"]:
                linked += len(text)

    def close(tag: str) -> None:
        while opened[tag]:
            top = stack.pop()
            opened[top.tag] -= 1
            if top.tag == tag:
                return

    while 0 <= (start := page.find("<", at)) < last:
        add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        match = OPENING.match(page, start + 1)
        if not match:
            add("<")
            at = start + 1
            continue
        tag = match[2].lower()
        at, names, closed = _attributes(page, match.end()) if quotes else (-1, 0, False)
        if at < 0:
            quotes, at = False, page.find(">", match.end()) + 1
            closed = page[at - 2] == "/"
        if match[1]:
            if tag in BLOCK_TAGS:
                flush()
            close(tag)
            continue
        if tag in RAW_TAGS and not closed:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            if not at:
                at = len(page)
            continue
        if tag == "br":
            texts.append(" ")
        if tag in BLOCK_TAGS:
            flush()
            close("p")
            closes = CLOSED_BY.get(tag, ())
            place = stack[-1].block
            if place and stack[place].tag in closes:
                for gone in stack[place:]:
                    opened[gone.tag] -= 1
                del stack[place:]
        if tag not in VOID_TAGS and not closed:
            if tag in ("html", "body"):
                continue
            around, bit = stack[-1], TAG_BIT.get(tag, 0)
            place = len(stack) if tag in BLOCK_TAGS else around.block
            if tag in HOLDERS:
                own = Open(tag, place, True, around.outer | around.inner | bit, 0, around.far | around.near, names)
            elif around.held:
                own = Open(tag, place, True, around.outer, around.inner | bit, around.far, around.near | names)
            else:
                own = Open(tag, place, False, around.outer | bit, 0, 0, around.near | names)
            stack.append(own)
            opened[tag] += 1
    add(page[at:])
    flush()
    return out


FEATURES = (
    [f"in:{t}" for t in TAGS] + [f"inside:{t}" for t in TAGS] + [f"tag:{t}" for t in sorted(BLOCK_TAGS | {"body"})]
    + [f"{kind}:{n}" for kind in ("name", "near", "far") for n in NAME_LIST]
    + ["linked", "half linked", "words<4", "words<12", "words<40", "long", "stop at end", "sign of right", "always"]
)
NUMBER = {name: i for i, name in enumerate(FEATURES)}


@lru_cache(maxsize=10_000)
def _place_features(tag: str, held: bool, outer: int, inner: int, far: int, near: int) -> tuple[int, ...]:
    names = [f"tag:{tag}", "always"]
    names += [f"in:{t}" for t, bit in TAG_BIT.items() if outer & bit] + [f"inside:{t}" for t, bit in TAG_BIT.items() if inner & bit]
    # names inside a holder have a weight that they share with names elsewhere and one of their own
    for kind in ("name", "near") if held else ("name",):
        names += [f"{kind}:{n}" for n, bit in NAME_BIT.items() if near & bit]
    names += [f"far:{n}" for n, bit in NAME_BIT.items() if far & bit]
    return tuple(NUMBER[n] for n in names)


def features_of(block: Block) -> list[int]:
    place, words = block.place, block.text.count(" ") + 1
    names = ["words<4" if words < 4 else "words<12" if words < 12 else "words<40" if words < 40 else "long"]
    if block.links > 0.3:
        names.append("half linked" if block.links < 0.9 else "linked")
    if block.text[-1] in ".!?…。":
        names.append("stop at end")
    if "©" in block.text:
        names.append("sign of right")
    return [*_place_features(block.tag, place.held, place.outer, place.inner, place.far, place.near), *(NUMBER[n] for n in names)]


def page_features(blocks: list[Block]) -> list[list[int]]:
    return [features_of(b) for b in blocks]


@dataclass
class Model:
    """Scores of the label article against other: one weight per feature, label changes and the first label."""

    weights: np.ndarray
    moves: np.ndarray

    def labels(self, rows: list[list[int]]) -> list[int]:
        """The best sequence of labels (Viterbi)."""
        if not rows:
            return []
        w, ((oo, oa), (ao, aa)) = self.weights, self.moves.tolist()
        scores = [float(w[r].sum()) for r in rows]
        other, article, came = 0.0, scores[0], []
        for s in scores[1:]:
            from_o, from_a = other + oa + s, article + aa + s
            stay, back = other + oo, article + ao
            came.append((stay < back, from_a > from_o))
            other, article = max(stay, back), max(from_o, from_a)
        label = int(article > other)
        out = [label]
        for step in reversed(came):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], steps: int = 300, decay: float = 0.0005) -> Model:
    """Maximum likelihood of label sequences; all pages advance side by side through the forward and backward sums."""
    pages = [p for p in pages if p[0]]
    longest = max(len(p[1]) for p in pages)
    y = np.zeros((len(pages), longest), int)
    on = np.zeros((len(pages), longest), bool)
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)], on[i, : len(labels)] = labels, True
    # features of all blocks behind each other, and the block of each
    active = np.concatenate([row for rows, _ in pages for row in rows]).astype(int)
    sizes = np.array([len(row) for rows, _ in pages for row in rows])
    first = np.cumsum(sizes) - sizes
    w, moves = np.zeros(len(FEATURES)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    pair_counts = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pair_counts[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & on[:, 1:]).sum()
    for step in range(1, steps + 1):
        emit = np.zeros((len(pages), longest, 2))
        emit[on, 1] = np.add.reduceat(w[active], first)
        ahead = np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
        behind = np.zeros_like(emit)
        for t in range(longest - 2, -1, -1):
            follow = np.logaddexp.reduce(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(on[:, t + 1, None], follow, 0)
        ends = on.sum(axis=1) - 1
        total = np.logaddexp.reduce(ahead[np.arange(len(pages)), ends], axis=1)
        article = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * on
        gw = np.bincount(active, np.repeat((y - article)[on], sizes), len(FEATURES)) / len(pages) - decay * w
        both = ahead[:, :-1, :, None] + moves + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        gm = (pair_counts - (np.exp(both) * on[:, 1:, None, None]).sum(axis=(0, 1))) / len(pages) - decay * moves
        for k, (value, grad) in enumerate(((w, gw), (moves, gm))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * grad**2
            value += 0.1 * (state[2 * k] / (1 - 0.9**step)) / (np.sqrt(state[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return Model(w, moves)


ARTICLE, OTHER = "\ue000", "\ue001"


def labelled_pages(count: int = 1000, seed: int = 7) -> list[tuple[list[list[int]], list[int]]]:
    """Pages drawn by rule; each text begins with a mark of its label, which is taken off again."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        blocks = blocks_of(_draw_page(rng))
        labels = [int(b.text.startswith(ARTICLE)) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(ARTICLE, "").replace(OTHER, "").strip() or "x"
        out.append((page_features(blocks), labels))
    return out


def _draw_page(rng: random.Random) -> str:
    def words(n: int) -> str:
        text = " ".join("".join(rng.choices("aeiounrstlmdé", k=rng.randint(1, 9))) for _ in range(n))
        return text + rng.choice([".", ".", ".", "", "!", "$$$"])

    def size() -> int:
        return rng.choice([1, 2, 3, 6, 10, 20, 40, 80])

    def attr(names: list[str]) -> str:
        if not names:
            return ""
        join = rng.choice(["-", " ", "_"])
        extra = [rng.choice(["x", "wrap", "inner", "box"])] if rng.random() < 0.3 else []
        return f' {rng.choice(["class", "class", "id"])}="{join.join([*names, *extra])}"'

    def wrap(tag: str, names: list[str], inner: str) -> str:
        return f"<{tag}{attr(names)}>{inner}</{tag}>"

    def piece(mark: str) -> str:
        tag = rng.choice(["p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "div"])
        text = mark + words(size())
        if rng.random() < 0.15:
            text += f' <a href="/x">{words(2)}</a>' + (words(3) if rng.random() < 0.5 else "")
        if rng.random() < 0.15:
            text = f"{mark}<b>{words(2)}</b> {words(size())}"
        body = f"<{tag}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.7 else "")
        return f"<ul>{body}</ul>" if tag == "li" else f"<table><tr>{body}</tr></table>" if tag == "td" else body

    def links(n: int) -> str:
        items = "".join(f'<li>{OTHER}<a href="/{i}">{words(rng.randint(1, 3))}</a></li>' for i in range(n))
        return f"<ul>{items}</ul>"

    def other(kind: str) -> str:
        text = "".join(piece(OTHER) for _ in range(rng.randint(1, 3))) if rng.random() < 0.5 else OTHER + words(size())
        if kind == "nav":
            return wrap(*rng.choice([("nav", []), ("nav", ["menu"]), ("div", ["navbar"]), ("div", ["menu"]), ("div", ["breadcrumbs"]), ("ul", ["pagination"])]), links(rng.randint(1, 7)))
        if kind == "header":
            return wrap(*rng.choice([("header", []), ("div", ["header"]), ("div", ["masthead"]), ("header", ["top"])]), f"<h1>{OTHER}{words(2)}</h1>" + (links(3) if rng.random() < 0.5 else text))
        if kind == "footer":
            return wrap(*rng.choice([("footer", []), ("div", ["footer"]), ("footer", ["bottom"]), ("div", ["copyright"]), ("div", ["legal"])]), f"{OTHER}&copy; {words(4)}" if rng.random() < 0.5 else text)
        if kind == "side":
            return wrap(*rng.choice([("aside", []), ("div", ["sidebar"]), ("aside", ["widget"]), ("div", ["related"]), ("section", ["recommended"]), ("div", ["side"])]), text + (links(3) if rng.random() < 0.4 else ""))
        if kind == "notice":
            name = rng.choice(["notice", "cookie", "cookies", "consent", "banner", "alert", "popup", "modal", "toolbar", "skip"])
            return wrap(rng.choice(["div", "section", "aside", "p"]), [name], OTHER + words(size()))
        if kind == "ad":
            name = rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion"])
            return wrap(rng.choice(["div", "div", "aside", "section", "p"]), [name], OTHER + words(size()))
        if kind == "form":
            inner = f"<label>{OTHER}{words(2)}</label><input><button>{OTHER}{words(1)}</button>"
            inner = f"<p>{OTHER}{words(size())}</p>" + inner if rng.random() < 0.6 else inner
            return wrap("form", rng.choice([[], ["newsletter"], ["search"], ["login"], ["subscribe"], ["signup"], ["form"]]), inner)
        if kind == "comments":
            name = rng.choice(["comments", "comment", "replies", "reply", "discussion", "respond"])
            each = rng.choice([("", []), ("", []), ("article", []), ("article", [rng.choice(["comment", "reply"])]), ("div", ["comment"])])
            said = [piece(OTHER) if not each[0] else wrap(*each, piece(OTHER)) for _ in range(rng.randint(1, 5))]
            return wrap(rng.choice(["section", "div", "ol", "article"]), [name], "".join(said))
        return wrap(rng.choice(["div", "p"]), [rng.choice(["share", "social", "tags"])], links(3) if rng.random() < 0.5 else text)

    inside = "".join(piece(ARTICLE) for _ in range(rng.choice([0, 1, 2, 4, 8, 14])))
    if rng.random() < 0.75:
        inside = f"<h1>{ARTICLE}{words(rng.randint(2, 10))}</h1>" + inside
    for kind in ("ad", "form", "share", "side", "notice", "comments"):
        if rng.random() < 0.2:
            inside += other(kind) + (piece(ARTICLE) if kind != "comments" else "")
    headed = rng.random() < 0.25
    shape = rng.choice(["article", "article", "main", "both"]) if headed else rng.choice(["article", "article", "article", "main", "named", "named", "both", "bare"])
    if headed:
        under = piece(ARTICLE) if rng.random() < 0.4 else ""
        inside = f"<header{attr(['entry', 'header']) if rng.random() < 0.4 else ''}><h1>{ARTICLE}{words(rng.randint(1, 8))}</h1>{under}</header>{inside}"
    if shape in ("article", "both") and rng.random() < 0.15:
        inside += f"<footer>{OTHER}{words(size())}</footer>"
    good = [rng.choice(GOOD_NAMES)]
    if shape == "article":
        inside = wrap("article", good if rng.random() < 0.4 else [], inside)
    elif shape == "main":
        inside = wrap("main", good if rng.random() < 0.4 else [], inside)
    elif shape == "named":
        inside = wrap(rng.choice(["div", "section"]), good, inside)
    elif shape == "both":
        inside = wrap("main", [], wrap("article", [], inside))
    before = "".join(other(k) for k in ("header", "nav", "notice", "ad") if rng.random() < 0.5)
    after = "".join(other(k) for k in ("share", "comments", "side", "form", "nav", "ad", "footer") if rng.random() < 0.4)
    # classes of site themes: on the body, and on a container around an article that its own tag marks
    theme = " ".join(rng.choices([f"{n}-{w}" for n in ("sidebar", "comments", "header", "nav") for w in ("open", "left", "fixed", "on")], k=rng.randint(1, 3)))
    if shape not in ("bare", "named") and rng.random() < 0.4:
        inside = wrap("div", [rng.choice(BAD_NAMES)], inside) if rng.random() < 0.2 else wrap("div", [rng.choice(GOOD_NAMES)], inside)
    page = f"{before}{inside}{after}"
    if rng.random() < 0.3:
        page = f'<div class="{theme}">{page}</div>'
    return f'<html><head><title>x</title></head><body class="{theme}">{page}</body></html>'


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (article blocks joined by an empty line), n_blocks, n_kept."""
    model = model or default_model()
    rows = spread(pick(pages, page_id=id_col, url=url_col, html=html_col), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, kept = [], [], []
            for page in batch.column("html"):
                blocks = blocks_of(page.as_py() or "")
                chosen = [b.text for b, on in zip(blocks, model.labels(page_features(blocks))) if on]
                texts.append("\n\n".join(chosen))
                sizes.append(len(blocks))
                kept.append(len(chosen))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(kept, pa.int32())],
                names=["page_id", "url", "text", "n_blocks", "n_kept"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_blocks int, n_kept int")
