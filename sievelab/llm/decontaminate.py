"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all items become one automaton over word numbers. Documents stream through it word by
word; at each place it holds the longest run of words, ending there, that occurs in some item. A run of at least
``WINDOW`` words hits all its words. An item of fewer words is one window of its own and hits where it occurs whole.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, so everything beyond ASCII is
a letter. The item set is a query set of limited size: items are dealt into automata of at most ``BLOCK_WORDS`` words
each, and every document passes all of them in its task; beyond ``MAX_WORDS`` the set is refused, never cut.

Defined results: null and wordless texts have no words and no hits; items that are null or wordless match nothing;
repeated rows are judged one by one; null ids stay null; an empty benchmark leaves all documents clean; an empty
table gives an empty table; extra columns are left out or, in ``remove_spans``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievelab.llm.common import pick, spread, trimmed

WINDOW = 10
BLOCK_WORDS = 1_000_000
MAX_WORDS = 20_000_000

#: Separators become blanks and A-Z become a-z, byte by byte; UTF-8 bytes beyond ASCII stay.
FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with what the matching needs at each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        states = len(self.next)
        #: items with a window whose words end in this state
        self.items: dict[int, set] = {}
        #: short items that are whole in this state, as (words, item)
        own: dict[int, list[tuple[int, object]]] = {}
        #: the state of the last ``window`` words of a run that ends in this state
        self.window_state = [-1] * states
        order = sorted(range(states), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.window_state[v] = v if self.length[up] < window else self.window_state[up]
        for item, words in items:
            v = 0
            for word in words:
                v = self.next[v][word]
                if self.length[v] >= window and (u := self.window_state[v]) >= 0:
                    self.items.setdefault(u, set()).add(item)
            if 0 < len(words) < window:
                own.setdefault(v, []).append((len(words), item))
        #: all short items that end in a run of this state: its own, and those of shorter suffixes
        self.short: dict[int, tuple[list, list]] = {}
        for v in order[1:]:
            above = self.short.get(self.link[v])
            inherited = above[0] + above[1] if above else []
            if v in own or inherited:
                self.short[v] = (own.get(v, []), inherited)

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        state = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        else:
            self.link[state] = 0
        return state

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words as (start, end), and the items that have a window there."""
        moves, link, length, window = self.next, self.link, self.length, self.window
        short, root = self.short, self.next[0]
        spans: list[tuple[int, int]] = []
        items: set = set()
        v = run = 0
        for i, word in enumerate(words):
            to = moves[v].get(word)
            if to is not None:
                v, run = to, run + 1
            elif v:
                while v > 0 and word not in moves[v]:
                    v = link[v]
                to = moves[v].get(word)
                if to is None:
                    v = run = 0
                    continue
                run = length[v] + 1 if v else 1
                v = to
            else:
                continue
            if run >= window:
                _join(spans, i + 1 - run, i + 1)
                u = v if run >= length[v] else self._holding(v, run)
                items |= self.items.get(self.window_state[u] if u >= 0 else -1, set())
            if short and v in short:
                whole, shorter = short[v]
                for n, item in shorter:
                    _join(spans, i + 1 - n, i + 1)
                    items.add(item)
                for n, item in whole:
                    if n <= run:
                        _join(spans, i + 1 - n, i + 1)
                        items.add(item)
        return spans, items

    def _holding(self, v: int, run: int) -> int:
        """The state that holds the last ``run`` words of ``v``."""
        while self.length[self.link[v]] >= run:
            v = self.link[v]
        return v


def _join(spans: list[tuple[int, int]], start: int, end: int) -> None:
    """Adds a span that ends last; spans that touch become one."""
    while spans and spans[-1][1] >= start:
        before = spans.pop()
        start, end = min(start, before[0]), max(end, before[1])
    spans.append((start, end))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[object, list[bytes]]]]:
    """The items in blocks of at most ``BLOCK_WORDS`` words; refuses a set of more than ``MAX_WORDS``."""
    rows = pick(benchmark, item_id=item_col, text=text_col).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > 8 * MAX_WORDS:
        raise ValueError(f"the items have {size} bytes; split the set and judge by each part")
    blocks: list[list] = [[]]
    room = BLOCK_WORDS
    for row in rows.sort("item_id").toLocalIterator():
        words = item_words(row.text)
        if words:
            if len(words) > room and blocks[-1]:
                blocks.append([])
                room = BLOCK_WORDS
            blocks[-1].append((row.item_id, words))
            room -= len(words)
    return blocks if blocks[-1] else []


RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (ids as strings, sorted), spans (word positions, end exclusive)."""
    blocks = item_blocks(benchmark, item_col, item_text_col)
    sent = docs.sparkSession.sparkContext.broadcast(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(block, window) for block in sent.value]
        for batch in batches:
            found = []
            for text in batch.column("text"):
                data = text.as_buffer()
                words = (data.to_pybytes() if data else b"").translate(FOLD).split()
                spans, items = [], set()
                for a in automata:
                    more, its = a.hits(words)
                    spans, items = (more if not spans else _union(spans, more)), items | its
                found.append((len(words), sum(e - s for s, e in spans), sorted(map(str, items)), spans))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                    pa.array(
                        [[{"start": s, "end": e} for s, e in f[3]] for f in found],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    rows = spread(pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col), "doc_id")
    return rows.mapInArrow(trimmed(run), RESULT)


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        _join(out, start, end)
    return out


def remove_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_coverage: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` without the passages that items share with them.

    A hit span goes from its first word to its last, in the text as it was written. Documents of which more than
    ``max_coverage`` of the words are hit are left out whole. Untouched texts, null ones too, stay as they are.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col)
    sent = docs.sparkSession.sparkContext.broadcast(blocks)
    schema = docs.schema
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [Automaton(block, window) for block in sent.value]
        for batch in batches:
            keep, texts, changed = [], [], False
            for text in batch.column(place):
                data = text.as_buffer()
                raw = data.to_pybytes() if data else None
                folded = (raw or b"").translate(FOLD)
                words = folded.split()
                spans: list[tuple[int, int]] = []
                for a in automata:
                    spans = _union(spans, a.hits(words)[0])
                hit = sum(e - s for s, e in spans)
                keep.append(hit <= max_coverage * len(words))
                texts.append(_without(raw, folded, words, spans) if hit else raw)
                changed |= hit > 0
            if changed:
                column = pa.array(texts, pa.binary()).cast(batch.schema.field(place).type)
                batch = batch.set_column(place, batch.schema.field(place), column)
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(trimmed(run), schema)


def _without(raw: bytes, folded: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last."""
    out, done, at, n = [], 0, 0, 0
    for start, end in spans:
        while n < start:
            at = folded.index(words[n], at) + len(words[n])
            n += 1
        first = folded.index(words[n], at)
        while n < end:
            at = folded.index(words[n], at) + len(words[n])
            n += 1
        out.append(raw[done:first])
        done = at
    return b"".join([*out, raw[done:]])
