"""BPE encoding and decoding by tree concatenation, exactly as the tokenizers library does it.

* A text longer than ``PIECE`` code points is cut by Spark into pieces that are encoded in parallel tasks.
* Inside a piece, white space is a border that no token of a supported tokenizer crosses, and so are changes between
  letters, digits and signs in words of plain characters. What lies between is encoded once and looked up from then on, in
  a table of ``REMEMBERED`` bytes at most. A word longer than ``LEAF`` is cut into halves down to leaves, and all leaves are
  encoded together.
* At each join a window of text around it is encoded again and grown until it gives, on both sides, two tokens in
  a row that the side has at the same places. Between them the window's tokens replace those of the sides. A sequence
  of BPE tokens in which all neighbours are right is right, so the joined tokens are those of the whole text.

A tokenizer is supported for word look-up if its pre-tokenizer drops white space; texts of others go through
the tree whole. Truncation and padding of a tokenizer file are switched off.

Defined results: null and blank texts give no ids and decode to the empty text; repeated rows and null ids are kept as
they come; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievelab.llm.common import give_back, pick, spread, trimmed

LEAF = 512
PIECE = 1 << 20
FIRST_WINDOW = 32
#: Bytes of parts of words that a worker remembers, with their ids; and texts taken together.
REMEMBERED = 16 << 20
SLICE = 2 << 20
#: White space bytes become blanks; the second also lowers A-Z.
BLANK = np.array([32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else BLANK[b] for b in range(256)], np.uint8)


class Encoded:
    """Tokens of a text with their places in it."""

    def __init__(self, text: str, ids: list[int], places: list[tuple[int, int]]):
        self.text, self.ids, self.places = text, ids, places


class Remembered:
    """Parts of words and their ids as flat arrays, in two generations of bounded size: what was used since the last turn
    outlives the next one."""

    def __init__(self, limit: int = REMEMBERED):
        self.limit = limit
        self.young = self.old = self._none()

    @staticmethod
    def _none() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: pa.Array, make: Callable[[list[str]], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words: where each one's begin in the third array, how many there are, and that array."""
        young, old = (pc.fill_null(pc.index_in(words, value_set=g[0]), -1).to_numpy() for g in (self.young, self.old))
        missing = np.flatnonzero((young < 0) & (old < 0))
        made = make(words.take(pa.array(missing)).to_pylist()) if len(missing) else []
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.concatenate([self.young[2], self.old[2], np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))])
        first, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = 0
        for found, (_, many, ids) in ((old, self.old), (young, self.young)):
            base = len(self.young[2]) if found is old else 0
            known = np.flatnonzero(found >= 0)
            at = np.cumsum(many) - many
            first[known], length[known] = at[found[known]] + base, many[found[known]]
        first[missing], length[missing] = len(self.young[2]) + len(self.old[2]) + np.cumsum(sizes) - sizes, sizes
        # overlong ones are not worth the room
        fresh = np.flatnonzero((young < 0) & (pc.utf8_length(words).to_numpy() <= LEAF))
        if len(fresh):
            taken = flat[_spread(first[fresh], length[fresh])]
            self.young = (pa.concat_arrays([self.young[0], words.take(pa.array(fresh))]), np.append(self.young[1], length[fresh]), np.append(self.young[2], taken))
            if sum(x.nbytes for x in self.young) > self.limit // 2:
                self.old, self.young = self.young, self._none()
        return first, length, flat


def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all stretches one after another."""
    after = np.cumsum(length)
    return np.arange(int(after[-1]) if len(after) else 0) + np.repeat(first - (after - length), length)


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = Remembered()
        self.shown: pa.Array | None = None
        self.by_words, self.pattern = self._shape(spec)
        self.byte_chars = _byte_chars()
        # a window sees a special token that crosses the join whole
        self.first_window = max([FIRST_WINDOW, *(2 * len(t["content"]) for t in spec.get("added_tokens", []))])

    @staticmethod
    def _shape(spec: dict) -> tuple[bool, object]:
        """Whether white space is a border, and the pattern of parts where the steps of the file are the known ones:
        NFC, white space to blanks, lower case; then a split by a pattern, then bytes as characters."""
        import regex

        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if not pre or pre[0].get("type") != "Split" or not (pre[0].get("invert") and pre[0].get("behavior") == "Removed"):
            return False, None
        pattern = pre[0]["pattern"].get("Regex", "")
        if regex.search(pattern, " \t\n\r\x0b\x0c") or regex.search(pattern, "a a").group() != "a":
            return False, None
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"]
        known = plain and not pre[1].get("add_prefix_space") and spec["model"]["type"] == "BPE"
        return True, regex.compile(pattern) if known else None

    # one word

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of texts without inner borders."""
        out: list[list[int]] = []
        far = []
        tokenize = self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            ids: list[int] = []
            if len(word) > LEAF or self.pattern is None or "<|" in word or (not word.isascii() and max(word) >= "̀") or "İ" in word:
                far.append(i)
            else:
                for part in [word] if word.isascii() and word.isalpha() and word.islower() else self.pattern.findall(word.lower()):
                    shown = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.byte_chars)
                    ids += [t.id for t in tokenize(shown)]
            out.append(ids)
        if far:
            for i, done in zip(far, self.tree([words[i] for i in far])):
                out[i] = done.ids
        return out

    # long words

    def tree(self, texts: list[str]) -> list[Encoded]:
        """Whole texts by halves: leaves in one batch, then joins from neighbours upwards."""
        levels: list[list[Encoded]] = []
        leaves: list[str] = []
        counts = []
        for text in texts:
            n = 1
            while len(text) > n * LEAF:
                n *= 2
            cuts = [len(text) * i // n for i in range(n + 1)]
            leaves += [text[a:b] for a, b in zip(cuts, cuts[1:])]
            counts.append(n)
        done = self._encode(leaves)
        at = 0
        for n in counts:
            levels.append(done[at : at + n])
            at += n
        while any(len(x) > 1 for x in levels):
            levels = [[self.join(a, b) for a, b in zip(x[::2], x[1::2])] if len(x) > 1 else x for x in levels]
        return [x[0] for x in levels]

    def _encode(self, texts: list[str]) -> list[Encoded]:
        batch = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [Encoded(t, e.ids, e.offsets) for t, e in zip(texts, batch)]

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The tokens of both texts as one, by a window around the join that grows until both sides agree."""
        border = len(left.text)
        text = left.text + right.text
        size = self.first_window
        moved = [(a + border, b + border) for a, b in right.places]
        while True:
            low, high = max(0, border - size), min(len(text), border + size)
            seen = self._encode([text[low:high]])[0]
            places = [(a + low, b + low) for a, b in seen.places]
            head = (0, 0) if low == 0 else self._agree(left.ids, left.places, seen.ids, places, lambda p: p[1] < border)
            tail = (
                (len(right.ids), len(seen.ids))
                if high == len(text)
                else self._agree(right.ids, moved, seen.ids, places, lambda p: p[0] > border)
            )
            if head and tail and head[1] <= tail[1]:
                return Encoded(
                    text,
                    left.ids[: head[0]] + seen.ids[head[1] : tail[1]] + right.ids[tail[0] :],
                    left.places[: head[0]] + places[head[1] : tail[1]] + moved[tail[0] :],
                )
            size *= 2

    @staticmethod
    def _agree(ids, places, seen_ids, seen_places, inside) -> tuple[int, int] | None:
        """Numbers in the side and in the window of a token that is the second of two equal ones in a row."""
        at = {}
        low, high = seen_places[0][0] if seen_places else 0, seen_places[-1][1] if seen_places else 0
        first, last = _between(places, low, high)
        for i in range(first, last):
            at[(places[i], ids[i])] = i
        for j in range(1, len(seen_ids) - 1):
            if inside(seen_places[j]) and inside(seen_places[j - 1]):
                i = at.get((seen_places[j], seen_ids[j]))
                if i is not None and i > 0 and at.get((seen_places[j - 1], seen_ids[j - 1])) == i - 1:
                    return i, j
        return None

    # many texts

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the ends of each text; texts are UTF-8 bytes between offsets."""
        raw = data[offsets[0] : offsets[-1]]
        # what the tokenizer does not tell apart is looked up once; special tokens are case sensitive
        raw = (LOWER if self.pattern is not None and b"<|" not in raw.tobytes() else BLANK)[raw]
        borders = raw == 32
        begins = np.zeros(len(raw), bool)
        begins[1:] = borders[:-1] & ~borders[1:]
        begins[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = True
        if self.pattern is not None:
            begins |= _part_borders(raw, np.flatnonzero(begins))
        starts = np.flatnonzero(begins)
        solid = ~borders
        before = np.append(0, np.cumsum(solid))
        words = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(before[starts], before[-1]).astype(np.int32)), pa.py_buffer(raw[solid])
        )
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts, lengths, flat = self.known.look_up(coded.dictionary, self.word_ids)
        many = lengths[codes]
        after = np.cumsum(many)
        # chunks before each text's end
        closed = np.searchsorted(starts, offsets[1:] - offsets[0], side="left")
        text_ends = np.concatenate([[0], after])[closed]
        return flat[_spread(firsts[codes], many)], text_ends

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_flat`` for a string column; nulls are empty. Slices keep working memory bounded."""
        column = pc.fill_null(column, "")
        if not self.by_words:
            done = self.tree(column.to_pylist())
            ends = np.cumsum([len(d.ids) for d in done]).astype(np.int64)
            return np.array([i for d in done for i in d.ids], np.int32), ends
        wide = pa.types.is_large_string(column.type)
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
        offsets = offsets.astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        ids, ends, first, base = [], [], 0, 0
        while first < len(column):
            last = int(np.searchsorted(offsets, offsets[first] + SLICE, side="right"))
            last = min(len(column), max(first + 1, last - 1))
            part, stops = self.encode_flat(data, offsets[first : last + 1])
            ids.append(part)
            ends.append(stops + base)
            base += len(part)
            first = last
        return (np.concatenate(ids), np.concatenate(ends)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))


    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The library's text of each list of ids, special ones too."""
        if self.tokenizer.decoder is not None:
            return pa.array(self.tokenizer.decode_batch(ids.to_pylist(), skip_special_tokens=False), pa.string())
        if self.shown is None:
            size = self.tokenizer.get_vocab_size(with_added_tokens=True)
            self.shown = pa.array([self.tokenizer.id_to_token(i) for i in range(size)], pa.string())
        tokens = pa.ListArray.from_arrays(ids.offsets, self.shown.take(ids.values))
        return pc.binary_join(tokens, " ").cast(pa.string())


#: Kinds of bytes: blank, letter, digit, sign; 4 for all that takes a closer look.
KIND = np.array(
    [0 if b == 32 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if b < 32 or chr(b) in "'<\x7f" else 3 for b in range(128)] + [4] * 128,
    np.uint8,
)


def _part_borders(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where parts begin inside words that hold only ASCII and Latin letters of two bytes: at each digit and wherever letters,
    digits and signs meet. A word with any other character, an apostrophe or ``<`` has no inner borders here."""
    kind = KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    # U+00C0 to U+00FF; two of them are signs
    letter = np.where((raw[lead + 1] == 0x97) | (raw[lead + 1] == 0xB7), 3, 1)
    kind[lead] = kind[lead + 1] = letter
    inner = np.zeros(len(raw), bool)
    if not len(starts):
        return inner
    inner[1:] = (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    open_word = np.maximum.reduceat(kind, starts) == 4
    odd = np.zeros(len(raw), np.int8)
    odd[starts] = np.diff(open_word.astype(np.int8), prepend=np.int8(0))
    return inner & (np.cumsum(odd, dtype=np.int8) == 0)


def _between(places: list[tuple[int, int]], low: int, high: int) -> tuple[int, int]:
    """The range of tokens whose places lie between two text positions."""
    from bisect import bisect_left, bisect_right

    return bisect_left(places, (low, -1)), bisect_right(places, (high, 1 << 60))


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Codec(path)
    give_back()
    return made


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE, decoded: bool = False
) -> DataFrame:
    """Per row: doc_id and ids, the tokens of the whole text; with ``decoded`` also the text of the ids, from the same pass."""
    rows = spread(pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col), "doc_id")
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = _lists(*own.encode_column(part.column("text")))
                columns = [part.column("doc_id"), lists, *([own.decode_lists(lists)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    short = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= piece).mapInArrow(trimmed(run), "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))
    far = _encode_long(rows.filter(F.length("text") > piece), path, piece)
    return short.unionByName(decode(far, path) if decoded else far)


def _encode_long(rows: DataFrame, path: str, piece: int) -> DataFrame:
    """Texts of more than one piece: pieces in parallel tasks, then the joins of one text in one task."""
    numbers = F.sequence(F.lit(0), ((F.length("text") - 1) / piece).cast("int"))
    # named by what they hold, so that a task that runs again names them alike; equal rows are worked on once
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256))
    pieces = (
        rows.groupBy("doc_id", name.alias("row")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        .select("row", "doc_id", "times", "text", F.explode(numbers).alias("n"))
        .select("row", "doc_id", "times", "n", F.substring("text", F.col("n") * piece + 1, F.lit(piece)).alias("text"))
        .repartition("row", "n")
    )
    kind = "row string, doc_id long, times long, n int, head string, ids array<int>, tail string, parts array<int>, starts array<int>, ends array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for row in batch.to_pylist():
                yield _piece(own, row)

    def joined(pdf):
        return _joined(codec(path), pdf)

    whole = pieces.mapInArrow(cut, kind).groupBy("row").applyInPandas(joined, "doc_id long, times int, ids array<int>")
    return whole.select("doc_id", F.explode(F.array_repeat("ids", F.col("times"))).alias("ids"))


def _piece(own: Codec, row: dict) -> pa.RecordBatch:
    """A piece as the word at its start, the ids of what no neighbour can change, and the word at its end.

    A piece without a border, or of a tokenizer without borders, is one open word: it is encoded here, with places.
    """
    import re

    text = row["text"]
    out = {"head": text, "ids": None, "tail": None, "parts": None, "starts": None, "ends": None}
    found = re.search("[ \t-\r]", text) if own.by_words else None
    if found:
        first = found.start()
        last = max(text.rfind(c) for c in " \t\n\x0b\x0c\r") + 1
        ids, _ = own.encode_column(pa.array([text[first:last]]))
        out |= {"head": text[:first], "ids": ids, "tail": text[last:]}
    else:
        whole = own.tree([text])[0]
        out |= {"parts": whole.ids, "starts": [a for a, _ in whole.places], "ends": [b for _, b in whole.places]}
    fields = [("row", pa.string()), ("doc_id", pa.int64()), ("times", pa.int64()), ("n", pa.int32()), ("head", pa.string()), ("ids", pa.list_(pa.int32())), ("tail", pa.string())]
    fields += [(c, pa.list_(pa.int32())) for c in ("parts", "starts", "ends")]
    record = {**{c: row[c] for c in ("row", "doc_id", "times", "n")}, **out}
    return pa.RecordBatch.from_arrays([pa.array([record[c]], t) for c, t in fields], names=[c for c, _ in fields])


def _joined(own: Codec, pdf):
    import pandas as pd

    done: list[np.ndarray] = []
    open_word: Encoded | None = None

    def with_next(word: Encoded | None, more: Encoded) -> Encoded:
        return own.join(word, more) if word is not None and word.text else more

    for row in pdf.sort_values("n").itertuples():
        if row.ids is None:
            word = Encoded(row.head, list(row.parts), list(zip(row.starts, row.ends)))
            open_word = with_next(open_word, word)
            continue
        if row.head:
            open_word = with_next(open_word, own.tree([row.head])[0])
        if open_word is not None:
            done.append(np.array(open_word.ids, np.int32))
        done.append(np.array(row.ids, np.int32))
        open_word = own.tree([row.tail])[0] if row.tail else None
    if open_word is not None:
        done.append(np.array(open_word.ids, np.int32))
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "times": pdf["times"].iloc[:1], "ids": [np.concatenate(done)]})


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to rows of doc_id and ids: the library's text of all ids, special ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, own.decode_lists(part.column("ids"))], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
