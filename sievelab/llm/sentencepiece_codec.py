"""SentencePiece encoding and decoding that knows where in the original text each piece comes from.

* A text is normalised here, not by the library: at each place the longest rule of the model's compiled character map (a
  double array of bytes, see ``CharMap``) is replaced, other characters are copied, blanks become U+2581, and every
  normalised byte is given the place of the original byte that it comes from. Stretches in which no rule begins are copied whole.
* No piece of a supported model crosses from another character to U+2581, so the normalised text falls into words there;
  distinct words of a slice are given once to the library's BPE, with its own normaliser switched off.
* A piece's bytes in the normalised text are found by adding up the lengths of the pieces; the places of its first and
  its next byte are its span in the original text. Spans follow each other without gaps; the bytes of a character that
  has no piece share its span's start, and the last one ends it.
* Decoding looks the bytes of all pieces up and joins them; texts that are not valid in the end, and those that begin
  with a control id, are decoded by the library.

Texts are worked on in slices of ``SLICE`` bytes, long ones of plain models in parts between words, so that memory does not grow
with a text's length but for its ids. Models with rules (a character map) or with pieces across words take each text whole.

Defined results: null and empty texts give no ids, no spans and the empty text; repeated rows and null ids are kept as they
come; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievelab.llm.common import pick, spread

SLICE = 4 << 20
BAR = "▁".encode()
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class CharMap:
    """The rules of a compiled character map, found by longest prefix.

    The file format: four bytes with the size of the trie, the trie as a double array of 32-bit units, then the
    replacements, each ended by a zero byte. A unit holds a label in its lowest byte, a flag (bit 8) for a value below it, and the
    distance to its children (from bit 10 on, in units of 256 if bit 9 is set).
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        #: bytes with which a rule begins
        self.first = np.zeros(256, bool)
        if self.units:
            root = self._children(0)
            for b in range(256):
                at = root ^ b
                self.first[b] = at < len(self.units) and self._label(at) == b

    def _children(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit >> 9 & 1) * 8))

    def _label(self, at: int) -> int:
        return self.units[at] & 0x800000FF

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest rule that the text has at this place."""
        if not self.units:
            return None
        found, node = None, self._children(0)
        for n, byte in enumerate(raw[at:], 1):
            node ^= byte
            if node >= len(self.units) or self._label(node) != byte:
                break
            has_value = self.units[node] >> 8 & 1
            node = self._children(node)
            if has_value:
                found = n, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


class Normalizer:
    """Normalises texts as a model's specification says, with the original place of every byte."""

    def __init__(self, spec, blank_last: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.plain = not self.map.units and not spec.remove_extra_whitespaces
        self.dummy, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.bar = BAR if spec.escape_whitespaces else b" "
        if blank_last:
            raise ValueError("models that mark blanks at the end of words are not supported")

    def steps(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, normalised) of each stretch that is replaced or copied as one."""
        starts = np.flatnonzero(self.map.first[np.frombuffer(raw, np.uint8)])
        at = i = 0
        while at < len(raw):
            i += int(np.searchsorted(starts[i:], at))
            stop = int(starts[i]) if i < len(starts) else len(raw)
            if stop > at:
                yield at, stop, raw[at:stop]
            else:
                rule = self.map.longest(raw, at)
                # the character itself, of which the first byte tells the length
                size = rule[0] if rule else 1 + sum(raw[at] >= b for b in (0xC0, 0xE0, 0xF0))
                stop = at + size
                yield at, stop, rule[1] if rule else raw[at:stop]
            at = stop

    def normalize(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and the original place of each and of the end."""
        if not raw:
            return np.zeros(0, np.uint8), np.zeros(1, np.int64)
        parts, places = [], []
        for start, stop, new in self.steps(raw):
            parts.append(np.frombuffer(new, np.uint8))
            copied = new == raw[start:stop]
            places.append(np.arange(start, stop) if copied else np.full(len(new), start))
        text = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        place = np.append(np.concatenate(places) if places else np.zeros(0, np.int64), len(raw))
        if self.trim:
            # of blanks in a row the first is kept, none at the start
            blank = text == 32
            keep = ~blank | np.append(False, ~blank)[: len(blank)]
            text, place = text[keep], place[np.append(keep, True)]
        if not len(text):
            return text, np.zeros(1, np.int64)
        text, place = self.marked(text, place, self.dummy)
        # nor any mark at the end, whatever it was made of
        while self.trim and len(text) and text[-len(self.bar) :].tobytes() == self.bar:
            text, place = text[: -len(self.bar)], place[: -len(self.bar)]
        return text, place

    def marked(self, text: np.ndarray, place: np.ndarray, dummy: bool) -> tuple[np.ndarray, np.ndarray]:
        """Blanks as marks of several bytes, and one before the text if asked for."""
        bar = np.frombuffer(self.bar, np.uint8)
        blank = text == 32
        width = np.where(blank, len(bar), 1)
        front = len(bar) if dummy else 0
        out = np.empty(front + int(width.sum()), np.uint8)
        out[:front] = bar[:front]
        to = np.cumsum(width) - width + front
        out[to] = text
        for i, byte in enumerate(bar):
            out[to[blank] + i] = byte
        places = np.concatenate([np.full(front, place[0]), np.repeat(place[:-1], width), place[-1:]])
        return out, places


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        with open(path, "rb") as f:
            proto = model.ModelProto.FromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        self.normalizer = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        names = [p.piece.encode() for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not supported")
        #: whether words are borders: no piece has the mark behind another character
        self.by_words = self.normalizer.bar == BAR and not any(BAR in n.lstrip(BAR) for n in names if BAR in n.replace(BAR, b"", 1))
        bytes_of = {i: bytes([int(n[3:5], 16)]) for i, (n, k) in enumerate(zip(names, kinds)) if k == BYTE}
        #: bytes of each piece in a normalised text
        self.sizes = np.array([1 if k == BYTE else len(n) for n, k in zip(names, kinds)], np.int64)
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.controls = np.array([k == CONTROL for k in kinds])
        surface = proto.trainer_spec.unk_surface.encode()
        shown = [bytes_of.get(i, b"" if k == CONTROL else surface if k == UNKNOWN else n.replace(BAR, b" ")) for i, (n, k) in enumerate(zip(names, kinds))]
        drops = proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces
        first = [s[1:] if drops and k == NORMAL and n.startswith(BAR) else s for s, n, k in zip(shown, names, kinds)]
        self.shown = pa.array(shown + first, pa.binary())
        # the same pieces without any normalisation
        proto.normalizer_spec.Clear()
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    # encoding

    def normal(self, raw: bytes, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes and places of a text or, for plain models, of a part of one."""
        if not self.normalizer.plain:
            return self.normalizer.normalize(raw)
        return self.normalizer.marked(np.frombuffer(raw, np.uint8), np.arange(len(raw) + 1), self.normalizer.dummy and first and len(raw) > 0)

    def encode_parts(self, parts: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts one after another, the end of each part, and the begin and end of each piece in its part."""
        normal = [self.normal(*p) for p in parts]
        sizes = np.array([len(n) for n, _ in normal], np.int64)
        stops = np.cumsum(sizes)
        text = np.concatenate([n for n, _ in normal]) if normal else np.zeros(0, np.uint8)
        begins = np.zeros(len(text), bool)
        begins[(stops - sizes)[sizes > 0]] = True
        if self.by_words and len(text) > 2:
            bar = np.zeros(len(text), bool)
            bar[:-2] = (text[:-2] == BAR[0]) & (text[1:-1] == BAR[1]) & (text[2:] == BAR[2])
            behind = np.zeros(len(text), bool)
            behind[3:] = bar[:-3]
            begins |= bar & ~behind
        starts = np.flatnonzero(begins)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(text)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text)))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        known = self.pieces.encode(coded.dictionary.to_pylist(), num_threads=1) if len(coded.dictionary) else []
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int32, int(lengths.sum()))
        firsts = np.cumsum(lengths) - lengths
        many = lengths[codes] if len(codes) else np.zeros(0, np.int64)
        after = np.cumsum(many)
        ids = flat[np.arange(int(many.sum())) + np.repeat((firsts[codes] if len(codes) else many) - (after - many), many)]
        ends = np.concatenate([[0], after])[np.searchsorted(starts, stops, side="left")]
        # pieces lie one after another, so their lengths give their places
        to = np.cumsum(self.sizes[ids])
        shift = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
        place = np.concatenate([p[:-1] for _, p in normal]) if normal else np.zeros(0, np.int64)
        last = np.array([p[-1] for _, p in normal], np.int64)
        begin = place[to - self.sizes[ids]]
        # a piece ends where the next byte begins; the last one at the end of the text
        closing = to == stops[shift] if len(shift) else np.zeros(0, bool)
        end = np.where(closing, last[shift], place[np.minimum(to, len(place) - 1)]) if len(ids) else begin
        # a byte within a character ends where it begins, but for the character's last byte
        inner = self.is_byte[ids]
        character = np.append(text, 0)
        open_byte = inner & ~closing & ((character[np.minimum(to, len(text))] & 0xC0) == 0x80) if len(ids) else inner
        lead = np.maximum.accumulate(np.where(~inner | ((character[to - self.sizes[ids]] & 0xC0) != 0x80), np.arange(len(ids)), 0)) if len(ids) else inner
        begin = begin[lead] if len(ids) else begin
        end = np.where(open_byte, begin, end)
        # the places within a part of a text that is longer are moved by the caller
        return ids, ends, begin, end

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, end of each text among them, and spans in each text."""
        texts = pc.fill_null(column, "").cast(pa.large_binary())
        out, counts = [], np.zeros(len(texts), np.int64)
        parts, owners, shifts, room = [], [], [], SLICE

        def close():
            ids, ends, begin, end = self.encode_parts(parts)
            each = np.diff(ends, prepend=0)
            np.add.at(counts, owners, each)
            move = np.repeat(np.array(shifts, np.int64), each)
            out.append((ids, begin + move, end + move))

        for i, text in enumerate(texts):
            for at, raw in self.parts(text.as_buffer().to_pybytes()):
                parts.append((raw, at == 0))
                owners.append(i)
                shifts.append(at)
                room -= len(raw)
                if room <= 0:
                    close()
                    parts, owners, shifts, room = [], [], [], SLICE
        if parts:
            close()
        if not out:
            return np.zeros(0, np.int32), np.cumsum(counts), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, begin, end = (np.concatenate(x) for x in zip(*out))
        return ids, np.cumsum(counts), begin, end

    def parts(self, raw: bytes) -> Iterator[tuple[int, bytes]]:
        """A text as parts of about a slice, cut before blanks that follow another character where the model allows it."""
        at = 0
        while self.by_words and self.normalizer.plain and len(raw) - at > SLICE:
            cut = raw.find(b" ", at + SLICE)
            while cut > 0 and raw[cut - 1] in (0x20, BAR[2]):
                cut = raw.find(b" ", cut + 1)
            if cut < 0:
                break
            yield at, raw[at:cut]
            at = cut
        yield at, raw[at:]

    # decoding

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The library's text of each list of ids."""
        starts = ids.offsets.to_numpy()
        flat = ids.values.to_numpy()
        size = len(self.sizes)
        look = flat.astype(np.int64)
        opening = starts[:-1][np.diff(starts) > 0]
        look[opening] += size
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.shown.take(pa.array(look))), b"")
        odd = np.zeros(len(ids), bool)
        odd[np.diff(starts) > 0] = self.controls[flat[opening]]
        if not odd.any():
            try:
                return joined.cast(pa.string())
            except pa.ArrowInvalid:
                pass
        texts = []
        for i, raw in enumerate(joined.to_pylist()):
            try:
                text = None if odd[i] else raw.decode()
            except UnicodeDecodeError:
                text = None
            texts.append(self.library.decode(ids[i].as_py()) if text is None else text)
        return pa.array(texts, pa.string())


@lru_cache(maxsize=4)
def piece_codec(path: str) -> PieceCodec:
    """One codec for each worker process and file."""
    return PieceCodec(path)


SCHEMA = "doc_id long, ids array<int>, begins array<long>, ends array<long>, covered long"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True, decoded: bool = False) -> DataFrame:
    """Per row: doc_id, ids, begins and ends (the bytes of the original text that each piece stands for), and covered,
    the number of original bytes that pieces stand for.

    Without ``spans`` the two arrays are left out. With ``decoded`` the text of the ids follows, worked out in the same pass.
    """
    rows = spread(pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col), "doc_id")
    names = ["doc_id", "ids", *(["begins", "ends"] if spans else []), "covered", *(["decoded"] if decoded else [])]
    kinds = {"doc_id": "long", "ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "covered": "long", "decoded": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, stops, begin, end = own.encode_column(part.column("text"))
                offsets = pa.array(np.append(0, stops).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                total = np.append(0, np.cumsum(end - begin))
                made = {"doc_id": part.column("doc_id"), "ids": lists, "covered": pa.array(np.diff(total[np.append(0, stops)]))}
                if spans:
                    made |= {"begins": pa.ListArray.from_arrays(offsets, pa.array(begin)), "ends": pa.ListArray.from_arrays(offsets, pa.array(end))}
                if decoded:
                    made["decoded"] = own.decode_lists(lists)
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of doc_id and ids: doc_id, ids and ``decoded``, the library's text of the ids; null lists give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_codec(path)
        for batch in batches:
            ids = batch.column("ids")
            filled = pa.array([[] if x is None else x for x in ids.to_pylist()], pa.list_(pa.int32()))
            texts = pc.if_else(ids.is_valid(), own.decode_lists(filled), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, texts], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
