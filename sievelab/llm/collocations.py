"""Collocations: frequent phrases of two to five words, scored by the parts they can be cut into.

* Texts become blocks of about ``BLOCK`` words: distinct words, a number among them for each word, and the pieces (between
  stops) with their languages. Pieces longer than a block go on in the next one, with the last words repeated as context.
* Rabin-Karp fingerprints: with ``w`` the words' hashes and ``b`` an odd base, prefix sums of ``w[i] * b**-i`` modulo 2**64 give the
  polynomial of any stretch of words as a difference times a power. Mixed with length and language, it stands for a phrase.
* A block sends each distinct fingerprint once, with its count; keys are dealt to parts by range, a part adds the
  counts up and answers each block which of its fingerprints reach ``least``. The pointer of an occurrence is its block and
  the fingerprint's rank in it, so an answer is one bit.
* A block looks the frequent fingerprints up in its text, groups their occurrences by their words (two phrases with one fingerprint
  part here), and sends the phrases with their counts to the fingerprint's part, packed as one value. The part adds them up as text
  and cuts them off at ``least``: colliding fingerprints can only add candidates, never lose or change a count. Only frequent
  phrases leave the parts as rows; all others never become text.
* Every cut asks for the counts of its parts in one look-up join that deals hot keys out. Scores are exact decimals.
* A phrase inside a longer one with as many occurrences is inside one that is one word longer with as many, too, so only
  those are compared.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each; an empty table gives an empty
table; extra columns are left out; ties of score go by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelab.llm.common import drop_path, pick, spread, written
from sievelab.llm.packed import key_ranges, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys
from sievelab.llm.wordhash import U, mix
from sievelab.operators.skew import lookup_join

BLOCK = 2_000_000
#: Words of one phrase length in a part, about.
PART_WORDS = 4_000_000
LONGEST = 5
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

GAPS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: A-Z become a-z, blanks between words 32, stops 33.
FOLD = np.array([32 if b in GAPS else 33 if b in STOPS else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

BLOCKS = "block long, langs array<string>, lang_words array<long>, words binary, tokens binary, piece_lang binary, piece_size binary, piece_seen binary"


def split_words(column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts as numbers, the distinct words, and for each piece its text and its number of words."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    raw = FOLD[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    apart = (raw == 32) | (raw == 33)
    begins = ~apart
    begins[1:] &= apart[:-1]
    opens = offsets[:-1][np.diff(offsets) > 0]
    begins[opens] = ~apart[opens]
    starts = np.flatnonzero(begins)
    # the pieces before a place: stops up to it, and texts up to it
    stop = np.cumsum(raw == 33)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    piece = (stop[starts] if len(starts) else starts) + owner
    raw = np.where(apart, 32, raw).astype(np.uint8)
    coded = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)
    ).dictionary_encode()
    names: dict[bytes, int] = {}
    number = np.array([names.setdefault(w.rstrip(b" "), len(names)) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    _, first, sizes = np.unique(piece, return_index=True, return_counts=True)
    return (number[codes] if len(codes) else np.zeros(0, np.int64)), list(names), owner[first], sizes


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.langs: dict[str, int] = {}
        self.tokens: list[np.ndarray] = []
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.room = BLOCK

    def add(self, names: list[bytes], codes: np.ndarray, langs: list[str], sizes: np.ndarray, seen: np.ndarray) -> None:
        used, where = np.unique(codes, return_inverse=True)
        mine = np.array([self.names.setdefault(names[i], len(self.names)) for i in used], np.int32)
        self.tokens.append(mine[where])
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)
        self.pieces.append((lang, sizes.astype(np.int32), seen.astype(np.int32)))
        self.room -= len(codes)

    def close(self, number: int) -> pa.RecordBatch:
        lang, size, seen = (np.concatenate(x) for x in zip(*self.pieces))
        words = np.bincount(lang, weights=size - seen, minlength=len(self.langs)).astype(np.int64)
        packed = squeeze(np.frombuffer(b" ".join(self.names), np.uint8))
        values = [number, list(self.langs), words.tolist(), packed, squeeze(np.concatenate(self.tokens)), squeeze(lang), squeeze(size), squeeze(seen)]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 5]
        columns = [f.strip().split(" ")[0] for f in BLOCKS.split(",")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=columns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    block = _Open()
    context = LONGEST - 1
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            langs = part.column("lang").to_pylist()
            codes, names, owner, sizes = split_words(part.column("text"))
            ends = np.cumsum(sizes)
            first, begun = 0, 0
            while first < len(sizes):
                # whole pieces that fit, or as much of one as fits
                base = ends[first] - sizes[first]
                last = int(np.searchsorted(ends, base + begun + block.room, side="right"))
                if last > first:
                    low = base + max(0, begun - context)
                    seen = np.zeros(last - first, np.int64)
                    seen[0] = base + begun - low
                    block.add(names, codes[low : ends[last - 1]], [langs[i] for i in owner[first:last]], np.diff(ends[first:last], prepend=low), seen)
                    first, begun = last, 0
                elif block.room > context and sizes[first] > BLOCK:
                    low, stop = base + max(0, begun - context), base + begun + block.room - context
                    block.add(names, codes[low:stop], [langs[owner[first]]], np.array([stop - low]), np.array([base + begun - low]))
                    begun = stop - base
                    block.room = 0
                else:
                    block.room = 0
                if block.room <= 0:
                    if block.pieces:
                        yield block.close(number)
                        number += 1
                    block = _Open()
    if block.pieces:
        yield block.close(number)


class Block:
    """A block's words, and the fingerprints of its phrases."""

    def __init__(self, row: dict):
        self.langs = row["langs"]
        self.words = unsqueeze(row["words"], np.uint8).tobytes().split(b" ")
        self.tokens = unsqueeze(row["tokens"], np.int32)
        lang, size, seen = (unsqueeze(row[c], np.int32) for c in ("piece_lang", "piece_size", "piece_seen"))
        piece = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.lang = lang[piece]
        stops = np.cumsum(size.astype(np.int64))
        #: words from each place to the end of its piece, and from it to the end of the context
        self.left = stops[piece] - np.arange(len(piece))
        self.fresh = (stops - size + seen)[piece] - np.arange(len(piece))
        digits = np.fromiter(map(xxhash.xxh64_intdigest, self.words), U, len(self.words))[self.tokens]
        n = len(digits)
        powers, inverse = np.full(n + 1, BASE, U), np.full(n, BASE_INVERSE, U)
        powers[0], inverse[:1] = 1, 1
        self.powers = np.cumprod(powers, dtype=U)
        self.prefix = np.concatenate([np.zeros(1, U), np.cumsum(digits * np.cumprod(inverse, dtype=U), dtype=U)])
        self.lang_hash = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in self.langs), U, len(self.langs))

    def places(self, size: int) -> np.ndarray:
        """Where phrases of so many words begin that end in their piece and not in its context."""
        return np.flatnonzero((self.left >= size) & (self.fresh < size))

    def fingerprints(self, places: np.ndarray, size: int) -> np.ndarray:
        value = (self.prefix[places + size] - self.prefix[places]) * self.powers[places + size - 1]
        return mix(value ^ mix(self.lang_hash[self.lang[places]] + U(size)))

    def phrases(self, size: int, frequent: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """lang, phrase and n of the phrases whose fingerprint's rank in the block is marked, and that rank."""
        places = self.places(size)
        _, where = np.unique(self.fingerprints(places, size), return_inverse=True)
        wanted = frequent[where]
        places, where = places[wanted], where[wanted]
        order = np.argsort(where, kind="stable")
        places, where = places[order], where[order]
        if not len(places):
            return self.table(places, np.zeros(0, np.int64), size), where
        new = np.append(True, where[1:] != where[:-1])
        group = np.cumsum(new) - 1
        first = places[new]
        same = self.lang[places] == self.lang[first[group]]
        for i in range(size):
            same &= self.tokens[places + i] == self.tokens[first[group] + i]
        if same.all():
            return self.table(first, np.bincount(group), size), where[new]
        # another phrase with the fingerprint of one: told apart by the words
        whole = np.stack([self.lang[places], *[self.tokens[places + i] for i in range(size)]], axis=1)
        _, first, n = np.unique(whole, axis=0, return_index=True, return_counts=True)
        return self.table(places[first], n, size), where[first]

    def table(self, places: np.ndarray, n: np.ndarray, size: int) -> pa.Table:
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        parts = [words.take(pa.array(self.tokens[places + i])) for i in range(size)]
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[places]))
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        return pa.table({"lang": lang, "phrase": phrase, "n": pa.array(n, pa.int64())})


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


ASKED = "words int, part int, block long, keys binary, counts binary"
ANSWER = "words int, part int, block long, bits binary, size int"
FOUND = "words int, part int, phrases binary"


def _merged(group: pa.Table, least: int) -> pa.Table:
    """Phrases of one part added up over blocks, the frequent ones."""
    every = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in group.column("phrases").to_pylist()])
    summed = every.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    summed = summed.filter(pc.greater_equal(summed.column("n_sum"), least))
    words = pa.array(np.full(len(summed), group.column("words")[0].as_py()), pa.int32())
    return pa.table({"lang": summed.column("lang"), "phrase": summed.column("phrase"), "words": words, "n": summed.column("n_sum")})


def _answers(group: pa.Table, least: int) -> pa.Table:
    """For each block, which of the fingerprints that it asked for are frequent."""
    keys = [unsqueeze_keys(k) for k in group.column("keys").to_pylist()]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unsqueeze(c, np.int64) for c in group.column("counts").to_pylist()])
    frequent = np.bincount(where, weights=counts, minlength=len(every)) >= least
    bits, at = [], 0
    for k in keys:
        bits.append(squeeze(np.packbits(frequent[where[at : at + len(k)]])))
        at += len(k)
    out = group.select(["words", "part", "block"])
    return out.append_column("bits", pa.array(bits, pa.binary())).append_column("size", pa.array([len(k) for k in keys], pa.int32()))


def frequent_phrases(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words and n of all phrases of 1 to ``LONGEST`` words met ``least`` times or more; lang and n of all words."""
    spark = docs.sparkSession
    # the id only deals rows out over tasks
    rows = pick(docs, id=id_col, lang=F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    blocks, blocks_path = written(spread(rows, "id").mapInArrow(_blocks, BLOCKS), "phrase-blocks", with_path=True)
    totals = blocks.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n"))
    totals = written(totals, "phrase-totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PART_WORDS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("words", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                for size in range(1, LONGEST + 1):
                    keys, counts = np.unique(block.fingerprints(block.places(size), size), return_counts=True)
                    for part, low, high in key_ranges(keys, parts):
                        values = (size, part, row["block"], squeeze_keys(keys[low:high]), squeeze(counts[low:high].astype(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, (_, k) in zip(values, fields)], names=[n for n, _ in fields])

    def answer(group: pa.Table) -> pa.Table:
        return _answers(group, least)

    def look_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(block.to_pylist()[0])
        got = sorted(answers.to_pylist(), key=lambda r: (r["words"], r["part"]))
        rows = []
        for size in range(1, LONGEST + 1):
            mine = [r for r in got if r["words"] == size]
            if not mine:
                continue
            marks = [np.unpackbits(unsqueeze(r["bits"], np.uint8), count=r["size"]) for r in mine]
            found, ranks = own.phrases(size, np.concatenate(marks).astype(bool))
            part = np.searchsorted(np.cumsum([r["size"] for r in mine]), ranks, side="right")
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(len(mine) + 1))
            found = found.take(pa.array(order))
            rows += [(size, r["part"], _pack(found.slice(a, b - a))) for r, a, b in zip(mine, cuts, cuts[1:]) if b > a]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.table({"words": pa.array(columns[0], pa.int32()), "part": pa.array(columns[1], pa.int32()), "phrases": pa.array(columns[2], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        return _merged(group, least)

    asked = blocks.mapInArrow(ask, ASKED).repartition(parts, "words", "part")
    answers = asked.groupBy("words", "part").applyInArrow(answer, ANSWER)
    seen = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(look_up, FOUND)
    counted = seen.repartition(parts, "words", "part").groupBy("words", "part").applyInArrow(merge, "lang string, phrase string, words int, n long")
    phrases = written(counted, "phrases")
    drop_path(spark, blocks_path)
    return phrases, totals


def _words(phrase: str, count: Column) -> Column:
    """The first so many words of a phrase; the last ones for a negative number."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words or more.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its weakest cut, ``n`` all words; a phrase goes if a longer one that
    holds it has at least ``share`` hundredths of its count.
    """
    phrases, totals = frequent_phrases(docs, least, lang_col, text_col, id_col)
    # no word holds a line break, so the last one ends the language
    key = lambda phrase: F.concat("lang", F.lit("\n"), phrase)
    size = F.col("words")
    candidates = phrases.filter(size > 1)

    longer = candidates.filter(size > 2)
    inner = F.explode(F.array(_words("phrase", size - 1), _words("phrase", 1 - size)))
    covered = longer.select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer_n"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(
        F.col("longer_n").isNull() | (100 * F.col("longer_n") < share * F.col("n"))
    ).select("lang", "phrase", "words", F.col("n").alias("a"))

    ends = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("is_left"), _words("phrase", k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("is_left"), _words("phrase", k - size).alias("part")),
    ))
    asked = kept.select("lang", "phrase", "a", F.explode(F.flatten(ends)).alias("x")).select("lang", "phrase", "a", "x.k", "x.is_left", key(F.col("x.part")).alias("key"))
    asked = written(asked, "phrase-cuts")
    wanted = asked.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    counts = wanted.join(phrases.select(key(F.col("phrase")).alias("key"), F.col("n").alias("f")), "key")
    found = lookup_join(asked, counts, "key", F.col("phrase"), "times")
    cuts = range(1, LONGEST)
    sides = [F.max(F.when((F.col("k") == k) & (F.col("is_left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}") for k in cuts for left in (True, False)]
    scored = found.groupBy("lang", "phrase", "a").agg(*sides).join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    # ten to the sixteenth words at most, so products stay below 38 digits
    exact = "cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l{k} as decimal(16,0)) * cast(r{k} as decimal(16,0)))"
    options = F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(exact.format(k=k)).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in cuts])
    best = scored.select("lang", "phrase", "a", "n", F.array_min(F.filter(options, lambda x: x.isNotNull())).alias("cut"))
    rows = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))

    # first within slices of a language, so that no task sorts all of it
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
