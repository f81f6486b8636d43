"""Katz back-off bigram model over the whole corpus, with exactly normalised back-off weights.

Words are 64-bit hashes of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; every text ends with one end token.

* Texts become blocks of up to ``BLOCK`` tokens: distinct words and, for each token, a number among them.
* A block asks the partitioned count tables for its distinct words and word pairs, each once: keys are dealt to parts
  by hash, a part adds the training counts of all blocks and answers each. No word, however frequent,
  costs a part more than one entry per block, and a part's size is fixed by the number of parts, which follows the corpus.
* Counts up to ``K`` are discounted by Good-Turing from counts of counts smoothed by a line of logarithms, higher ones by the same
  amount as ``K``, so every context leaves something to unseen words, in every table.
* For each context the discounted mass of its successors and their unigram mass are added up, each distinct pair once;
  ``(1 - first) / (1 - second)`` is its back-off weight, kept in the context table by parts.
* A token's probability: the discounted pair if seen; else the weight of its context times its unigram probability
  (of unknown words: what the discounts leave, as one class); an unseen context goes straight to the unigram.

Defined results: null and empty texts are the end token alone; repeated rows count and are scored one by one but share
their sum if they share an id and are equal in place; rows with a null id are training rows; an empty table gives an
empty table; without training rows only the unknown class has mass; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sievelab.llm.common import drop_path, pick, spread, written
from sievelab.llm.wordhash import U, mix, word_hashes

BLOCK = 2_000_000
PART_TOKENS = 4_000_000
K = 5
#: Counts up to this one make the line of counts of counts; and the flattest slope that it may have.
SMOOTHED = 40
FLATTEST = -1.05
END, BEGIN = U(0x7B1D0C5A9E3F2468), U(0x2C6F81D4E7A90B35)


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; planes of zeros cost nothing."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _open(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _squeeze(np.diff(keys, prepend=U(0)))


def _open_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_open(data, U), dtype=U)


BLOCKS = (
    "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, before array<long>, rows array<long>, words binary, tokens binary"
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number, row_number = TaskContext.get().partitionId() << 33, 0, 0
    held: list[np.ndarray] = []
    pieces: list[tuple] = []
    room = BLOCK

    def close() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(held), return_inverse=True)
        values = [task + number, *map(list, zip(*pieces)), _squeeze_keys(words), _squeeze(tokens.astype(np.int32))]
        longs = pa.list_(pa.int64())
        kinds = [pa.int64(), longs, pa.list_(pa.bool_()), pa.list_(pa.int32()), longs, longs, pa.binary(), pa.binary()]
        names = ["block", "doc_ids", "held", "sizes", "before", "rows", "words", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            each, counts = word_hashes(part.column("text"))
            ends = np.cumsum(counts)
            for doc_id, out, a, b in zip(part.column("doc_id").to_pylist(), part.column("held").to_pylist(), ends - counts, ends):
                text = np.append(each[a:b], END)
                done, last = 0, BEGIN
                while done < len(text):
                    piece = text[done : done + room]
                    held.append(piece)
                    pieces.append((doc_id, out, len(piece), int(np.int64(last.view(np.int64))), task + row_number))
                    done, last, room = done + len(piece), piece[-1], room - len(piece)
                    if not room:
                        yield close()
                        held, pieces, room, number = [], [], BLOCK, number + 1
                row_number += 1
    if held:
        yield close()


@dataclass
class Block:
    """A block's tokens and, for each, the one before it."""

    row: dict
    words: np.ndarray
    tokens: np.ndarray
    before: np.ndarray
    train: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        words, tokens = _open_keys(row["words"]), _open(row["tokens"], np.int32)
        sizes = np.asarray(row["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes
        previous = np.concatenate([[U(0)], words[tokens[:-1]]]).astype(U)
        previous[starts] = np.asarray(row["before"], np.int64).view(U)
        return cls(row, words, tokens, previous, ~np.repeat(np.asarray(row["held"], bool), sizes), starts)

    def pairs(self) -> np.ndarray:
        return mix(mix(self.before) ^ self.words[self.tokens])

    def asked_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of words and contexts, and training counts; the beginning is as frequent as the end."""
        keys = np.unique(np.concatenate([self.words, self.contexts()]))
        counts = np.zeros(len(keys), np.int64)
        counts[np.searchsorted(keys, self.words)] = np.bincount(self.tokens[self.train], minlength=len(self.words))
        return keys, counts

    def contexts(self) -> np.ndarray:
        return np.where(self.before == BEGIN, END, self.before)


ASKED = "kind string, part int, block long, keys binary, counts binary"


def _to_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, and for each list of values their sums by key."""
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    return every, [np.bincount(where, weights=np.concatenate(v), minlength=len(every)) for v in values]


def _answer_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per part and kind: the count table and, for each block, the counts of what it asked for, doubled; the lowest
    bit marks the one block that stands for the key in sums over distinct keys."""
    keys = [_open_keys(k) for k in pdf["keys"]]
    counts = [_open(c, np.int64) for c in pdf["counts"]]
    every, (total,) = _summed(keys, [counts])
    total = total.astype(np.int64)
    free = np.ones(len(every), bool)
    out = []
    kind, part = pdf["kind"].iloc[0], int(pdf["part"].iloc[0])
    for block, own in zip(pdf["block"], keys):
        at = np.searchsorted(every, own)
        answer = total[at] * 2 + free[at]
        free[at] = False
        out.append((kind + " answer", part, int(block), b"", _squeeze(answer)))
    seen = total > 0
    out.append((kind + " table", part, -1, _squeeze_keys(every[seen]), _squeeze(total[seen])))
    return pd.DataFrame(out, columns=["kind", "part", "block", "keys", "counts"])


def smoothed_slope(count_of_counts: dict[int, int]) -> float:
    """Slope b of the line log Z = a + b log r, where Z spreads the number of keys seen r times over the gap to its neighbours
    (Gale and Sampson 1995); at most ``FLATTEST``, for flatter lines would raise counts. Without two points it is -2."""
    seen = sorted(r for r, n in count_of_counts.items() if n and 0 < r <= SMOOTHED)
    if len(seen) < 2:
        return -2.0
    z = []
    for i, r in enumerate(seen):
        before = seen[i - 1] if i else 0
        after = seen[i + 1] if i + 1 < len(seen) else 2 * r - before
        z.append(2 * count_of_counts[r] / (after - before))
    return min(FLATTEST, float(np.polyfit(np.log(seen), np.log(z), 1)[0]))


def discounts(count_of_counts: dict[int, int]) -> np.ndarray:
    """Katz's factors for counts 0 (unused) to ``K``; the last entry is the amount taken from every higher count.

    Good-Turing on the smoothed counts of counts, which are A r**b: (r + 1) n(r + 1) / (r n(r)) is then ((r + 1) / r)**(1 + b),
    and all factors lie between 0 and 1 whatever single counts of counts do.
    """
    rise = 1.0 + smoothed_slope(count_of_counts)
    common = (K + 1.0) ** rise
    r = np.arange(1, K + 1)
    out = np.zeros(K + 2)
    out[1 : K + 1] = (((r + 1.0) / r) ** rise - common) / (1.0 - common)
    out[K + 1] = K * (1 - out[K])
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    counts = np.asarray(counts, float)
    return np.where(counts > K, counts - d[K + 1], counts * d[np.minimum(counts, K).astype(int)])


@dataclass
class Totals:
    """What the whole corpus says in a few numbers."""

    tokens: int
    distinct: int
    unknown: float
    one: np.ndarray
    two: np.ndarray

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.one) / max(1, self.tokens), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def _table_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of counts of table parts."""
    for batch in batches:
        for row in batch.to_pylist():
            values, times = np.unique(_open(row["counts"], np.int64), return_counts=True)
            large = values > SMOOTHED
            rows = [(row["kind"], int(v), int(t), int(v) * int(t)) for v, t in zip(values[~large], times[~large])]
            rows.append((row["kind"], SMOOTHED + 1, int(times[large].sum()), int((values[large] * times[large]).sum())))
            yield _to_batch(rows, "kind string, count long, keys long, tokens long")


def _totals(answers: DataFrame) -> Totals:
    rows = (
        answers.filter("block < 0").select("kind", "counts").mapInArrow(_table_counts, "kind string, count long, keys long, tokens long")
        .groupBy("kind", "count").agg(F.sum("keys").alias("keys"), F.sum("tokens").alias("tokens")).collect()
    )
    words = [r for r in rows if r.kind == "word table"]
    one = discounts({r["count"]: r["keys"] for r in words})
    two = discounts({r["count"]: r["keys"] for r in rows if r.kind == "pair table"})
    tokens, distinct = sum(r.tokens for r in words), sum(r["keys"] for r in words)
    taken = sum(r["keys"] * one[K + 1] if r["count"] > K else r.tokens * (1 - one[r["count"]]) for r in words)
    return Totals(tokens, distinct, taken / tokens if tokens else 1.0, one, two)


SCORED = "kind string, part int, block long, keys binary, counts binary, sums binary, masses binary"


def _scored_block(row: dict, answers: pd.DataFrame, t: Totals, parts: int) -> list[tuple]:
    """What a block can say itself: masses of contexts (each distinct pair once), contexts whose weight it needs,
    and the sums of its pieces, with the tokens that wait for a weight."""
    b = Block.of(row)
    got = {k: np.concatenate([_open(c, np.int64) for c in g.sort_values("part")["counts"]]) for k, g in answers.groupby("kind")}
    asked, _ = b.asked_words()
    counts = got["word answer"] >> 1
    word_counts = counts[np.searchsorted(asked, b.words)]
    keys, first, where = np.unique(b.pairs(), return_index=True, return_inverse=True)
    pair_counts, stands = got["pair answer"] >> 1, (got["pair answer"] & 1) > 0
    contexts, context_of = np.unique(b.before, return_inverse=True)
    sizes = counts[np.searchsorted(asked, np.where(contexts == BEGIN, END, contexts))]
    out = []

    # masses: sums of discounted pair counts, and of discounted word counts of the same successors
    use = stands & (pair_counts > 0)
    at = context_of[first[use]]
    pair_mass = np.bincount(at, weights=discounted(pair_counts[use], t.two), minlength=len(contexts))
    word_mass = np.bincount(at, weights=discounted(word_counts[b.tokens[first[use]]], t.one), minlength=len(contexts))
    there = np.bincount(at, minlength=len(contexts)) > 0
    # tokens
    c_word, c_pair, c_context = word_counts[b.tokens], pair_counts[where], sizes[context_of]
    unigram = np.log10(t.unigram(c_word))
    seen = c_pair > 0
    score = np.where(seen, 0.0, unigram)
    score[seen] = np.log10(discounted(c_pair[seen], t.two) / c_context[seen])
    waits = ~seen & (c_context > 0)
    needed = np.unique(context_of[waits])
    for part, low, high in _parts(contexts, parts):
        inside = np.flatnonzero(there[low:high]) + low
        if len(inside):
            out.append(("mass", part, b.row["block"], _squeeze_keys(contexts[inside]), _squeeze(sizes[inside]), _squeeze(pair_mass[inside]), _squeeze(word_mass[inside])))
        inside = needed[(needed >= low) & (needed < high)]
        if len(inside):
            out.append(("need", part, b.row["block"], _squeeze_keys(contexts[inside]), b"", b"", b""))
    piece = np.repeat(np.arange(len(b.starts)), np.asarray(row["sizes"]))
    add = lambda values: np.add.reduceat(values, b.starts)
    waiting, times = np.unique(piece[waits] * np.int64(len(contexts)) + context_of[waits], return_counts=True)
    local = {
        "rows": np.asarray(row["rows"], np.int64), "ids": row["doc_ids"], "held": row["held"], "sizes": row["sizes"],
        "known": add((c_word > 0).astype(np.int64)).tolist(), "base": add(t.base(c_word)).tolist(), "score": add(score).tolist(),
        "piece": (waiting // len(contexts)).astype(np.int32), "key": np.searchsorted(needed, waiting % len(contexts)).astype(np.int32), "n": times.astype(np.int32),
    }
    table = pa.table({k: pa.array(local[k]) for k in ("rows", "held", "sizes", "known", "base", "score")} | {"ids": pa.array(local["ids"], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    wait = np.stack([local["piece"], local["key"], local["n"]]).astype(np.int32)
    out.append(("local", -1, b.row["block"], sink.getvalue().to_pybytes(), _squeeze(wait.reshape(-1)), b"", b""))
    return out


def _parts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of ascending keys that belong to each part."""
    cuts = np.searchsorted(keys, np.array([(i << 64) // parts for i in range(parts)], U)).tolist()
    for part, (low, high) in enumerate(zip(cuts, [*cuts[1:], len(keys)])):
        if high > low:
            yield part, low, high


def _answer_weights(pdf: pd.DataFrame, tokens: int) -> pd.DataFrame:
    """Per part: the context table (key, back-off weight) and, for each block, log10 of the weights that it needs."""
    mass, out, part = pdf[pdf["kind"] == "mass"], [], int(pdf["part"].iloc[0])
    every, weight = np.zeros(0, U), np.zeros(0)
    if len(mass):
        keys = [_open_keys(k) for k in mass["keys"]]
        every, (pairs, words) = _summed(keys, [[_open(v, float) for v in mass["sums"]], [_open(v, float) for v in mass["masses"]]])
        sizes = np.zeros(len(every))
        for k, v in zip(keys, mass["counts"]):
            sizes[np.searchsorted(every, k)] = _open(v, np.int64)
        weight = (1 - pairs / sizes) / (1 - words / max(1, tokens))
        out.append(("context table", part, -1, _squeeze_keys(every), _squeeze(weight)))
    for row in pdf[pdf["kind"] == "need"].itertuples():
        answer = np.log10(weight[np.searchsorted(every, _open_keys(row.keys))])
        out.append(("weight answer", part, row.block, b"", _squeeze(answer)))
    return pd.DataFrame(out, columns=["kind", "part", "block", "keys", "counts"])


DOCS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finished(local: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Sums of a block's pieces with the weights that came back."""
    out = []
    for row in local.itertuples():
        own = pa.ipc.open_stream(row.keys).read_pandas()
        if len(answers):
            weights = np.concatenate([_open(c, float) for c in answers.sort_values("part")["counts"]])
            piece, key, n = _open(row.counts, np.int32).reshape(3, -1)
            own["score"] += np.bincount(piece, weights=weights[key] * n, minlength=len(own))
        out.append(own.rename(columns={"rows": "row", "ids": "doc_id", "held": "held_out", "sizes": "n_tokens", "known": "n_known", "base": "base_score"}))
    return pd.concat(out)[["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is an expression of ``doc_id``; rows for which it is false or null train the model.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col).withColumn("held", F.coalesce(held_out, F.lit(False)))
    blocks, blocks_path = written(spread(rows, "doc_id").mapInArrow(_blocks, BLOCKS), "lm-blocks", with_path=True)
    tokens = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PART_TOKENS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block.of(batch.slice(i, 1).to_pylist()[0])
                keys, counts = b.asked_words()
                pairs, where = np.unique(b.pairs(), return_inverse=True)
                for kind, k, c in (("word", keys, counts), ("pair", pairs, np.bincount(where[b.train], minlength=len(pairs)))):
                    for part, low, high in _parts(k, parts):
                        yield _to_batch([(kind, part, b.row["block"], _squeeze_keys(k[low:high]), _squeeze(c[low:high].astype(np.int64)))], ASKED)

    asked = blocks.mapInArrow(ask, ASKED).repartition(parts, "kind", "part")
    answers, answers_path = written(asked.groupBy("kind", "part").applyInPandas(_answer_counts, ASKED), "lm-counts", with_path=True)
    totals = _totals(answers)

    def score(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = [x for row in block.to_dict("records") for x in _scored_block(row, own, totals, parts)]
        return pd.DataFrame(found, columns=[f.strip().split(" ")[0] for f in SCORED.split(",")])

    own = answers.filter("block >= 0").select("kind", "part", "block", "counts")
    scored, scored_path = written(
        blocks.groupBy("block").cogroup(own.groupBy("block")).applyInPandas(score, SCORED), "lm-scores", with_path=True
    )
    drop_path(spark, blocks_path)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        return _answer_weights(pdf, totals.tokens)

    weights, weights_path = written(
        scored.filter("part >= 0").repartition(parts, "part").groupBy("part").applyInPandas(weigh, ASKED), "lm-weights", with_path=True
    )
    local = scored.filter("kind = 'local'").select("block", "keys", "counts")
    back = weights.filter("block >= 0").select("part", "block", "counts")
    pieces = local.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(_finished, DOCS)
    summed = pieces.groupBy("row", "doc_id", "held_out").agg(
        *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    return summed.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
