"""Token ids as files: canonical, length-limited Huffman codes from global counts, decoded by table.

A token file is a folder of three tables, written and read by Spark, so tasks may run twice and machines may go:

* ``blocks``: rows (part, block) of up to ``BLOCK`` ids as one bit string, with the bit offset of each ``STEP``-th id
  (``checkpoints``), and the pieces of documents in it: doc_ids, sizes, places in the document, whole sizes and
  starts from the beginning of the part. Blocks are independent; the places after a checkpoint are decoded side by side.
* ``index``: the number of ids before each part.
* ``codebook``: the code length of each id; codes are canonical, so lengths say all.

Documents stand in ascending order of id, null ids first, repeated ids by size and content. Every document ends with
the end id, so null and empty texts are one id long. An empty table gives an empty file that reads as no rows.
A document of any length is cut over blocks; its checksum is joined from theirs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelab.llm.bpe import codec
from sievelab.llm.common import drop_path, pick, spread, written
from sievelab.session import scratch_path

BLOCK = 1 << 16
STEP = 256
MAX_BITS = 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); symbols that never occur get 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf, kinds = leaves, np.ones(n, bool), []
    for _ in range(max_bits):
        kinds.append(is_leaf)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        level, is_leaf = both[by_weight], by_weight < n
    take = 2 * n - 2
    for flags in reversed(kinds):
        own = int(flags[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = before = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - before
            codes[i], before = code, int(lengths[i])
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids as bits, first bit highest, and the bit offset of each ``STEP``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 6, 64 - (at & 63) - size
    code = codes[ids]
    high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(shift < 0)
    words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.byteswap().tobytes()[: int(ends[-1] + 7) // 8], at[::STEP].astype(np.uint32)


class Table:
    """Decoding table: the next ``bits`` bits give the id and its code length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.bits - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.bits, np.int32)
        self.sizes = np.ones(1 << self.bits, np.int64)
        filled = np.repeat(order, spans)
        self.ids[: len(filled)] = filled
        self.sizes[: len(filled)] = lengths[filled]

    def unpack(self, bits: list[bytes], checkpoints: list[bytes], counts: list[int]) -> list[np.ndarray]:
        """The ids of several blocks; all checkpoints of all blocks advance together, one id at a time."""
        data = np.frombuffer(b"".join(bits) + bytes(8), np.uint8).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        bases = np.cumsum([0, *map(len, bits)][:-1]) * 8
        marks = [np.frombuffer(c, np.uint32).astype(np.int64) + b for c, b in zip(checkpoints, bases)]
        at = np.concatenate(marks)
        out = np.zeros((STEP, len(at)), np.int32)
        limit, back = (len(window) - 1) * 8, np.uint32(32 - self.bits)
        for step in range(min(STEP, max(counts))):
            look = (window[at >> 3] << (at & 7).astype(np.uint32)) >> back
            out[step] = self.ids[look]
            at = np.minimum(at + self.sizes[look], limit)
        ids, column = [], 0
        for mark, count in zip(marks, counts):
            ids.append(out[:, column : column + len(mark)].T.reshape(-1)[:count])
            column += len(mark)
        return ids


def write_token_file(
    docs: DataFrame, tokenizer: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every whole text, appends the end id and writes the file to the folder ``out``."""
    spark = docs.sparkSession
    rows = spread(pick(docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=text_col), "doc_id")

    kind = np.dtype("<u2" if max(end_id, codec(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = codec(tokenizer), np.zeros(0, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids, ends = own.encode_column(part.column("text"))
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
                offsets = np.append(0, ends * kind.itemsize).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])
                sizes = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, data, pa.nulls(len(part), pa.binary())], names=CODED)
        # one row more tells how often this task met each id
        columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=CODED)

    every, folder = written(rows.mapInArrow(encode, "doc_id long, n long, ids binary, counts binary"), "ids", with_path=True)
    coded = every.filter("counts IS NULL").drop("counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts"):
                total = np.frombuffer(data.as_py(), np.int64)
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # as many rows as the vocabulary has ids
    told = every.filter("counts IS NOT NULL").select("counts")
    found = told.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([end_id, *(r.id for r in found)]) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    sent = spark.sparkContext.broadcast((codes, lengths))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "n").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "n", "ids"
    )
    ordered.mapInArrow(lambda batches: _blocks(batches, kind, *sent.value), BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    blocks = spark.read.parquet(f"{out}/blocks")
    base, index = 0, []
    for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).sort("part").toLocalIterator():
        index.append((r.part, base))
        base += r.n
    spark.createDataFrame(index, "part int, base long").coalesce(1).write.parquet(f"{out}/index")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{out}/codebook")
    drop_path(spark, folder)


CODED = ["doc_id", "n", "ids", "counts"]
BLOCKS = (
    "part int, block int, n long, bits binary, checkpoints binary, doc_ids array<long>, sizes array<int>, "
    "places array<long>, doc_sizes array<long>, doc_starts array<long>"
)
LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _blocks(batches: Iterator[pa.RecordBatch], kind: np.dtype, codes: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    pieces: list[tuple] = []
    room, number, start = BLOCK, 0, 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate(held)
        bits, marks = pack(ids, codes, lengths)
        values = [part, number, len(ids), bits, marks.tobytes(), *map(list, zip(*pieces))]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), LONGS, INTS, LONGS, LONGS, LONGS]
        names = ["part", "block", "n", "bits", "checkpoints", "doc_ids", "sizes", "places", "doc_sizes", "doc_starts"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    for batch in batches:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            ids = np.frombuffer(data.as_buffer(), kind)
            done = 0
            while done < len(ids):
                piece = ids[done : done + room]
                held.append(piece)
                pieces.append((doc_id, len(piece), done, len(ids), start))
                done += len(piece)
                room -= len(piece)
                if not room:
                    yield close()
                    held, pieces, room, number = [], [], BLOCK, number + 1
            start += len(ids)
    if held:
        yield close()


def _with_bases(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8)
    return spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/index"), "part"), lengths


def _decoded(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, many: int = 16) -> Iterator[tuple[dict, np.ndarray]]:
    table = Table(lengths)
    for batch in batches:
        for first in range(0, batch.num_rows, many):
            rows = batch.slice(first, many).to_pylist()
            ids = table.unpack([r["bits"] for r in rows], [r["checkpoints"] for r in rows], [r["n"] for r in rows])
            yield from zip(rows, ids)


def _pieces(row: dict, ids: np.ndarray) -> Iterator[tuple]:
    at = 0
    for doc_id, size, place, whole, start in zip(row["doc_ids"], row["sizes"], row["places"], row["doc_sizes"], row["doc_starts"]):
        yield doc_id, row["base"] + start, whole, place, ids[at : at + size]
        at += size


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents as the blocks hold them: doc_id, start, n_tokens (of the document), place, ids."""
    blocks, lengths = _with_bases(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _decoded(batches, lengths):
            columns = list(zip(*_pieces(row, ids)))
            kinds = [pa.int64()] * 4 + [INTS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "n_tokens", "place", "ids"]
            )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, place long, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the decoded blocks.

    The checksum of joined strings is the exclusive or of theirs, each carried over the bytes that follow it, so pieces
    of a document are put together by an aggregate in any order.
    """
    blocks, lengths = _with_bases(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in _decoded(batches, lengths):
            found = []
            for doc_id, start, whole, place, own in _pieces(row, ids):
                crc = zlib.crc32(own.astype("<u4").tobytes())
                found.append((doc_id, start, whole, carried(crc, 4 * (whole - place - len(own)))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*found)], names=["doc_id", "start", "n_tokens", "crc"]
            )

    pieces = blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, crc long")
    return pieces.groupBy("start", "doc_id", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32")).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )


CRC_POLYNOMIAL = 0xEDB88320


def carried(crc: int, n_bytes: int) -> int:
    """The checksum's part in that of a string with ``n_bytes`` more at its end."""
    if not n_bytes or not crc:
        return crc
    power, square, n = 0x80000000, 0x00800000, n_bytes  # x^0, and x^8 for one byte, lowest power in the highest bit
    while n:
        if n & 1:
            power = _times(power, square)
        square = _times(square, square)
        n >>= 1
    return _times(crc, power)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the checksum's."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def token_file_path(spark: SparkSession) -> str:
    return scratch_path(spark, "tokens")
