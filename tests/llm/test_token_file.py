import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievelab.llm import token_file as t

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, n_tokens int"


@pytest.mark.parametrize("seed", range(6))
def test_codes_are_optimal_limited_and_reversible(seed):
    import heapq

    rng = np.random.default_rng(seed)
    counts = (rng.zipf(1.3, 300) % 100_000 * (rng.random(300) < 0.8)).astype(np.int64)
    lengths = t.code_lengths(counts, 40)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        best += both
        heapq.heappush(heap, both)
    assert (lengths * counts).sum() == best
    short = t.code_lengths(counts, 9)
    assert short.max() <= 9 and sum(2.0 ** -int(x) for x in short if x) <= 1 and ((short > 0) == (counts > 0)).all()
    ids = [rng.choice(np.flatnonzero(counts), n) for n in (1, 255, 256, 257, 3000)]
    codes = t.canonical_codes(short)
    packed = [t.pack(x, codes, short) for x in ids]
    back = t.Table(short).unpack([p[0] for p in packed], [p[1].tobytes() for p in packed], [len(x) for x in ids])
    assert all((a == b).all() for a, b in zip(ids, back))


def test_checksums_join():
    data = random.Random(1).randbytes(5000)
    for cut in (0, 1, 7, 4096, 4999, 5000):
        a, b = data[:cut], data[cut:]
        assert t.carried(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(data)


def test_file_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(t, "BLOCK", 100)
    rng = random.Random(2)
    words = "the of an Ünïx 42 word!! ing".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), "x", 0) for i in range(60)]
    rows += [(70, None, "x", 0), (71, "", "x", 0), (None, "the the", "x", 0), (3, rows[3][1], "x", 0), (80, "of " * 900, "x", 0)]
    rng.shuffle(rows)
    path = str(tmp_path / "file")
    t.write_token_file(spark.createDataFrame(rows, SCHEMA), PATH, 2, path)
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    ids = lambda r: library.encode(r[1] or "", add_special_tokens=False).ids + [2]
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = np.array(ids(r), "<u4")
        want.append((r[0], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert [tuple(r) for r in t.read_checksums(spark, path).sort("start").collect()] == want
    pieces = t.read_tokens(spark, path).sort("start", "place").collect()
    assert [i for p in pieces for i in p.ids] == [i for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in ids(r)]
    empty = str(tmp_path / "empty")
    t.write_token_file(spark.createDataFrame([], SCHEMA), PATH, 2, empty)
    assert t.read_checksums(spark, empty).count() == 0
