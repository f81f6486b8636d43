import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievelab.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_text(rng, n):
    letters = ["a", "e", "th", "ing", "É", "ß", "漢", "😀", "́", "İ", "Σ", "1", "²", "'s", "!", "...", "<|endoftext|>", "<|", "\x1c", "\x85", "\xa0"]
    spaces = [" ", "\n", "\t ", "  ", " "]
    return "".join(rng.choice(spaces) if rng.random() < 0.15 else rng.choice(letters) for _ in range(n))


def test_words_and_trees_equal_the_library(library, monkeypatch):
    rng = random.Random(3)
    own = bpe.Codec(PATH)
    texts = ["", " ", None, "\n\nThe  QUICK brown'S fox,the"] + [random_text(rng, rng.randint(0, 60)) for _ in range(400)]
    import pyarrow as pa

    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, ends = own.encode_column(pa.array(texts))
    starts = [0, *ends[:-1]]
    assert [ids[a:b].tolist() for a, b in zip(starts, ends)] == want
    monkeypatch.setattr(bpe, "LEAF", 8)
    monkeypatch.setattr(bpe, "FIRST_WINDOW", 2)
    assert [e.ids for e in own.tree([t or "" for t in texts])] == want
    ids, ends = bpe.Codec(PATH).encode_column(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == want


def test_tables_in_pieces_and_back(spark, library):
    rng = random.Random(4)
    rows = [(i, random_text(rng, 300), "x", 0) for i in range(12)]
    rows += [(1, rows[1][1], "x", 0), (None, "a b", "x", 0), (50, None, "x", 0), (51, "", "x", 0), (52, "unsplit" * 3000, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    for piece in (1 << 20, 50):
        out = bpe.decode(bpe.encode(df, PATH, piece=piece), PATH).collect()
        assert sorted((r.doc_id or -1, r.ids) for r in out) == want
        assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in out)
        once = bpe.encode(df, PATH, piece=piece, decoded=True).collect()
        assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in once) == sorted((r.doc_id or -1, r.ids, r.decoded) for r in out)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_other_tokenizers_go_through_the_tree(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(bpe, "LEAF", 16)
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    assert not own.by_words
    rng = random.Random(8)
    texts = [random_text(rng, 200) for _ in range(40)]
    assert [e.ids for e in own.tree(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded_and_forgets_nothing_wrongly(library):
    own = bpe.Codec(PATH)
    own.known = bpe.Remembered(4000)
    rng = random.Random(5)
    import pyarrow as pa

    for _ in range(60):
        texts = [random_text(rng, 80) + " the thing, of 12 things (don't)" for _ in range(5)]
        ids, ends = own.encode_column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sum(x.nbytes for g in (own.known.young, own.known.old) for x in g) < 40_000


def test_parts_of_plain_words_equal_the_library(library):
    rng = random.Random(6)
    signs = list("aZé×÷ÀÿßµªÆ09.,;-_()#$%&*+/:=?@[]^`{|}~'<>!\\\"") + ["'s", "''", "'ll", "\x7f", "\x00", "½", "²", "ſ", "Ā"]
    texts = ["".join(rng.choice(signs + [" "]) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    import pyarrow as pa

    ids, ends = bpe.Codec(PATH).encode_column(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
