import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model

from sievelab.llm import sentencepiece_codec as s
from sievelab.llm.q_sentencepiece_codec import sentencepiece_codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, covered int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_text(rng, n):
    letters = ["a", "e", "th", "ing", "É", "ß", "漢", "😀", "é", "ﬁ", "①", "ｶﾞ", "　", "1", "'s", "...", "<s>", "</s>", "<0x0A>", "▁", "\x00", "\xa0", "​", "㍿"]
    spaces = [" ", "\n", "\t ", "  ", "    "]
    return "".join(rng.choice(spaces) if rng.random() < 0.25 else rng.choice(letters) for _ in range(n))


def library_spans(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def test_ids_spans_and_texts_equal_the_library(library, monkeypatch):
    rng = random.Random(3)
    own = s.PieceCodec(PATH)
    assert own.by_words and own.normalizer.plain
    texts = ["", " ", None, "a  b ", "▁", "\n\nThe  QUICK brown fox,the"] + [random_text(rng, rng.randint(0, 60)) for _ in range(500)]
    want = [library.encode(t or "") for t in texts]
    for size in (4 << 20, 25, 1):
        monkeypatch.setattr(s, "SLICE", size)
        ids, ends, begin, end = own.encode_column(pa.array(texts))
        starts = [0, *ends[:-1]]
        assert [ids[a:b].tolist() for a, b in zip(starts, ends)] == want
        for t, a, b in zip(texts, starts, ends):
            got = list(zip(begin[a:b].tolist(), end[a:b].tolist()))
            assert got == library_spans(library, t or ""), t
            assert not got or (got[0][0] == 0 and got[-1][1] == len(t.encode()) and all(x[1] == y[0] for x, y in zip(got, got[1:])))
    lists = pa.array(want + [[1, 300, 2, 400], [233], [201, 200, 299], [0, 0, 300], [259, 259], []], pa.list_(pa.int32()))
    assert own.decode_lists(lists).to_pylist() == [library.decode(i) for i in lists.to_pylist()]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_character_map_equals_the_library(rule, trim, dummy):
    rng = random.Random(5)
    flags = {"add_dummy_prefix": dummy, "remove_extra_whitespaces": trim, "escape_whitespaces": True}
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
    spec = model.NormalizerSpec.FromString(lib.serialized_normalizer_spec())
    for k, f in flags.items():
        setattr(spec, k, f)
    own = s.Normalizer(spec)
    for _ in range(300):
        text = random_text(rng, rng.randint(0, 40))
        raw, place = own.normalize(text.encode())
        shown, offsets = lib.normalize(text, with_offsets=True)
        assert raw.tobytes().decode() == shown, text
        # characters of the library's places, where a normalised character begins
        heads = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80] + [len(raw)]
        got = [len(text.encode()[: place[i]].decode()) for i in heads]
        assert got == offsets, text


def test_tables(spark, library):
    rng = random.Random(4)
    rows = [(i, random_text(rng, 300), "x", 0) for i in range(12)]
    rows += [(1, rows[1][1], "x", 0), (None, "a b", "x", 0), (50, None, "x", 0), (51, "", "x", 0), (52, "unsplit" * 30000 + " é" * 9, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted((r[0] or -1, library.encode(r[1] or ""), len((r[1] or "").encode())) for r in rows)
    coded = s.encode(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.ids, r.covered) for r in coded) == want
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in coded)
    back = s.decode(s.encode(df, PATH, spans=False), PATH).collect()
    assert all(r.decoded == library.decode(r.ids) for r in back) and len(back) == len(rows)
    assert s.encode(spark.createDataFrame([], SCHEMA), PATH, decoded=True).count() == 0
    assert s.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().decoded is None


def test_query_on_a_given_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs:
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((r.text or "").encode())))
    assert sorted(tuple(r) for r in sentencepiece_codec(spark, sf).collect()) == sorted(want)
