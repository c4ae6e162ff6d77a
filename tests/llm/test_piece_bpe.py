"""Encoding by merge rounds against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lumenframe.llm import piece_bpe
from lumenframe.llm.queries import PIECES, tokenizer_path

ALPHABET = "abcdefghijklmnopqrstuvwxyzéàABC  ▁\n\t0123456789日本語한국어🙂.,;'\"-_()́\x00½İß"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def table():
    return piece_bpe.PieceTable(tokenizer_path(PIECES))


def check(codec, library, texts):
    ids, sizes = codec.encode(texts)
    ends = np.cumsum(sizes)
    for t, a, b, said in zip(texts, ends - sizes, ends, codec.decode(ids, sizes), strict=True):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids[a:b].tolist() == want, t
        assert said == library.decode(want).encode(), t


def test_edges(table, library):
    codec = piece_bpe.PieceCodec(table)
    check(codec, library, ["", "", " ", "  ", "a", "▁", "   a   ", "hello world", " " * 50 + "x" + " " * 33, "<s></s><unk><0x41>"])
    ids, sizes = codec.encode([])
    assert len(ids) == len(sizes) == len(codec.decode(ids, sizes)) == 0


def test_random_texts(table, library):
    rng, codec = random.Random(1), piece_bpe.PieceCodec(table)
    for _ in range(300):
        check(codec, library, ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(8)])


@pytest.mark.parametrize("long", [3, 40, 1 << 20])
def test_long_words_by_rounds_and_by_heap(table, library, monkeypatch, long):
    monkeypatch.setattr(piece_bpe, "LONG", long)
    rng = random.Random(long)
    texts = ["".join(rng.choice("abcdeinrst ") for _ in range(3000)) for _ in range(3)]
    check(piece_bpe.PieceCodec(table), library, [*texts, "ab" * 700, " " * 1000, "the" * 300, "a" * 999])


def test_slices(table, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "SLICE", 50)
    rng = random.Random(4)
    check(piece_bpe.PieceCodec(table), library, ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(400))) for _ in range(30)] + ["x" * 700])


def test_decodes_any_ids(table, library):
    rng, codec = random.Random(2), piece_bpe.PieceCodec(table)
    for _ in range(300):
        rows = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32_000)]) for _ in range(rng.randrange(12))] for _ in range(5)]
        rows += [[29871] * 3, [1, 29871, 29871, 1576], []]
        said = codec.decode(np.array(sum(rows, []), np.int64), np.array([len(r) for r in rows]))
        assert said == [library.decode(r).encode() for r in rows]


def test_models_that_it_cannot_follow_are_errors(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(tokenizer_path(PIECES), "rb") as file:
        whole = file.read()
    for change in (
        lambda m: setattr(m.trainer_spec, "byte_fallback", False),
        lambda m: setattr(m.trainer_spec, "model_type", pb.TrainerSpec.UNIGRAM),
        lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
        lambda m: setattr(m.pieces[300], "type", pb.ModelProto.SentencePiece.USER_DEFINED),
    ):
        model = pb.ModelProto()
        model.ParseFromString(whole)
        change(model)
        (tmp_path / "m").write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            piece_bpe.PieceTable(str(tmp_path / "m"))


def test_documents(spark, library):
    texts = {1: "Hello  wörld\n", 2: None, 3: "", 4: "日本 " * 20_000, 5: "z" * 100_000}
    rows = [(k, t, "x", 1) for k, t in texts.items()] + [(1, "again", "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    path = tokenizer_path(PIECES)

    def expected(text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        decoded = library.decode(ids).encode()
        return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    got = sorted(map(tuple, piece_bpe.piece_digests(docs, path).collect()), key=str)
    assert got == sorted(((k, *expected(t)) for k, t, *_ in rows), key=str)
    back = piece_bpe.decode_documents(piece_bpe.encode_documents(docs, path), path).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((k, t or "") for k, t, *_ in rows if k)
    assert piece_bpe.piece_digests(docs.limit(0), path).count() == 0


def test_bytes_that_are_no_text(spark, library):
    docs = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    row = piece_bpe.piece_digests(docs, tokenizer_path(PIECES)).first()
    assert row.decoded_sha256 == hashlib.sha256("a\ufffdb".encode()).hexdigest()
