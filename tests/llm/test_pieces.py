import random
import zlib

import numpy as np
import pytest
import sentencepiece

from lexloom.llm import pieces
from lexloom.llm.queries import piece_model


def flipped(data: bytes) -> bytes:
    """The model as a unigram model with the same scores."""
    out, at = b"", 0
    for field, value in pieces._fields(data):
        if field == 2:
            spec = dict(pieces._fields(value))
            assert spec[3] == 2
            changed = value.replace(b"\x18\x02", b"\x18\x01", 1)
            assert dict(pieces._fields(changed))[3] == 1
            return data.replace(value, changed)
    raise AssertionError


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["the", "of", "Interesting", "ththation", "ouêaux", "straße", "  ", "日本", "12.50", "\n", "\t", "😀", "<s>", "<0x0A>", "aaaaaaaaaaaaaaaaaaa", "naïve", "it's", "█", "x" * 60]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    syllables = ["th", "er", "tion", "ing", "an", "re", "ou", "ble", "wh", "sch", "é", "ß", "ge", "keit"]
    made += [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(80)]
    return [*made, "", " ", "   ", "a", "\n\n", " lead", "trail  ", None]


def test_like_the_library(texts):
    data = piece_model()
    own, library = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for t, c in zip(texts, own.encode(texts)):
        assert np.frombuffer(c, "<u4").tolist() == library.encode(t or ""), t
        assert own.decode(c) == (t or "")


def test_unigram_like_the_library(texts):
    data = flipped(piece_model())
    own, library = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert own.unigram
    score = lambda ids: sum(own.pieces[k][1] for k in ids if own.pieces[k][2] == pieces.NORMAL)
    for t, c in zip(texts, own.encode(texts)):
        got, want = np.frombuffer(c, "<u4").tolist(), library.encode(t or "")
        assert score(got) == pytest.approx(score(want)) and own.decode(c) == (t or "")


def test_query(spark, docs, odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    rows = {r["doc_id"]: r for r in pieces.digest(docs(odd), piece_model()).collect()}
    for k, t in enumerate(odd):
        ids = library.encode(t or "")
        assert rows[k]["n_tokens"] == len(ids) and rows[k]["round_trip"]
        assert rows[k]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert pieces.digest(docs([]), piece_model()).count() == 0
    assert pieces.encode(docs(["a b"]), piece_model()).first()["source"] == "s0"
