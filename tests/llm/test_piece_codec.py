"""Piece encoding against the library, character maps included."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from edge_cases import EDGES
from loomtrace.llm import piece_codec, queries

MODEL = piece_codec.load(queries.TOKENIZER)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
CODEC = piece_codec.PieceCodec(MODEL)
TEXTS = st.text(alphabet=st.sampled_from("ab e▁ﬁ𝟙é　\n\t<s>xyz\u0301½Å"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_and_spans(text):
    data = text.encode()
    ids, starts, ends = CODEC.encode(data)
    assert ids.tolist() == LIBRARY.encode(text)
    assert CODEC.decode(CODEC.with_marks(ids)) == LIBRARY.decode(LIBRARY.encode(text, add_bos=True, add_eos=True))
    assert (starts[1:] >= ends[:-1]).all() and (not len(ids) or ends[-1] == len(data))
    for i, a, b in zip(ids.tolist(), starts, ends):
        piece = LIBRARY.id_to_piece(i)
        if "<0x" not in piece and "▁" not in text:
            assert data[a:b].decode() == (piece.replace("▁", " ") if a or data[:1] == b" " else piece.replace("▁", " ").removeprefix(" ")) or not a


def mapped(rule, **settings_):
    """The public model with the compiled character map of a rule of the library."""
    proto = sentencepiece_model_pb2.ModelProto.FromString(MODEL)
    own = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = own.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.name = rule
    for key, value in settings_.items():
        setattr(proto.normalizer_spec, key, value)
    return proto.SerializeToString()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("strips", [True, False])
def test_character_map(rule, strips):
    model = mapped(rule, remove_extra_whitespaces=strips)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), piece_codec.PieceCodec(model)

    @settings(max_examples=200, deadline=None)
    @given(TEXTS)
    def run(text):
        ids, starts, ends = codec.encode(text.encode())
        assert ids.tolist() == library.encode(text)
        assert (starts <= ends).all() and (np.diff(starts) >= 0).all()

    run()
    ids, starts, ends = codec.encode("x ﬁ½ y".encode())
    assert "x ﬁ½ y".encode()[starts[1] : ends[-1]] == " ﬁ½ y".encode()


def test_documents(edges, nothing):
    got = sorted(map(tuple, piece_codec.encoding_digests(edges, MODEL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, text, _ in EDGES:
        ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
        digests = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
        want.append((i, len(ids), *digests))
    assert got == sorted(want, key=str)
    full = {r.doc_id: r for r in piece_codec.encode_documents(edges, MODEL).collect()}
    assert full[4].ids == LIBRARY.encode("one", add_bos=True, add_eos=True) and (full[4].starts, full[4].ends) == ([0], [3])
    assert full[1].ids == [1, 2] and full[1].starts == []
    assert piece_codec.encoding_digests(nothing, MODEL).collect() == []
