"""Pieces with a model that maps characters, trims spaces and has no byte fallback: the compiled map's path, and unknown pieces."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from redactrix.llm import pieces
from redactrix.llm.queries_b import model_path

PARTS = [" ", "  ", "\n", "\t", "a", "the", "é", "é", "日本", "ｶﾞ", "①", "ﬁn", "㍿", "Ⅷ", "\r\n", "ing", " ", "​", "１２", "Zz", "😀", "☂"]


def model(fallback: bool, trim: bool) -> bytes:
    """The public model's pieces behind the map of a public normalisation rule."""
    proto, rule = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(pieces.read_model(model_path()))
    rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rule.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = trim
    if not fallback:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                p.type, p.piece = pb.ModelProto.SentencePiece.NORMAL, f"{p.piece}"
    return proto.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("trim", [True, False])
def test_mapped_text_equals_the_library(fallback, trim):
    made = model(fallback, trim)
    own, library = pieces.Encoder(made), sentencepiece.SentencePieceProcessor(model_proto=made)
    assert own.map.units and not own.plain
    random.seed(3)
    texts = ["", " ", *("".join(random.choice(PARTS) for _ in range(random.randint(1, 16))) for _ in range(800))]
    unknown = 0
    for text, raw in zip(texts, own.encode_many(texts), strict=True):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)
        begin, end = own.spans(text, ids)
        size = len(text.encode())
        assert (begin <= end).all() and (begin[1:] >= begin[:-1]).all() and (end <= size).all()
        inner = [(b, e) for b, e, i in zip(begin, end, ids, strict=True) if i not in (own.bos, own.eos)]
        assert all(a[1] <= b[1] for a, b in zip(inner[:-1], inner[1:], strict=True))
        unknown += int((ids == own.unk).sum())
    assert bool(unknown) != fallback


def test_spans_of_text_that_holds_the_space_mark():
    own = pieces.Encoder(pieces.read_model(model_path()))
    for text in ("a▁b", "▁", "▁▁ x", " ▁é", "x"):
        ids = np.frombuffer(own.encode(text), "<u4")
        begin, end = own.spans(text, ids)
        assert int((end - begin).sum()) == len(text.encode()) and end[-1] == len(text.encode()), text
