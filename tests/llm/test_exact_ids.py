"""Ids and spans against the libraries: words that a polynomial hash cannot tell apart, and models with compiled character maps."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import piece_tokens
from driftline.llm.hashing import distinct_spans, span_hashes
from driftline.llm.word_tokens import WordTokens, default_path


def morse(n, flip):
    """A Thue-Morse word over two letters, or its complement: equal under every polynomial modulo 2**64 from 1024 letters on."""
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


PAIRS = [morse(n, f) for n in (512, 1024, 2048, 4096) for f in (0, 1)]
TEXTS = [
    *PAIRS,
    None,
    "",
    " ",
    "   ",
    " a",
    "a ",
    "a  b",
    "  two  blanks  ",
    "▁",
    "▁ ▁",
    "x▁y ▁▁ z",
    "ｆｕｌｌ　ｗｉｄｔｈ １２３",
    "été Å ﬁne ²",
    "tab\tand\nline\r\n\x0bend hard",
    "가각가 中文字 🙂🙂 zero​width",
    "½ ¼ ™ ㍿ …",
    "plain words only, and 3.14!",
    "Don't <|endoftext|> stop <s> </s> <unk>",
]


def test_words_of_a_polynomial_collision():
    joined = np.frombuffer("".join(PAIRS).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in PAIRS])
    starts = ends - [len(x) for x in PAIRS]
    assert len(set(span_hashes(joined, starts, ends).tolist())) == len(PAIRS)


def test_distinct_spans_compare_bytes(monkeypatch):
    monkeypatch.setattr("driftline.llm.hashing.span_hashes", lambda buf, s, e: np.zeros(len(s), np.uint64))
    buf = np.frombuffer(b"one two one three twoone" + b"x" * 2000, np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 18, 21, 24, 1024]), np.array([3, 7, 11, 17, 21, 24, 1024, 2024])
    lead, which = distinct_spans(buf, starts, ends)
    back = [bytes(buf[starts[lead[w]] : ends[lead[w]]]) for w in which]
    assert back == [bytes(buf[s:e]) for s, e in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("made", [True, False])
def test_word_ids(made):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(default_path()), WordTokens(default_path())
    own.by_unit = own.by_unit and made
    ids, at = own.encode(pa.array(TEXTS, pa.string()))
    for k, t in enumerate(TEXTS):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids


def variants():
    """The dealt model with the compiled maps that the library brings along, and each treatment of blanks; nothing is trained."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb2

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        blob = f.read()
    yield "dealt", blob
    for rule, dummy, collapse, escape, suffix, fallback in itertools.product(["", "nmt_nfkc", "nmt_nfkc_cf"], [True, False], [True, False], [True, False], [True, False], [True, False]):
        proto = pb2.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        if rule:
            spec.precompiled_charsmap = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto() and charsmap(rule)
        spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = dummy, collapse, escape
        proto.trainer_spec.treat_whitespace_as_suffix = suffix
        if not fallback:
            proto.trainer_spec.byte_fallback = False
            for p in proto.pieces:
                if p.type == 6:
                    p.type = 1
        yield f"{rule or 'none'}-{dummy}-{collapse}-{escape}-{suffix}-{fallback}", proto.SerializeToString()


def charsmap(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb2

    proto = pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    return proto.normalizer_spec.precompiled_charsmap


def test_pieces_and_spans_of_every_model(tmp_path):
    import sentencepiece

    for name, blob in variants():
        path = tmp_path / "m.model"
        path.write_bytes(blob)
        library, own = sentencepiece.SentencePieceProcessor(model_proto=blob), piece_tokens.PieceModel(str(path))
        ids, begins, ends, decoded = (x.to_pylist() for x in own.encode(pa.array(TEXTS, pa.string())))
        for k, t in enumerate(TEXTS):
            t = t or ""
            found = library.encode(t, return_type="proto")
            want = [p.id for p in found.pieces]
            assert ids[k] == want, (name, t)
            assert decoded[k] == library.decode(want), (name, t)
            raw = t.encode()
            at = 0
            for piece, b, e in zip(found.pieces, begins[k], ends[k], strict=True):
                assert 0 <= b <= e <= len(raw) and b >= at - 4, (name, t)
                if library.is_byte(piece.id):
                    continue
                assert (piece.begin, piece.end) == (b, e), (name, t, piece.piece)
                at = e
