"""What workers remember between tasks stays small."""

from __future__ import annotations

import sys

import numpy as np
import public_tokenizers
import sentencepiece

from flowlens.llm import pieces


def test_encoder_remembers_little():
    """An executor has a worker for each core, and each keeps its words after the stage."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoder = pieces.Encoder(pieces.read_model(path))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    most = 0
    for begin in range(0, 320_000, 20_000):
        text = " ".join(f"w{i:x}" for i in range(begin, begin + 20_000))
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert begin % 60_000 or ids == model.encode(text, add_bos=True, add_eos=True)
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in encoder.cache.items())
        most = max(most, held + sys.getsizeof(encoder.cache))
    assert most < 40 << 20
