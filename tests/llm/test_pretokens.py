"""Pre-token cutting against the library on random texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from strataloom.llm.common import sums  # noqa: E402
from strataloom.llm.pretokens import Encoder  # noqa: E402


def test_random_texts():
    rng = random.Random(7)
    letters = [*"aabcdstmrvel'''  \n\t.,!19é", "'s", "'re", "'ll", " '", "ß", " ", " ", "　", "\u0085", "中", "́", "😀", "<|endoftext|>", "Ⅷ", "\x1c", "\x00", "½", "​"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(6000)] + ["", " ", "\n", "'", "'s", "''s", "'re", "a'l", "'lls"]
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), len)
    index, distinct, offsets, odd = encoder.cut(pa.array(texts))
    counts = sums(np.array(encoder.values(distinct))[index], offsets)
    for i in np.flatnonzero(odd):
        counts[i] = encoder.whole(texts[i])
    expected = [len(e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == expected
