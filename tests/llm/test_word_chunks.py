"""Ids of chunks against ids of whole texts."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quern.llm import pieces


def test_chunks_give_the_ids_of_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, known = Tokenizer.from_file(path), pieces.word_ids(path)
    rng = np.random.default_rng(4)
    parts = ["GELDİ", "İ", "i\u0307", "Σ", "ΟΔΟΣ", "<|", "<|endoftext|>", "e\u0301", "É", "É", "ab", "X", "7", ".", ",", "!?", "|", ">", "#", "...", " ", " ", "\n"]
    texts = ["GELDİ. Σ", "GELDİ. <|", "GELDİ. e\u0301"] + ["".join(rng.choice(parts, rng.integers(2, 12))) for _ in range(5000)]
    ids = [np.frombuffer(i, "<u4").tolist() for i in known.texts(texts)]
    wrong = [t for t, i in zip(texts, ids, strict=True) if i != tok.encode(t, add_special_tokens=False).ids]
    assert not wrong, (len(wrong), wrong[:10])
