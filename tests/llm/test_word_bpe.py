"""Word ids against the library, on words that take either path."""

import random

import numpy as np
import public_tokenizers

from lastleg.llm.word_bpe import LONGEST, WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aAbeEtThHsSnN'’.,!?<|>startofxé ÉßÀÿ×÷0123456789\t\n\r\x0b\xa0́İΣςK漢字🙂_-%#&µª"


def texts():
    pick = random.Random(5)
    some = ["".join(pick.choice(ALPHABET) for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    some += ["a" * n for n in range(3 * LONGEST)] + ["ab" * 60, "é" * 70, "!" * 99, "it's don't WE'LL 'S 'll''re"]
    return some + ["<|startoftext|>hi<|endoftext|>", "x<|endoftext|>y <|ENDOFTEXT|>", "", " ", "\n", " a  b \n\n c"]


def expected(tokenizer, some):
    return [np.array([*e.ids, 1], dtype="<u4").tobytes() for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_ids_equal_the_library():
    words = WordTokenizer(PATH, 1)
    assert words.merges is not None
    some = texts()
    assert words.encode(some) == expected(words.tokenizer, some)
    assert words.encode(some[::-1]) == expected(words.tokenizer, some[::-1])  # now from memory


def test_other_files_go_to_the_library():
    words = WordTokenizer(PATH, 1)
    words.merges = None
    some = texts()[:500]
    assert words.encode(some) == expected(words.tokenizer, some)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("lastleg.llm.word_bpe.KNOWN_WORDS", 10)
    monkeypatch.setattr("lastleg.llm.word_bpe.KNOWN_PIECES", 7)
    words, some = WordTokenizer(PATH, 1), texts()[:600]
    assert [words.encode([t])[0] for t in some] == expected(words.tokenizer, some)
