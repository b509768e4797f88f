"""Ids of texts encoded piece by piece and many pieces at a time, against the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

queries = pytest.importorskip("tablewright.llm.queries")

from tablewright.llm import tokens as T  # noqa: E402
from tablewright.llm.words import text_slices  # noqa: E402


@pytest.mark.parametrize("limits", [{}, {"RECENT": 3, "AT_ONCE": 5}, {"KEPT_BYTES": 400, "RECENT": 2}], ids=str)
def test_ids_equal_the_tokenizer(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(T, name, value)
    r = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "漢", "😀", " \n", " ", "\r", "　", "<|endoftext|>", "!", "  x", " '", ",", "w" * 300]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(1500)] + ["", None, "\n", " ", "x\ny", "x\n\ny z"]
    encoder = T.Encoder(queries.tokenizer_path())
    plain = encoder.tokenizer
    for row, data, starts in text_slices(pa.array(texts), 4000):
        ids, counts = encoder(data, starts, 2)
        for text, own in zip(texts[row : row + len(counts)], np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_are_encoded_once_whatever_stands_around_them():
    """A word with punctuation is not a piece of its own, and what an apostrophe or an added token needs together stays so."""
    encoder = T.Encoder(queries.tokenizer_path())

    def pieces(text):
        (_, data, starts), = text_slices(pa.array([text]))
        return [data[a:b].tobytes().decode() for a, b in zip(*encoder.pieces(data, starts))]

    assert pieces("so Été, (Été) Été2!") == ["so", " Été", ",", " (", "Été", ")", " Été", "2", "!"]
    assert pieces("don't ,'sa x<|endoftext|>y") == ["don", "'t", " ,'sa", " x<|endoftext|>y"]
    r = random.Random(2)
    parts = ["a", "Str", "don", "'s", "'t", "'", "''", " ", "  ", "\n", "\t", "é", "ß", "×", "÷", "Ł", "ſ", "ƀ", "中", "2", "½", ".", "_", "<|endoftext|>", "<|", "|>", "é", "\u0085", "’s", "\x00", "٣"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(5000)]
    for row, data, starts in text_slices(pa.array(texts)):
        ids, counts = encoder(data, starts, 2)
        for text, own in zip(texts[row : row + len(counts)], np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
