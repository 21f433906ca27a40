import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiltscale.llm import tokens
from tiltscale.llm.tokens import WordIds, default_path

WORDS = WordIds(default_path())
TOKENIZER = Tokenizer.from_file(default_path())


def _same(text):
    want = np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert WORDS.ids(text) == want, text


def test_documents(texts):
    for text in texts.values():
        _same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzÀßéÿÑ .,'\"!1²ªº\t\n\x1c\x85 ́ İΣς<|>"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(text):
    _same(text)


def test_contractions_and_special_strings():
    for text in ["don't", "we'll've", "'s", "x's. y", "<|endoftext|> a", "é ́x", "ÅB", "a.b,c", "...", "it''s"]:
        _same(text)


def test_memory_is_bounded_in_bytes(monkeypatch):
    """Thousands of long texts without a space leave nothing behind; many short words start it anew."""
    words = WordIds(default_path())
    long = np.random.default_rng(3).integers(0x4E00, 0x9FA5, (2_000, 1_000))
    for row in long:
        words.ids("".join(map(chr, row)))
    assert not words and not words.runs and words.held == 0
    monkeypatch.setattr(tokens, "_MEMORY_BYTES", 50_000)
    text = " ".join(f"word{i} run{chr(97 + i % 26) * (i % 9)}" for i in range(5_000))
    assert words.ids(text) == WORDS.ids(text)
    assert words.held < 52_000 and len(words) + len(words.runs) < 250
