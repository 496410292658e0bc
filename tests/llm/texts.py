"""Texts that are hard for tokenizers."""

from hypothesis import strategies as st

PARTS = [
    "'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", " ", "\u0085", "\x1c", "a", "B",
    "é", "1", "²", "漢", "🙂", "!", "''", "'S", "<|endoftext|>", "<|endof", "th", "the", "ing", "᠎", "​", "ß",
    "é", "\x00", "ab" * 40, "=" * 70, "     \n     ",
]
HARD = ["", " ", "\n", "'", "''s", "'re'", "don't 'twas", " 's", "a  b", "a \n b", "   ", "x" * 70_000, " " * 3_000 + "y"]

hard_text = st.lists(st.sampled_from(PARTS), max_size=25).map("".join)
