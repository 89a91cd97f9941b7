"""Hashed n-grams of one text at a time, as NumPy arrays of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Characters of a text that are laid out as an array at a time.
BLOCK = 1 << 18
_SPACE = re.compile(r"\s")
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x85EBCA6B)


def _spread(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _SPREAD
    h ^= h >> np.uint32(15)
    h *= _SPREAD
    return h ^ (h >> np.uint32(13))


def sequence_ngrams(codes: np.ndarray, orders: range, salt: int) -> list[np.ndarray]:
    """One array of 32-bit hashes for each order in ``orders`` (from 1 up) that the sequence is long enough for."""
    out, h = [], codes.astype(np.uint32)
    for n in range(1, orders.stop):
        if n > 1:
            h = h[:-1] * _STEP + codes[n - 1 :]
        if len(codes) < n:
            break
        if n >= orders.start:
            out.append(_spread(h, salt + n))
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def char_blocks(text: str, beyond: int) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, how many of them n-grams start at) of a text block by block; a block goes on for ``beyond`` characters of the next one."""
    for k in range(0, len(text), BLOCK):
        yield code_points(text[k : k + BLOCK + beyond]), min(BLOCK, len(text) - k)


def char_ngrams(text: str, orders: range, salt: int) -> Iterator[np.ndarray]:
    """Arrays of the hashes of a text's character n-grams, each n-gram once for each place where it stands."""
    for codes, starts in char_blocks(text, orders.stop - 2):
        for h in sequence_ngrams(codes, orders, salt):
            yield h[:starts]


def lower_char_ngrams(text: str) -> Iterator[np.ndarray]:
    """Character 3- to 5-grams of the lower-cased text between two spaces; an empty text has none."""
    return char_ngrams(f" {text.lower()} ", range(3, 6), 0) if text else iter(())


def word_blocks(text: str) -> Iterator[tuple[list[str], int]]:
    """(words, words known from before) of a text cut at white space; up to three words stand in the next block again."""
    at, last = 0, []
    while at < len(text):
        end = at + BLOCK
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.end() if cut else len(text)
        words = last + text[at:end].split()
        yield words, len(last)
        at, last = end, words[-3:]


def word_shapes(words: list[str]) -> np.ndarray:
    """A small code for each word: case of its first two characters, kind of its last one, and whether the word before is the same."""
    if not words:
        return np.zeros(0, np.uint32)
    cp = code_points(" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 2
    start = end - size + 1
    same = np.zeros(len(words), np.uint32)
    same[1:] = np.fromiter(map(str.__eq__, words[1:], words), np.uint32, len(words) - 1)
    upper = lambda c: ((c >= 65) & (c <= 90)) | ((c >= 0xC0) & (c <= 0xDE) & (c != 0xD7))
    letter = lambda c: upper(c) | ((c >= 97) & (c <= 122)) | (c >= 0xDF)
    last = cp[end]
    kind = np.where(letter(last), 0, np.where((last >= 48) & (last <= 57), 1, last & 0x7F)).astype(np.uint32)
    second = upper(cp[np.minimum(start + 1, end)]) & (size > 1)
    return kind * 16 + upper(cp[start]) * np.uint32(8) + second * np.uint32(4) + (size == 1) * np.uint32(2) + same


def shape_ngrams(text: str) -> Iterator[np.ndarray]:
    """Arrays of the hashes of 1- to 3-grams of word shapes; an n-gram at the border of two blocks stands in both."""
    for words, known in word_blocks(text):
        shapes = word_shapes(words)
        # Of three known words what stands before the first isn't known, so its shape is left out; its n-grams stand in the block before. Fewer are the text's first ones.
        yield from sequence_ngrams(shapes[1:] if known == 3 else shapes, range(1, 4), 32)


def shape_and_char_ngrams(text: str) -> Iterator[np.ndarray]:
    """Character 1- to 3-grams of the text as it is, and 1- to 3-grams of its word shapes; an empty text has none."""
    if text:
        yield from char_ngrams(text, range(1, 4), 16)
        yield from shape_ngrams(text)
