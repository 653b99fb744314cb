"""Texts cut at blanks into pieces that a tokenizer encodes alone, so that each distinct piece is encoded once.

A slice of texts is seen as one array of bytes; cuts, lengths and owners come from numpy, distinct pieces from
Arrow's dictionary encoding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CUT = np.zeros(256, bool)
_CUT[[9, 10, 32]] = True
# Last bytes of the blanks beyond ASCII (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000).
_WIDE_END = np.zeros(256, bool)
_WIDE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each text begins and the end); null counts as empty."""
    flat = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def spans_in(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the members of the given runs, run after run; run k is ``at[k]`` to ``at[k + 1]``."""
    sizes = at[numbers + 1] - at[numbers]
    ends = np.cumsum(sizes)
    return np.repeat(at[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Chunks:
    """Pieces of some texts: ``ids`` number the distinct ``pieces`` in order, ``starts`` has where each text's begin (and the end)."""

    def __init__(self, own: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray):
        """Piece k is bytes ``first[k]`` to ``last[k]`` of the texts; ``own`` has the bytes of all pieces, one after another."""
        self.starts = np.searchsorted(first, at)
        offsets = np.concatenate([[0], np.cumsum(last - first)])
        coded = pc.dictionary_encode(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own))]))
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.pieces: list[bytes] = coded.dictionary.to_pylist()


def words(texts: pa.Array) -> tuple[Chunks, np.ndarray]:
    """Runs without ASCII blanks, and whether a line ends after each; a full stop or comma that ends a run after an ASCII letter is a piece of its own."""
    raw, at = bytes_of(texts)
    n = len(raw)
    inside = ~_BLANK[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    for edge, own in ((at[:-1], begins), (at[1:] - 1, ends)):  # runs don't go on into the next text
        edge = edge[(edge >= 0) & (edge < n)]
        own[edge] = inside[edge]
    stop = np.flatnonzero(ends)
    stop = stop[((raw[stop] == 44) | (raw[stop] == 46)) & ~begins[stop]]
    stop = stop[_LETTER[raw[stop - 1]]]
    begins[stop] = True
    ends[stop - 1] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lines = np.flatnonzero(raw == 10)
    line_ends = np.searchsorted(lines, np.append(first[1:], n)[:len(first)]) > np.searchsorted(lines, last)
    return Chunks(raw[inside], at, first, last), line_ends


def blank_led(texts: pa.Array) -> Chunks:
    """All of each text, cut before blanks (space, tab, line feed) that follow something other than a blank.

    A piece is a run of blanks with what follows it.  Neither a pattern that joins blanks nor a merge across such a
    cut can see it, as long as no token goes on with a space, tab or line feed after anything but a space.
    """
    raw, at = bytes_of(texts)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), raw[:-k]])[:len(raw)] for k in (1, 2, 3))
    wide = _WIDE_END[one] & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3)))
    first = np.flatnonzero(edge[:-1] | (_CUT[raw] & ~_BLANK[one] & ~wide))
    return Chunks(raw, at, first, np.append(first[1:], len(raw)))
