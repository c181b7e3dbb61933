"""Token ids of whole texts by a tokenizers vocabulary, encoded word by word with a bounded memory.

Both vocabularies split texts before merging, and no split crosses a single space between two
characters that aren't white space. So a text is cut at such spaces, each different piece is encoded
once, and the ids are gathered with numpy. Arrow cuts the texts, takes trailing punctuation off plain
words, and numbers the different words and tails, so Python sees each of those once in a slice. A plain
word goes straight to the vocabulary's merge model; byte-level pieces of several lines are cut at their
line feeds; every other new piece goes through the whole tokenizer. What was encoded is remembered up
to `MOST_PIECES` pieces; then only those of the last slice are.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from rookery.llm.staging import buffer_of, hold

END_ID = 2
MOST_PIECES = 500_000
SLICE_BYTES = 4 << 20
# letters whose case and composition are fixed: ASCII and Latin-1
_TAIL = '.,;:!?|#$%&*"()-'
_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = re.compile(rf"({_WORD})([{re.escape(_TAIL)}]*)")
# white space of str.isspace; a text with more than single spaces between other characters is cut with care
_SPACE = r"[\t-\r\x1c-\x20\x{85}\pZ]"
_ODD = rf"^ | $|{_SPACE} | {_SPACE}"


def _byte_letters() -> dict[int, str]:
    """Bytes as the letters of byte-level vocabularies: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _halves(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Plain words and the punctuation after them; any other piece is whole, and nothing after it."""
    data, offsets = buffer_of(pieces.cast(pa.large_binary()))
    words = pc.utf8_rtrim(pieces, _TAIL)
    plain = pc.match_substring_regex(words, f"^{_WORD}$").to_numpy(zero_copy_only=False)
    stops = np.where(plain, offsets[:-1] + pc.binary_length(words).to_numpy(), offsets[1:])
    cuts = np.append(np.stack([offsets[:-1], stops], 1).ravel(), offsets[-1:])
    both = pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(cuts), pa.py_buffer(data))
    return both.take(pa.array(np.arange(0, len(both), 2))), both.take(pa.array(np.arange(1, len(both), 2)))


class Encoder:
    """`encode(texts)` gives all ids and each text's end; an end id closes every text."""

    def __init__(self, path: str, spaced: bool, end: int | None = END_ID, most: int = MOST_PIECES):
        """spaced: the space before a word belongs to its ids (byte-level vocabularies)."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merge, self.spaced, self.end, self.most = self.tokenizer.model.tokenize, spaced, end, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | tuple | None, int] = {}
        self.flat, self.starts, self.lens = array("I"), array("q"), array("q")
        self._add(None, [])  # the tail of a piece without one
        if self.end is not None:
            self._add((), [self.end])

    def _add(self, key: str | tuple | None, ids: list[int]) -> None:
        self.index[key] = len(self.starts)
        self.starts.append(len(self.flat))
        self.lens.append(len(ids))
        self.flat.extend(ids)

    def _whole(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _known(self, key: str | tuple) -> list[int]:
        """The ids of a key, remembered from now on."""
        if key not in self.index:
            self._add(key, self._ids(key))
        at = self.index[key]
        return self.flat[self.starts[at] : self.starts[at] + self.lens[at]].tolist()

    def _ids(self, key: str | tuple) -> list[int]:
        """Keys of later pieces leave out their leading space; a first piece, a tail or a later line stands in a tuple."""
        first = isinstance(key, tuple)
        word = piece = key[0] if first else key
        if not (piece.isascii() and piece.isalpha()):
            if plain := _PLAIN.fullmatch(piece):
                word, tail = plain.groups()
                if tail:
                    return self._known((word,) if first else word) + self._known((tail,))
            else:
                lines = piece.split("\n") if self.spaced and "\n" in piece else ()
                if lines and all(p and not p[0].isspace() and not p[-1].isspace() for p in lines):
                    ids = self._known((lines[0],) if first else lines[0])
                    for p in lines[1:]:
                        ids += self._known(("\n",)) + self._known((p,))
                    return ids
                return self._whole(" " + piece if self.spaced and not first else piece)
        word = word if self.spaced else word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_LETTERS)
        return [t.id for t in self.merge(_LETTERS[32] + word if self.spaced and not first else word)]

    def _careful(self, text: str) -> list[str | tuple]:
        """Keys of the pieces of a text with other white space than single spaces between characters."""
        glued: list[str | tuple] = []
        run: list[str] = []
        for p in text.split(" "):
            if run and p and run[-1] and not p[0].isspace() and not run[-1][-1].isspace():
                glued.append(" ".join(run))
                run = [p]
            else:
                run.append(p)
        glued.append(" ".join(run))
        glued[0] = (glued[0],)
        return glued

    def _numbers(self, keys: list[str | tuple | None]) -> np.ndarray:
        """The place of each key; new ones are encoded."""
        for key in set(keys).difference(self.index):
            if key not in self.index:  # a piece before it may have had it for its word
                self._add(key, self._ids(key))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def _forget(self, keys: set) -> None:
        """Drops all pieces but `keys`."""
        old, flat, starts, lens = self.index, self.flat, self.starts, self.lens
        self.clear()
        for key in keys:
            if key in old and key not in self.index:
                at = starts[old[key]]
                self._add(key, flat[at : at + lens[old[key]]])

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pieces' words and tails in turn, and each text's number of them."""
        cut = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = cut.flatten()
        pieces = whole.dictionary_encode()
        words, tails = (half.dictionary_encode() for half in _halves(pieces.dictionary))
        keys, ends = words.dictionary.to_pylist(), [(t,) if t else None for t in tails.dictionary.to_pylist()]
        if len(self.index) > self.most:
            self._forget({*keys, *ends})
        each = np.stack([self._numbers(keys)[words.indices.to_numpy()], self._numbers(ends)[tails.indices.to_numpy()]], 1)
        places = each[pieces.indices.to_numpy()]
        if self.spaced and len(counts):
            first = np.cumsum(counts) - counts
            places[first, 0] = self._numbers([(p,) for p in whole.take(pa.array(first)).to_pylist()])
            places[first, 1] = self.index[None]
        return places.ravel(), 2 * counts

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`texts`: strings; null is empty."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(column), bool)
        if self.spaced:
            odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        places, own = self._places(column.filter(pa.array(~odd)))
        counts = np.empty(len(column), np.int64)
        counts[~odd] = own
        keys = [self._careful(t) for t in column.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(k) for k in keys]
        counts += self.end is not None
        stops = np.cumsum(counts)
        at = np.empty(stops[-1] if len(stops) else 0, np.int64)
        kind = np.repeat(odd, counts)
        last = np.zeros(len(at), bool)
        if self.end is not None:
            last[stops - 1] = True
            at[last] = self.index[()]
        at[~kind & ~last] = places
        at[kind & ~last] = self._numbers([k for own in keys for k in own])
        lens = np.frombuffer(self.lens, np.int64)[at] if len(at) else np.empty(0, np.int64)
        upto = np.concatenate(([0], np.cumsum(lens)))
        starts = np.frombuffer(self.starts, np.int64)[at] if len(at) else lens
        place = np.repeat(starts - upto[:-1], lens) + np.arange(upto[-1])
        ids = np.frombuffer(self.flat, np.uint32)[place] if len(place) else np.empty(0, np.uint32)
        return ids, upto[stops]


def encoder(path: str, spaced: bool, end: int | None = END_ID) -> Encoder:
    """The encoder of this Python worker, with what it remembers of earlier tasks."""
    return hold((path, spaced, end), lambda: Encoder(path, spaced, end))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine; resolved on each executor."""
    return public_tokenizers.path(name)
