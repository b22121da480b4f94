"""Token ids of whole texts, by the public tokenizers, with a store of ids by chunk.

A text is cut at white space; both vocabularies treat every chunk by itself,
so the ids of a text are those of its chunks one after the other, and a batch
encodes each distinct chunk once. Where spaces are part of ids, texts are cut
at single spaces only, and each chunk but the first begins with its space.
Texts in which white space runs over a cut or lies outside ASCII, and texts
that name a special token, are encoded as a whole.

New chunks are encoded many at a time, as one text. Which ids belong to which
chunk shows in the ids: with spaces in ids a chunk's first id begins with a
space, and with word ends every piece of a chunk ends with a word end. A group
whose ids don't show as many chunks as it has is encoded chunk by chunk. The
store holds a bounded number of chunks and forgets the rarest first.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np

from tallymark.llm.common import ragged, tokenizer_path

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
#: Letters, one digit, or a run of other marks; apostrophes are left out, as they may begin an ending.
_PIECE = re.compile(rb"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
GROUP = 1000


class _Codes(dict):
    """Numbers for chunks, in the order they are first asked for."""

    def __missing__(self, chunk):
        self[chunk] = code = len(self)
        return code


def _pieces(chunk: bytes) -> int:
    """Into how many pieces the vocabulary with word ends cuts a chunk, or 0 where that isn't plain."""
    if b"'" in chunk:
        return 0
    if chunk.isascii():
        return 1 if chunk.isalpha() else len(_PIECE.findall(chunk))
    text = chunk.decode()
    word = text.rstrip(_MARKS)
    return 1 + (len(word) < len(text)) if word.isalpha() else 0


def _spaces_apart(text: str) -> bool:
    """Whether every space of a text stands between two characters that aren't white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in "\n\t\r\x0b\x0c")


class ChunkEncoder:
    """Ids by ``name``'s tokenizer, without added special tokens.

    A special token's string in a text becomes that token, as the library has
    it; with ``special_as_text`` it is ordinary text.
    """

    def __init__(self, name: str, leading_space: bool, most_chunks: int = 600_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.leading_space = leading_space
        self.most_chunks = most_chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bound = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.bound[[k for x, k in vocabulary.items() if (x.startswith("Ġ") if leading_space else x.endswith("</w>"))]] = True
        self.clear()

    def clear(self) -> None:
        self.codes = _Codes()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the more frequent half of the chunks, none of them seen but once."""
        least = max(1, int(np.partition(self.hits, len(self.hits) // 2)[len(self.hits) // 2]))
        keep = self.hits > least
        order = np.flatnonzero(keep)
        names = [c for c, k in zip(self.codes, keep.tolist(), strict=True) if k]
        self.codes = _Codes(zip(names, range(len(names)), strict=True))
        self.flat = self.flat[ragged(self.starts[order], self.lengths[order])]
        self.lengths, self.hits = self.lengths[order], self.hits[order]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), one text at a time."""
        found = self._encoded(texts)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _together(self, chunks: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that are encoded as one text; each has so many bounds among its ids."""
        text = "".join(chunks) if self.leading_space else " ".join(chunks)
        ids = np.array(self._encoded([text])[0], np.uint32)
        at = np.flatnonzero(self.bound[ids])
        if len(at) != pieces.sum():
            return self._each(chunks)
        if self.leading_space:
            return ids, np.diff(np.append(at, len(ids)))
        return ids, np.diff(at[np.cumsum(pieces) - 1] + 1, prepend=0)

    def _learn(self, chunks: list) -> None:
        if self.leading_space:  # a tuple marks the first chunk of a text
            pieces = np.fromiter((type(c) is not tuple for c in chunks), np.int64, len(chunks))
            texts = [" " + c if k else c[0] for c, k in zip(chunks, pieces.tolist(), strict=True)]
        else:
            pieces = np.fromiter(map(_pieces, chunks), np.int64, len(chunks))
            texts = [c.decode() for c in chunks]
        odd, plain = np.flatnonzero(pieces == 0), np.flatnonzero(pieces)
        parts = [self._each([texts[k] for k in odd.tolist()])]
        for a in range(0, len(plain), GROUP):
            part = plain[a : a + GROUP]
            parts.append(self._together([texts[k] for k in part.tolist()], pieces[part]))
        order = np.concatenate([odd, plain])
        lengths = np.concatenate([n for _, n in parts])
        starts = np.empty(len(order), np.int64)
        starts[order] = len(self.flat) + np.cumsum(lengths) - lengths
        sizes = np.empty(len(order), np.int64)
        sizes[order] = lengths
        self.flat = np.concatenate([self.flat, *(x for x, _ in parts)])
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), np.int64)])

    def _cuts(self, text: str) -> bool:
        """Whether the ids of a text are those of its chunks."""
        if any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text):
            return False
        return not any(s in text for s in self.special) and (not self.leading_space or _spaces_apart(text))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null is an empty text."""
        if len(self.codes) > self.most_chunks:
            self._forget()
        codes, known = self.codes, len(self.codes)
        each, sizes, whole = [], np.zeros(len(texts), np.int64), []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not self._cuts(text):
                whole.append(k)
                continue
            chunks = text.split(" ") if self.leading_space else text.encode().split()
            if not chunks:
                continue
            if self.leading_space:
                chunks[0] = (chunks[0],)
            each.append(np.fromiter(map(codes.__getitem__, chunks), np.int64, len(chunks)))
            sizes[k] = len(chunks)
        if len(codes) > known:
            self._learn(list(islice(codes, known, None)))
        all_codes = np.concatenate(each) if each else np.zeros(0, np.int64)
        self.hits += np.bincount(all_codes, minlength=len(codes))
        lengths = self.lengths[all_codes]
        ids = self.flat[ragged(self.starts[all_codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.concatenate([[0], np.cumsum(sizes)])
        n = ends[at[1:]] - ends[at[:-1]]
        if not whole:
            return ids, n
        odd = {k: np.array(x, np.uint32) for k, x in zip(whole, self._encoded([texts[k] for k in whole]), strict=True)}
        stops = np.cumsum(n)
        parts = [odd[k] if k in odd else ids[stops[k] - n[k] : stops[k]] for k in range(len(texts))]
        for k, x in odd.items():
            n[k] = len(x)
        return np.concatenate(parts) if parts else ids, n


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(name: str, leading_space: bool, special_as_text: bool = False) -> ChunkEncoder:
    """One encoder for each vocabulary in a worker, kept between tasks."""
    key = (name, leading_space, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(name, leading_space, special_as_text=special_as_text)
    return _ENCODERS[key]
