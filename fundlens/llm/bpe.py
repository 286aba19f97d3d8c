"""Encoders of whole texts that know a word's tokens once they have seen it.

A space between two characters that are not white space always begins a pre-token of the byte-level
vocabulary (only white space and letters, digits or signs after one space may share a pre-token), and
no piece of the sentence vocabulary has its word mark behind another character. So a text is cut
there, and its tokens are those of its parts one after the other. Texts are
encoded by slices: a slice's distinct parts are encoded once, and numpy puts their tokens in place.
Each worker keeps the tokens of the pre-tokens that it met, at most ``REMEMBERED``, which changes no
result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 600_000
SLICE_BYTES = 8 << 20
TOGETHER = 1024
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
CUT = re.compile(r"(?<=\S) (?=\S)")
PLAIN = "ɐ"              # below this the two pattern libraries agree on every character's class
OTHER = re.compile(f"[{PLAIN}-\U0010ffff]")


def regular(text: str, blanks: list[str] = BLANKS) -> bool:
    """Every space stands between two characters that are not white space; ``blanks``: the white space
    besides spaces that may occur."""
    return not ("  " in text or text[:1] == " " or text[-1:] == " "
                or any([c in text and (c + " " in text or " " + c in text) for c in blanks]))


def parts(text: str) -> list[str]:
    """The text cut at single spaces between characters that are not white space."""
    return text.split(" ") if regular(text) else CUT.split(text)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """The texts (null: empty) in runs of about ``size`` bytes, each with its first place."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, [t or "" for t in texts.slice(at, stop - at).to_pylist()]
        at = stop


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()          # many times as fast as to_pylist()


def cut_all(texts: list[str], whole: set[int] = frozenset()) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of the distinct part at each place, distinct parts, places of the texts' ends); the
    texts numbered in ``whole`` are one part each."""
    joined = "".join(texts)
    blanks = [c for c in BLANKS if c in joined]
    split = [i not in whole and regular(t, blanks) for i, t in enumerate(texts)]
    pieces = pc.split_pattern(pa.array([t if s else None for t, s in zip(texts, split)], pa.large_string()), " ")
    if not all(split):
        pieces = pa.array([x if x is not None else [t] if i in whole else CUT.split(t)
                           for i, (x, t) in enumerate(zip(pieces.to_pylist(), texts))], pa.large_list(pa.large_string()))
    coded = pieces.values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary), pieces.offsets.to_numpy()[1:].astype(np.int64)


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


def laid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all values one after the other, number of ids of each)."""
    return np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4


def gathered(at: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, their end at each place): the runs of ``flat`` numbered in ``at``, one after the other."""
    taken = sizes[at]
    stops = np.cumsum(taken)
    shift = (np.cumsum(sizes) - sizes)[at] - (stops - taken)
    return flat[np.repeat(shift, taken) + np.arange(stops[-1] if len(stops) else 0)], stops


class Memory:
    """Values of at most ``size`` keys; it begins anew when further keys do not fit."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def all(self, keys: list[str], learn) -> list[bytes]:
        """The keys' values; ``learn`` gives those of the unknown ones, in their order."""
        out = list(map(self.known.get, keys))
        if None in out:
            unknown = list(dict.fromkeys([k for k, x in zip(keys, out) if x is None]))
            found = dict(zip(unknown, learn(unknown)))
            if len(self.known) + len(found) > self.size:
                self.known = {}
            self.known.update(found if len(found) <= self.size else islice(found.items(), self.size))
            out = [found[k] if x is None else x for k, x in zip(keys, out)]
        return out


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in a byte-level vocabulary: bytes that print stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBPE:
    """Byte-level BPE of a ``tokenizers`` file. ``plain``: the special tokens' strings inside texts
    are ordinary text; otherwise the library finds them first."""

    def __init__(self, path: str, plain: bool, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain
        self.model, self.pattern = self.whole.model, regex.compile(public_tokenizers.PATTERN)
        self.special = [] if plain else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.symbols = dict(enumerate(byte_symbols()))
        self.pre = Memory(remembered)

    def vocabulary(self) -> list[bytes]:
        """The bytes of each id."""
        byte = {s: b for b, s in self.symbols.items()}
        out = [b""] * self.whole.get_vocab_size()
        for token, i in self.whole.get_vocab().items():
            out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        symbols = "".join(words).encode().decode("latin-1").translate(self.symbols)
        ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy(zero_copy_only=False), dtype=np.int64).tolist()
        parts, flat, sizes = [symbols[s:e] for s, e in zip([0, *ends], ends)], array("I"), []
        for at in range(0, len(parts), TOGETHER):
            found = list(map(self.model.tokenize, parts[at:at + TOGETHER]))
            flat.extend([t.id for tokens in found for t in tokens])
            sizes += map(len, found)
        raw, ends = flat.tobytes(), (4 * np.cumsum(sizes, dtype=np.int64)).tolist()
        return [raw[s:e] for s, e in zip([0, *ends], ends)]

    def library(self, text: str) -> bytes:
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def alone(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        found = [None if OTHER.search(t) else self.pattern.findall(t) for t in texts]
        known = iter(self.pre.all([w for f in found if f for w in f], self.merged))
        return [self.library(t) if f is None else b"".join(islice(known, len(f))) for t, f in zip(texts, found)]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each with a space in front: (ids, number of each part's ids). One search
        finds the pre-tokens of all parts that are plain and bounded by other than white space."""
        joined, easy, plain = " ".join(words), np.ones(len(words), bool), words
        if not regular(joined) or OTHER.search(joined):
            easy = np.array([bool(p) and not (p[0].isspace() or p[-1].isspace() or OTHER.search(p)) for p in words], bool)
            plain = [p for p, e in zip(words, easy) if e]
            joined = " ".join(plain)
        found = self.pattern.findall(" " + joined) if plain else []
        coded = pa.array(found, pa.string()).dictionary_encode()
        ids, stops = gathered(coded.indices.to_numpy(), *laid(self.pre.all(strings(coded.dictionary), self.merged)))
        # where each part ends among the pre-tokens, by characters
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
        last = np.searchsorted(np.cumsum(np.fromiter(map(len, found), np.int64, len(found))), ends)
        sizes = np.zeros(len(words), np.int64)
        sizes[easy] = np.diff(stops[last], prepend=0)
        if easy.all():
            return ids, sizes
        other = self.alone([" " + p for p, e in zip(words, easy) if not e])
        flat, sizes[~easy] = laid(other)
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return gathered(place, np.concatenate([ids, flat]), sizes[order])[0], sizes

    def encode(self, texts: list[str], spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of the texts' ids) of the whole texts, or of a space and each text."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        at, distinct, ends = cut_all(texts, whole)
        flat, sizes = self.spaced(distinct)
        first, own = 0, []
        for i, end in enumerate(ends.tolist()):
            if i in whole or not spaced:            # no space stands before a text's first part
                part, at[first] = distinct[at[first]], len(sizes) + len(own)
                own.append((i in whole, " " + part if spaced else part))
            first = end
        alone = iter(self.alone([p for entire, p in own if not entire]))
        more, counts = laid([self.library(p) if entire else next(alone) for entire, p in own])
        ids, stops = gathered(at, np.concatenate([flat, more]), np.concatenate([sizes, counts]))
        return ids, stops[ends - 1]


@lru_cache(maxsize=2)
def of_worker(path: str, plain: bool, remembered: int = REMEMBERED) -> ByteBPE:
    """The Python process's own encoder: a later task meets the pre-tokens of the earlier ones."""
    return ByteBPE(path, plain, remembered)


class SentenceBPE:
    """BPE with byte fallback of a sentencepiece file, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)

    def vocabulary(self) -> list[bytes]:
        """The bytes of each id: a byte piece is its byte, the word mark a space."""
        m = self.model
        return [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode("utf-8", "replace")
                for i in range(m.get_piece_size())]

    def whole(self, texts: list[str]) -> set[int]:
        """Numbers of the texts that must not be cut: a word mark in a text may join a space beside it."""
        return {i for i, t in enumerate(texts) if not self.apart or "▁" in t}

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts: (ids, number of each part's ids)."""
        return laid([packed(x) for x in self.model.encode(words, num_threads=1)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends of the texts' ids) of the whole texts."""
        at, distinct, ends = cut_all(texts, self.whole(texts))
        ids, stops = gathered(at, *self.spaced(distinct))
        return ids, stops[ends - 1]
