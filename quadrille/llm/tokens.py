"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded.

The vocabulary's own pre-tokenisation cuts a text into pieces that are encoded independently. Most pieces of a
corpus repeat, so each distinct piece goes through the library once per worker (until ``CACHE_PIECES`` are held)
and texts become look-ups. Texts in which the cut could differ from the library's (added tokens, control
characters, code points whose class has changed since Unicode 3.2) are encoded by the library as a whole.
Null counts as the empty text.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

CACHE_PIECES = 400_000
END_ID = 2
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same cut for texts of Latin-1 without control characters, where the classes can be spelled out.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t\\n "
_CUT_LATIN = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\xa0]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    """Piece to its number; an unknown one gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece):
        self[piece] = n = len(self)
        self.waiting.append(piece)
        return n


@functools.cache
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return [chr(c) for _, c in sorted([(b, b) for b in own] + [(b, 256 + k) for k, b in enumerate(rest)])]


@functools.cache
def _stable(c: str) -> bool:
    return unicodedata.category(c) == unicodedata.ucd_3_2_0.category(c) and c.isspace() == (unicodedata.category(c)[0] == "Z")


class Encoder:
    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        path = vocabulary or default_vocabulary()
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and not spec.get("normalizer")
        self.model = self.tok.model
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile(_CUT).findall if plain else None
        self._clear()

    def _clear(self) -> None:
        self.pieces = _Pieces()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _encode_waiting(self) -> None:
        # The pieces are cut already: only the bytes' letters and the library's model are left of its pipeline.
        letters = dict(enumerate(_byte_letters()))
        tokenize = self.model.tokenize
        sizes, new = [], []
        for p in self.pieces.waiting:
            got = tokenize(p.encode().decode("latin-1").translate(letters))
            sizes.append(len(got))
            new += [t.id for t in got]
        self.pieces.waiting = []
        flat = np.array(new, np.uint32)
        used = self.start[-1]
        if used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + 2 * len(flat), np.uint32)])
        self.ids[used : used + len(flat)] = flat
        self.start = np.concatenate([self.start, used + np.cumsum(sizes)])

    def _cutter(self, text: str):
        """What cuts this text; None if the library itself has to."""
        if self.cut is None or any(a in text for a in self.added) or _CONTROL.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.cut if all(map(_stable, set(text))) else None
        return _CUT_LATIN

    def encode(self, texts, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, with the end id behind each; where each begins and the last ends)."""
        texts = ["" if t is None or t != t else t for t in texts]
        cutters = [self._cutter(t) for t in texts]
        whole = [i for i, cut in enumerate(cutters) if cut is None]
        own = dict(zip(whole, (e.ids for e in self.tok.encode_batch([texts[i] for i in whole], add_special_tokens=False)), strict=True)) if whole else {}
        get, numbers, counts = self.pieces.__getitem__, [], []
        for i, t in enumerate(texts):
            if i in own:
                counts.append(0)
                continue
            found = cutters[i](t)
            counts.append(len(found))
            numbers += map(get, found)
        if self.pieces.waiting:
            self._encode_waiting()
        number = np.array(numbers, np.int64)
        size = self.start[number + 1] - self.start[number]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[number] - (ends - size), size)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if own or end is not None:
            parts = []
            lengths = np.diff(bounds)
            tail = [] if end is None else [end]
            if own:
                for i in range(len(texts)):
                    parts.append(np.array(own[i], np.uint32) if i in own else flat[bounds[i] : bounds[i + 1]])
                    parts.append(np.array(tail, np.uint32))
                    lengths[i] = len(parts[-2])
                flat = np.concatenate(parts) if parts else flat
            else:
                flat = np.insert(flat, bounds[1:], end).astype(np.uint32)
            bounds = np.concatenate([[0], np.cumsum(lengths + len(tail))])
        if len(self.pieces) > CACHE_PIECES:
            self._clear()
        return flat, bounds


@functools.cache
def encoder(vocabulary: str | None = None) -> Encoder:
    """This worker's encoder."""
    return Encoder(vocabulary)


def in_runs(texts, limit: int = 500_000):
    """Positions (from, to) of runs of texts with about limit characters."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if isinstance(t, str) else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
