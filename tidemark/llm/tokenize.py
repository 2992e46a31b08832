"""Token ids of whole texts by a public tokenizer, with a bounded cache of segments.

Both vocabularies split a text before any merge, and no piece crosses a break between words. So the
ids of a text are the ids of its segments in a row, and each distinct segment is given to the
tokenizers library once while the cache holds it. A text whose white space could be read
differently in segments than in the whole is encoded as a whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the vocabularies see it.
WHITE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts to encode whole: white-space runs that one piece may span (three or more characters, or
#: two at the end) and control characters that only some splitters take for white space.
WHOLE = {"bytes": rf"\x00|{WHITE}{{3}}|{WHITE}{{2}}\z", "words": r"[\x1c-\x1f]"}
#: A piece of their own after letters.
MARKS = (",", ".")
#: Longer segments are encoded but not kept.
KEPT_LENGTH = 64
#: Beyond so many segments the cache starts anew.
KEPT_SEGMENTS = 800_000
#: Characters that are split and looked up together.
BATCH_CHARS = 8_000_000

_open: dict[tuple[str, str, int], "Encoder"] = {}


def byte_characters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """kind: "words" for a vocabulary that drops white space, "bytes" for one that keeps it."""

    def __init__(self, path: str, kind: str, kept: int = KEPT_SEGMENTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.most = kind, kept
        self.alphabet = byte_characters()
        self.forget()

    def forget(self) -> None:
        """Kept segments: a number each, and by number where its ids begin in one long array."""
        self.number: dict[str, int] = {}
        self.begin, self.kept = array("q", [0]), array("I")

    def keep(self, segment: str, ids: list[int]) -> int:
        self.kept.extend(ids)
        self.begin.append(len(self.kept))
        n = len(self.begin) - 2
        if len(segment) <= KEPT_LENGTH:
            self.number[segment] = n
        return n

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def number_of(self, segment: str) -> int:
        n = self.number.get(segment)
        return self.keep(segment, self.encode(segment)) if n is None else n

    def encode(self, segment: str) -> list[int]:
        """Ids of one segment. Letters alone are one piece, which the library's merges take as it
        is; so are letters before one comma or full stop. Only Latin letters go that way, for
        which lower case and composed form are the same everywhere."""
        if segment[-1:] in MARKS and len(segment) > 1:
            parts = [self.number_of(segment[:-1]), self.number_of(segment[-1])]
            if segment[:-1].strip(" ").isalpha():
                return [x for n in parts for x in self.kept[self.begin[n] : self.begin[n + 1]]]
        word = segment[1:] if segment[:1] == " " else segment
        if not word.isalpha() or max(word) > "\u012f":
            return self.whole(segment)
        piece = word.lower() if self.kind == "words" else segment
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return [x.id for x in self.tokenizer.model.tokenize(piece.translate(self.alphabet))]

    def look_up(self, wanted: list[str]) -> np.ndarray:
        if len(self.number) > self.most:
            self.forget()
        found = np.fromiter((self.number.get(x, -1) for x in wanted), np.int64, len(wanted))
        for i in np.flatnonzero(found < 0).tolist():
            x = wanted[i]
            found[i] = self.number_of(x)
        return found

    def split(self, texts: pa.Array) -> pa.ListArray:
        if self.kind == "words":
            return pc.utf8_split_whitespace(texts)
        # A word after a space carries that space; a line break is a piece of its own.
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        return pc.split_pattern(marked, "\x00")

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) in a row as uint32, and where each text's begin, with the end."""
        texts = texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, WHOLE[self.kind])
        parts = self.split(pc.if_else(odd, "", texts))
        words = parts.flatten().dictionary_encode()
        number = self.look_up(words.dictionary.to_pylist())
        begin, kept = np.frombuffer(self.begin, np.int64), np.frombuffer(self.kept, "<u4")
        which = number[words.indices.to_numpy()]
        length = (begin[1:] - begin[:-1])[which]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = kept[np.repeat(begin[which] - ends[:-1], length) + np.arange(ends[-1])]
        del begin, kept  # their arrays can't grow while these look at them
        at = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if pc.any(odd).as_py():
            pieces = [np.array(self.whole(x.as_py()), "<u4") if o else flat[a:b] for x, o, a, b in zip(texts, odd.to_pylist(), at, at[1:], strict=False)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            flat = np.concatenate([np.empty(0, "<u4"), *pieces])
        return flat, at


def encoder(path: str, kind: str, kept: int = KEPT_SEGMENTS) -> Encoder:
    """One encoder per worker process and size of cache."""
    if (path, kind, kept) not in _open:
        _open[path, kind, kept] = Encoder(path, kind, kept)
    return _open[path, kind, kept]


def slices(texts: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """The texts in order in parts of about `most` bytes, each with its first position."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False) if len(texts) else np.empty(0, np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a).cast(pa.large_string())
