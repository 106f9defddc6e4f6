"""Token ids by the tokenizers library, with a memo of words.

A byte-level tokenizer cuts a text at the borders of letter runs and never joins
characters across a single space between two characters that aren't white space.
Nor does it join a comma or full stop to a letter or digit before it, nor anything
across a line break between two such characters. Plain texts, which have no other
white space and no marks before commas or full stops, are cut at all of these.
Others are cut at spaces only, and pieces of letters and marks further. Each distinct part is encoded
once by the library and ids are put together from the memo; they equal those of
the whole text. Parts of plain texts are told apart by Arrow, many texts at a time,
and only the distinct ones are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CUT = re.compile(r"(?<=\S) (?=\S)")
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r".,;:!?\"()#%&$*-"
PLAIN = re.compile(rf"(?:[{LATIN}{MARKS}]+\n)*[{LATIN}{MARKS}]+")
PART = re.compile(rf"[{LATIN}]+|[{MARKS}]+|\n")
#: What plain texts are made of, what stands between parts while they are cut, and neighbours that aren't plain.
WORD = re.compile(r" ?\S+|\n")
BAR = "\x1f"
TWINS = ("..", ",,", ".,", ",.", "\n\n", BAR)
#: Characters of the parts that outlive a full memo.
COMMON = 9
#: How byte-level vocabularies write a leading space.
SPACE = "Ġ"
#: Entries of a worker's memos of pieces and of parts; characters of a remembered piece; characters taken at a time.
PIECES, PARTS, LONGEST, SEGMENT = 100_000, 700_000, 60, 1 << 19


def odd(text: str) -> bool:
    """Whether a space of the text stands beside white space or an end."""
    return "  " in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or text[:1] == " " or text[-1:] == " " or not text.isascii() and bool(re.search(r" \s|\s ", text))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    _known: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: Pieces without their space, and parts with theirs.
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.long: list[str] = []
        #: Last characters of parts that are neither letters nor digits.
        self.marks: set[str] = set()
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for this vocabulary file."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, texts: list[str]) -> None:
        """Remember parts of one space and letters or marks: they go to the library as one text, in which a token with a space in front opens each."""
        for i in range(0, len(texts), 2000):
            some = texts[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            if len(at) == len(some) + 1:
                whole = ids.tobytes()
                self.parts.update(zip(some, [whole[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], strict=True))
            else:
                self.parts.update(zip(some, self._each(some), strict=True))

    def _learn(self, pieces: set[str]) -> None:
        """Fill the memo of pieces."""
        new = [x for x in pieces if x not in self.pieces]
        cut = {x: PART.findall(f" {x}") for x in new if PLAIN.fullmatch(x)}
        for x, parts in cut.items():
            parts[0] = f" {parts[0]}"
        missing = {p for parts in cut.values() for p in parts}.difference(self.parts)
        self._spaced([p for p in missing if p[0] == " "])
        bare = [p for p in missing if p[0] != " "]
        self.parts.update(zip(bare, self._each(bare), strict=True))
        known = self.parts.__getitem__
        self.pieces.update((x, b"".join(map(known, parts))) for x, parts in cut.items())
        rest = [x for x in new if x not in cut]
        self.pieces.update(zip(rest, self._each([f" {x}" for x in rest]), strict=True))
        self.long += [x for x in new if len(x) > LONGEST]

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT and (m := CUT.search(text, at + SEGMENT)):
            yield text[at : m.start()]
            at = m.start() + 1
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes, without special tokens."""
        out = []
        for text in self._plain(texts):
            if isinstance(text, bytes) or len(text) <= SEGMENT:
                out.append(text)
                continue
            ids = []
            for k, segment in enumerate(self._segments(text)):
                head, rest = self._split(segment, k > 0)
                self._learn(set(rest))
                ids += [*self._each([head] * (not k)), *map(self.pieces.__getitem__, rest)]
                self._forget()
            out.append(b"".join(ids))
        at = [i for i, x in enumerate(out) if isinstance(x, str)]
        split = [self._split(out[i], False) for i in at]
        seen: set[str] = set()
        for _, rest in split:
            seen.update(rest)
        self._learn(seen)
        known = self.pieces.__getitem__
        for i, (_, rest), head in zip(at, split, self._each([head for head, _ in split]), strict=True):
            out[i] = head + b"".join(map(known, rest))
        self._forget()
        return out

    def _plain(self, texts: list[str]) -> list[str | bytes]:
        """Plain texts as ids, others as they are."""
        out: list[str | bytes] = list(texts)
        at = [i for i, text in enumerate(texts) if text and len(text) <= SEGMENT and not any(t in text for t in TWINS)]
        if not at:
            return [x or b"" for x in out]
        marked = [texts[i].replace(" ", "\x1f ").replace(",", "\x1f,").replace(".", "\x1f.").replace("\n", "\x1f\n\x1f") for i in at]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), BAR)
        parts = lists.values.dictionary_encode()
        distinct, which, ends = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy(), lists.offsets.to_numpy()
        memo = self.parts
        memo[""] = b""
        missing = [x for x in distinct if x not in memo and WORD.fullmatch(x)]
        for x in missing:
            if not x[-1].isalnum() and x[-1] not in ",.\n":
                self.marks.add(x[-1])
        self._spaced([x for x in missing if x[0] == " "])
        bare = [x for x in missing if x[0] != " "]
        memo.update(zip(bare, self._each(bare), strict=True))
        found = [memo.get(x) for x in distinct]
        odd_ones = np.array([x is None for x in found])  # parts that aren't plain
        own = [x or b"" for x in found]
        flat, sizes = np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own], np.int64)
        first = np.cumsum(sizes) - sizes
        # the ids of all parts one after another
        length = sizes[which]
        before = np.cumsum(length) - length
        ids = flat[np.repeat(first[which] - before, length) + np.arange(int(length.sum()))]
        stop = np.concatenate([before, [len(ids)]])[ends]
        not_plain = np.logical_or.reduceat(odd_ones[which], ends[:-1])
        for i, a, b, other in zip(at, stop[:-1].tolist(), stop[1:].tolist(), not_plain.tolist(), strict=True):
            if not other and not self._joined(texts[i]):
                out[i] = ids[a:b].tobytes()
        return [x or b"" for x in out]

    def _joined(self, text: str) -> bool:
        """Whether a comma or full stop follows a mark, to which the tokenizer joins it."""
        return any(c in text and (c + "," in text or c + "." in text) for c in self.marks)

    def _split(self, text: str, later: bool) -> tuple[str, list[str]]:
        """The first piece, which has no space before it, and the others; a later segment has only others."""
        pieces = CUT.split(text) if odd(text) else text.split(" ")
        return ("", pieces) if later else (pieces[0], pieces[1:])

    def _forget(self) -> None:
        """Between batches: long pieces aren't kept, nor more than the bounds."""
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if len(self.parts) > PARTS:  # short parts are the common ones
            self.parts = {x: ids for x, ids in self.parts.items() if len(x) <= COMMON}
            if len(self.parts) > PARTS // 2:
                self.parts.clear()
        for x in self.long:
            self.pieces.pop(x, None)
        self.long.clear()
