"""Token ids of whole texts, by the distinct pieces between white space.

A tokenizer that never joins a piece with the white space after it gives a text the ids of its
pieces, one after the other. Texts repeat their words, so a task encodes each distinct piece
once and keeps short ones. Whether a tokenizer allows this is read from its file; any
other one gets whole texts.

A tokenizer that drops white space needs no more of a word than its hash: words of a batch
are hashed, told apart and put back as arrays, and only words not met before are encoded. Two
words of one 64-bit hash would get the same ids; among a million words that has a chance of one in
ten million.

Tokenizer files are read on the driver from a path the caller names and broadcast: their size
is that of a vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from tallywatch.llm import textarrays as ta

#: Bytes or characters of text cut at once.
SEGMENT = 1 << 20

# The split patterns after which no piece reaches past white space.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

LOWER_CASE = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}

#: Where a text may be cut: before a space that follows something else than white space.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


def led_pieces(text: str) -> list[str]:
    """The text with a space put before it, cut before each space that follows a solid character.

    Every piece begins with a space, which is left out.
    """
    if text.startswith(" ") or _SPACE_AFTER_SPACE.search(text):
        return [p[1:] for p in _BEFORE_SPACE.split(" " + text)]
    return text.split(" ")


def pieces_with_spaces(text: bytes) -> list[bytes]:
    """The text cut before each space that follows a solid character; joined, it is whole."""
    return [p.encode() for p in _BEFORE_SPACE.split(text.decode())] if text else []


def pieces_without_spaces(text: bytes) -> list[bytes]:
    """The runs between ASCII white space."""
    return text.split()


def whole(text: bytes) -> list[bytes]:
    return [text] if text else []


class Recent:
    """What was made of pieces of text lately: two generations of at most ``kept / 2`` each."""

    def __init__(self, kept: int = 200_000, longest: int = 64) -> None:
        self.kept, self.longest = kept, longest
        self.young: dict = {}
        self.old: dict = {}
        self.long: list = []

    def of(self, wanted: set, make: Callable[[list], Iterable]) -> dict:
        """A table with all wanted pieces; ``make`` gives the values of those not seen lately.

        It is good until the next call.
        """
        for piece in self.long:
            self.young.pop(piece, None)
        if len(self.young) > self.kept // 2:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for piece in wanted.difference(young):
            value = old.get(piece)
            if value is None:
                new.append(piece)
            else:
                young[piece] = value
        if new:
            young.update(zip(new, make(new)))
        self.long = [p for p in new if len(p) > self.longest]
        return young


def groups(texts: Sequence) -> Iterator[list]:
    """Texts in groups of about a segment."""
    group: list = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= SEGMENT:
            yield group
            group, size = [], 0
    yield group


class Encoder:
    """Ids of texts; ``cut`` gives pieces whose ids follow each other in those of the text.

    Texts and pieces are UTF-8, as Arrow holds them.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Iterable[Sequence[int]]],
        cut: Callable[[bytes], list[bytes]],
        kept: int = 500_000,
        longest: int = 64,
    ) -> None:
        self.encode, self.cut = encode, cut
        self.known = Recent(kept, longest)

    def texts(self, texts: Sequence[bytes | None]) -> Iterator[bytes]:
        """The ids of each text as 32-bit numbers, null as empty; a segment is cut at once."""

        def made(pieces: list[bytes]) -> Iterator[bytes]:
            return (array("I", ids).tobytes() for ids in self.encode([p.decode() for p in pieces]))

        for group in groups([t or b"" for t in texts]):
            cut = [self.cut(t) for t in group]
            here = self.known.of(set().union(*cut), made)
            for pieces in cut:
                yield b"".join(map(here.__getitem__, pieces))

    def arrays(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column of strings."""
        texts = column.cast(pa.large_binary()).to_pylist()
        return (np.frombuffer(ids, "=u4") for ids in self.texts(texts))


class WordEncoder:
    """Ids of texts whose words between ASCII white space have ids of their own.

    ``special`` are strings that are not what their words say: where one occurs, case is kept.
    The table of words holds some thirty bytes a word, and is emptied at ``kept`` words.
    """

    def __init__(
        self,
        encode: Callable[[list[str]], Iterable[Sequence[int]]],
        lowers: bool = False,
        special: Sequence[bytes] = (),
        kept: int = 3_000_000,
    ) -> None:
        self.encode, self.lowers, self.special, self.kept = encode, lowers, special, kept
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self._empty()

    def _empty(self) -> None:
        #: Hashes in order, and of each word where its ids are and how many.
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.held = 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [array("I", ids) for ids in self.encode(words)]
        count = np.array([len(f) for f in found], np.int64)
        at = self.held + np.cumsum(count) - count
        self.ids.append(np.frombuffer(b"".join([f.tobytes() for f in found]), np.uint32))
        self.held += int(count.sum())
        place = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, place, hashes)
        self.at, self.count = np.insert(self.at, place, at), np.insert(self.count, place, count)

    def _segment(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        raw = data.tobytes() if self.lowers else b""
        if self.lowers and not any(s in raw for s in self.special):
            data = self.lower[data]
        start, end, hashes, first = ta.words(data, at)
        own, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(own) > self.kept:
            self._empty()
        known = np.searchsorted(self.hashes, own)
        new = np.ones(len(own), bool)
        inside = known < len(self.hashes)
        new[inside] = self.hashes[known[inside]] != own[inside]
        if new.any():
            spans = zip(start[place[new]].tolist(), end[place[new]].tolist())
            raw = data.tobytes()
            self._learn(own[new], [raw[i:j].decode() for i, j in spans])
            known = np.searchsorted(self.hashes, own)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        slot = known[which]
        count = self.count[slot]
        ends = np.concatenate([[0], np.cumsum(count)])
        if not len(slot):
            ids = np.zeros(0, np.uint32)
        else:
            ids = self.ids[0][np.repeat(self.at[slot] - ends[:-1], count) + np.arange(ends[-1])]
        bounds = ends[first]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[i:j]

    def arrays(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column of strings, null as empty."""
        data, at = ta.layout(column)
        for i, j in ta.row_groups(at):
            yield from self._segment(data[at[i] : at[j]], at[i : j + 1] - at[i])


def _library_tokenizer(blob: bytes, plain_specials: bool) -> Callable[[list[str]], Iterator[list[int]]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark splits the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(blob.decode())
    tokenizer.encode_special_tokens = plain_specials

    def encode(pieces: list[str]) -> Iterator[list[int]]:
        return (e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False))

    return encode


def _bare(specification: dict) -> bool:
    """No added token swallows white space, and nothing is put around a text."""
    added = specification.get("added_tokens") or []
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) and not (
        specification.get("truncation") or specification.get("padding")
    )


def drops_white_space(specification: dict) -> bool:
    """Is the tokenizer one whose pieces are matches of ``WORD_PATTERN``, white space dropped?"""
    steps = (specification.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0]
    return (
        _bare(specification)
        and split.get("type") == "Split"
        and split.get("pattern") == {"Regex": WORD_PATTERN}
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and all(s == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False} for s in steps[1:])
    )


def leads_with_space(specification: dict) -> bool:
    """Is the tokenizer byte-level with the library's own pattern: a space only leads a piece?"""
    step = specification.get("pre_tokenizer") or {}
    return (
        _bare(specification)
        and specification.get("normalizer") is None
        and step.get("type") == "ByteLevel"
        and step.get("add_prefix_space") is False
        and step.get("use_regex") is True
    )


_loaded: dict[tuple, object] = {}


def _once(kind: str, blob: bytes, make: Callable[[], object]):
    """One tokenizer per Python worker, however many tasks it runs."""
    key = (kind, len(blob), hash(blob))
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def library_encoder(blob: bytes, plain_specials: bool = False) -> Encoder | WordEncoder:
    """Of a file of the tokenizers library; ``plain_specials`` reads special strings as text."""

    def make() -> Encoder | WordEncoder:
        encode = _library_tokenizer(blob, plain_specials)
        specification = json.loads(blob)
        if drops_white_space(specification):
            special = [t["content"].encode() for t in specification.get("added_tokens") or []]
            return WordEncoder(encode, specification.get("normalizer") == LOWER_CASE, special)
        if leads_with_space(specification):
            return Encoder(encode, pieces_with_spaces)
        return Encoder(encode, whole)

    return _once(f"library {plain_specials}", blob, make)


def vocabulary_size(blob: bytes) -> int:
    """One more than the highest id of a file of the tokenizers library."""
    specification = json.loads(blob)
    ids = list(specification["model"]["vocab"].values())
    return 1 + max(ids + [t["id"] for t in specification.get("added_tokens") or []])
