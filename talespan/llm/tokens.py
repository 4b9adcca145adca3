"""Encoding of whole texts with a public tokenizer file, one cached piece at a time.

Both tokenizer files used here split a text into pretokens first, and no pretoken reaches across a
single space between two other characters: the byte-level file starts a pretoken at that space, the
word file drops it. So a text is cut at such spaces and at single line ends, each distinct piece goes
through the library once, and its ids are kept in a cache of bounded size. Pieces next to runs of
white space are not cut. Results equal those of encoding the text as a whole; a file with other rules
is recognised and gets whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from tokenizers import Encoding, Tokenizer

#: Pieces that a worker's cache holds at most.
CACHE_PIECES = 800_000
_WHITE = "".join(chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_BEYOND_ASCII = [c for c in _WHITE if ord(c) > 127]
#: Runs of these after letters are a pretoken of their own; an apostrophe may be a part of a contraction, and <| may open a special token.
_MARKS = ".,;:!?#*$%&()[]{}\"-_/+=~^@>"
#: White space for Python and not for the files.
_CONTROLS = re.compile("[\\x00\\x1c-\\x1f]")
_RARE_ASCII = [c for c in _WHITE if ord(c) < 127 and c not in " \n"]


def pieces(text: str) -> list[str]:
    """Keys of the text's pieces in order: a piece after a cut by what follows its space, which has
    no white space at its ends; any other piece by itself after a NUL."""
    if "\0" in text:
        return ["\0" + text]
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RARE_ASCII)
    if not odd and (text.isascii() or not any(c in text for c in _BEYOND_ASCII)):
        # a single line end between two other characters is a pretoken by itself, or is dropped
        lines = [text] if "\n\n" in text or text[:1] == "\n" or text[-1:] == "\n" else text.split("\n")
        out = []
        for line in lines:
            parts = line.split(" ")
            parts[0] = "\0" + parts[0]
            out += parts
            out.append("\0\n")
        out.pop()
        return out
    parts = text.split(" ")
    out, open_, free = ["\0" + parts[0]], not parts[0] or parts[0][-1] in _WHITE, False
    for p in parts[1:]:
        if open_ or not p or p[0] in _WHITE:
            out[-1] = ("\0 " if free else "") + out[-1] + " " + p
            free = False
        else:
            out.append(p)
            free = True
        open_ = not p or p[-1] in _WHITE
        if open_ and free:
            out[-1], free = "\0 " + p, False
    return out


# The two pretokenizers whose pretokens never cross a single space, with their normalizers.
_LETTERS_OR_MARKS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTE_FORM = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_FORM = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _LETTERS_OR_MARKS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
#: Letters below this code are one character in any normal form, and their small letters are letters too (but for U+0130).
_PLAIN = "\u0180"


def _byte_letters() -> dict[int, int]:
    """How byte-level files write the bytes that are no printable Latin-1 character: 256 and up, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in printable)}


class Encoder:
    """Ids of texts as little-endian bytes, and the character offsets of their tokens.

    The cache has two generations; a piece that is used again moves to the young one, and the old
    one is dropped when the young one is full, so memory is bounded and frequent pieces stay. The
    large cache is asked once for each distinct piece of a call. A file that doesn't split texts in
    one of the two known ways is given whole texts.
    """

    def __init__(self, path: str, dtype: str = "<u4", with_offsets: bool = False, cache_pieces: int = CACHE_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.with_offsets, self.limit = dtype, with_offsets, cache_pieces // 2
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.model = self.tokenizer.model
        self.code = {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        form = (parts["normalizer"], parts["pre_tokenizer"])
        self.whole = form not in (_BYTE_FORM, _WORD_FORM) or bool(parts["model"].get("dropout")) or any(a["normalized"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in parts["added_tokens"])
        # the byte-level file writes the space before a piece as one letter; the other one folds case
        self.space = "\u0120" if form == _BYTE_FORM else ""
        self.bytes_as = _byte_letters()

    def _entries(self, out: dict, encoded: Encoding, keys: list[str], lengths: list[int]) -> None:
        """Deal the tokens of pieces that were encoded next to each other to the pieces."""
        offsets = np.array(encoded.offsets, dtype=np.int32).reshape(-1, 2)
        ends = np.cumsum(lengths)
        stops = np.searchsorted(offsets[:, 0], ends).tolist()
        at = 0
        if self.with_offsets:
            for key, stop, end, n in zip(keys, stops, ends.tolist(), lengths, strict=True):
                out[key] = offsets[at:stop] - np.int32(end - n)
                at = stop
        else:
            raw, width = np.array(encoded.ids, dtype=self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            for key, stop in zip(keys, stops, strict=True):
                out[key] = raw[width * at : width * stop]
                at = stop

    def _encode(self, missing: list[str]) -> dict:
        """Pieces that may stand next to each other go through the library many at a time."""
        out: dict[str, object] = {}
        loose = []
        for p in missing:
            if p[0] == "\0":
                self._entries(out, self.tokenizer.encode(p[1:], add_special_tokens=False), [p], [len(p)])
            else:
                loose.append(p)
        joined = [loose[i : i + 200] for i in range(0, len(loose), 200)]
        for i in range(0, len(joined), 25):
            some = joined[i : i + 25]
            for group, e in zip(some, self.tokenizer.encode_batch([" " + " ".join(g) for g in some], add_special_tokens=False), strict=True):
                self._entries(out, e, group, [len(p) + 1 for p in group])
        return out

    def _form(self, piece: str) -> str | None:
        """How the library's model sees a piece of plain letters, which is one pretoken; None for any other piece."""
        if not piece.isalpha():
            return None
        if not self.space:
            piece = piece.lower()
        if piece.isascii():
            return piece
        if max(piece) >= _PLAIN or not piece.isalpha():
            return None
        return piece.encode().decode("latin-1").translate(self.bytes_as)

    def _letters(self, form: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(form)]).tobytes()

    def _new(self, piece: str) -> bytes | None:
        """Ids of pieces of plain letters, with or without marks behind: letters and a run of marks are always two pretokens."""
        if piece[0] == "\0":
            form = self._form(piece[1:])
            return None if form is None else self._letters(form)
        base = piece.rstrip(_MARKS)
        form = self._form(base)
        if form is None:
            return None
        if base == piece:
            return self._letters(self.space + form)
        return (self.young.get(base) or self.old.get(base) or self._letters(self.space + form)) + self._marks(piece[len(base) :])

    def _marks(self, marks: str) -> bytes:
        key = "\0" + marks
        if key not in self.young:
            self.young[key] = self._other(key)
        return self.young[key]

    def _other(self, piece: str) -> bytes:
        encoded = self.tokenizer.encode(piece[1:] if piece[0] == "\0" else " " + piece, add_special_tokens=False)
        return array(self.code, encoded.ids).tobytes()

    def _load(self) -> dict:
        """A small table of pieces for one call; what it lacks comes from the cache or the library."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return _Here(self)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        cut = [(pieces(t) if self.space else _dropping(_folded(t))) if t else [] for t in texts]
        of = self._load().__getitem__
        return [b"".join(map(of, one)) for one in cut]

    def offsets(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text an array of (start, end) rows in characters, one row a token."""
        if self.whole:
            return [np.array(e.offsets, dtype=np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        cut = [pieces(t) if t else [] for t in texts]
        here = self._load()
        here |= self._encode([p for p in set().union(*cut) if p not in self.young and p not in self.old])
        self.young |= here
        of = here.__getitem__
        out = []
        for one in cut:
            if not one:
                out.append(np.empty((0, 2), np.int64))
                continue
            found = list(map(of, one))
            # a bare key leaves out its space; a NUL is no character of the text
            base = np.cumsum([0, *(len(p) + (-1 if p[0] == "\0" else 1) for p in one[:-1])])
            out.append(np.concatenate(found) + np.repeat(base, [len(f) for f in found])[:, None])
        return out


class _Here(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> object:
        own = self.encoder
        ids = own.young.get(piece)
        if ids is None:
            ids = own.old.get(piece)
            if ids is None:
                ids = own._new(piece)
                if ids is None:
                    ids = own._other(piece)
            own.young[piece] = ids
        self[piece] = ids
        return ids


def _dropping(text: str) -> list[str]:
    """Pieces for ids where the file drops all white space."""
    return pieces(text) if _CONTROLS.search(text) else text.split()


def _folded(text: str) -> str:
    """Where the file folds case, folding a Latin-1 text first leaves fewer distinct pieces; special tokens stay as they are."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_encoders: dict[tuple[str, str, bool, int], Encoder] = {}


def encoder(path: str, dtype: str = "<u4", with_offsets: bool = False, cache_pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder for each file and Python worker, kept across tasks."""
    key = (path, dtype, with_offsets, cache_pieces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, dtype, with_offsets, cache_pieces)
    return _encoders[key]
