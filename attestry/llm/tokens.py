"""Token ids by the tokenizers library, with a bounded memory of pieces already encoded.

The library spends most of its time on offsets and normalisation. Byte-level BPE works on each piece
that the pre-tokenizer cuts, independently, so texts of plain characters are cut here and each distinct
piece goes through the library's BPE model once. Where white space is dropped, a batch is cut at once by arrays, and only its
distinct pieces become texts. Any other text goes through the library whole, as does
a text with the content of an added token, such as <|endoftext|>, which the library makes one id.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

#: Characters whose classes and forms are the same in every Unicode version and stable under NFC.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two pre-tokenizers known here, over plain characters.
_SPACED = re.compile(f"{_SHORT}| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+")
_UNSPACED = re.compile(f"{_SHORT}|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_UNSPACED_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces of a generation, two of which are remembered in a worker: some 100 MB at most, and half of it between tasks.
MEMORY = 250_000
#: Characters that are cut together: a worker's arrays take some 25 bytes for each.
BLOCK = 2 << 20


#: Classes of Latin-1 characters: white space, letters, numbers, others.
_SPACE, _LETTERS, _NUMBERS, _OTHERS = range(4)
_CLASS = np.array([_SPACE if chr(b) in "\t\n\r " else _LETTERS if re.match(f"[{_LETTER}]", chr(b)) else _NUMBERS if re.match(f"[{_NUMBER}]", chr(b)) else _OTHERS for b in range(256)], np.uint8)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


def cut_unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and sizes of the pieces of lower-cased Latin-1 bytes, as _UNSPACED cuts them."""
    kind = _CLASS[data]
    before = np.concatenate(([_SPACE], kind[:-1]))
    start = (kind != _SPACE) & ((kind != before) | (kind == _NUMBERS))
    # A contraction begins at an apostrophe that begins a piece; what follows it begins another.
    at = np.flatnonzero((data == 39) & start)
    follow = np.concatenate((data, [32, 32, 32]))
    one, two = follow[at + 1], follow[at + 2]
    size = np.where(np.isin(one, (115, 116, 109, 100)), 1, 0)
    size = np.where((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108), 2, size)
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    # The letters after a contraction; a run of letters may begin right there.
    after = at + 1 + size
    inside = after < len(data)
    start[after[inside]] |= kind[after[inside]] != _SPACE
    first = np.flatnonzero(start)
    gap = np.flatnonzero((kind == _SPACE) & (before != _SPACE))
    # A piece ends where the next begins or white space does.
    end = np.concatenate((first[1:], [len(data)]))
    k = np.searchsorted(gap, first)
    space = np.concatenate((gap, [len(data)]))[k]
    return first, np.minimum(end, space) - first


def _byte_letters() -> str:
    """Byte-level BPE's letter for each byte: printable bytes are themselves, the rest follow from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


class _Pieces(dict):
    """Ids of pieces. When full, it becomes the elder generation, from which pieces in use come back."""

    def __init__(self, model) -> None:
        self.model, self.letters, self.elder = model, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        out = self.elder.get(piece)
        if out is None:
            # ASCII letters and digits stand for themselves.
            word = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.letters)
            out = array("I", [x.id for x in self.model.tokenize(word)]).tobytes()
        self[piece] = out
        return out

    def age(self) -> None:
        self.elder = dict(self)
        self.clear()


def _literal(contents: list[str]) -> str:
    """A pattern of one of the contents that starts with what they have in common."""
    start = os.path.commonprefix(contents)
    return re.escape(start) + "(?:" + "|".join(re.escape(x[len(start) :]) for x in contents) + ")"


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.cut, self.lower = self._scheme(kind)
        self.added = self._added(kind)
        self.pieces = _Pieces(self.whole.model)

    @staticmethod
    def _scheme(kind: dict):
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not norm:
            return _SPACED, False
        steps, norms = pre.get("pretokenizers", []), [x["type"] for x in norm.get("normalizers", [])]
        if norms == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _UNSPACED_SOURCE:
            return _UNSPACED, True
        return None, False

    @staticmethod
    def _added(kind: dict) -> re.Pattern | None:
        """Contents of added tokens; case is ignored if one is looked for in the normalised text."""
        added = [x for x in kind.get("added_tokens") or () if x["content"]]
        flags = re.IGNORECASE if any(x.get("normalized", True) for x in added) else 0
        # A common start first: the search for a literal start is fast.
        return re.compile(_literal([x["content"] for x in added]), flags) if added else None

    def rest(self) -> None:
        """Between tasks only the pieces used last stay in memory."""
        self.pieces.elder = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not _PLAIN.fullmatch(text) or self.added and self.added.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.pieces) > MEMORY:
            self.pieces.age()
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(text.lower() if self.lower else text)))

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not (self.added and self.added.search(text))

    def encode_all(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each followed by the end id, and how many each has."""
        whole = [i for i, t in enumerate(texts) if t and not (self.cut is _UNSPACED and self._plain(t))]
        parts: list = [b""] * len(texts)
        for i in whole:
            parts[i] = self.encode(texts[i])
        at = sorted({*range(len(texts))} - {*whole})
        while at:  # arrays over about BLOCK characters, a longer text alone
            ends = np.cumsum([len(texts[i] or "") for i in at])
            k = max(1, int(np.searchsorted(ends, BLOCK, "right")))
            for i, ids in zip(at[:k], self._by_piece([texts[i] or "" for i in at[:k]]), strict=True):
                parts[i] = ids
            at = at[k:]
        end = np.array([end_id], "<u4").tobytes()
        sizes = np.fromiter((len(x) // 4 + 1 for x in parts), np.int64, len(parts))
        return np.frombuffer(b"".join(x for part in parts for x in (part, end)), "<u4"), sizes

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts, by the distinct pieces of all of them."""
        if not texts:
            return []
        if len(self.pieces) > MEMORY:
            self.pieces.age()
        line = "\n".join(texts)
        raw = (line.lower() if self.lower else line).encode("latin-1")
        padded = raw + bytes(8)
        first, size = cut_unspaced(np.frombuffer(raw, np.uint8))
        # Up to 7 bytes a piece is its own key; up to 16 its first and last 8 tell it, which is checked below; longer ones are few.
        words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
        head = words[first]
        key = np.where(size < 8, (head & _MASK[np.minimum(size, 7)]) | size.astype(np.uint64) << np.uint64(56), 0)
        mid = np.flatnonzero((size >= 8) & (size <= 16))
        tail = words[first[mid] + size[mid] - 8]
        mixed = (head[mid] * np.uint64(0x9E3779B97F4A7C15)) ^ ((tail ^ tail >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)) ^ size[mid].astype(np.uint64) << np.uint64(40)
        key[mid] = mixed >> np.uint64(8) | np.uint64(0xFF << 56)
        long = np.flatnonzero(size > 16)
        key[long] = np.arange(len(long), dtype=np.uint64) | np.uint64(0xFE << 56)
        coded = pa.array(key).dictionary_encode()
        code = coded.indices.to_numpy()
        of = np.zeros(len(coded.dictionary), np.int64)
        of[code[::-1]] = np.arange(len(code))[::-1]  # the first piece of each key
        same = of[code[mid]]
        if not ((head[mid] == head[same]) & (size[mid] == size[same]) & (tail == words[first[same] + size[same] - 8])).all():
            return [self.encode(t) for t in texts]  # two pieces with one key
        ids = [self.pieces[raw[a : a + n].decode("latin-1")] for a, n in zip(first[of].tolist(), size[of].tolist(), strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n
        each = n[code]
        after = np.cumsum(each)
        total = int(after[-1]) if len(after) else 0
        out = flat[np.repeat(begin[code] - (after - each), each) + np.arange(total)].tobytes()
        # Each text's first piece, and where its ids begin.
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        edges = (4 * np.concatenate(([0], after))[np.searchsorted(first, starts)]).tolist()
        return [out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
