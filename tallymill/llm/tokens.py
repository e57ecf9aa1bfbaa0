"""Token ids of whole texts from a vocabulary file of the tokenizers library, as bytes.

A tokenizer that drops white space and never joins what it separates gives a text the ids of its
words, one after another. For such a file many texts are cut at once, by arrays over their bytes:
plain words into letters and the signs behind them, as the library's splitter would hand them to its
model, other words not at all. Each distinct piece is encoded once per worker process and remembered
(a bounded number of them). Other files encode text by text. All ways give the library's ids.
"""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import json  # noqa: E402
from array import array  # noqa: E402
from itertools import pairwise  # noqa: E402

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tallymill.llm.common import remembers, working  # noqa: E402

#: Pieces remembered by a worker process, and as many of those before them.
REMEMBERED = 400_000
#: Characters of texts that are cut together, or one text.
GROUP_CHARS = 1 << 22
#: Words encoded in one call.
TOGETHER = 1000

#: A digit is a token of its own, so it can stand between words that are encoded in one call.
_BETWEEN = b"7"

# fixed values: the parts of a tokenizer file under which ids do not depend on other words
_NORMALIZERS = (
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
)
_SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


#: Bytes of lower-case Latin letters and of signs: what the splitter makes one part each of, and what
#: normalising leaves as it is. (An apostrophe may begin a part of its own.) In UTF-8 a letter from
#: U+00DF on is 0xC3 and one of the bytes here; other bytes follow 0xC3 in no letter, and these follow
#: another first byte only in words that this byte makes odd.
_LETTERS = bytes([*range(ord("a"), ord("z") + 1), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)])
_SIGNS = b"!#$%&()*+,-./:;=?@[]^_{|}~"
_WHITE = b" \t\n\r\v\f"
_NO, _LETTER, _SIGN, _ODD = range(4)
_CLASS = bytes([_NO if b in _WHITE else _LETTER if b in _LETTERS else _SIGN if b in _SIGNS else _ODD for b in range(256)])


def _byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def _by_word(spec: dict) -> bool:
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    return (
        tuple(normalizer.get("normalizers", ())) == _NORMALIZERS
        and splitter.get("pretokenizers", [None])[0] == _SPLIT
        and splitter["pretokenizers"][1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        and not spec.get("post_processor")
        and not any(set(t["content"]) & set(" \t\n\r\v\f") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )


class Encoder:
    """texts -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = _by_word(spec)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        self.known_before: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        between = self.ids(_BETWEEN.decode())
        self.between = between[0] if len(between) == 1 else None

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.ids(t).tobytes() for t in texts]
        out: list[bytes] = []
        begin = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= GROUP_CHARS or i + 1 == len(texts):
                out += self._group(texts[begin : i + 1])
                begin, size = i + 1, 0
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        pieces, upto = _cut([_bytes(t) for t in texts])
        coded = pieces.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, ends, raw = ids.buffers()
        reach = [0, *np.frombuffer(ends, np.int64)[ids.offset + upto].tolist()]
        return [raw[a:b].to_pybytes() for a, b in pairwise(reach)]

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        known, before, tokenize = self.known, self.known_before, self.model.tokenize
        found = list(map(known.get, pieces))
        fresh, odd, upto = [], [], []
        new: list[int] = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = before.get(piece)
            if ids is not None:
                known[piece] = found[i] = ids
            elif piece.translate(None, _LETTERS) and piece.translate(None, _SIGNS):
                odd.append(i)
            else:  # what the library's splitter would hand to its model
                part = piece.decode() if piece.isascii() else "".join([_BYTE_LETTERS[b] for b in piece])
                new += [t.id for t in tokenize(part)]
                fresh.append(i)
                upto.append(4 * len(new))
        raw, begin = array("I", new).tobytes(), 0
        for i, end in zip(fresh, upto, strict=True):
            known[pieces[i]] = found[i] = raw[begin:end]
            begin = end
        if odd:
            self._learn([pieces[i] for i in odd])
            for i in odd:
                found[i] = known[pieces[i]]
        if len(known) > REMEMBERED:
            self.known, self.known_before = {}, known
        return found

    def _learn(self, words: list[bytes]) -> None:
        known = self.known
        alone = self.between is None
        together = [] if alone else [w for w in words if _BETWEEN not in w and not any(a in w for a in self.added)]
        for at in range(0, len(together), TOGETHER):
            part = together[at : at + TOGETHER]
            joined = (b" " + _BETWEEN + b" ").join(part).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) != len(part) - 1:
                continue
            raw, begin = ids.tobytes(), 0
            for word, cut in zip(part, [*(4 * cuts).tolist(), len(raw)], strict=True):
                known[word] = raw[begin:cut]
                begin = cut + 4
        for word in words:
            if word not in known:
                known[word] = self.ids(word.decode()).tobytes()


def _bytes(text: str) -> bytes:
    raw = text.encode()
    # lower case first means fewer distinct words; only where that changes neither a composed
    # letter nor a special token
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return raw
    return raw if b"<|" in raw else raw.lower()


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of texts one behind the other, and how many there are up to each text's end."""
    joined = b" ".join([b"", *texts, b""])
    asis, raw = np.frombuffer(joined, np.uint8), bytearray(joined.lower())
    low = np.frombuffer(raw, np.uint8)
    if b"\xc3" in raw:  # letters from U+00C0 to U+00DE, the multiplication sign is none
        second = np.flatnonzero(low == 0xC3) + 1
        second = second[(low[second] < 0x9F) & (low[second] != 0x97)]
        low[second] += 0x20
    kind = np.frombuffer(raw.translate(_CLASS), np.uint8)
    step = kind[:-1] << 2
    step |= kind[1:]
    inside = kind != _NO
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    first = np.zeros(len(low), bool)  # bytes that begin a piece
    np.equal(step, _LETTER << 2 | _SIGN, out=first[1:])
    odd = kind == _ODD
    odd[1:] |= step == _SIGN << 2 | _LETTER
    runs = np.flatnonzero(odd[1:] > odd[:-1]) + 1
    if len(runs):
        words = np.searchsorted(begins, runs, "right") - 1
        words = words[np.append(True, words[1:] != words[:-1])]
        size = ends[words] - begins[words]
        within = np.repeat(ends[words] - np.cumsum(size), size)  # then the bytes of these words
        within += np.arange(len(within))
        first[within] = False
        low[within] = asis[within]
    first[begins] = True
    at = np.flatnonzero(first)
    # without the white space: how much of it lies before each piece
    white = np.zeros(len(at), np.int64)
    white[~inside[at - 1]] = begins - np.append(0, ends[:-1])
    offsets = np.append(at - np.cumsum(white), len(low) - np.count_nonzero(~inside)).astype(np.int32)
    data = raw.translate(None, _WHITE)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pieces, np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))


_encoders: dict[str, Encoder] = {}
remembers("tokens", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    working("tokens")
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
