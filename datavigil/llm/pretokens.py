"""Pre-tokens of whole texts, byte-pair merges of one pre-token, and compact id lists. Shared by operators 1 and 6."""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from datavigil.llm import arrays as A

_SHORT = 96


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes, from a file with lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > _SHORT:
        return _merge_long(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (least := min(pairs)) < _NONE:
        i = pairs.index(least)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return [ranks[p] for p in parts]


_NONE = 1 << 60


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over linked places, for pre-tokens of any length."""
    n = len(piece)
    stop = list(range(1, n + 1))  # where the part that begins here ends; 0 once it has been merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if stop[i] != mid or mid >= n or stop[mid] != end:
            continue  # one of the two parts has changed since
        stop[i], stop[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i:stop[end]])) is not None:
                heapq.heappush(heap, (r, i, end, stop[end]))
        if (j := before[i]) >= 0 and (r := ranks.get(piece[j:end])) is not None:
            heapq.heappush(heap, (r, j, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:stop[i]]])
        i = stop[i]
    return out


#: Kinds of bytes: white space, letter, digit, other mark, apostrophe, and those that only the pattern can judge.
_WHITE, _LETTER, _DIGIT, _MARK, _QUOTE, _OTHER = range(6)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _WHITE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[range(0x30, 0x3A)] = _DIGIT
_KIND[0x27] = _QUOTE
_KIND[[*range(0x1C, 0x20), *range(0x80, 0x100)]] = _OTHER
# A pre-token surely ends between two bytes of these kinds. White space may belong to what follows, an apostrophe too.
_ENDS = np.zeros((6, 6), bool)
_ENDS[_LETTER, [_WHITE, _DIGIT, _MARK, _QUOTE]] = True
_ENDS[_DIGIT, [_WHITE, _LETTER, _MARK, _QUOTE]] = True
_ENDS[_MARK, [_WHITE, _LETTER, _DIGIT]] = True
_ENDS[_QUOTE, _WHITE] = True
_ENDS = _ENDS.ravel()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[range(0x41, 0x5B)] += 32


def _ends_white(chars: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether the character that is not ASCII and ends before each stop is white space."""
    one, two, three = (chars[np.maximum(stops - k, 0)] for k in (1, 2, 3))
    short = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (three == 0xE2) & (((two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))) | ((two == 0x81) & (one == 0x9F)))
    far = ((three == 0xE1) & (two == 0x9A) & (one == 0x80)) | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    return short | general | far | (one < 0x80)


def segments(texts: pa.Array, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct segments of the texts, each text's segments as their numbers one after the other, and where each text's
    begin. A segment is one pre-token or a few; where only the pattern can tell, nothing is cut. With lower A-Z are lower-cased.

    It holds for patterns in which runs of letters, digits and other marks are pre-tokens of their own, with the space before
    them or without, and white space stays with what follows it.
    """
    data, offsets = A.byte_view(texts)
    chars, bounds = data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]
    n = len(chars)
    if not n:
        return [], np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
    kind = _KIND[chars]
    cut = np.ones(n + 1, bool)
    np.take(_ENDS, kind[:-1] * np.uint8(6) + kind[1:], out=cut[1:-1])
    unsure = np.flatnonzero((kind[:-1] == _OTHER) & (kind[1:] == _WHITE)) + 1
    if len(unsure):
        cut[unsure] = ~_ends_white(chars, unsure)
    return _coded(chars, cut, bounds, lower)


def runs(texts: pa.Array, inside: np.ndarray, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same for runs of bytes that are alike in `inside`, which must be alike for all bytes from 0x80 on."""
    data, offsets = A.byte_view(texts)
    chars, bounds = data[int(offsets[0]):int(offsets[-1])], offsets - offsets[0]
    if not len(chars):
        return [], np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
    own, cut = inside[chars], np.ones(len(chars) + 1, bool)
    np.not_equal(own[1:], own[:-1], out=cut[1:-1])
    return _coded(chars, cut, bounds, lower)


def _coded(chars: np.ndarray, cut: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    cut[bounds] = True
    starts = np.flatnonzero(cut).astype(np.int32)
    chars = _LOWER[chars] if lower else np.ascontiguousarray(chars)
    coded = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(chars)]).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(starts, bounds)


class Block:
    """Texts as lists of numbers of distinct pre-tokens.

    Texts are cut into segments, and only distinct segments meet the pattern. Without a pattern the segments themselves are
    the words, without the ASCII white space around them; with lower A-Z are lower-cased.
    """

    def __init__(self, pattern: str | None, lower: bool = False):
        self.find = regex.compile(pattern).findall if pattern is not None else None
        self.lower = lower
        self.texts: list[pa.Array] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        self.extend(pa.array([text], pa.string()))

    def extend(self, texts: pa.Array) -> None:
        """A null counts as empty."""
        self.texts.append(texts)
        self.size += A.text_bytes(texts) + 64 * len(texts)

    def close(self) -> tuple[list[str], list[np.ndarray]]:
        """The distinct pre-tokens, most frequent first, and each text as their numbers."""
        words, numbers, bounds = self.numbered()
        return words, [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def numbered(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same, with the numbers of all texts one after the other and where each text's begin."""
        if not self.texts:
            return [], np.empty(0, np.int32), np.zeros(1, np.int64)
        cuts, codes, bounds = segments(pa.concat_arrays(self.texts), self.lower)
        if self.find is None:
            trimmed = pc.utf8_trim(pa.array(cuts, pa.string()), " \t\n\v\f\r")
            coded = trimmed.dictionary_encode()
            words, lengths = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), pc.binary_length(trimmed).to_numpy() > 0
            flat, lengths = coded.indices.to_numpy(), lengths.astype(np.int64)
            if "" in words:  # white space alone is no word
                none = words.index("")
                del words[none]
                flat = np.where(flat > none, flat - 1, flat)
            flat = flat[lengths > 0].astype(np.int32)
        else:
            words, flat, lengths = self._found(cuts)
        weight = np.bincount(codes, minlength=len(cuts))
        counts = np.bincount(flat, np.repeat(weight, lengths), minlength=len(words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        flat = rank[flat]
        sizes = lengths[codes]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        starts = np.cumsum(lengths) - lengths
        return [words[i] for i in order], flat[A.ragged(starts[codes], sizes)], ends[bounds]

    def _found(self, cuts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct pre-tokens of the segments, those of each segment as their numbers, and how many each has."""
        number: dict[str, int] = {}
        flat, lengths = array("i"), array("q", [1]) * len(cuts)
        whole = self.find(" az") == [" az"] and self.find("az") == ["az"]  # letters, with a space or without, are one pre-token
        for i, cut in enumerate(cuts):
            if whole and cut.isascii() and (cut.isalpha() or cut[0] == " " and cut[1:].isalpha()):
                flat.append(number.setdefault(cut, len(number)))
                continue
            found = self.find(cut)
            lengths[i] = len(found)
            for word in found:
                flat.append(number.setdefault(word, len(number)))
        return list(number), np.array(flat, np.int32), np.array(lengths, np.int64)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers below 2^28 in groups of seven bits, low ones first; all bytes but a number's last have the high bit."""
    return pack_ragged(numbers, np.array([0, len(numbers)]))[0].tobytes()


def pack_ragged(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed bytes of several lists one after the other, and where each list's begin."""
    v = numbers.astype(np.uint32)
    size = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    ends = np.concatenate(([0], np.cumsum(size)))
    starts = ends[:-1]
    out = np.empty(int(ends[-1]), np.uint8)
    for k in range(4):
        own = size > k
        if not own.any():
            break
        out[starts[own] + k] = ((v[own] >> np.uint32(7 * k)) & np.uint32(127)) | np.where(size[own] > k + 1, 128, 0).astype(np.uint32)
    return out, ends[bounds]


def unpack_ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the packed lists of a binary column one after the other, and where each list's begin."""
    data, offsets = A.byte_view(column)
    own = data[int(offsets[0]):int(offsets[-1])]
    ends = np.concatenate(([0], np.cumsum(own < 128)))
    return unpack_numbers(own), ends[offsets - offsets[0]]


def unpack_numbers(data: bytes | np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    out = (b[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        more = starts + k <= ends
        if not more.any():
            break
        out[more] |= (b[starts[more] + k] & 127).astype(np.int64) << (7 * k)
    return out
