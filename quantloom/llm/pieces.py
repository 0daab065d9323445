"""SentencePiece BPE encoding with spans of the original text, and decoding.

The text is normalised by the longest prefix in the model's compiled character map; every
normalised byte keeps the place of the original byte it came from. The normalised text is cut
in chunks that no piece can cross, the library merges each new chunk once (by a copy of the
model that normalises nothing any more), and every piece is projected back through the alignment.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_BPE = 2  # model_type of the public model format
_GROUP_CHARS = 500_000  # texts of about so many characters are encoded together
# Normaliser of the copy: no map, no added and no removed spaces, spaces shown as marks.
_IDENTITY = bytes([0x0A, 8]) + b"identity" + bytes([0x18, 0, 0x20, 0, 0x28, 1])


def wire_fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: numbers and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, blob[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, blob[at : at + size]
            at += size


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


class CharMap:
    """The compiled character map: a double-array trie over byte strings and its targets."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.targets = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Target and length of the longest key at a place of the text."""
        units = self.units
        if not units:
            return None
        found = None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start = found[0]
        return self.targets[start : self.targets.index(b"\0", start)], found[1]


class PieceModel:
    """A SentencePiece BPE model as plain tables."""

    def __init__(self, path: str, cache: int = 300_000):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = list(wire_fields(self.library.serialized_model_proto()))
        trainer = dict(wire_fields(b"".join(v for k, v in model if k == 2)))
        rules = dict(wire_fields(b"".join(v for k, v in model if k == 3)))
        if trainer.get(3, 1) != _BPE:
            raise ValueError("Only BPE models are supported")
        self.char_map = CharMap(rules.get(2, b""))
        self.dummy_prefix, self.strip = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.escape, self.suffix = bool(rules.get(5, 1)), bool(trainer.get(24, 0))
        bare = [_field(k, v) for k, v in model if k != 3 and isinstance(v, bytes)]
        lib = self.merger = sentencepiece.SentencePieceProcessor(model_proto=b"".join([*bare, _field(3, _IDENTITY)]))
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        own = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if not self.escape or any(SPACE in names[i].lstrip(SPACE) for i in own):
            raise ValueError("Models whose pieces span several words are not supported")
        self.byte_of = np.full(size, -1)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_of[i] = int(names[i][3:5], 16)
        self.width = np.array([len(n.encode()) for n in names])
        self.unk = lib.unk_id()
        # No piece has a space after another character, and characters that are in no longer
        # piece never merge: no merge crosses a cut before a run of spaces or around a line end.
        alone = "" if any("\n" in names[i] and len(names[i]) > 1 for i in own) else "\n"
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else "")).findall
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for every byte of it and its end, the original byte it came from."""
        raw = text.encode()
        if not self.char_map.units and not self.strip:
            if not raw:
                return "", np.zeros(1, np.int64)
            prefix = int(self.dummy_prefix)
            sizes = np.where(np.frombuffer(raw, np.uint8) == 32, 3, 1)
            body = np.repeat(np.arange(len(raw)), sizes)
            pads = np.zeros(3 * prefix, np.int64), np.full(3 * prefix, len(raw))
            marked = text.replace(" ", SPACE)
            whole = marked + SPACE * prefix if self.suffix else SPACE * prefix + marked
            parts = [body, pads[1]] if self.suffix else [pads[0], body]
            return whole, np.concatenate([*parts, [len(raw)]])
        return self._normalise_mapped(raw)

    def _normalise_mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        def prefix(at: int) -> tuple[bytes, int]:
            hit = self.char_map.longest(raw, at)
            if hit is not None:
                return hit
            size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            return raw[at : at + size], size

        at = 0
        while self.strip and at < len(raw):
            made, size = prefix(at)
            if made != b" ":
                break
            at += size
        if at >= len(raw):
            return "", np.zeros(1, np.int64)
        out, align = bytearray(), []

        def put(made: bytes) -> None:
            made = made.replace(b" ", _SPACE_BYTES)
            out.extend(made)
            align.extend([at] * len(made))

        if self.dummy_prefix and not self.suffix:
            put(b" ")
        after_space = self.strip
        while at < len(raw):
            made, size = prefix(at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                put(made)
                after_space = made.endswith(b" ")
            after_space = after_space and self.strip
            at += size
        end = at
        while self.strip and out.endswith(_SPACE_BYTES):
            end = align[-3]
            del out[-3:], align[-3:]
        at = end
        if self.dummy_prefix and self.suffix:
            put(b" ")
        return out.decode(), np.array([*align, end], np.int64)

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each id covers; of a character in bytes the last has all."""
        sizes = self.width[ids]
        raw = self.byte_of[ids]
        spelled = raw >= 0
        if spelled.any():
            goes_on = np.concatenate(((raw[1:] & 0xC0 == 0x80) & spelled[1:], [False]))
            lead = np.where(raw < 0x80, 1, np.where(raw < 0xE0, 2, np.where(raw < 0xF0, 3, 4)))
            begins = np.maximum.accumulate(np.where(spelled & (raw & 0xC0 != 0x80), np.arange(len(raw)), 0))
            sizes = np.where(spelled, np.where(goes_on, 0, lead[begins]), sizes)
        return sizes

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and the first and last-plus-one original byte of each id."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= _GROUP_CHARS:
                yield from self._encode_group(some)
                some, size = [], 0
        yield from self._encode_group(some)

    def _encode_group(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        known = self.known
        ready = [(marked, self.cut(marked), align) for marked, align in map(self.normalise, texts)]
        every = set().union(*[chunks for _, chunks, _ in ready])
        new = every.difference(known)
        if len(known) + len(new) > self.cache:
            known.clear()
            new = every
        new = list(new)
        known.update(zip(new, [array("I", x).tobytes() for x in self.merger.encode(new, num_threads=1)], strict=True))
        for marked, chunks, align in ready:
            ids = np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4")
            if (ids == self.unk).any():  # neighbouring unknown characters are one piece
                found = self.merger.encode(marked, return_type="proto").pieces
                yield np.array([p.id for p in found], "<u4"), align[[p.begin for p in found]], align[[p.end for p in found]]
                continue
            ends = np.cumsum(self._sizes(ids))
            starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[: len(ids)]
            yield ids, align[starts], align[ends]
        for chunk in new:
            if len(chunk) > 64 or len(known) > self.cache:
                del known[chunk]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return list(self.encode_batch([text]))[0]


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def pieces(text: Column, path: str, add_ends: bool = True) -> Column:
    """Struct per text: ``ids``, ``starts``, ``stops`` (arrays) and ``decoded``.

    ``add_ends`` puts the begin and end ids, with empty spans, around. ``starts`` and
    ``stops`` are byte offsets in the UTF-8 text; of a character that falls back to bytes the
    last id holds the span. A null text counts as empty. ``path`` must be readable on all nodes.
    """
    return _pieces(text, path, add_ends, packed=False)


def packed_pieces(text: Column, path: str, add_ends: bool = True) -> Column:
    """As ``pieces``, with ``ids``, ``starts`` and ``stops`` as little-endian 32-bit words in binary."""
    return _pieces(text, path, add_ends, packed=True)


def _pieces(text: Column, path: str, add_ends: bool, packed: bool) -> Column:
    kind, inner = ("binary", pa.binary()) if packed else ("array<int>", pa.list_(pa.int32()))
    arrow = pa.struct([("ids", inner), ("starts", inner), ("stops", inner), ("decoded", pa.string())])
    give = (lambda a: a.astype("<u4").tobytes()) if packed else (lambda a: a.astype(np.int32))

    @F.arrow_udf(f"struct<ids:{kind},starts:{kind},stops:{kind},decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        begin, end = [model.library.bos_id()] * add_ends, [model.library.eos_id()] * add_ends
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            texts = [t or "" for t in batch.to_pylist()]
            for text, (ids, starts, stops) in zip(texts, model.encode_batch(texts), strict=True):
                if add_ends:
                    size = len(text.encode())
                    ids = np.concatenate((begin, ids, end))
                    starts, stops = np.concatenate(([0], starts, [size])), np.concatenate(([0], stops, [size]))
                rows[0].append(give(ids))
                rows[1].append(give(starts))
                rows[2].append(give(stops))
                rows[3].append(model.library.decode(ids.astype(np.int64).tolist()))
            yield pa.StructArray.from_arrays([pa.array(r, f.type) for r, f in zip(rows, arrow, strict=True)], fields=list(arrow))

    return run(text)
