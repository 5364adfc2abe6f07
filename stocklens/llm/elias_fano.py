"""Elias-Fano sequences in files that tasks map into memory."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_COUNT = np.arange(1 << 20)
SKIP = 64  # one of so many values is also kept plain; the values between two of them are a block


def pack(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Sections of a monotone sequence of unsigned numbers: low bits, in whole bytes, high bits in unary, skips.

    Low parts have so many bytes that nearly all blocks rise by less than they hold; a value of such a block is
    known from its low part and the skip before it.
    """
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = next(w for w in (1, 2, 4, 8) if w == 8 or (top // max(n, 1)).bit_length() + 10 <= 8 * w)  # bytes of a low part
    high = np.zeros((top >> 8 * width) + n + 1, bool)
    high[((values >> np.uint64(8 * width)) + np.arange(n, dtype=np.uint64)).astype(np.int64)] = True
    return {f"{name}_low": values.astype(f"<u{width}"), f"{name}_high": np.packbits(high, bitorder="little"),
            f"{name}_skip": np.append(values[::SKIP], np.uint64(top))}


class EliasFano:
    """Reads a sequence that ``pack`` made: single values wherever they stand, or runs of blocks that are decoded."""

    def __init__(self, sections: dict[str, np.ndarray], name: str):
        self.low, self.high, self.skip = (sections[f"{name}_{x}"] for x in ("low", "high", "skip"))
        self.size, self.width = len(self.low), self.low.itemsize

    def decode(self, block: int, end_block: int) -> np.ndarray:
        """Values of a run of blocks of SKIP values."""
        a, b = block * SKIP, min(end_block * SKIP, self.size)
        shift = np.uint64(8 * self.width)
        start = int(self.skip[block] >> shift) + a
        stop = int(self.skip[end_block] >> shift) + b if b < self.size else len(self.high) * 8 - 1
        bits = np.unpackbits(self.high[start >> 3:(stop >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits.view(bool))
        skip = int(np.count_nonzero(bits[:start & 7]))
        ones = ones[skip:skip + b - a]
        ones += ((start >> 3) << 3) - a
        ones -= _COUNT[:b - a] if b - a <= len(_COUNT) else np.arange(b - a)
        out = ones.view(np.uint64)
        out <<= shift
        out |= self.low[a:b]
        return out

    def _wide(self, blocks: np.ndarray) -> np.ndarray:
        """Places in ``blocks`` of those that rise by more than a low part holds."""
        return np.flatnonzero((self.skip[blocks + 1] - self.skip[blocks]) >> np.uint64(8 * self.width))

    def _runs(self, blocks: np.ndarray):
        """Runs of neighbouring blocks (gaps of a few are decoded as well) and the queries that fall into them."""
        if not len(blocks):
            return
        cuts = [0, *(np.flatnonzero(np.diff(blocks) > 64) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:]):
            yield slice(a, b), int(blocks[a]), int(blocks[b - 1]) + 1

    def at(self, places: np.ndarray) -> np.ndarray:
        """Values at ascending places."""
        blocks = places // SKIP
        out = self.skip[blocks] + (self.low[places] - self.low[blocks * SKIP])
        wide = self._wide(blocks)
        for run, first, last in self._runs(blocks[wide]):
            out[wide[run]] = self.decode(first, last)[places[wide[run]] - first * SKIP]
        return out

    def successor(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending numbers: the place of the first value that is not smaller, and whether it is equal."""
        if not self.size or not len(wanted):
            return np.full(len(wanted), self.size, np.int64), np.zeros(len(wanted), bool)
        begin, beyond = np.searchsorted(wanted, self.skip[0], "right"), np.searchsorted(wanted, self.skip[-1], "right")
        place, equal = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        equal[:begin] = wanted[:begin] == self.skip[0]
        place[beyond:] = self.size
        if begin < beyond:
            place[begin:beyond], equal[begin:beyond] = self._inside(wanted[begin:beyond])
        return place, equal

    def _inside(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``successor`` of numbers above the first value and not above the last."""
        blocks = np.searchsorted(self.skip[:-1], wanted, "left") - 1
        rise = (wanted - self.skip[blocks]).astype(self.low.dtype)
        place = blocks * SKIP
        before = self.low[place]
        step = SKIP // 2
        place += 1  # the first value of the block is smaller
        while step:
            probe = place + (step - 1)
            place += step * (self.low[np.minimum(probe, self.size - 1, out=probe)] - before < rise)
            step //= 2
        np.minimum(place, self.size - 1, out=place)
        equal = self.low[place] - before == rise
        wide = self._wide(blocks)
        for run, first, last in self._runs(blocks[wide]):
            values, asked = self.decode(first, last), wanted[wide[run]]
            at = np.searchsorted(values, asked, "left")
            place[wide[run]] = at + first * SKIP
            # the next block begins with the successor if this run has none
            after = np.append(values, self.skip[last])
            equal[wide[run]] = after[at] == asked
        return place, equal


def write_sections(path: str, sections: dict[str, np.ndarray]) -> None:
    """One file of several arrays. It appears whole under its name, so a task that is run again does no harm."""
    head, at = {}, 0
    for name, x in sections.items():
        head[name] = [x.dtype.str, x.shape, at]
        at += -(-x.nbytes // 8) * 8
    text = json.dumps(head).encode()
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text + b" " * (-len(text) % 8))
        for x in sections.values():
            f.write(np.ascontiguousarray(x).tobytes() + b"\0" * (-x.nbytes % 8))
    os.replace(part, path)


def map_sections(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(size))
    whole, base = np.memmap(path, np.uint8, "r").view(np.ndarray), 8 + size + -size % 8  # one mapping for all
    out = {}
    for name, (kind, shape, at) in head.items():
        if 0 in shape:
            out[name] = np.empty(shape, np.dtype(kind))
        else:
            kind = np.dtype(kind)
            out[name] = whole[base + at:base + at + kind.itemsize * int(np.prod(shape))].view(kind).reshape(shape)
    return out
