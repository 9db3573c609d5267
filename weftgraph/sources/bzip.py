"""bzip2 files in byte ranges: blocks are found by their 48-bit marks, at any bit, and each is decoded by itself.

A block belongs to the range in which its mark begins. It is decoded by putting it between a file header and a footer of its
own. A mark that is only by chance in the data is told by the block's checksum: what doesn't decode up to the next mark is
tried up to the one after, and what never does isn't a block.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

#: Marks of a block and of the end of a stream.
BLOCK, END = 0x314159265359, 0x177245385090
#: Compressed bytes that a block takes at most, with room to spare; bytes that are read at once.
MOST, CHUNK = 2 << 20, 1 << 20


def _needles(mark: int) -> list[tuple[int, int, bytes, int]]:
    """For each bit shift: (head mask, head, five whole bytes, tail) of the mark, which begins `shift` bits into a byte."""
    out = []
    for shift in range(8):
        seven = (mark << (8 - shift)).to_bytes(7, "big")
        out.append((0xFF >> shift, seven[0], seven[1:6], seven[6]))
    return out


_NEEDLES = {mark: _needles(mark) for mark in (BLOCK, END)}


def _marks(data: bytes, base: int) -> list[tuple[int, int]]:
    """(bit, mark) of all marks that lie whole in data, whose first byte is byte `base` of the file."""
    out = []
    for mark, needles in _NEEDLES.items():
        for shift, (mask, head, middle, tail) in enumerate(needles):
            at = data.find(middle, 1)
            while at >= 0:
                last = data[at + 5 : at + 6]
                if data[at - 1] & mask == head and (shift == 0 or last and last[0] & (0xFF << (8 - shift)) & 0xFF == tail):
                    out.append((8 * (base + at - 1) + shift, mark))
                at = data.find(middle, at + 1)
    return sorted(out)


def _decoded(data: bytes, start: int, stop: int) -> bytes | None:
    """The block in bits start to stop of data, or None if it isn't one."""
    n = stop - start
    bits = int.from_bytes(data[start // 8 : -(-stop // 8)], "big") >> (-stop % 8) & ((1 << n) - 1)
    crc = bits >> (n - 80) & 0xFFFFFFFF
    whole = bits << 80 | END << 32 | crc
    try:
        return bz2.decompress(b"BZh9" + (whole << (-(n + 80) % 8)).to_bytes(-(-(n + 80) // 8), "big"))
    except (OSError, ValueError):
        return None


class _Window:
    """A stretch of the file with the marks in it; grows at its end and shrinks at its start."""

    def __init__(self, raw, start: int):
        self.raw, self.base, self.data, self.over, self.marks = raw, start, b"", False, []
        raw.seek(start)

    def more(self) -> None:
        chunk = self.raw.read(CHUNK)
        self.over = not chunk
        known = max(0, len(self.data) - 7)
        self.data += chunk
        seen = {bit for bit, _ in self.marks}
        self.marks += [m for m in _marks(self.data[known:], self.base + known) if m[0] not in seen]

    def forget(self, bit: int) -> None:
        """What lies before this bit isn't needed any more."""
        cut = max(0, bit // 8 - self.base)
        if cut > CHUNK:
            self.data, self.base = self.data[cut:], self.base + cut
            self.marks = [m for m in self.marks if m[0] >= bit]


def blocks(raw, start: int, stop: int | None) -> Iterator[tuple[bool, bytes]]:
    """(whether its mark begins in bytes [start, stop), decoded bytes) of the blocks from `start` on to the file's end."""
    window, bit = _Window(raw, start), 8 * start
    while True:
        while not (found := next((m for m in window.marks if m[0] >= bit and m[1] == BLOCK), None)) and not window.over:
            if not window.marks:
                window.forget(8 * (window.base + len(window.data) - 8))
            window.more()
        if not found:
            return
        window.forget(found[0])
        out = None
        while out is None:
            for end in (m[0] for m in window.marks if m[0] >= found[0] + 80):
                out = _decoded(window.data, found[0] - 8 * window.base, end - 8 * window.base)
                if out is not None:
                    break
            if out is not None or window.over or len(window.data) - (found[0] // 8 - window.base) > MOST:
                break
            window.more()
        if out is None:
            bit = found[0] + 1
        else:
            yield stop is None or found[0] < 8 * stop, out
            bit = end


class BlockStream:
    """The decoded blocks of a byte range and, where its last record goes on, of what follows. `limit` is the number of bytes
    from blocks of the range, once all of them were read; until then there is none."""

    def __init__(self, raw, start: int, stop: int | None):
        self.blocks, self.size, self.limit = blocks(raw, start, stop), 0, None

    def read(self, _: int) -> bytes:
        for own, block in self.blocks:
            if not own and self.limit is None:
                self.limit = self.size
                if not self.size:
                    return b""
            self.size += len(block)
            if block:
                return block
        if self.limit is None:
            self.limit = self.size
        return b""
