"""Old binary spreadsheets (BIFF8 in a compound document), read from their published record layout: values only.

Numbers are as stored, so dates are day numbers; text is that of the shared table or of the cell; errors are empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: Numbers of records.
BOF, EOF, CONTINUE, BOUNDSHEET, SST = 0x0809, 0x000A, 0x003C, 0x0085, 0x00FC
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207
_END = 0xFFFFFFFE


class NotAWorkbook(Exception):
    pass


def stream_of(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A named stream of a compound document."""
    if len(data) < 512 or data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise NotAWorkbook
    sector, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, cutoff, first_mini, first_more = (struct.unpack_from("<I", data, i)[0] for i in (44, 48, 56, 60, 68))
    at = lambda s: data[(s + 1) * sector : (s + 2) * sector]
    places, more = list(struct.unpack_from("<109I", data, 76)), first_more
    while more < _END and len(places) < n_fat + 200:
        block = struct.unpack(f"<{sector // 4}I", at(more))
        places += block[:-1]
        more = block[-1]
    fat = [x for p in places[: max(n_fat, 0)] if p < _END for x in struct.unpack(f"<{sector // 4}I", at(p).ljust(sector, b"\xff"))]

    def chain(start: int, table: list[int], piece) -> bytes:
        out, seen = [], 0
        while start < _END and start < len(table) and seen <= len(table):
            out.append(piece(start))
            start, seen = table[start], seen + 1
        return b"".join(out)

    directory = chain(first_dir, fat, at)
    entries = []
    for lo in range(0, len(directory) - 127, 128):
        e = directory[lo : lo + 128]
        entries.append((e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "ignore"), *struct.unpack_from("<II", e, 116)))
    if not entries:
        raise NotAWorkbook
    for name, start, size in entries:
        if name in names:
            if size >= cutoff:
                return chain(start, fat, at)[:size]
            small = chain(first_mini, fat, at)
            mini_fat = list(struct.unpack(f"<{len(small) // 4}I", small[: len(small) // 4 * 4]))
            holder = chain(entries[0][1], fat, at)
            return chain(start, mini_fat, lambda s: holder[s * mini : (s + 1) * mini])[:size]
    raise NotAWorkbook


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """Each record from a place on: its number and its pieces (its own, then those of the records that continue it)."""
    held: tuple[int, list[bytes]] | None = None
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
    if held:
        yield held


class Text:
    """Reads strings that may run over from a piece to the next, where a new byte says how wide characters go on."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.piece, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.piece < len(self.pieces):
            part = self.pieces[self.piece][self.at : self.at + n - len(out)]
            out += part
            self.at += len(part)
            if self.at >= len(self.pieces[self.piece]) and len(out) < n:
                self.piece, self.at = self.piece + 1, 0
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while n:
            if self.at >= len(self.pieces[self.piece]):
                self.piece, self.at = self.piece + 1, 0
                if self.piece >= len(self.pieces):
                    break
                wide = self.take(1)[0] & 1
            left = (len(self.pieces[self.piece]) - self.at) // (2 if wide else 1)
            some = min(n, left) or 1
            raw = self.take(some * (2 if wide else 1))
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= some
        self.take(4 * runs + extra)
        return "".join(out)


def compressed_number(raw: int) -> float:
    """A number in 32 bits: an integer of 30 bits or the upper bits of a double, perhaps times 100."""
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def cells_of(stream: bytes, at: int, shared: list[str]) -> Iterator[tuple[int, int, object]]:
    """Row, column and value of each cell of the sheet that begins there."""
    pending = None
    for kind, pieces in records(stream, at):
        body = pieces[0]
        if kind == EOF:
            return
        if kind == STRING and pending:
            yield *pending, Text(pieces).string()
            pending = None
        elif kind in (LABELSST, NUMBER, RK, BOOLERR, FORMULA, LABEL):
            row, col = struct.unpack_from("<HH", body)
            if kind == LABELSST:
                i = struct.unpack_from("<I", body, 6)[0]
                yield row, col, shared[i] if i < len(shared) else ""
            elif kind == NUMBER:
                yield row, col, struct.unpack_from("<d", body, 6)[0]
            elif kind == RK:
                yield row, col, compressed_number(struct.unpack_from("<I", body, 6)[0])
            elif kind == BOOLERR:
                yield row, col, "" if body[7] else int(body[6])
            elif kind == LABEL:
                yield row, col, Text([body[6:], *pieces[1:]]).string()
            elif body[12:14] == b"\xff\xff" and body[6] in (0, 1, 2, 3):  # a result that is no number: text that follows, a truth value, an error, nothing
                pending = (row, col) if body[6] == 0 else None
                if body[6] == 1:
                    yield row, col, int(body[8])
            else:
                yield row, col, struct.unpack_from("<d", body, 6)[0]
        elif kind == MULRK:
            row, col = struct.unpack_from("<HH", body)
            for i in range((len(body) - 6) // 6):
                yield row, col + i, compressed_number(struct.unpack_from("<I", body, 6 + 6 * i)[0])


def sheets_of(data: bytes) -> Iterator[tuple[str, Iterator[list]]]:
    """Each worksheet's name and rows. A sheet holds 65,536 rows at most."""
    try:
        stream = stream_of(data)
        places, shared = [], []
        for kind, pieces in records(stream):
            if kind == BOUNDSHEET:
                place, _, sort = struct.unpack_from("<IBB", pieces[0])
                n, wide = pieces[0][6], pieces[0][7] & 1
                name = pieces[0][8 : 8 + n * (2 if wide else 1)].decode("utf-16-le" if wide else "latin-1")
                if sort == 0:
                    places.append((name, place))
            elif kind == SST:
                n = struct.unpack_from("<I", pieces[0], 4)[0]
                text = Text([pieces[0][8:], *pieces[1:]])
                shared = [text.string() for _ in range(n)]
            elif kind == EOF:
                break
    except (struct.error, IndexError, UnicodeDecodeError) as e:
        raise NotAWorkbook from e
    for name, place in places:
        rows: dict[int, dict[int, object]] = {}
        for r, c, v in cells_of(stream, place, shared):
            rows.setdefault(r, {})[c] = v
        width = max((max(r) for r in rows.values()), default=-1) + 1
        yield name, ([rows.get(i, {}).get(c, "") for c in range(width)] for i in range(max(rows, default=-1) + 1))
