"""CRC-32C of many byte strings at once, in numpy."""

from __future__ import annotations

import struct

import numpy as np

_POLY = 0x82F63B78
_CHUNK = 256


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    return t


_T = _byte_table()


def _zeros(state: np.ndarray, n: int) -> np.ndarray:
    """The states after n more zero bytes."""
    for _ in range(n):
        state = _T[state & 0xFF] ^ (state >> 8)
    return state


def _halves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The effect of n zero bytes (n >= 4) on the low and the high half of a state."""
    half = np.arange(1 << 16, dtype=np.uint32)
    return _zeros(half, n), _zeros(half << np.uint32(16), n)


_STEP, _SHIFT = _halves(4), _halves(_CHUNK)


def _apply(halves: tuple[np.ndarray, np.ndarray], state: np.ndarray) -> np.ndarray:
    return halves[0][state & 0xFFFF] ^ halves[1][state >> 16]


def crc32c(items: list[bytes]) -> np.ndarray:
    """The CRC-32C of each item."""
    out = np.zeros(len(items), np.uint32)
    for i, item in enumerate(items):
        if len(item) < 4:
            state = 0xFFFFFFFF
            for b in item:
                state = int(_T[(state ^ b) & 0xFF]) ^ (state >> 8)
            out[i] = state ^ 0xFFFFFFFF
    at = np.array([i for i, item in enumerate(items) if len(item) >= 4], np.int64)
    if not len(at):
        return out
    # A start state of ones is the first four bytes inverted; zero bytes before a start state of zero change nothing.
    size = np.array([len(items[i]) for i in at])
    chunks = -(-size // _CHUNK)
    last = np.cumsum(chunks)
    data = np.zeros(int(last[-1]) * _CHUNK, np.uint8)
    for i, end in zip(at, last * _CHUNK, strict=True):
        item = items[i]
        data[end - len(item) : end] = np.frombuffer(item, np.uint8)
        data[end - len(item) : end - len(item) + 4] ^= 0xFF
    words = np.ascontiguousarray(data.view("<u4").reshape(-1, _CHUNK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for column in words:
        state = _apply(_STEP, state ^ column)
    order = np.argsort(-chunks, kind="stable")
    chunks, last = chunks[order], last[order]
    total = np.zeros(len(at), np.uint32)
    for left in range(int(chunks[0]), 0, -1):
        n = int(np.searchsorted(-chunks, -left, "right"))
        total[:n] = _apply(_SHIFT, total[:n]) ^ state[last[:n] - left]
    out[at[order]] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum that is safe to store beside data that holds checksums: rotated and shifted by a constant."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record: length (8 bytes), masked CRC of the length, payload, masked CRC of the payload."""
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    heads, tails = masked(crc32c(sizes)), masked(crc32c(payloads))
    return [b"".join((s, int(h).to_bytes(4, "little"), p, int(t).to_bytes(4, "little"))) for s, h, p, t in zip(sizes, heads, payloads, tails, strict=True)]


def unframe(data: bytes, offsets: list[int]) -> list[bytes]:
    """The payloads of the records that begin at the offsets; ValueError if a checksum doesn't hold."""
    sizes = [data[o : o + 8] for o in offsets]
    payloads = [data[o + 12 : o + 12 + struct.unpack("<Q", s)[0]] for o, s in zip(offsets, sizes, strict=True)]
    heads = [int.from_bytes(data[o + 8 : o + 12], "little") for o in offsets]
    tails = [int.from_bytes(data[o + 12 + len(p) : o + 16 + len(p)], "little") for o, p in zip(offsets, payloads, strict=True)]
    if heads != masked(crc32c(sizes)).tolist() or tails != masked(crc32c(payloads)).tolist():
        raise ValueError("a record's checksum does not match its bytes")
    return payloads
