"""Opening PDF files that are encrypted under the empty user password, by RC4 or AES with 128 bits."""

from __future__ import annotations

import hashlib
import struct
from typing import Any

_PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for k, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[k] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """The product in the field of 256 elements that AES uses."""
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    box = []
    for x in range(256):
        y = next((k for k in range(256) if _times(x, k) == 1), 0) if x else 0
        box.append(0x63 ^ y ^ (y << 1 | y >> 7) & 255 ^ (y << 2 | y >> 6) & 255 ^ (y << 3 | y >> 5) & 255 ^ (y << 4 | y >> 4) & 255)
    back = [0] * 256
    for x, y in enumerate(box):
        back[y] = x
    return box, back


_TABLES: list = []


def _tables() -> list:
    if not _TABLES:
        box, back = _boxes()
        _TABLES.extend([box, back, [[_times(x, k) for x in range(256)] for k in (14, 11, 13, 9)]])
    return _TABLES


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """The text of whole blocks behind the first, which starts the chain; the padding is taken off."""
    box, back, (m14, m11, m13, m9) = _tables()
    n = len(key) // 4
    rounds = n + 6
    words, mark = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
    for k in range(n, 4 * rounds + 4):
        w = list(words[-1])
        if k % n == 0:
            w = [box[x] for x in w[1:] + w[:1]]
            w[0] ^= mark
            mark = _times(mark, 2)
        elif n > 6 and k % n == 4:
            w = [box[x] for x in w]
        words.append([a ^ b for a, b in zip(w, words[k - n])])
    keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(rounds + 1)]
    order = [0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3]
    out, chain = bytearray(), data[:16]
    for at in range(16, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, keys[rounds])]
        for r in range(rounds - 1, -1, -1):
            s = [back[s[k]] ^ key_byte for k, key_byte in zip(order, keys[r])]
            if r:
                s = [
                    m14[a] ^ m11[b] ^ m13[c] ^ m9[d]
                    for q in range(0, 16, 4)
                    for a, b, c, d in (s[q : q + 4], s[q + 1 : q + 4] + s[q : q + 1], s[q + 2 : q + 4] + s[q : q + 2], s[q + 3 : q + 4] + s[q : q + 3])
                ]
        out += bytes(a ^ b for a, b in zip(s, chain))
        chain = block
    return bytes(out[: len(out) - out[-1]]) if out and out[-1] <= 16 else bytes(out)


class Cipher:
    """Of a file's Encrypt entry, with values already looked up; first_id is the first part of the file's ID."""

    def __init__(self, about: dict[str, Any], first_id: bytes) -> None:
        version, revision = about.get("V") or 0, about.get("R") or 0
        if about.get("Filter") != "Standard" or version not in (1, 2, 4) or revision not in (2, 3, 4):
            raise ValueError("this encryption is not read")
        self.method, bits = "V2", about.get("Length") or 40
        if version == 4:
            filters = about.get("CF") or {}
            self.method = (filters.get(about.get("StmF") or "Identity") or {}).get("CFM") or "None"
            bits = 128
        size = 5 if revision == 2 else bits // 8
        seed = _PAD + about["O"][:32] + struct.pack("<I", int(about["P"]) & 0xFFFFFFFF) + first_id
        if revision == 4 and about.get("EncryptMetadata") is False:
            seed += b"\xff" * 4
        key = hashlib.md5(seed).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if revision == 2:
            known, seen = rc4(self.key, _PAD), about["U"][:32]
        else:
            known = hashlib.md5(_PAD + first_id).digest()
            for k in range(20):
                known = rc4(bytes(x ^ k for x in self.key), known)
            seen = about["U"][:16]
        if known != seen:
            raise ValueError("the file has a password")

    def opened(self, data: bytes, number: int, generation: int) -> bytes:
        """A string or stream of an object."""
        if self.method not in ("V2", "AESV2"):
            return data
        seed = self.key + struct.pack("<I", number)[:3] + struct.pack("<H", generation) + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc(key, data) if self.method == "AESV2" else rc4(key, data)
