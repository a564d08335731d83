"""The standard security handler of PDF files, for files that open with an empty password: RC4 and AES, revisions 2 to 6.

AES decryption of a stream is done for all blocks at once, as CBC allows; only the hash of revision 6 encrypts, block
after block. Tables come from the field's rule.
"""

from __future__ import annotations

from hashlib import md5, sha256, sha384, sha512

import numpy as np

# Fixed value: what the standard pads passwords with.
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _field() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The S-box, its inverse, and products by 0 to 15 in the field of AES."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            out ^= a * (b & 1)
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        return out

    box = np.zeros(256, np.uint8)
    for x in range(256):
        y = next((c for c in range(256) if times(x, c) == 1), 0)
        turned = y
        for k in range(1, 5):
            turned ^= ((y << k) | (y >> (8 - k))) & 255
        box[x] = turned ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back, [np.array([times(x, k) for x in range(256)], np.uint8) for k in range(16)]


_tables: list = []


def _aes() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    if not _tables:
        _tables.append(_field())
    return _tables[0]


def _round_keys(key: bytes) -> np.ndarray:
    box = _aes()[0]
    words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
    size, turn = len(words), 1
    while len(words) < 4 * (size + 7):
        w = list(words[-1])
        if len(words) % size == 0:
            w = [int(box[x]) for x in (*w[1:], w[0])]
            w[0] ^= turn
            turn = (turn << 1) ^ (0x11B if turn & 0x80 else 0)
        elif size > 6 and len(words) % size == 4:
            w = [int(box[x]) for x in w]
        words.append([a ^ b for a, b in zip(words[-size], w, strict=True)])
    return np.array(words, np.uint8).reshape(-1, 16)


_SHIFT = np.array([(5 * i) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


def _mix(state: np.ndarray, factors: tuple[int, ...]) -> np.ndarray:
    product = _aes()[2]
    columns = state.reshape(-1, 4, 4)
    out = np.zeros_like(columns)
    for r in range(4):
        for k in range(4):
            out[:, :, r] ^= product[factors[(k - r) % 4]][columns[:, :, k]]
    return out.reshape(-1, 16)


def aes_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """CBC, without taking off padding."""
    keys, back = _round_keys(key), _aes()[1]
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    if not len(blocks):
        return b""
    state = blocks ^ keys[-1]
    for k in range(len(keys) - 2, -1, -1):
        state = back[state[:, _UNSHIFT]] ^ keys[k]
        if k:
            state = _mix(state, (14, 11, 13, 9))
    return (state ^ np.vstack([np.frombuffer(iv, np.uint8), blocks[:-1]])).tobytes()


def aes_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    keys, box = _round_keys(key), _aes()[0]
    out, last = [], np.frombuffer(iv, np.uint8)
    for block in np.frombuffer(data, np.uint8).reshape(-1, 16):
        state = (block ^ last ^ keys[0])[None]
        for k in range(1, len(keys)):
            state = box[state][:, _SHIFT]
            if k < len(keys) - 1:
                state = _mix(state, (2, 3, 1, 1))
            state = state ^ keys[k]
        last = state[0]
        out.append(last.tobytes())
    return b"".join(out)


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _hash_6(salt: bytes) -> bytes:
    """The hardened hash of revision 6, of an empty password."""
    k, n = sha256(salt).digest(), 0
    while True:
        e = aes_encrypt(k[:16], k[16:32], k * 64)
        k = (sha256, sha384, sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Security:
    """Decrypts strings and streams of a file whose user password is empty."""

    def __init__(self, info: dict, file_id: bytes):
        self.version, revision = info.get("V", 0), info.get("R", 2)
        size = 5 if revision == 2 else info.get("Length", 40) // 8
        self.method = "AESV2" if self.version == 4 else "AESV3" if self.version == 5 else "RC4"
        if self.version >= 4:
            used = (info.get("CF") or {}).get(info.get("StmF", "Identity")) or {}
            self.method = {"V2": "RC4", "None": "Identity"}.get(str(used.get("CFM", "None")), str(used.get("CFM", "None")))
            size = 16 if self.version == 4 else 32
        user = info["U"]
        if revision >= 5:
            digest = _hash_6 if revision >= 6 else lambda salt: sha256(salt).digest()
            if digest(user[32:40]) != user[:32]:
                raise ValueError("the file needs a password")
            self.key = aes_decrypt(digest(user[40:48]), bytes(16), info["UE"])
            return
        seed = _PAD + info["O"][:32] + (info["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if revision >= 4 and info.get("EncryptMetadata") is False:
            seed += b"\xff\xff\xff\xff"
        key = md5(seed).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = md5(key[:size]).digest()
        self.key = key[:size]
        if revision == 2:
            good = rc4(self.key, _PAD) == user[:32]
        else:
            check = md5(_PAD + file_id).digest()
            for i in range(20):
                check = rc4(bytes(b ^ i for b in self.key), check)
            good = check == user[:16]
        if not good:
            raise ValueError("the file needs a password")

    def decrypt(self, number: int, generation: int, data: bytes) -> bytes:
        if self.method == "Identity":
            return data
        key = self.key
        if self.method != "AESV3":
            salted = key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if self.method == "AESV2" else b"")
            key = md5(salted).digest()[: min(16, len(key) + 5)]
        if self.method == "RC4":
            return rc4(key, data)
        plain = aes_decrypt(key, data[:16], data[16:])
        return plain[: -plain[-1]] if plain and 1 <= plain[-1] <= 16 else plain
