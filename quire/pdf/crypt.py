"""Known-password decryption of the standard security handler (V 1, 2, 4, 5; R 2 to 6)."""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass
from functools import cache

from quire.pdf.objects import Document, Hex, Ref, Stream, Writer

#: Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@cache
def library():
    """The OpenSSL that hashlib is linked to, where it has the ciphers of this module and they give the known results; else None."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.EVP_CIPHER_CTX_new.restype = ctypes.c_void_p
        for f in (lib.EVP_aes_128_cbc, lib.EVP_aes_192_cbc, lib.EVP_aes_256_cbc):
            f.restype = ctypes.c_void_p
        lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
        lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
        lib.EVP_CIPHER_CTX_free.argtypes = [ctypes.c_void_p]
        lib.EVP_CIPHER_CTX_free.restype = None
        lib.RC4_set_key.argtypes = [ctypes.c_void_p, ctypes.c_int, ctypes.c_char_p]
        lib.RC4_set_key.restype = None
        lib.RC4.argtypes = [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_char_p, ctypes.c_void_p]
        lib.RC4.restype = None
        key, iv, data = bytes(range(32)), bytes(range(7, 23)), bytes(range(48))
        for n in (16, 24, 32):
            closed = _cbc_tables(key[:n], iv, data, True)
            if _cbc_native(lib, key[:n], iv, data, True) != closed or _cbc_native(lib, key[:n], iv, closed, False) != data:
                return None
        return lib if _rc4_native(lib, key[:5], data) == _rc4_plain(key[:5], data) else None
    except (ImportError, AttributeError, OSError, TypeError):
        return None


def _rc4_native(lib, key: bytes, data: bytes) -> bytes:
    state, out = ctypes.create_string_buffer(4096), ctypes.create_string_buffer(len(data))
    lib.RC4_set_key(state, len(key), key)
    lib.RC4(state, len(data), data, out)
    return out.raw


def rc4(key: bytes, data: bytes) -> bytes:
    lib = library()
    return _rc4_native(lib, key, bytes(data)) if lib and 0 < len(key) <= 256 and data else _rc4_plain(key, data)


def _rc4_plain(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a, b = _double(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES and its inverse: inverses in GF(256), then an affine map."""
    box = [0] * 256
    power, p = [], 1
    for _ in range(255):
        power.append(p)
        p ^= _double(p)
    log = {v: k for k, v in enumerate(power)}
    for x in range(256):
        inv = power[-log[x] % 255] if x else 0
        y = 0x63
        for k in range(5):
            y ^= (inv << k | inv >> (8 - k)) & 255
        box[x] = y
    back = [0] * 256
    for x, y in enumerate(box):
        back[y] = x
    return box, back


_BOX, _BACK = _boxes()


def _tables(box: list[int], column: tuple[int, int, int, int]) -> list[list[int]]:
    """For each row of the state: what a byte there adds to a column after the substitution and the column mix."""
    first = [sum(_product(y, k) << 8 * (3 - i) for i, k in enumerate(column)) for y in box]
    return [[(t >> 8 * r | t << 8 * (4 - r)) & 0xFFFFFFFF if r else t for t in first] for r in range(4)]


_MIX, _UNMIX = _tables(_BOX, (2, 1, 1, 3)), _tables(_BACK, (14, 9, 13, 11))


def _round_keys(key: bytes) -> list[list[int]]:
    """Four words for each round."""
    n, rcon = len(key) // 4, 1
    words = [int.from_bytes(key[4 * k : 4 * k + 4], "big") for k in range(n)]
    sub = lambda w: _BOX[w >> 24] << 24 | _BOX[w >> 16 & 255] << 16 | _BOX[w >> 8 & 255] << 8 | _BOX[w & 255]
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = sub((w << 8 | w >> 24) & 0xFFFFFFFF) ^ rcon << 24
            rcon = _double(rcon)
        elif n > 6 and k % n == 4:
            w = sub(w)
        words.append(words[k - n] ^ w)
    return [words[k : k + 4] for k in range(0, len(words), 4)]


def _inverse_keys(key: bytes) -> list[list[int]]:
    """Round keys for decryption: backwards, the inner ones through the inverse column mix."""
    t0, t1, t2, t3 = _UNMIX
    keys = _round_keys(key)[::-1]
    mix = lambda w: t0[_BOX[w >> 24]] ^ t1[_BOX[w >> 16 & 255]] ^ t2[_BOX[w >> 8 & 255]] ^ t3[_BOX[w & 255]]
    return [k if i in (0, len(keys) - 1) else [mix(w) for w in k] for i, k in enumerate(keys)]


def _cipher(keys: list[list[int]], tables: list[list[int]], box: list[int], turn: int, block: int) -> int:
    """One block. turn: 1 moves rows to the left (encryption), 3 to the right."""
    t0, t1, t2, t3 = tables
    k = keys[0]
    s = [(block >> 96) ^ k[0], (block >> 64 & 0xFFFFFFFF) ^ k[1], (block >> 32 & 0xFFFFFFFF) ^ k[2], (block & 0xFFFFFFFF) ^ k[3]]
    i, j = (1, 3) if turn == 1 else (3, 1)
    for k in keys[1:-1]:
        a, b, c, d = s
        p, q = (b, d) if i == 1 else (d, b)
        # columns 0 to 3 of the next state; the second and fourth rows come from the columns beside
        s = [
            t0[a >> 24] ^ t1[p >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[q & 255] ^ k[0],
            t0[b >> 24] ^ t1[(c if i == 1 else a) >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[(a if i == 1 else c) & 255] ^ k[1],
            t0[c >> 24] ^ t1[q >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[p & 255] ^ k[2],
            t0[d >> 24] ^ t1[(a if i == 1 else c) >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[(c if i == 1 else a) & 255] ^ k[3],
        ]
    k, out = keys[-1], 0
    for n in range(4):
        w = box[s[n] >> 24] << 24 | box[s[(n + i) % 4] >> 16 & 255] << 16 | box[s[(n + 2) % 4] >> 8 & 255] << 8 | box[s[(n + j) % 4] & 255]
        out = out << 32 | w ^ k[n]
    return out


def _cbc_tables(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    keys, last, out = _round_keys(key) if encrypt else _inverse_keys(key), int.from_bytes(iv, "big"), []
    for k in range(0, len(data) - 15, 16):
        block = int.from_bytes(data[k : k + 16], "big")
        if encrypt:
            block = last = _cipher(keys, _MIX, _BOX, 1, block ^ last)
        else:
            block, last = _cipher(keys, _UNMIX, _BACK, 3, block) ^ last, block
        out.append(block.to_bytes(16, "big"))
    return b"".join(out)


def _cbc_native(lib, key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes | None:
    """None if the library refuses. Whole blocks only, so nothing is left inside it at the end."""
    out, got, at = ctypes.create_string_buffer(len(data) + 16), ctypes.c_int(0), 0
    context = lib.EVP_CIPHER_CTX_new()
    if not context:
        return None
    try:
        kind = {16: lib.EVP_aes_128_cbc, 24: lib.EVP_aes_192_cbc, 32: lib.EVP_aes_256_cbc}[len(key)]()
        if lib.EVP_CipherInit_ex(context, kind, None, key, iv, encrypt) != 1 or lib.EVP_CIPHER_CTX_set_padding(context, 0) != 1:
            return None
        # lengths are C integers
        for k in range(0, len(data), 1 << 30):
            part = data[k : k + (1 << 30)]
            if lib.EVP_CipherUpdate(context, ctypes.addressof(out) + at, got, part, len(part)) != 1:
                return None
            at += got.value
    finally:
        lib.EVP_CIPHER_CTX_free(context)
    return out.raw[:at] if at == len(data) else None


def _cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    data, lib = bytes(data[: len(data) // 16 * 16]), library()
    out = _cbc_native(lib, key, iv, data, encrypt) if lib and data and len(key) in (16, 24, 32) and len(iv) == 16 else None
    return _cbc_tables(key, iv, data, encrypt) if out is None else out


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    """Whole blocks, no padding."""
    return _cbc(key, iv, data, True)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    return _cbc(key, iv, data, False)


def aes_open(key: bytes, data: bytes) -> bytes | None:
    """IV and ciphertext of a string or stream: a ragged tail is ignored, 16 bytes or less are empty, None for bad padding."""
    if len(data) <= 16:
        return b""
    plain = cbc_decrypt(key, data[:16], data[16:])
    n = plain[-1] if plain else 0
    return plain[:-n] if 1 <= n <= 16 and plain.endswith(bytes([n]) * n) else None


def hardened(password: bytes, salt: bytes, owner: bytes = b"") -> bytes:
    """The hash of revision 6: rounds of AES and a SHA-2 that its own output picks."""
    k, i = hashlib.sha256(password + salt + owner).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + owner) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


@dataclass
class Lock:
    v: int
    r: int
    size: int
    o: bytes
    u: bytes
    oe: bytes
    ue: bytes
    permissions: int
    meta: bool
    id: bytes
    streams: str
    strings: str


def read_lock(doc: Document) -> Lock | str | None:
    """The encryption of a document, what is not supported of it, or None."""
    d = doc.get(doc.trailer.get("Encrypt"))
    if not isinstance(d, dict):
        return None
    if d.get("Filter") != "Standard":
        return f"security handler /{d.get('Filter', 'unknown')}"
    v, r, bits = d.get("V", 0), d.get("R", 0), d.get("Length")
    if v not in (1, 2, 4, 5):
        return f"/V {v}"
    if not 2 <= r <= 6:
        return f"/R {r}"
    ids = doc.get(doc.trailer.get("ID")) or [b""]
    kinds = {"None": "identity", "V2": "rc4", "AESV2": "aes", "AESV3": "aes"}

    def method(which: str) -> str | None:
        name = d.get(which, "Identity")
        if name == "Identity":
            return "identity"
        entry = doc.get((doc.get(d.get("CF")) or {}).get(str(name)))
        return kinds.get(str(entry.get("CFM"))) if isinstance(entry, dict) else None

    streams, strings = ("rc4", "rc4") if v < 4 else (method("StmF"), method("StrF"))
    if not streams or not strings:
        return "an unrecognised crypt filter"
    size = 5 if v == 1 else 32 if v == 5 else max(5, min(16, (bits or (40 if v == 2 else 128)) >> 3))
    b = lambda k: doc.get(d.get(k)) or b""
    return Lock(v, r, size, b("O"), b("U"), b("OE"), b("UE"), d.get("P", 0), d.get("EncryptMetadata") is not False, ids[0], streams, strings)


def file_key(lock: Lock, password: bytes) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + lock.o[:32] + (lock.permissions & 0xFFFFFFFF).to_bytes(4, "little") + lock.id + (b"\xff" * 4 if lock.r >= 4 and not lock.meta else b"")).digest()
    for _ in range(50 if lock.r >= 3 else 0):
        h = hashlib.md5(h[: lock.size]).digest()
    return h[: lock.size]


def user_check(lock: Lock, key: bytes) -> bytes:
    if lock.r == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + lock.id).digest())
    for k in range(1, 20):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def owner_key(lock: Lock, password: bytes) -> bytes:
    h = hashlib.md5((password + PAD)[:32]).digest()
    for _ in range(50 if lock.r >= 3 else 0):
        h = hashlib.md5(h).digest()
    return h[: lock.size]


def _passwords(lock: Lock, text: str) -> list[bytes]:
    if lock.r >= 5:
        return [text.encode()[:127]]
    low = bytes(ord(c) & 255 for c in text)
    return list(dict.fromkeys([low, text.encode()]))


def unlock(lock: Lock, text: str) -> bytes | None:
    """The file key for a user or owner password; None if it is neither."""
    for password in _passwords(lock, text):
        if lock.v == 5:
            digest = hardened if lock.r == 6 else lambda p, salt, own=b"": hashlib.sha256(p + salt + own).digest()
            if digest(password, lock.u[32:40]) == lock.u[:32]:
                return cbc_decrypt(digest(password, lock.u[40:48]), bytes(16), lock.ue[:32])
            if digest(password, lock.o[32:40], lock.u[:48]) == lock.o[:32]:
                return cbc_decrypt(digest(password, lock.o[40:48], lock.u[:48]), bytes(16), lock.oe[:32])
            continue
        own = owner_key(lock, password)
        inner = lock.o[:32]
        for k in range(19 if lock.r >= 3 else 0, -1, -1):
            inner = rc4(bytes(b ^ k for b in own), inner)
        for candidate in (password, inner):
            key = file_key(lock, candidate)
            want = user_check(lock, key)
            if lock.u[: 32 if lock.r == 2 else 16] == want[: 32 if lock.r == 2 else 16]:
                return key
    return None


def object_key(lock: Lock, key: bytes, ref: Ref, method: str) -> bytes:
    if lock.v == 5:
        return key
    return hashlib.md5(key + ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + (b"sAlT" if method == "aes" else b"")).digest()[: min(16, len(key) + 5)]


def opened(lock: Lock, key: bytes, ref: Ref, data: bytes, method: str) -> bytes | None:
    if method == "identity" or not data:
        return data
    k = object_key(lock, key, ref, method)
    return rc4(k, data) if method == "rc4" else aes_open(k, data)


def unlock_document(data: bytes, password: str) -> tuple[bytes | None, str | None, str | None]:
    """(bytes, error, warning) of a document opened with a password."""
    doc = Document.open(data)
    lock = read_lock(doc)
    if lock is None:
        return data, None, "W_NOTHING_CHANGED"
    if isinstance(lock, str) or any(p[0] == "in" for p in doc.places.values()):
        return None, "E_UNSUPPORTED_ENCRYPTION", None
    key = unlock(lock, password)
    if key is None:
        return None, "E_WRONG_PASSWORD", None
    failed = 0

    def walk(x, ref: Ref):
        nonlocal failed
        if isinstance(x, bytes):
            plain = opened(lock, key, ref, x, lock.strings)
            failed += plain is None
            return x if plain is None else Hex(plain)
        if isinstance(x, list):
            return [walk(y, ref) for y in x]
        if isinstance(x, dict):
            return {k: walk(v, ref) for k, v in x.items()}
        if isinstance(x, Stream):
            kind = x.info.get("Type")
            plain = x.raw if kind == "XRef" or kind == "Metadata" and not lock.meta else opened(lock, key, ref, x.raw, lock.streams)
            failed += plain is None
            return Stream(walk({k: v for k, v in x.info.items() if k != "Length"}, ref), x.raw if plain is None else plain)
        return x

    lock_ref = doc.trailer.get("Encrypt")
    for num, place in list(doc.places.items()):
        ref = Ref(num, place[2] if place[0] == "at" else 0)
        if place[0] == "at" and not (isinstance(lock_ref, Ref) and lock_ref.num == num):
            doc.held[num] = walk(doc.get(Ref(num)), ref)
    w = Writer()
    root = w.copy(doc, doc.trailer["Root"])
    info = w.copy(doc, doc.trailer["Info"]) if isinstance(doc.trailer.get("Info"), Ref) else None
    return w.finish(root, info), None, "W_PARTIAL_DECRYPT" if failed else None
