"""Ed25519 as RFC 8032 defines it, in plain integers: it needs nothing on an executor. Multiples of the base, and of keys that sign often, come
from tables, 32 additions each; points of a batch are put into bytes by one inversion."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
ZERO = (0, 1, 1, 0)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p):
    out = ZERO
    while n:
        if n & 1:
            out = _add(out, p)
        p = _add(p, p)
        n >>= 1
    return out


def _x(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


def _point(raw: bytes):
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (2**255 - 1)
    x = _x(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


def _inverses(values: list[int]) -> list[int]:
    """1/v of each value, none of which is 0, by one inversion for all."""
    upto = [1]
    for v in values:
        upto.append(upto[-1] * v % P)
    rest, out = pow(upto[-1], P - 2, P), [0] * len(values)
    for i in range(len(values) - 1, -1, -1):
        out[i], rest = upto[i] * rest % P, rest * values[i] % P
    return out


def _all_bytes(points: list) -> list[bytes]:
    return [((p[1] * z % P) | ((p[0] * z % P & 1) << 255)).to_bytes(32, "little") for p, z in zip(points, _inverses([p[2] for p in points]), strict=True)]


_Y = 4 * pow(5, P - 2, P) % P
BASE = (_x(_Y, 0), _Y, 1, _x(_Y, 0) * _Y % P)


def _table(p):
    """j 256^w p for each byte j > 0 and each place w of a number's 32 bytes, as (y + x, y - x, 2 d x y)."""
    points = []
    for _ in range(32):
        q = p
        for _ in range(255):
            points.append(q)
            q = _add(q, p)
        p = q
    out = []
    for (x, y, _, _), z in zip(points, _inverses([q[2] for q in points]), strict=True):
        x, y = x * z % P, y * z % P
        out.append((y + x, y - x, 2 * D * x * y % P))
    return [out[255 * w : 255 * (w + 1)] for w in range(32)]


@lru_cache(1)
def _base_table():
    return _table(BASE)


@lru_cache(16)
def _key_table(public: bytes):
    """Of the key's point with its sign changed."""
    x, y, z, t = _known(public)
    return _table((P - x, y, z, P - t))


def _plus(table, n: int, p=ZERO):
    """p and the table's point n times."""
    x, y, z, t = p
    for row in table:
        j, n = n & 255, n >> 8
        if j:
            up, down, both = row[j - 1]
            a, b, c, d = (y - x) * down % P, (y + x) * up % P, t * both % P, 2 * z
            e, f, g, h = b - a, d - c, d + c, b + a
            x, y, z, t = e * f % P, g * h % P, f * g % P, e * h % P
    return x, y, z, t


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@lru_cache(4096)
def _secret(seed: bytes) -> tuple[int, bytes, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | (1 << 254)
    return a, h[32:], _all_bytes([_plus(_base_table(), a)])[0]


def public_key(seed: bytes) -> bytes:
    return _secret(seed)[2]


def sign_all(seeds: list[bytes], messages: list[bytes]) -> list[bytes]:
    """The signature of each message under the seed beside it."""
    secrets = [_secret(s) for s in seeds]
    r = [_hash(prefix, m) for (_, prefix, _), m in zip(secrets, messages, strict=True)]
    points = _all_bytes([_plus(_base_table(), n) for n in r])
    return [p + ((n + _hash(p, public, m) * a) % ORDER).to_bytes(32, "little") for p, n, (a, _, public), m in zip(points, r, secrets, messages, strict=True)]


def sign(seed: bytes, message: bytes) -> bytes:
    return sign_all([seed], [message])[0]


@lru_cache(4096)
def _known(public: bytes):
    return _point(public)


#: A key with so many signatures in a batch gets a table, which costs as much as some 30 multiplications without one.
OFTEN = 64


def verify_all(publics: list[bytes], messages: list[bytes], signatures: list[bytes]) -> list[bool]:
    """Whether each signature is its key's. The point that it must name is computed and compared in bytes, so no signature's own point is decoded: bytes
    that aren't a point's only form never equal it."""
    out, n = [False] * len(publics), Counter(publics)
    at, points = [], []
    for i, (public, m, signature) in enumerate(zip(publics, messages, signatures, strict=True)):
        s = int.from_bytes(signature[32:], "little")
        if len(public) != 32 or len(signature) != 64 or s >= ORDER or _known(public) is None:
            continue
        h, p = _hash(signature[:32], public, m), _plus(_base_table(), s)
        if n[public] >= OFTEN:
            p = _plus(_key_table(public), h, p)
        else:
            x, y, z, t = _known(public)
            p = _add(p, _times(h, (P - x, y, z, P - t)))
        at.append(i)
        points.append(p)
    for i, b in zip(at, _all_bytes(points), strict=True):
        out[i] = b == signatures[i][:32]
    return out


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    return verify_all([bytes(public)], [message], [bytes(signature)])[0]
