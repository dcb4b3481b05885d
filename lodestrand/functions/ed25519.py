"""Ed25519 signatures as RFC 8032 defines them, for keys and messages of this library's receipts."""

from __future__ import annotations

import hashlib
from functools import lru_cache

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _add(a: Point, b: Point) -> Point:
    u, v = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    t, z = 2 * a[3] * b[3] * D % P, 2 * a[2] * b[2] % P
    e, f, g, h = v - u, z - t, z + t, v + u
    return e * f % P, g * h % P, f * g % P, e * h % P


@lru_cache(maxsize=64)
def _windows(a: Point) -> list[list[Point]]:
    """``[i][j]`` is j * 16**i times the point, for points that are multiplied again and again."""
    out = []
    for _ in range(64):
        row: list[Point] = [(0, 1, 1, 0)]
        for _ in range(15):
            row.append(_add(row[-1], a))
        out.append(row)
        a = _add(row[-1], a)
    return out


def _times(n: int, a: Point) -> Point:
    """n times the point; n has at most 256 bits."""
    out: Point = (0, 1, 1, 0)
    for row in _windows(a):
        if n & 15:
            out = _add(out, row[n & 15])
        n >>= 4
    return out


def _x(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


_BASE_Y = 4 * pow(5, P - 2, P) % P
BASE: Point = (_x(_BASE_Y, 0), _BASE_Y, 1, _x(_BASE_Y, 0) * _BASE_Y % P)


def _packed(a: Point) -> bytes:
    inverse = pow(a[2], P - 2, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


@lru_cache(maxsize=64)
def _known_point(data: bytes) -> Point | None:
    return _point(data)


def _point(data: bytes) -> Point | None:
    y = int.from_bytes(data, "little")
    odd, y = y >> 255, y & ((1 << 255) - 1)
    x = _x(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _expanded(secret: bytes) -> tuple[int, bytes]:
    if len(secret) != 32:
        raise ValueError("a secret key has 32 bytes")
    h = hashlib.sha512(secret).digest()
    a = int.from_bytes(h[:32], "little")
    return a & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(secret: bytes) -> bytes:
    return _packed(_times(_expanded(secret)[0], BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _expanded(secret)
    public = _packed(_times(a, BASE))
    r = _number(prefix, message) % L
    point = _packed(_times(r, BASE))
    s = (r + _number(point, public, message) * a) % L
    return point + s.to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r = _known_point(public), _point(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, BASE), _add(r, _times(_number(signature[:32], public, message) % L, a))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
