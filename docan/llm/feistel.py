"""Keyed permutations of digit strings and dates within their format (a Feistel network over decimal digits).

The same key maps equal values to equal pseudonyms and can undo them; without the key they are
unlinkable to the value.
"""

from __future__ import annotations

from datetime import date, timedelta
from hashlib import blake2b

ROUNDS = 10
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


def _round(key: bytes, tweak: bytes, i: int, half: str, size: int) -> int:
    digest = blake2b(f"{i}|{size}|{half}".encode(), key=key[:64], person=tweak[:16].ljust(16, b"\0"), digest_size=16).digest()
    return int.from_bytes(digest, "big")


def permute(digits: str, key: bytes, tweak: bytes = b"") -> str:
    """A permutation of the strings of as many decimal digits; one digit is shifted by the key."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _round(key, tweak, 0, "", n)) % 10) if n else ""
    u, v = n // 2, n - n // 2
    a, b = digits[:u], digits[u:]
    for i in range(ROUNDS):
        m = u if i % 2 == 0 else v
        a, b = b, str((int(a) + _round(key, tweak, i, b, n)) % 10**m).zfill(m)
    return a + b


def restore(digits: str, key: bytes, tweak: bytes = b"") -> str:
    """Undoes ``permute``."""
    n = len(digits)
    if n < 2:
        return str((int(digits) - _round(key, tweak, 0, "", n)) % 10) if n else ""
    u, v = n // 2, n - n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(ROUNDS)):
        m = u if i % 2 == 0 else v
        a, b = str((int(b) - _round(key, tweak, i, a, n)) % 10**m).zfill(m), a
    return a + b


def _walk(day: date, step) -> date:
    size = (LAST - FIRST).days + 1
    width = len(str(size - 1))
    at = step(str((day - FIRST).days).zfill(width))
    while int(at) >= size:  # cycle walking keeps the permutation within the dates
        at = step(at)
    return FIRST + timedelta(days=int(at))


def permute_date(day: date, key: bytes) -> date:
    """A permutation of the days from 1900 to 2099; other days are returned as they are."""
    return _walk(day, lambda d: permute(d, key, b"date")) if FIRST <= day <= LAST else day


def restore_date(day: date, key: bytes) -> date:
    """Undoes ``permute_date``."""
    return _walk(day, lambda d: restore(d, key, b"date")) if FIRST <= day <= LAST else day
