"""Format-preserving pseudonyms: keyed permutations of digit strings and of calendar dates.

Equal values give equal pseudonyms under one key, in every document and on every executor; different values give
different ones, since each function is a bijection on its format.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable

ROUNDS = 8
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2100, 1, 1).toordinal() - FIRST_DAY


def _round(key: bytes, n: int, i: int, half: str, modulus: int) -> int:
    digest = hashlib.blake2b(f"{n}|{i}|{half}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") % modulus


def permute_digits(digits: str, key: bytes) -> str:
    """A digit string of the same length; a bijection for each length of two digits and more.

    One digit is shifted by a keyed amount; the empty string stays empty.
    """
    n = len(digits)
    if n == 0:
        return digits
    if n == 1:
        return str((int(digits) + _round(key, 1, 0, "", 10)) % 10)
    u, v = n // 2, n - n // 2
    left, right = digits[:u], digits[u:]
    for i in range(ROUNDS):
        width = u if i % 2 == 0 else v
        mixed = (int(left) + _round(key, n, i, right, 10**width)) % 10**width
        left, right = right, str(mixed).zfill(width)
    return left + right


def restore_digits(digits: str, key: bytes) -> str:
    """The inverse of :func:`permute_digits`."""
    n = len(digits)
    if n == 0:
        return digits
    if n == 1:
        return str((int(digits) - _round(key, 1, 0, "", 10)) % 10)
    u, v = n // 2, n - n // 2
    left, right = (digits[:u], digits[u:]) if ROUNDS % 2 == 0 else (digits[:v], digits[v:])
    for i in reversed(range(ROUNDS)):
        width = u if i % 2 == 0 else v
        before = (int(right) - _round(key, n, i, left, 10**width)) % 10**width
        left, right = str(before).zfill(width), left
    return left + right


def permute_within(digits: str, key: bytes, valid: Callable[[str], bool]) -> str:
    """A bijection on the valid strings among those of one length: the permutation is repeated until it is back among them.

    A string that isn't valid itself is permuted once.
    """
    out = permute_digits(digits, key)
    while valid(digits) and not valid(out):
        out = permute_digits(out, key)
    return out


def permute_date(day: dt.date, key: bytes) -> dt.date:
    """Another valid date between 1900 and 2099, by cycle walking; dates outside that span are returned as they are."""
    at = day.toordinal() - FIRST_DAY
    if not 0 <= at < DAYS:
        return day
    while True:
        at = int(permute_digits(str(at).zfill(5), key))
        if at < DAYS:
            return dt.date.fromordinal(FIRST_DAY + at)
