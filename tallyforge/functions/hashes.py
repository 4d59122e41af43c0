"""Keccak-256 and base58 over Arrow batches, and the leaf layout of hash chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 136  # bytes that a permutation of the 256-bit hash takes in
#: Fixed value: the alphabet of base58.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: The domains of the chains' links and of their leaves.
LINK_DOMAIN = {"feedback": "8004_FEEDBACK_V1", "response": "8004_RESPONSE_V1", "revoke": "8004_REVOKE_V1"}
LEAF_DOMAIN = {"feedback": "8004_LEAF_V1____", "response": "8004_RSP_LEAF_V1", "revoke": "8004_RVK_LEAF_V1"}


def _constants() -> tuple[list[int], dict[tuple[int, int], int]]:
    """Round constants by the specification's feedback register, and the rotation of each lane."""
    bits, register = [], 1
    for _ in range(255):
        bits.append(register & 1)
        register = (register << 1) ^ (0x171 if register & 0x80 else 0)
    rounds = [sum(bits[(7 * r + j) % 255] << ((1 << j) - 1) for j in range(7)) for r in range(24)]
    turn, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        turn[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turn


_ROUNDS, _TURN = _constants()


def _rotate(v: np.ndarray, n: int) -> np.ndarray:
    return v if n == 0 else (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def _permute(a: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    for constant in _ROUNDS:
        c = [a[x, 0] ^ a[x, 1] ^ a[x, 2] ^ a[x, 3] ^ a[x, 4] for x in range(5)]
        d = [c[(x - 1) % 5] ^ _rotate(c[(x + 1) % 5], 1) for x in range(5)]
        b = {(y, (2 * x + 3 * y) % 5): _rotate(a[x, y] ^ d[x], _TURN[x, y]) for x in range(5) for y in range(5)}
        a = {(x, y): b[x, y] ^ (~b[(x + 1) % 5, y] & b[(x + 2) % 5, y]) for x in range(5) for y in range(5)}
        a[0, 0] = a[0, 0] ^ np.uint64(constant)
    return a


_WHOLE = (1 << 64) - 1
#: For each lane of the next round's order: the lane it comes from, and how far it turns.
_MOVES = [(x + 5 * y, y + 5 * ((2 * x + 3 * y) % 5), _TURN[x, y]) for x in range(5) for y in range(5)]


def keccak_one(message: bytes) -> bytes:
    """The digest of one message, in whole numbers: much less work than a batch of one."""
    padded = message + b"\1" + bytes(-(len(message) + 1) % RATE)
    padded = padded[:-1] + bytes([padded[-1] | 0x80])
    a = [0] * 25
    for at in range(0, len(padded), RATE):
        for j in range(RATE // 8):
            a[j] ^= int.from_bytes(padded[at + 8 * j : at + 8 * j + 8], "little")
        for constant in _ROUNDS:
            c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
            d = [c[x - 1] ^ ((c[x - 4] << 1 & _WHOLE) | c[x - 4] >> 63) for x in range(5)]
            b = [0] * 25
            for source, to, turn in _MOVES:
                v = a[source] ^ d[source % 5]
                b[to] = (v << turn & _WHOLE) | v >> (64 - turn)
            for y in range(0, 25, 5):
                p, q, r, s, t = b[y : y + 5]
                a[y : y + 5] = p ^ (~q & r), q ^ (~r & s), r ^ (~s & t), s ^ (~t & p), t ^ (~p & q)
            a[0] ^= constant
    return b"".join(lane.to_bytes(8, "little") for lane in a[:4])


#: Batches of fewer messages are hashed one by one.
FEW = 8


def keccak_batch(messages: list[bytes]) -> list[bytes]:
    """The 32-byte digests of messages; those of as many blocks are hashed together."""
    out: list[bytes] = [b""] * len(messages)
    blocks = np.array([len(m) // RATE + 1 for m in messages], np.int64)
    for n in np.unique(blocks).tolist():
        where = np.flatnonzero(blocks == n)
        if len(where) < FEW:
            for i in where.tolist():
                out[i] = keccak_one(messages[i])
            continue
        data = np.zeros((len(where), n * RATE), np.uint8)
        for row, i in enumerate(where.tolist()):
            data[row, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            data[row, len(messages[i])] = 1
        data[:, -1] |= 0x80
        lanes = data.view("<u8").reshape(len(where), n, RATE // 8)
        a = {(x, y): np.zeros(len(where), np.uint64) for x in range(5) for y in range(5)}
        for k in range(n):
            for j in range(RATE // 8):
                a[j % 5, j // 5] = a[j % 5, j // 5] ^ lanes[:, k, j]
            a = _permute(a)
        digests = np.ascontiguousarray(np.stack([a[x, 0] for x in range(4)], axis=1)).view(np.uint8)
        for row, i in enumerate(where.tolist()):
            out[i] = digests[row].tobytes()
    return out


@F.pandas_udf(T.BinaryType())
def keccak256(message: pd.Series) -> pd.Series:
    """The hash of binary values; null stays null."""
    full = message.notna()
    found = pd.Series([None] * len(message), index=message.index, dtype=object)
    found[full] = pd.Series(keccak_batch([bytes(m) for m in message[full]]), index=message.index[full], dtype=object)
    return found


def _digits(values: np.ndarray, base: int, into: int, places: int) -> np.ndarray:
    """Rows of digits in one base as rows of digits in another, the highest first, by long division of all rows at once."""
    left, out = values.astype(np.int64), np.zeros((len(values), places), np.int64)
    for k in range(places - 1, -1, -1):
        rest = np.zeros(len(left), np.int64)
        for j in range(left.shape[1]):
            rest = rest * base + left[:, j]
            left[:, j], rest = np.divmod(rest, into)
        out[:, k] = rest
    return out


def _by_length(values: list) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for i, v in enumerate(values):
        if v is not None:
            found.setdefault(len(v), []).append(i)
    return found


_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_VALUE = np.full(256, -1, np.int64)
_VALUE[_LETTERS] = np.arange(58)


def base58_batch(values: list[bytes | None]) -> list[str | None]:
    """The base58 texts; a zero byte in front is a `1`. Values of one length go together."""
    out: list[str | None] = [None] * len(values)
    for size, where in _by_length(values).items():
        raw = np.frombuffer(b"".join(values[i] for i in where), np.uint8).reshape(len(where), size)
        digits = _digits(raw, 256, 58, size * 138 // 100 + 1)
        zeros = (np.cumsum(raw != 0, axis=1) == 0).sum(axis=1)
        lead = (np.cumsum(digits != 0, axis=1) == 0).sum(axis=1)
        text = _LETTERS[digits]
        for row, i in enumerate(where):
            out[i] = "1" * int(zeros[row]) + text[row, lead[row] :].tobytes().decode()
    return out


def from_base58_batch(texts: list[str | None]) -> list[bytes | None]:
    """The bytes of base58 texts; null for other texts."""
    out: list[bytes | None] = [None] * len(texts)
    raw_texts = [None if t is None or not t.isascii() else t.encode() for t in texts]
    for size, where in _by_length(raw_texts).items():
        value = _VALUE[np.frombuffer(b"".join(raw_texts[i] for i in where), np.uint8).reshape(len(where), size)]
        good = (value >= 0).all(axis=1)
        digits = _digits(np.maximum(value, 0), 58, 256, size * 74 // 100 + 1)
        ones = (np.cumsum(value != 0, axis=1) == 0).sum(axis=1)
        lead = (np.cumsum(digits != 0, axis=1) == 0).sum(axis=1)
        for row, i in enumerate(where):
            if good[row]:
                out[i] = bytes(int(ones[row])) + digits[row, lead[row] :].astype(np.uint8).tobytes()
    return out


@F.pandas_udf(T.StringType())
def base58(value: pd.Series) -> pd.Series:
    return pd.Series(base58_batch([None if v is None else bytes(v) for v in value]), index=value.index, dtype=object)


@F.pandas_udf(T.BinaryType())
def from_base58(text: pd.Series) -> pd.Series:
    return pd.Series(from_base58_batch([None if pd.isna(t) else t for t in text]), index=text.index, dtype=object)


#: Rotations of the published lookup hash's mixing rounds and of its last one, and what it starts from.
_MIX, _FINAL, _START = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24), 0x9E3779B9 + 3923095


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def lookup_hash(values: list[bytes]) -> np.ndarray:
    """The 32-bit lookup hash of byte strings, as a database hashes text; strings of one length go together.

    Three words take in twelve bytes a round; the first byte of the last
    round's third word stays free.
    """
    out = np.zeros(len(values), np.uint32)
    for size, where in _by_length(values).items():
        raw = np.zeros((len(where), size // 12 * 12 + 12), np.uint8)
        raw[:, :size] = np.frombuffer(b"".join(values[i] for i in where), np.uint8).reshape(len(where), size)
        tail = size // 12 * 12
        raw[:, tail + 9 : tail + 12] = raw[:, tail + 8 : tail + 11].copy()
        raw[:, tail + 8] = 0
        words = raw.view("<u4").astype(np.uint32)
        w = [np.full(len(where), (_START + size) & 0xFFFFFFFF, np.uint32) for _ in range(3)]
        for k in range(size // 12 + 1):
            for j in range(3):
                w[j] = w[j] + words[:, 3 * k + j]
            if k < size // 12:  # each word in turn gives way to the one before it
                for r, n in enumerate(_MIX):
                    x, y, z = r % 3, (r + 1) % 3, (r + 2) % 3
                    w[x] = (w[x] - w[z]) ^ _turn(w[z], n)
                    w[z] = w[z] + w[y]
        for r, n in enumerate(_FINAL):
            x, y = (2, 0, 1)[r % 3], (1, 2, 0)[r % 3]
            w[x] = (w[x] ^ w[y]) - _turn(w[y], n)
        out[where] = w[2]
    return out


@F.pandas_udf(T.LongType())
def tie_breaker(text: pd.Series) -> pd.Series:
    """The absolute value of the signed lookup hash of a text, modulo ten million; null stays null."""
    full = text.notna()
    found = pd.Series([None] * len(text), index=text.index, dtype="Int64")
    if full.any():
        signed = lookup_hash([t.encode() for t in text[full]]).view(np.int32).astype(np.int64)
        found[full] = np.abs(signed) % 10_000_000
    return found


def u64_le(n: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in range(15, 0, -2)]))


def leaf(chain: str, asset: Column, client: Column, index: Column, seal_hash: Column, slot: Column, responder: Column | None = None, response_hash: Column | None = None) -> Column:
    """The bytes of a leaf, to be hashed: the chain's domain, asset, client, index[, responder, response hash], seal hash, slot; a null hash is 32 zero bytes."""
    zero = F.unhex(F.lit("00" * 32))
    parts = [F.lit(LEAF_DOMAIN[chain].encode()), asset, client, u64_le(index)]
    if responder is not None:
        parts += [responder, F.coalesce(response_hash, zero)]
    return F.concat(*parts, F.coalesce(seal_hash, zero), u64_le(slot))


def link(chain: str, previous: Column, leaf_hash: Column) -> Column:
    """The bytes of a link, to be hashed: the digest before (null at the start: zeros), the chain's domain, the leaf's hash."""
    return F.concat(F.coalesce(previous, F.unhex(F.lit("00" * 32))), F.lit(LINK_DOMAIN[chain].encode()), leaf_hash)
