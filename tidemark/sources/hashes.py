"""Spark's 32-bit hash of a whole number and a salt, for DuckDB: so that hashed picks can be checked by another engine."""

from __future__ import annotations

_WORD = 2**32
_MIX, _MIX2 = 0xCC9E2D51, 0x1B873593


def _rotated(x: int, n: int) -> int:
    return (x << n | x >> (32 - n)) % _WORD


def _mixed(word: int) -> int:
    return _rotated(word * _MIX % _WORD, 15) * _MIX2 % _WORD


def _salt_words(salt: str) -> list[int]:
    """A text's words of four bytes, then its last bytes one by one, signed."""
    raw = salt.encode()
    whole = len(raw) // 4 * 4
    words = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, whole, 4)]
    return [_mixed(w) for w in [*words, *((b - 256 if b > 127 else b) % _WORD for b in raw[whole:])]]


def _absorbed(start: str, words: list[str]) -> str:
    turned = f"((xor(h, k) * 8192) % {_WORD} + xor(h, k) // 524288)"
    return f"list_reduce([{', '.join([f'CAST({start} AS BIGINT)', *words])}], lambda h, k: ({turned} * 5 + 3864292196) % {_WORD})"


def _finished(state: str, length: int) -> str:
    times = f"CAST((CAST(h AS HUGEINT) * c) % {_WORD} AS BIGINT)"
    return f"list_reduce([xor({state}, {length}), 16, 2246822507, 13, 3266489909, 16], lambda h, c: CASE WHEN c < 32 THEN xor(h, h >> c) ELSE {times} END)"


def spark_hash(column: str, salt: str) -> str:
    """hash(column, salt) for whole numbers from 0 to 2 ** 63 - 1."""
    turned = f"((h * 32768) % {_WORD} + h // 131072)"
    word = lambda x: f"list_reduce([CAST({x} AS BIGINT), {_MIX}, 0, {_MIX2}], lambda h, c: CASE WHEN c = 0 THEN {turned} ELSE CAST((CAST(h AS HUGEINT) * c) % {_WORD} AS BIGINT) END)"
    number = _finished(_absorbed("42", [word(f"{column} % {_WORD}"), word(f"{column} // {_WORD}")]), 8)
    words = _salt_words(salt)
    unsigned = _finished(_absorbed(number, list(map(str, words))) if words else number, len(salt.encode()))
    return f"({unsigned} + 2147483648) % {_WORD} - 2147483648"


def spark_pmod(column: str, salt: str, n: int | str) -> str:
    return f"((({spark_hash(column, salt)}) % {n} + {n}) % {n})"


def pick(column: str, salt: str, palette: list[str]) -> str:
    names = ", ".join(f"'{x}'" for x in palette)
    return f"([{names}])[CAST({spark_pmod(column, salt, len(palette))} + 1 AS INTEGER)]"


def uniform(column: str, seed: int) -> str:
    return f"(({spark_pmod(column, f'u{seed}', 1_000_003)} + 0.5::DOUBLE) / 1000003)"
