"""Words of a text by one translate table over its UTF-8 bytes."""

from __future__ import annotations


def folding_table(separators: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z become small, every separator becomes a space."""
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    for b in separators:
        table[b] = ord(" ")
    return bytes(table)


def byte_ranges(*ranges: tuple[int, int]) -> bytes:
    return bytes(b for first, last in ranges for b in range(first, last + 1))


# Letters of any script stay; digits are separators in the first table and words in the second.
LETTERS = folding_table(byte_ranges((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))
LETTERS_AND_DIGITS = folding_table(byte_ranges((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))


def words(text: str, table: bytes) -> list[bytes]:
    """Folded words in order, as UTF-8; every separator has become a space, so ``split`` finds all borders."""
    return text.encode("utf-8", "surrogatepass").translate(table).split()
