"""Words of letters, digits and non-ASCII characters in lower case, as bytes and as Spark columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: For ``bytes.translate``: A-Z to a-z, bytes of words as they are, all others to a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes whose words are held as a list at a time.
PIECE = 1 << 20


def word_pieces(raw: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists of ``size`` bytes each, so that a very long text needs little memory."""
    plain = raw.translate(PLAIN)
    at = 0
    while at < len(plain):
        stop = plain.find(b" ", at + size)
        stop = len(plain) if stop < 0 else stop
        yield plain[at:stop].split()
        at = stop


def words(text: str) -> Column:
    """The words of the column ``text`` as an array; null has none."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1))
