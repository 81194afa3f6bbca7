"""Column functions on file bytes and text: binary test, decoding, framing, token estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom.fixed_values import BLOCK_CLOSING, BPE_SPECIAL_TOKENS
from packloom.functions.globs import SPACES
from packloom.functions.paths import escape_path

_SPECIAL = "|".join(t.replace("|", r"\|") for t in BPE_SPECIAL_TOKENS)
# The public split pattern of the encoding, written without look-ahead and possessive
# quantifiers so that any regex engine finds the same pieces.  A zero byte stands for a special
# token; text files have no zero bytes of their own.
_PIECES = "|".join([
    r"\x00",
    r"'(?i:[sdmt]|ll|ve|re)",
    r"[^\r\n\p{L}\p{N}\x00]?\p{L}+",
    r"\p{N}{1,3}",
    rf" ?[^{SPACES}\p{{L}}\p{{N}}\x00]+[\r\n]*",
    rf"[{SPACES}]*[\r\n]",
    rf"[{SPACES}]+",
])


def is_binary(content: Column) -> Column:
    """A zero byte anywhere makes a file binary; works on strings and on bytes."""
    return F.coalesce(F.contains(content, F.lit("\0")), F.lit(False))


def is_binary_bytes(content: Column) -> Column:
    return F.coalesce(F.contains(content, F.lit(bytearray(1))), F.lit(False))


def is_lossy(content_bytes: Column) -> Column:
    return F.coalesce(~F.is_valid_utf8(content_bytes.cast("string")), F.lit(False))


def decode_lossy(content_bytes: Column) -> Column:
    """Text of the bytes; malformed sequences become U+FFFD."""
    return F.make_valid_utf8(content_bytes.cast("string"))


def opening(rel_path: Column) -> Column:
    return F.concat(F.lit('<file path="'), escape_path(rel_path), F.lit('">\n'))


def frame(rel_path: Column, content: Column) -> Column:
    return F.concat(opening(rel_path), content, F.lit(BLOCK_CLOSING))


def estimated_tokens(text: Column) -> Column:
    """Pieces the encoding's pre-split makes of the text, an estimate from below of its tokens."""
    plain = F.when(F.contains(text, F.lit("<|")), F.regexp_replace(text, _SPECIAL, "\0")).otherwise(text)
    # The pieces cover the text, so writing one character for each leaves as many as there are
    # pieces, without building an array of them.
    return F.length(F.regexp_replace(plain, _PIECES, "x")).cast("bigint")
