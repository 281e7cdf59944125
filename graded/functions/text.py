"""String helpers that reproduce Python ``str`` semantics with JVM-side
expressions (P7, P8 and the string group of §2.10).

Spark's ``trim`` removes spaces only and its ``\\s`` is ASCII; Python's
``strip``/``split``/``isspace`` use Unicode whitespace. The class below is
written with ``\\x{..}`` escapes that Java regex and RE2 (DuckDB) read the
same way, so the SQL oracle can reuse the very same pattern text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
WS_CLASS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same set for Java regex: the Unicode White_Space property plus
# U+001C..U+001F. Equal to the ranges above on every code point (tested),
# and as fast as ``\s`` (the explicit range list is about 3x slower).
WS_CLASS_JAVA = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"
# The same set as a plain string (for character-set trimming).
WS_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
             (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
WS_CHARS = "".join(chr(c) for lo, hi in WS_RANGES for c in range(lo, hi + 1))
NON_WS_RUN = "[^" + WS_CLASS[1:-1] + "]+"
# Characters dropped by the lenient parser: all but letters, digits and
# whitespace (removed in runs; same result as one at a time).
NOT_ALNUM_SPACE = r"[^\p{L}\p{N}" + WS_CLASS[1:-1] + "]+"
NOT_ALNUM_SPACE_JAVA = r"[^\p{L}\p{N}" + WS_CLASS_JAVA[1:-1] + "]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``s.strip()``: character-set trim, linear, no regex."""
    return F.call_function("btrim", _c(c), F.lit(WS_CHARS))


def strip_chars(c, chars: str) -> Column:
    """Python ``s.strip(chars)`` for a literal character set."""
    return F.call_function("btrim", _c(c), F.lit(chars))


def char_class(chars: str) -> str:
    """A regex character class (Java and RE2) holding exactly ``chars``."""
    return "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in chars) + "]"


def rstrip_chars(c, chars: str) -> Column:
    """Python ``s.rstrip(chars)``."""
    return F.regexp_replace(_c(c), char_class(chars) + "+\\z", "")


def norm(c) -> Column:
    """``s.strip().lower()``."""
    return F.lower(strip(c))


def keep_alnum_space(c) -> Column:
    """Keep characters that are ``isalnum()`` or ``isspace()``."""
    return F.regexp_replace(_c(c), NOT_ALNUM_SPACE_JAVA, "")


def words(c) -> Column:
    """Python ``s.split()``: whitespace runs, no empty tokens (T4)."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.split(s, WS_CLASS_JAVA + "+")
    )


def n_words(c) -> Column:
    """``len(s.split())`` without building the word array: whitespace runs
    inside the stripped text, plus one."""
    s = strip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.regexp_count(s, F.lit(WS_CLASS_JAVA + "+")) + 1)
