"""Plain words of a text, for the operators that run Python in tasks."""

from __future__ import annotations

import string

#: A-Z to a-z, ASCII marks and control characters to spaces; all else, UTF-8 letters too, as it is.
_TABLE = bytes(
    ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 32 if b < 32 or b == 127 or chr(b) in string.punctuation else b
    for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space and punctuation, as UTF-8."""
    return text.lower().encode().translate(_TABLE).split() if text else []
