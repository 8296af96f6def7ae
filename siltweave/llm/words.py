"""Word splitting and text folding shared by the text operators."""

from __future__ import annotations

import re

#: A Chinese character is a word of its own, otherwise a longest run of letters and digits.
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
HAN = re.compile(r"[一-鿿]")
_NOT_ALNUM = re.compile(r"[\W_]+")


def words(text: str | None) -> list[str]:
    """The lower-cased words of a text; none for null or a text without letters and digits."""
    return WORD.findall(text.lower()) if text else []


def folded(text: str | None) -> str:
    """Lower-cased text with all but letters and digits dropped."""
    return _NOT_ALNUM.sub("", text.lower()) if text else ""
