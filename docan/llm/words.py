"""Words: maximal runs of Unicode letters and digits, lower-cased."""

from __future__ import annotations

import re

# [^\W_] of the re module is exactly the characters of categories L and N.
_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order; none for null."""
    if not text:
        return []
    low = text.lower()
    if len(low) == len(text):
        return _RUN.findall(low)
    return [w.lower() for w in _RUN.findall(text)]  # lower-casing would change the runs
