"""Spell the shorthand of ``fixed`` patterns for a regex engine.

``\\b``, ``\\d`` and ``\\s`` mean letters, decimal digits and whitespace of all of
Unicode. Java reads them as ASCII (or, with a flag, as a slightly different set
that also changed between JDKs), so they are written out.
"""

import re

_TOKEN = re.compile(r"\\.|\[|\]|[^\\\[\]]+", re.DOTALL)


WORD = r"\p{L}\p{N}_"
_SPACE = r"\p{Z}\t-\r\x1C-\x1F"


def _spell(pattern: str, digit: str, space: str, boundary) -> str:
    out, in_class = [], False
    for token in _TOKEN.finditer(pattern):
        text = token.group()
        if text == "[":
            in_class = True
        elif text == "]":
            in_class = False
        elif text == r"\d":
            text = digit
        elif text == r"\s":
            text = space if in_class else f"[{space}]"
        elif text == r"\b":
            text = boundary(pattern[token.end():])
        out.append(text)
    return "".join(out)


def _java_boundary(rest: str) -> str:
    if rest[:1] in ("", ")", "|"):  # the fixed patterns close a word here
        return f"(?![{WORD}])"
    if re.match(r"\w|\[A-Z\]|\(\?:[A-Z]", rest):  # a word character must follow
        return f"(?<![{WORD}])"
    return f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark's (Java's) regex functions."""
    flags = "(?iu)" if ignore_case else ""
    return flags + _spell(pattern, r"\p{Nd}", _SPACE + r"\x85", _java_boundary)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for RE2 (the checking engine); its ``\\b`` stays ASCII."""
    flags = "(?i)" if ignore_case else ""
    return flags + _spell(pattern, r"\p{Nd}", _SPACE + r"\x{85}", lambda rest: r"\b")
