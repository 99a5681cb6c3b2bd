"""Whole tokens that every match of a regular expression must hold, read from the expression itself.

A token is a longest run of letters a-z and digits. A run of literals is a whole token of every match if it must be part of
a match, the character before it can't be a letter or digit, and neither can the one behind it. What isn't certain (branches,
optional parts, open classes, the ends of the expression) gives no token, so a token that is missing in a text rules a match out.
"""

from __future__ import annotations

import re
from re import _constants as C  # the parts of a parsed expression
from re import _parser

_INLINE = re.compile(r"^\(\?i\)")


def _is_token(code: int) -> bool:
    return code < 128 and chr(code).isalnum()


def _apart(op, value) -> bool:
    """That one character of this part is surely neither letter nor digit."""
    if op is C.LITERAL:
        return not _is_token(value) and value < 128
    if op is C.IN and value[0][0] is not C.NEGATE:
        return all(k is C.LITERAL and v < 128 and not _is_token(v) or k is C.RANGE and v[1] < 128 and not any(map(_is_token, range(v[0], v[1] + 1))) for k, v in value)
    return False


def _begins_apart(parts: list) -> bool:
    """That what follows begins with no letter or digit, or stands at a word boundary or at the end of the text."""
    for i, (op, value) in enumerate(parts):
        if op is C.AT:
            return value in (C.AT_BOUNDARY, C.AT_END, C.AT_END_STRING)
        if op is C.SUBPATTERN:
            return _begins_apart([*value[3], *parts[i + 1 :]])
        if op is C.MAX_REPEAT:
            low, _, body = value
            return _begins_apart(list(body)) and (low > 0 or _begins_apart(parts[i + 1 :]))
        return _apart(op, value)
    return False


def _walk(parts: list, apart: bool, tail: list, found: set[str]) -> bool:
    """Adds the tokens of a sequence that must match; whether what it ends with is surely apart from what follows."""
    i = 0
    while i < len(parts):
        op, value = parts[i]
        if op is C.LITERAL and _is_token(value):
            j = i
            while j < len(parts) and parts[j][0] is C.LITERAL and _is_token(parts[j][1]):
                j += 1
            if apart and _begins_apart([*parts[j:], *tail]):
                found.add("".join(chr(v) for _, v in parts[i:j]).lower())
            apart, i = False, j
            continue
        if op is C.SUBPATTERN:
            apart = _walk(list(value[3]), apart, [*parts[i + 1 :], *tail], found)
        elif op is C.MAX_REPEAT:
            low, _, body = value
            ends = _walk(list(body), False, [], set())
            apart = ends and (apart or low > 0)
        elif op is C.AT:
            apart = apart or value in (C.AT_BOUNDARY, C.AT_BEGINNING, C.AT_BEGINNING_STRING)
        else:
            apart = _apart(op, value)
        i += 1
    return apart


def required_tokens(pattern: str) -> tuple[str, ...]:
    """The tokens, in the order of the alphabet; none where no token is certain or Python can't read the expression."""
    found: set[str] = set()
    try:
        parts = list(_parser.parse(_INLINE.sub("", pattern)))
    except re.error:
        return ()
    _walk(parts, False, [], found)
    return tuple(sorted(found))
