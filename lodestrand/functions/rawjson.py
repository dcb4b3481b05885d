"""Parts of JSON text as they are spelled: no number, key or escape is rewritten."""

from __future__ import annotations

import json

_DECODER = json.JSONDecoder()
_SPACE = " \t\r\n"


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACE:
        at += 1
    return at


def _end(text: str, at: int) -> int:
    """Where the value that begins at ``at`` ends."""
    return _DECODER.raw_decode(text, at)[1]


def members(text: str) -> dict[str, tuple[int, int]]:
    """Span of each member's value of the object that the text is; of repeated keys the last."""
    at = _skip(text, 0)
    out: dict[str, tuple[int, int]] = {}
    at = _skip(text, at + 1)
    while at < len(text) and text[at] != "}":
        key, at = _DECODER.raw_decode(text, at)
        begin = _skip(text, _skip(text, at) + 1)
        end = _end(text, begin)
        out[key] = (begin, end)
        at = _skip(text, end)
        if at < len(text) and text[at] == ",":
            at = _skip(text, at + 1)
    return out


def member_text(text: str, key: str) -> str | None:
    """The text of a member; null if it is absent or null."""
    span = members(text).get(key) if text and text.lstrip().startswith("{") else None
    if span is None:
        return None
    found = text[span[0] : span[1]]
    return None if found == "null" else found


def list_items(text: str, key: str) -> tuple[list[str], bool]:
    """Texts of the items of a bare list, or of the object's member ``key``; and whether it was an object."""
    text = text.strip()
    is_object = text.startswith("{")
    listing = (member_text(text, key) or "[]") if is_object else text
    items, at = [], _skip(listing, 1)
    while at < len(listing) and listing[at] != "]":
        end = _end(listing, at)
        items.append(listing[at:end])
        at = _skip(listing, end)
        if at < len(listing) and listing[at] == ",":
            at = _skip(listing, at + 1)
    return items, is_object
