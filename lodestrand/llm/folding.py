"""Text folded to what matters for comparing passages: letters and digits, accents and case aside."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters without a canonical decomposition (fixed values).
PLAIN_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k"})

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbf])|([\"'/\\]))")
#: A tag: short text, and quoted values of any length (an inline image). All scans stop at the next tag or blank, so they are linear.
_TAG = re.compile(r"""</?[A-Za-z!](?:(?:[^<>"']|"[^"<>]*+"|'[^'<>]*+'){0,300}+>|[^<>]{0,300}>)""")
_LINK = re.compile(r"\]\([^()\s]*+\)")
_SURROGATES = re.compile("[\ud800-\udbff][\udc00-\udfff]")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    return " " if m[3] else m[4]


def fold(text: str) -> str:
    """Lower-case text without escapes, mark-up, invisible characters and accents; punctuation and space stay."""
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
        text = _SURROGATES.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), text)
    if "&" in text:
        text = html.unescape(text)
        if "&" in text and ";" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)).casefold().translate(PLAIN_LETTERS)
    return "".join([c for c in text if c < "\u0300" or not unicodedata.combining(c)])


def words(text: str) -> list[str]:
    """White-space separated words of a text's folded form, punctuation within and around them dropped."""
    return [w for w in ("".join(filter(str.isalnum, part)) for part in fold(text).split()) if w]
