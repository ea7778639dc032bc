"""Plain words of a text whatever its case, punctuation, spacing, markup, escapes and character encoding."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһкмтвнАЕОРСУХІЈЅКМТВНοαερτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhkmtbhAEOPCYXIJSKMTBHoaeptuvikABEZHIKMNOPTYX",
)
#: Invisible characters: zero-width, soft hyphen, joiners and direction marks.
INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_CONTROL = re.compile(r"\\[nrtbf\"'/]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){1,}")
_QUOTED = re.compile(r"(?:=[0-9A-F]{2}){2,}")
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,400}>")
_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[Ѐ-ӿͰ-Ͽ]")


def _character(m: re.Match) -> str:
    return chr(int(m.group(1), 16))


def _bytes(m: re.Match) -> str:
    try:
        return bytes.fromhex(m.group().replace("=", "")).decode("utf-8")
    except ValueError:
        return m.group()


def plain_text(text: str) -> str:
    """Lower case, without accents, escapes, tags, entities and invisible characters; repaired where UTF-8 was read as Latin."""
    if "\\" in text:
        text = _ESCAPED.sub(_character, text)
        text = _CONTROL.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(), errors="replace"), text)
    if "=" in text:
        text = _QUOTED.sub(_bytes, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if "Ã" in text or "â€" in text or "Â" in text:
            text = "".join(_repaired(part) for part in re.split(r"(\s+)", text))
        text = unicodedata.normalize("NFKD", text.translate(INVISIBLE))
        text = "".join([c for c in text if c < "\u0300" or not unicodedata.combining(c)])
        if _MIXED.search(text):
            text = text.translate(LOOKALIKES)
    return text.casefold()


def _repaired(part: str) -> str:
    if part.isascii():
        return part
    for encoding in ("cp1252", "latin-1"):
        try:
            return part.encode(encoding).decode("utf-8")
        except ValueError:
            continue
    return part


def plain_words(text: str) -> list[str]:
    return _WORD.findall(plain_text(text))
