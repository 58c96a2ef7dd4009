"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, piece by piece.

A BPE model sees one piece of text at a time (a word with its blank, a run of digits, ...), and running text repeats
its pieces. So each text is cut into pieces once, and the library encodes each distinct piece once; a text's ids are
the joined ids of its pieces. The ids are those of the library over the whole text, at a fraction of the time. Strings of
the file's added tokens in a text get the ids of these tokens, as in the library: they cut the text before anything else.
A file whose pre-tokenizer isn't one of the two known here, or whose added tokens take white space along, is used over
whole texts.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache
from operator import attrgetter

PIECES_KEPT, LONGEST_KEPT = 300_000, 64  # pieces of a generation, of which a process keeps two, and characters of a piece
ID = attrgetter("id")

# How the two kinds of file cut a text, as written in them or in their library.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def _class(members: str, last: int) -> str:
    """The characters up to ``last`` that the library counts as members, as the inside of a character class for ``re``."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    runs = Split(Regex(f"{members}+"), "removed", invert=True)
    every = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
    return "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m, _ in runs.pre_tokenize_str(every))


@cache
def _cutter(pattern: str, last: int) -> Callable[[str], list[str]]:
    """``findall`` of one of the two patterns for texts whose characters go up to ``last``.

    ``re`` is several times as fast as patterns with categories, and faster yet with few characters in a class. Letters
    come first: no other alternative can begin with one.
    """
    letter, number, white = _class(r"\p{L}", last), _class(r"\p{N}", last), _class(r"\s", last)
    other = rf"[^{white}{letter}{number}]+"
    ends = r"'(?:s|t|re|ve|m|ll|d)"
    if pattern == BYTE_LEVEL:
        return re.compile(rf" ?[{letter}]+|{ends}| ?[{number}]+| ?{other}|[{white}]+(?![^{white}])|[{white}]+").findall
    return re.compile(rf"[{letter}]+|{ends}|[{number}]|{other}").findall


@cache
def _byte_characters() -> list[int]:
    """The characters that byte-level models write for the 256 bytes: printable ones as they are, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [b if b in plain else next(rest) for b in range(256)]


class _Ids(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers; forgets what wasn't used since it was full before."""

    def __init__(self, model) -> None:
        self.tokenize, self.written, self.older = model.tokenize, _byte_characters(), {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            plain = piece.isascii() and piece.isprintable() and " " not in piece
            tokens = self.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.written))
            out = array("I", map(ID, tokens)).tobytes()
        if len(piece) <= LONGEST_KEPT:  # of longer ones a cache could fill the memory
            if len(self) >= PIECES_KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


@cache
def encoder(path: str) -> Callable[[str], bytes]:
    """A function from text to its ids as bytes, with no special tokens added. One for each process and file."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    before, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    steps = before.get("pretokenizers", [])
    added = {t["content"]: t["id"].to_bytes(4, "little") for t in spec["added_tokens"]}
    plain = not spec["model"].get("dropout") and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain and not norm and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        pattern, simple, normal = BYTE_LEVEL, str, str
    elif plain and len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORDS} and steps[0]["invert"] and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        pattern, simple, normal = WORDS, str.lower, whole.normalizer.normalize_str
    else:
        return lambda text: array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    get = _Ids(whole.model).__getitem__
    latin = _cutter(pattern, 255)

    def ordinary(text: str) -> bytes:
        if _is_latin(text):  # composed as it is
            return b"".join(map(get, latin(simple(text))))
        return b"".join(map(get, _cutter(pattern, sys.maxunicode)(normal(text))))

    around = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split

    def encode(text: str) -> bytes:
        if not any(t in text for t in added):
            return ordinary(text)
        return b"".join(added[t] if k % 2 else ordinary(t) for k, t in enumerate(around(text)))

    return encode


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
