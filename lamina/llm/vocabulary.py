"""Tokenizer files, and the splitting of texts into runs whose tokens do not depend on their neighbours."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer

_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizers library
_GAPS = re.compile("[\t-\r \x85\xa0  -     　]+")
_WIDE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
_LATIN = re.compile("[!-~\u00a1-\u012f\u0132-\u017f]+")
#: The letter that stands for each byte in byte-level files: printable Latin-1 for itself, others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: The same for all bytes as UTF-32; zeros, ends of lines and of strings stand for themselves.
LINE_LETTERS = np.array([b if b in (0, 10) else ord(BYTE_LETTERS.get(b, chr(b))) for b in range(256)], "<u4")
_LOADED: dict[int, "Vocabulary"] = {}


class Vocabulary:
    """A BPE vocabulary read from the text of a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[str, str], int] = {}
        for i, m in enumerate(model["merges"]):
            self.ranks[tuple(m.split(" ")) if isinstance(m, str) else tuple(m)] = i
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"] if not t["normalized"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.plain = self._plain_pattern(spec)
        self.lines = regex.compile(f"(?:{self.plain.pattern})|\n") if self.plain is not None else None
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def symbols(self, piece: str) -> list[str]:
        """The first symbols of a piece: its byte letters, the last with the end-of-word suffix."""
        out = list(piece)
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    @staticmethod
    def _plain_pattern(spec: dict) -> "regex.Pattern | None":
        """The file's splitting pattern, if it lower-cases, then keeps what matches the pattern, as byte letters."""
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
            return None
        if (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1].get("use_regex")) != ("Removed", True, False, False):
            return None
        return regex.compile(cuts[0]["pattern"]["Regex"])

    def pieces(self, run: str) -> list[str]:
        """Normalised pieces of a run in byte letters, as the library's own normaliser and splitter cut it.

        Runs of Latin letters and signs, whose classes and cases are the same in every Unicode version,
        take a shorter way to the same pieces."""
        if self.plain is not None and _LATIN.fullmatch(run):
            found = self.plain.findall(run.lower())
            return found if run.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in found]
        norm, pre = self.library.normalizer, self.library.pre_tokenizer
        text = norm.normalize_str(run) if norm is not None else run
        return [p for p, _ in pre.pre_tokenize_str(text)]

    def pieces_of(self, runs: list[str]) -> list[list[str]]:
        """pieces() of every run. Runs of Latin letters and signs are cut together, a line for each."""
        plain = [i for i, r in enumerate(runs) if _LATIN.fullmatch(r)] if self.lines is not None else []
        lines = "".join([runs[i] + "\n" for i in plain]).lower()
        found = [p for p in self.lines.findall(lines) if p] if plain else []
        if not lines.isascii():
            found = LINE_LETTERS[np.frombuffer("\0".join(found).encode(), np.uint8)].tobytes().decode("utf-32-le").split("\0")
        ends = [i for i, p in enumerate(found) if p == "\n"]
        if len(ends) != len(plain):  # the file's pattern takes ends of lines into pieces
            plain, ends = [], []
        out: list[list[str] | None] = [None] * len(runs)
        first = 0
        for i, end in zip(plain, ends):
            out[i], first = found[first:end], end + 1
        return [[p for p in self.pieces(r) if p] if own is None else own for r, own in zip(runs, out)]

    def parts(self, text: str) -> list[str]:
        """Ordinary parts of a text at even places, special strings between them at odd ones."""
        if not any(t in text for t in self.special):
            return [text]
        return self.splitter.split(text)


def vocabulary(content: str) -> Vocabulary:
    """One instance for each Python worker and file."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def white_runs(text: str) -> list[str]:
    """Runs between white space as the tokenizers library sees it."""
    if _ODD.search(text):
        return [r for r in _GAPS.split(text) if r]
    return text.split()


def spaced_runs(text: str) -> list[str]:
    """Cuts before each space that a non-space follows; byte-level splitters never cross such a place."""
    if _WIDE.search(text) or _ODD.search(text):
        head, *rest = _CUT.split(text)
    else:
        head, *rest = text.split(" ")
    return [head, *rest]


class Memo(dict):
    """A bounded cache of a function; when it is full, it starts anew."""

    def __init__(self, function: Callable, most: int = 500_000, longest: int = 256):
        super().__init__()
        self.function, self.most, self.longest = function, most, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def read_content(path: str) -> str:
    """The text of a tokenizer file on the driver; it reaches the workers as a broadcast of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()
