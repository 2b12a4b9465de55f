"""Encoding whole texts with a public tokenizer inside tasks."""

from __future__ import annotations

import json
import os
import re
from array import array

from tillwise.llm.shared import worker_state

CACHE_ENTRIES = 650_000
LONGEST_CACHED = 64
# A space that follows other white space belongs to a run the vocabulary's pattern treats as a whole.
RUN = re.compile(r"\s ")
# So does a line end beside other white space.
BREAK = re.compile(r"\s\n|\n\s")
# White space other than spaces and line ends; without it, plain searches tell both.
RARE_WHITE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CLOSING = ".,;:!?"
# Below this lie the Latin, Greek and Cyrillic letters, on which all versions of Unicode agree.
BEYOND = "\u0530"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary lies; any other file's path does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The byte behind every character of byte-level vocabularies: printable ones stand for themselves, the rest count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pieces(dict):
    """The ids of pieces seen before; a new one is encoded, and kept while there is room."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < CACHE_ENTRIES and len(piece) <= LONGEST_CACHED:
            self[piece] = ids
        return ids


class Encoder:
    """Little-endian 32-bit ids of texts.

    The byte-level pattern always starts a new piece at a space that follows a non-space, and at
    and after a line end between two other characters, so a text is cut there and each distinct cut piece is
    encoded by the library once while it is in the cache. In a piece of letters and closing
    punctuation the pattern parts the two, so its letters are looked up by themselves. Texts where a space
    follows other white space are encoded whole. The cache is bounded and only saves time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = Pieces(self._piece)
        self.shown = {b: c for c, b in byte_alphabet().items()}
        settings = json.loads(self.tokenizer.to_str())
        first = settings.get("pre_tokenizer") or {}
        self.letters_apart = settings.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if self.letters_apart:
            stem = piece.rstrip(CLOSING)
            if (stem.isalpha() or (stem[:1] == " " and stem[1:].isalpha())) and max(stem) < BEYOND:
                if stem != piece:
                    return self.cache[stem] + self.cache[piece[len(stem) :]]
                # Letters, with or without a space before them, are one unit of the pattern.
                unit = stem.encode().decode("latin-1").translate(self.shown)
                return array("I", [t.id for t in self.model.tokenize(unit)]).tobytes()
        return self._whole(piece)

    def encode(self, text: str) -> bytes:
        rare = RARE_WHITE.search(text)
        if "\0" in text or (RUN.search(text) if rare else "  " in text or "\n " in text):
            return self._whole(text)
        marked = text.replace(" ", "\0 ")
        if self.letters_apart and "\n" in text and not (BREAK.search(text) if rare else "\n\n" in text or " \n" in text):
            marked = marked.replace("\n", "\0\n\0")
        return b"".join(map(self.cache.__getitem__, marked.split("\0")))


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file; loaded once per Python worker."""
    state = worker_state()
    key = ("encoder", path)
    if key not in state:
        state[key] = Encoder(path)
    return state[key]
