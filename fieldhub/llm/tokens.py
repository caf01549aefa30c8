"""Token ids of a public tokenizer, with the ids of words remembered by the worker."""

from __future__ import annotations

import json
import os
import re
import sys
from types import ModuleType

import numpy as np

REMEMBERED = 40_000  # words of a generation; a worker holds two of them at most between its batches
TOGETHER = 1_000  # words that are encoded as one text
#: tasks get this package by value, so what outlives a task hangs on a module of the worker
_MEMORY = "fieldhub_worker_memory"
#: fixed value: the splitting rule of byte-level tokenizers
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = "\u0250"  # below it, no Unicode version changes what is a letter or a number


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for
    themselves, the others for 256 and up in turn."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def _quick(path: str):
    """The same vocabulary in a faster encoder, if its ids are the ranks of its merges."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, merges = model["vocab"], model["merges"]
    joined = ("".join(m if isinstance(m, list) else m.split(" ")) for m in merges)
    if any(vocabulary[name] != 256 + i for i, name in enumerate(joined)):
        return None
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in name): i for name, i in vocabulary.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Byte-level BPE ids as little-endian unsigned 32-bit numbers.

    The tokenizer's splitting rule never joins what lies left of a space to what lies right
    of it, if the space is followed by a character that is not white space.  Texts are
    therefore cut before such spaces, and each different piece is encoded once while it is remembered.
    Pieces of common characters are encoded together by a faster encoder of the same vocabulary, if the file
    allows it; the tests compare all ways with the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.opens = np.array([name.startswith("Ġ") for name in names])  # ids that begin with a space
        self.quick = _quick(path)
        self.fresh: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Ids:
        """The worker's ids of a tokenizer file."""
        memory = vars(sys.modules.setdefault(_MEMORY, ModuleType(_MEMORY)))
        if path not in memory:
            memory[path] = Ids(path)
        return memory[path]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        heads, rests = [], []
        for text in texts:
            head, *rest = text.split(" ") if _plain(text) else re.split(r" (?=\S)", text)
            heads.append(head)
            rests.append(rest)
        self._remember(set().union(*rests))
        known = self.fresh.__getitem__
        found = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        encoded = [
            np.array(head.ids, "<u4").tobytes() + b"".join(map(known, rest))
            for head, rest in zip(found, rests, strict=True)
        ]
        if len(self.fresh) > REMEMBERED:  # one text's words may be more
            self.fresh = {}
        return encoded

    def _remember(self, pieces: set[str]) -> None:
        absent = pieces - self.fresh.keys()
        if len(self.fresh) + len(absent) > REMEMBERED:
            self.old, self.fresh, absent = self.fresh, {}, pieces
        again = absent & self.old.keys()
        self.fresh.update((piece, self.old[piece]) for piece in again)
        missing = absent - again
        plain = [p for p in missing if self.quick and " " not in p and (p.isascii() or max(p) < PLAIN)]
        rare = list(missing.difference(plain))
        found = self.tokenizer.encode_batch_fast([" " + piece for piece in rare], add_special_tokens=False)
        self.fresh.update((piece, np.array(e.ids, "<u4").tobytes()) for piece, e in zip(rare, found, strict=True))
        for first in range(0, len(plain), TOGETHER):
            part = plain[first : first + TOGETHER]
            ids = np.array(self.quick.encode_ordinary(" " + " ".join(part)), "<u4")
            starts = np.flatnonzero(self.opens[ids]).tolist()
            raw = ids.tobytes()
            ends = [*starts[1:], len(ids)]
            self.fresh.update(
                (piece, raw[4 * a : 4 * b]) for piece, a, b in zip(part, starts, ends, strict=True)
            )


#: characters that may not follow a space where a text is cut at every space
_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


def _plain(text: str) -> bool:
    """No space is followed by white space or the end."""
    spaces = _SPACES[:10] if text.isascii() else _SPACES
    return not text.endswith(" ") and not any(" " + c in text for c in spaces)
