"""Token ids of whole texts, by a tokenizer file whose path is a parameter.

Texts can be encoded as they are, or by chunks that are remembered: most words of
a corpus come again and again. ``split`` names a rule that only cuts where the
tokenizer's own pre-tokenizer cuts whatever stands around, so the ids are
those of the whole text (added tokens without white space stay whole, and are cut out by the library first):

* "byte_level": before a lone space and around a lone line feed, between
  characters that are not white space (a byte-level pre-tokenizer starts a new
  piece at such a space, and makes such a line feed a piece of its own);
* "white_space": at ASCII white space, for tokenizers that drop white space;
* None: whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

_loaded: dict[str, object] = {}
_known: dict = {}
#: Chunks that a worker remembers, the length of the longest it does, and those encoded in one call.
MOST_CHUNKS, LONGEST_CHUNK, AT_ONCE = 800_000, 64, 32
_BYTE_LEVEL = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_ASCII_SPACE = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_OTHER_ASCII_SPACE = [c for c in _OTHER_SPACE if c.isascii()]


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a worker; a special token's string in a text is that token, as the library has it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str, split: str | None) -> list[str]:
    """The chunks of a text whose ids, one after another, are the text's ids."""
    if split is None:
        return [text]
    if split == "white_space":
        return _ASCII_SPACE.findall(text)
    if split != "byte_level":
        raise ValueError(f"no such rule: {split}")
    if "\0" in text or not _plain(text):
        return _BYTE_LEVEL.split(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def _plain(text: str) -> bool:
    """Whether all white space is lone spaces and line feeds between other characters."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not any(c in text for c in (_OTHER_ASCII_SPACE if text.isascii() else _OTHER_SPACE))


def marker(t) -> tuple[str, int] | None:
    """An added token by which chunks can be joined: the library cuts there first and encodes what is between by itself."""
    found = t.get_added_tokens_decoder()
    if any(a.lstrip or a.rstrip or a.single_word or re.search(r"\s", a.content) for a in found.values()):
        return None
    return next(((a.content, i) for i, a in found.items() if a.special and not a.normalized), None)


class _Known:
    """The ids of chunks met before, as bytes; of two generations, the older is dropped when the younger is full."""

    def __init__(self, t) -> None:
        self.t, self.marker = t, marker(t)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk: some at a time as one text, joined by the marker."""
        if self.marker is None:
            return [np.array(e.ids, np.uint32).tobytes() for e in self.t.encode_batch_fast(chunks, add_special_tokens=False)]
        between, number = self.marker
        whole = [chunks[i : i + AT_ONCE] for i in range(0, len(chunks), AT_ONCE)]
        out: list[bytes] = []
        for part, e in zip(whole, self.t.encode_batch_fast(list(map(between.join, whole)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = (np.flatnonzero(ids == number) * 4).tolist()
            if len(cuts) + 1 == len(part):
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)]
            else:  # a chunk has the marker itself
                out += [np.array(x.ids, np.uint32).tobytes() for x in self.t.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def ids(self, cut: list[list[str]]) -> list[list[bytes]]:
        """The ids of every chunk; what isn't known is encoded, and remembered unless it is long."""
        if len(self.young) > MOST_CHUNKS:
            self.old, self.young = self.young, {}
        out = [list(map(self.young.get, chunks)) for chunks in cut]
        holes = [[i for i, x in enumerate(found) if x is None] for found in out]
        missing = {chunks[i] for chunks, where in zip(cut, holes, strict=True) for i in where}
        got = {c: self.old[c] for c in missing if c in self.old}
        new = [c for c in missing if c not in got]
        got.update(zip(new, self._encode(new), strict=True))
        for chunks, found, where in zip(cut, out, holes, strict=True):
            for i in where:
                found[i] = got[chunks[i]]
        self.young.update((c, x) for c, x in got.items() if len(c) <= LONGEST_CHUNK)
        return out


def encode(path: str, texts: list[str], end_id: int, split: str | None = None, at_once: int = 256) -> Iterator[np.ndarray]:
    """The ids of each text, the end id appended."""
    t = tokenizer(path)
    end = np.array([end_id], np.uint32).tobytes()
    for i in range(0, len(texts), at_once):
        if split is None:
            for e in t.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False):
                yield np.frombuffer(np.array(e.ids, np.uint32).tobytes() + end, np.uint32)
        else:
            if (path, split) not in _known:
                _known[path, split] = _Known(t)
            for found in _known[path, split].ids([chunks(x, split) for x in texts[i : i + at_once]]):
                yield np.frombuffer(b"".join(found) + end, np.uint32)
