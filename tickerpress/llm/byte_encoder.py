"""Ids of a byte-level tokenizer, remembered chunk by chunk.

A chunk is a run of non-space characters with the one space before it.  The split pattern of byte-level
tokenizers never joins characters across the start of a chunk, so the ids of a text are
those of its chunks in a row.  New chunks are encoded many at a time, as one text; byte
lengths of the ids tell them apart again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Chunks, and characters of them, in the younger half of the memory; when either is full, the older half goes.
REMEMBERED, REMEMBERED_CHARS = 600_000, 24_000_000
#: Characters split at a time.
SLICE = 1 << 20
#: The characters that split patterns take for white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_chunks = re.compile(f"[{SPACES}]+(?![^{SPACES}])| ?[^{SPACES}]+|[{SPACES}]").findall
_odd_space = re.compile(f"[{SPACES}]".replace(" ", "").replace("\\t-\\r", "\\t\\x0b-\\r")).search
_space = re.compile(f"[{SPACES}]").search
#: A place where a text may be cut: before one space or line feed between other characters.
_seam = re.compile(f"(?<=[^{SPACES}])[ \\n](?=[^{SPACES}])")
#: Latin letters, then ASCII signs but for the apostrophe, which begins endings such as 's.  Never merged with each other.
_letters_signs = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch


class ByteEncoder:
    """Keys of the memory: ``word`` for a space and the word, a line feed and what follows it for
    itself, and a space before any other chunk."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        #: A character of a byte-level token stands for a byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        for group in _groups(texts):
            keys = [self._keys(t) for t in group]
            self._learn(set().union(*(k for k in keys if k is not None)))
            find = self.known.__getitem__
            out += [b"".join(map(find, k)) if k is not None else self._whole(t) for k, t in zip(keys, group)]
        return out

    def encode_long(self, text: str) -> bytes:
        """The same for one text of any length, slice by slice."""
        if any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(self.encode([part])[0] for part in _parts(text))

    def _whole(self, text: str) -> bytes:
        return _little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _keys(self, text: str) -> list[str] | None:
        """None for a text with a special token, which the library has to see whole."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return None
        start = text[0] if text[0] in " \n" and len(text) > 1 else ""
        # One space or line feed between chunks, or two line feeds: a plain split finds the chunks.
        if ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text[-1] in " \n" or text[:2] == "\n\n"
                or _odd_space(text)):
            return [c[1:] if c[0] == " " and len(c) > 1 and not _space(c[1]) else c if c == "\n" else " " + c for c in _chunks(text)]
        keys = text.replace("\n", " \n").split(" ")
        if start:
            return keys[1:]
        keys[0] = " " + keys[0]
        return keys

    def _learn(self, keys: set[str]) -> None:
        """Forgets at most between groups of texts, so a group finds all its chunks."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.known, self.older, self.chars = {}, self.known, 0
        parted = {}
        new = self._unknown(keys)
        for key in new:
            if key[0] == "\n" and len(key) > 1:
                parted[key] = ("\n", " " + key[1:])
            elif (m := _letters_signs(key[1:] if key[0] == " " else key)) is not None:
                parted[key] = ((" " if key[0] == " " else "") + m[1], " " + m[2])
        parts = self._unknown({p for two in parted.values() for p in two}.union(new.difference(parted)).difference(parted))
        # The rest of a line's first chunk may be letters and signs itself.
        for key in list(parts):
            if key[0] == " " and (m := _letters_signs(key[1:])) is not None:
                parted[key] = (" " + m[1], " " + m[2])
        parts = self._unknown({p for k in parts & parted.keys() for p in parted[k]}.union(parts.difference(parted)))
        self._encode(parts)
        find = self.known
        for key in sorted(parted, key=lambda k: k[0] == "\n"):
            if key not in find:
                a, b = parted[key]
                find[key] = find[a] + find[b]
        self.chars += sum(map(len, new))

    def _unknown(self, keys: set[str]) -> set[str]:
        new = keys.difference(self.known)
        # Not intersection(): that would walk the whole dictionary.
        old = {k: self.older[k] for k in new if k in self.older}
        self.known.update(old)
        return new.difference(old)

    def _encode(self, keys: set[str]) -> None:
        spaced = [k for k in keys if k[0] not in " \n"]
        bare = [k[1:] for k in keys if k[0] == " " and not _space(k[1:])]
        self._encode_joined(spaced, " ", "", 0)
        self._encode_joined(bare, "\n", " ", 4)
        for key in keys:
            if key[0] == "\n" or (key[0] == " " and _space(key[1:])):
                self.known[key] = self._whole(key[1:] if key[0] == " " else key)

    def _encode_joined(self, chunks: list[str], before: str, prefix: str, skip: int) -> None:
        """Encode chunks with ``before`` in front of each; ``skip`` bytes of ids are those of ``before``."""
        for start in range(0, len(chunks), 4096):
            part = chunks[start:start + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([before + before.join(part)], add_special_tokens=False)[0].ids,
                           dtype="<u4")
            ends = np.cumsum(self.bytes_of[ids])
            last = np.cumsum([len(c.encode()) + 1 for c in part])
            at = np.searchsorted(ends, last)
            if not np.array_equal(ends[at], last):
                raise AssertionError("an id reaches over the end of a chunk")
            raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
            self.known.update((prefix + c, raw[a + skip:b]) for c, a, b in zip(part, [0, *cuts[:-1]], cuts))


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> ByteEncoder:
    """One per tokenizer and worker process, so that what a task has learnt serves the next."""
    return ByteEncoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _parts(text: str) -> Iterator[str]:
    """Cuts at seams, about every ``SLICE`` characters."""
    start = 0
    while len(text) - start > 2 * SLICE:
        seam = _seam.search(text, start + SLICE)
        if seam is None:
            break
        yield text[start:seam.start()]
        start = seam.start()
    yield text[start:]


def _little(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()
