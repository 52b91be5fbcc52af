"""Ids of a byte-level BPE vocabulary by segments of text, each distinct one encoded once while it is held.

A segment starts at a run of spaces that follows a character other than ASCII white space, or at the start of the text. The
vocabulary's pattern never takes a piece across such a place: a piece holds white space only in front, and of a run of it
only the last space joins what follows. So a text's ids are its segments' ids in order. White space beyond ASCII can join a run
on both sides of such a place; texts with any are one segment.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The pattern of the byte-level vocabulary, and UTF-8 of white space beyond ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SEGMENT = re.compile(rb"(?: +|\A)[^ ]*(?:(?<=[\t-\r ]) +[^ ]*)*")
LONG = 64


def segments(text: bytes) -> list[bytes]:
    if WIDE.search(text):
        return [text]
    return SEGMENT.findall(text) if text else []


def spelling() -> dict[str, int]:
    """The byte level's alphabet: visible bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """Ids of texts (UTF-8) as the tokenizers library gives them for the file at path.

    With `special`, special strings inside texts get their ids, as is the library's default; without, they are plain text. If the file's
    pattern is the one above and its merges are numbered in order, new segments are merged by tiktoken from the same vocabulary, else by the library,
    whole texts at a time.
    """

    def __init__(self, path: str, special: bool = True, hold: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.hold = Tokenizer.from_file(path), hold
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        byte, vocab = spelling(), kind["model"]["vocab"]
        names = [t["content"] for t in kind["added_tokens"]] if special else []
        added = {t["content"] for t in kind["added_tokens"]}
        self.token = {i: bytes(byte[c] for c in t) for t, i in vocab.items() if t not in added and all(c in byte for c in t)}
        self.token |= {t["id"]: t["content"].encode() for t in kind["added_tokens"]}
        self.special = re.compile("|".join(re.escape(n) for n in names).encode()) if names else None
        self.width = "<u2" if max(self.token) < 1 << 16 else "<u4"
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in kind["model"]["merges"]]
        cut = kind["pre_tokenizer"] or {}
        self.by_segment = (cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and kind["normalizer"] is None
                           and not any(re.search(r"\s", n) for n in names) and not any(t[k] for t in kind["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
                           and all(vocab[m] == 256 + i for i, m in enumerate(merged)) and set(vocab.values()) >= set(range(256)))
        if self.by_segment:
            ranks = {self.token[i]: i for t, i in vocab.items() if t not in added}
            self.merge = tiktoken.Encoding("segments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}

    def plain(self, segment: bytes) -> list[int]:
        """Ids of a segment by itself."""
        if self.by_segment and not (self.special and self.special.search(segment)):
            return self.merge(segment.decode("utf-8"))
        return self.library.encode(segment.decode("utf-8"), add_special_tokens=False).ids

    def learn(self, segment: bytes) -> bytes:
        ids = np.array(self.plain(segment), self.width).tobytes()
        if len(segment) <= LONG:
            if len(self.known) >= self.hold:
                self.known.clear()
            self.known[segment] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        """The ids, packed in integers of self.width."""
        if not self.by_segment:
            return np.array(self.plain(text), self.width).tobytes() if text else b""
        get, learn = self.known.get, self.learn
        return b"".join([get(s) or learn(s) for s in segments(text)])
