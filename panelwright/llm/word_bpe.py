"""Whole texts to ids with the tokenizers library, each distinct white-space-free chunk once per worker.

The vocabulary's pre-tokenizer never lets a piece cross white space, and neither Unicode composition
nor case mapping crosses it, so a text's ids are its chunks' ids in a row.  Chunks are cut at the four
ASCII blanks only; whatever else counts as white space stays inside a chunk and is left to the library.
"""
from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import claim_worker

#: Distinct chunks in one generation of a worker's memo; two are held, so that common chunks outlive a turn.  Bounds memory, not results.
MEMO = 700_000
_CHUNK = re.compile(r"[^ \t\n\r]+").findall
#: White space of str.split() beyond the ASCII blanks: texts with any are cut at the four blanks alone.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_MARKS = frozenset(".,!?;:")
#: The normalizer and pre-tokenizer of a vocabulary file for which cutting at blanks is exact.  Files with any
#: other are encoded whole text by whole text.
NORMALIZERS = ["NFC", r"Replace \s+", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that NORMALIZERS and SPLIT describe."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [" ".join(filter(None, (n["type"], (n.get("pattern") or {}).get("Regex")))) for n in norm.get("normalizers", [])]
    splits = [(s.get("pattern") or {}).get("Regex") for s in pre.get("pretokenizers", []) if s["type"] == "Split"]
    prefixed = any(s.get("add_prefix_space") for s in pre.get("pretokenizers", []))
    return kinds == NORMALIZERS and splits == [SPLIT] and not prefixed


def chunks_of(text: str) -> list[str]:
    return _CHUNK(text) if _OTHER_BLANK(text) else text.split()


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_chunk = cuts_at_blanks(json.load(f))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        self.code = "H" if self.width == 2 else "I"
        special = [t for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.parting = special[0].content if special else ""
        self.parting_id = self.tokenizer.token_to_id(self.parting) if special else -1
        self.closing = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.closing[[i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        self.base: dict[str, bytes] = {}

    def library(self, chunks: list[str], into: dict[str, bytes]) -> None:
        """Many chunks to a call, parted by a special token where there is one: the library takes those out before all else."""
        lines = [chunks[k : k + 128] for k in range(0, len(chunks), 128)]
        made = self.tokenizer.encode_batch_fast([self.parting.join(c) for c in lines], add_special_tokens=False) if self.parting else [None] * len(lines)
        for part, e in zip(lines, made):
            ids = np.array(e.ids if e else [], self.dtype)
            cuts = np.flatnonzero(ids == self.parting_id)
            if e is None or len(cuts) != len(part) - 1:
                for chunk, one in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    into[chunk] = array(self.code, one.ids).tobytes()
                continue
            raw, w = ids.tobytes(), self.width
            for chunk, start, stop in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                into[chunk] = raw[start * w : stop * w]

    def letters(self, words: list[str], into: dict[str, bytes]) -> None:
        """Words of Latin-1 letters alone are one pre-token each, so many go through one call; an end-of-word id closes each."""
        lines = [words[k : k + 256] for k in range(0, len(words), 256)]
        for part, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(w) for w in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.closing[ids]) + 1) * self.width
            if len(cuts) != len(part):
                self.library(part, into)
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(part, cuts.tolist()):
                into[word] = raw[at:stop]
                at = stop

    def learn(self, chunks: list[str]) -> None:
        """Words of letters that differ in case or in one closing mark alone share the library's work: the vocabulary maps
        case away and always parts a letter from the mark after it.  Only Latin-1 letters are so reduced, where case
        mapping has no context; all other chunks go to the library as they are."""
        plain, reduced, memo, base = [], [], self.memo, self.base
        for c in chunks:
            if c.isalpha():
                b, m = c, ""
            elif c[-1] in _MARKS and c[:-1].isalpha():
                b, m = c[:-1], c[-1]
            else:
                plain.append(c)
                continue
            if b.isascii() or max(b) < "\u0100":
                reduced.append((c, b.lower(), m))
            else:
                plain.append(c)
        self.library(plain, memo)
        if len(base) > MEMO:
            base = self.base = {}
        self.letters(list({b for _, b, _ in reduced}.difference(base)), base)
        self.library([m for m in _MARKS if m not in base], base)
        for c, b, m in reduced:
            memo[c] = base[b] + base[m] if m else base[b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed in the narrowest unsigned type that holds the vocabulary."""
        out: list[bytes] = []
        if not self.by_chunk:
            return [array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        for at in range(0, len(texts), 256):
            found = [chunks_of(t) for t in texts[at : at + 256]]
            if len(self.memo) > MEMO:
                self.memo, self.past = {}, self.memo
            get, past = self.memo.get, self.past
            ids = [list(map(get, f)) for f in found]
            gaps = [[k for k, x in enumerate(v) if x is None] for v in ids]
            if new := {f[k] for f, g in zip(found, gaps) for k in g}:
                if past:
                    known = {c: past[c] for c in new if c in past}
                    self.memo.update(known)
                    new.difference_update(known)
                self.learn(list(new))
                for f, v, g in zip(found, ids, gaps):
                    for k in g:
                        v[k] = get(f[k])
            out += map(b"".join, ids)
        return out


_OPEN: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker."""
    if path not in _OPEN:
        _OPEN[path] = ChunkEncoder(path)
    claim_worker("chunks", _OPEN[path].forget)
    return _OPEN[path]
