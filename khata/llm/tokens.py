"""Whole texts to token ids with the tokenizers library.

No pre-token of the two tokenizers spans the place where a space meets the word before it, so a text
falls into chunks that are encoded apart, and each different chunk is encoded once per worker. A
chunk's ids are kept as little-endian unsigned 32-bit bytes, and those of a text are their join. A text
that holds one of the tokenizer's added tokens goes to the library whole: they match before all else, also
inside words, and end the runs of spaces beside them.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

#: White space of the Unicode property White_Space, as the tokenizers' patterns read it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII signs but for the apostrophe.
SIGNS = r"[!-&(-/:-@\[-`{-~]+"
#: Marks that compose with a capital of ASCII alone (I with a dot) or with its small letter alone (h, j, t, w, y), also within
#: a longer mark: normal form comes before lower case, so words with them may not be lower-cased first.
ONE_CASE = re.compile("[\u0307\u0308\u030a\u030c\u0331\u0344]")
#: Chunks kept by each worker, by kind; beyond it the memory starts anew.
MEMORY = {"byte": 1_000_000, "word": 500_000}


class Encoder(dict):
    """encode(texts) -> bytes of each, for kind "byte" (byte-level, spaces belong to words) or "word" (white space dropped).

    As a dict: a chunk's bytes. For the byte kind a key is what follows the space that leads the chunk, or,
    where none leads, the chunk and a space.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Any text may hold an added token that matches normalised text.
        self.always_whole = self.tokenizer.normalizer is not None and any(t.normalized for t in added)
        self.added = [t.content if kind == "byte" else t.content.encode().lower().decode() for t in added]
        self.spaced, self.memory = kind == "byte", MEMORY[kind]
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+" if self.spaced else f"[^{WHITE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the patterns do not
        letters = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
        self.plain, self.stop = re.compile(letters), re.compile(f"({letters})({SIGNS})")
        self.model = self.tokenizer.model
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokenizers show as themselves
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.space = chr(self.shown[32])

    def __missing__(self, key: str) -> bytes:
        bare = self.spaced and key[-1:] == " "  # no space leads
        word = key[:-1] if bare else key
        if word.isascii() and word.isalpha():
            shown = word
        elif self.plain.fullmatch(word):
            shown = (word if self.spaced else word.lower()).encode().decode("latin-1").translate(self.shown)
        else:
            if "\n" in word:  # words over line ends are hardly met again
                parts = self.split_odd(word if bare or not self.spaced else f" {word}")
                if len(parts) > 1:
                    return b"".join([self[p] for p in parts])
            if end := self.stop.fullmatch(word):  # letters, and the signs after them, are pre-tokens
                tail = f"{end[2]} " if self.spaced else end[2]
                ids = self[f"{end[1]} " if bare else end[1]] + self[tail]
            else:
                ids = array("I", self.tokenizer.encode(word if bare or not self.spaced else f" {word}", add_special_tokens=False).ids).tobytes()
            return self._keep(key, ids)
        # A word of letters alone is one pre-token, so it goes to the tokenizer's model at once.
        lead = "" if bare or not self.spaced else self.space
        return self._keep(key, array("I", [t.id for t in self.model.tokenize(lead + shown)]).tobytes())

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self) >= self.memory:
            self.clear()
        self[key] = ids
        return ids

    def split_odd(self, text: str) -> list[str]:
        found = self.chunks.findall(text)
        return [c[1:] if c[0] == " " and (c == " " or c[-1] != " ") else f"{c} " for c in found] if self.spaced else found

    def split(self, text: str) -> list[str] | None:
        """The text's chunks; None if it must be encoded whole."""
        low = text if self.spaced else text.encode().lower().decode()  # also what only now looks like an added token may not stand in a chunk
        if self.always_whole or any(t in low for t in self.added):
            return None
        if not self.spaced:
            if text.isascii() or not ONE_CASE.search(text):
                text = low
            else:  # words with such marks keep their capitals
                text = self.chunks.sub(lambda m: m[0] if ONE_CASE.search(m[0]) else m[0].encode().lower().decode(), text)
            return self.split_odd(text) if self.odd.search(text) else text.split()
        if "  " in text or text.endswith(" "):
            return self.split_odd(text)
        words = text.split(" ")
        words[0] += " "
        return words

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.__getitem__
        return [self.whole(t) if (chunks := self.split(t)) is None else b"".join(map(known, chunks)) for t in texts]


    def encode_column(self, texts: pa.Array, *more: int) -> pa.ListArray:
        """The ids of every text of a column, and more ids after them, for the byte kind.

        The column is cut at spaces, and the different words into letters and the signs after them, by Arrow; each
        different part is looked up once.
        """
        odd = [pc.match_substring(texts, t) for t in ("  ", *self.added)] + [pc.ends_with(texts, " ")]
        whole = np.flatnonzero(reduce(pc.or_, odd).to_numpy(zero_copy_only=False) | self.always_whole)
        left = np.setdiff1d(np.arange(len(texts)), whole)
        parts = pc.split_pattern(texts.take(pa.array(left)) if len(whole) else texts, " ")
        words = pc.dictionary_encode(parts.flatten())
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]).astype(np.int64)
        number, different = words.indices.to_numpy(), words.dictionary
        found = pc.extract_regex(different, f"^(?P<word>{self.plain.pattern})(?P<signs>{SIGNS})$")
        plain = pc.is_null(found)
        heads = pc.dictionary_encode(pc.if_else(plain, different, pc.struct_field(found, "word")))
        tails = pc.dictionary_encode(pc.if_else(plain, "", pc.struct_field(found, "signs")))
        firsts = different.take(pa.array(number[cuts[:-1]])) if len(left) else different.slice(0, 0)
        listed = lambda x: x.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.__getitem__, listed(heads.dictionary)))
        n_heads = len(known)
        known += [self[f"{t} "] if t else b"" for t in listed(tails.dictionary)]
        first = len(known)
        known += [self[f"{w} "] for w in listed(firsts)]  # no space leads a text's first word
        end = len(known)
        known += [b"", np.array(more, "<u4").tobytes()] + self.encode([texts[int(k)].as_py() for k in whole])
        order = np.empty((len(number), 2), np.int64)
        order[:, 0] = heads.indices.to_numpy()[number]
        order[:, 1] = n_heads + tails.indices.to_numpy()[number]
        order[cuts[:-1], 0] = first + np.arange(len(left))
        order[cuts[:-1], 1] = end
        pieces, at = [], 0
        for nth, k in enumerate(whole):  # few: texts between two of them go as they are
            before = int(k) - nth
            pieces += [_with_ends(order, cuts[at : before + 1], end + 1), np.array([end + 2 + nth, end + 1])]
            at = before
        order = np.concatenate([*pieces, _with_ends(order, cuts[at:], end + 1)])
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[order]
        upto = np.cumsum(own)
        ids = np.frombuffer(b"".join(known), "<i4")[np.repeat(starts[order] - (upto - own), own) + np.arange(int(upto[-1]) if len(upto) else 0)]
        offsets = np.concatenate([[0], upto[order == end + 1]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def _with_ends(order: np.ndarray, cuts: np.ndarray, end: int) -> np.ndarray:
    """The rows cuts[0] to cuts[-1] of order in one line, with end after each piece."""
    return np.insert(order[cuts[0] : cuts[-1]].ravel(), 2 * (cuts[1:] - cuts[0]), end)


def encoder(path: str, kind: str) -> Encoder:
    """One for each worker process."""
    return remembered((path, kind), lambda: Encoder(path, kind))


def in_parts(texts: list, most: int = 2_000_000):
    """Slices of a batch with about so many characters each, at least one text; of texts or their lengths."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += t if isinstance(t, int) else len(t)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
