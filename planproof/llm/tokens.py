"""Token ids by a byte-level BPE vocabulary, with the ids of frequent words kept.

Byte-level BPE splits at a lone space between two characters that are not white space, whatever stands
around it, so a text is the concatenation of its space-led words. Their ids are kept per worker process
(bounded), so only new words are encoded. A text with white space runs, or at its end, is encoded whole.
Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

_RUN = re.compile(r"\s\s|\s$")
_ENCODERS: dict[tuple[str, str], "WordIds"] = {}
#: What the fast encoder must encode like the vocabulary's own before a worker uses it: text of several scripts, every
#: character of the Latin and Cyrillic blocks beside letters, digits and spaces, and white space of all kinds.
PROBES = (
    "It's a probe, 12 déjà-vu\n  l'été  100%  你好\t🙂 don't we'LL 's ",
    " ".join(f"{chr(c)}a {chr(c)}1 x{chr(c)}y" for c in range(33, 0x530)),
    "".join(f"a{s}{s}b {s}1{s}" for s in "\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\ufeff"),
    "".join(chr(c) for lo in (0x900, 0xE00, 0x3040, 0x4E00, 0xAC00, 0x1F600, 0xFF00) for c in range(lo, lo + 96)),
)


def encoder(path: str, code: str = "I"):
    """text -> list of ids. The rank file beside the vocabulary, where there is one, encodes the same ids
    several times faster; that is verified on PROBES when a worker starts, else the vocabulary is used."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if code == "H" and (top := max(slow.get_vocab().values(), default=0)) >= 1 << 16:
        raise ValueError(f"{path} has ids up to {top}; 16-bit ids reach 65,535")
    slow.encode_special_tokens = True
    plain = lambda t: slow.encode(t, add_special_tokens=False).ids
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return fast.encode_ordinary if all(fast.encode_ordinary(p) == plain(p) for p in PROBES) else plain


class WordIds(dict):
    """Word -> bytes of the ids of a space and the word; code is an array code: H 2 bytes, I 4 bytes, little-endian.

    Where more than one in MISSES of the words of a window is new although the first window has filled the cache, whole
    texts are encoded faster than words, so the cache goes."""

    LIMIT, WINDOW, MISSES = 200_000, 1 << 19, 20

    def __init__(self, path: str, code: str):
        super().__init__()
        self.encode, self.code = encoder(path, code), code
        self.whole, self.windows, self.words, self.missed = False, 0, 0, 0

    def __missing__(self, word: str) -> bytes:
        ids = array(self.code, self.encode(" " + word)).tobytes()
        self.missed += 1
        if len(self) < self.LIMIT:
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.whole or _RUN.search(text):
            return array(self.code, self.encode(text)).tobytes()
        head, *rest = text.split(" ")
        first = array(self.code, self.encode(head)).tobytes() if head else b""
        out = first + b"".join(map(self.__getitem__, rest))
        self.words += len(rest)
        if self.words >= self.WINDOW:
            self.whole = self.windows > 0 and self.missed * self.MISSES > self.words
            self.windows, self.words, self.missed = self.windows + 1, 0, 0
            if self.whole:
                self.clear()
        return out


def word_ids(path: str, code: str = "I") -> WordIds:
    """This worker's encoder."""
    if (path, code) not in _ENCODERS:
        _ENCODERS[path, code] = WordIds(path, code)
    return _ENCODERS[path, code]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
