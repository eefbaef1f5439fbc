"""Token ids of whole texts from public vocabulary files, with a cache of words in front of the tokenizer.

A text is cut into the pieces that the tokenizer itself would cut it into, and a piece's ids are looked up; only pieces that are
new to the worker go through the tokenizer.  This needs the cut to be the same in both, so texts with characters outside
ASCII and Latin letters, with control characters or with the strings of special tokens go through the tokenizer whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Callable

#: Words held in each of two generations of the cache of a Python worker.
CACHE_WORDS = 100_000

_CATEGORY = {c: unicodedata.category(chr(c))[0] for c in range(128, 0x300)}


def _class(kind: str) -> str:
    return "".join(chr(c) for c, k in _CATEGORY.items() if k == kind)


_L, _N = "A-Za-z" + _class("L"), "0-9" + _class("N")
#: Plain characters are those that stay plain in lower case, too: some letters below U+0300 have small ones far above.
_PLAIN = re.compile("[\t\n\r\x20-\x7e" + "".join(re.escape(chr(c)) for c in range(0xA1, 0x300) if all(ord(x) < 0x300 for x in chr(c).lower())) + "]*")
# The cutting patterns of the two vocabularies, \p{L} and \p{N} spelt out for the plain characters.
_PIECES = {
    "word_bpe_49k.json": rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+",
    "byte_bpe_50k.tiktoken": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+",
}
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Two generations of a bounded cache: what is used again moves to the young one."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode, self.young, self.old = encode, {}, {}

    def of(self, pieces: list[str]) -> bytes:
        young, old = self.young, self.old
        fresh = set(pieces).difference(young)
        if fresh:
            if len(young) + len(fresh) > CACHE_WORDS:
                self.old, self.young = young, {p: young[p] for p in set(pieces) if p in young}
                young, old = self.young, self.old
            new = []
            for p in fresh:
                if (b := old.get(p)) is not None:
                    young[p] = b
                else:
                    new.append(p)
            young.update(zip(new, self.encode(new), strict=True))
        return b"".join(map(young.__getitem__, pieces))


_open: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """text -> ids as 16-bit little-endian integers; one for each file and worker.  A .json file is opened with tokenizers
    (`add_special_tokens=False`), a .tiktoken file with tiktoken (ordinary text only)."""
    if path not in _open:
        _open[path] = _ranks(path) if path.endswith(".tiktoken") else _bpe(path)
    return _open[path]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def _bpe(path: str) -> Callable[[str], bytes]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    pattern = _PIECES.get(path.rpartition("/")[2])
    if pattern is None:
        return lambda text: array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()
    cut, letters, merge = re.compile(pattern).findall, _byte_letters(), whole.model.tokenize

    def new(pieces: list[str]) -> list[bytes]:
        """Pieces are lower-case and normal already, so only the merges are left to do."""
        return [array("H", [t.id for t in merge(p.encode().decode("latin-1").translate(letters))]).tobytes() for p in pieces]

    words = Words(new)

    def run(text: str) -> bytes:
        if _PLAIN.fullmatch(text) and not any(s in text for s in _SPECIAL):
            return words.of(cut(text.lower()))
        return array("H", whole.encode(text, add_special_tokens=False).ids).tobytes()

    return run


def _ranks(path: str) -> Callable[[str], bytes]:
    import base64

    import tiktoken

    pattern = _PIECES["byte_bpe_50k.tiktoken"]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    words = Words(lambda new: [array("H", whole.encode_ordinary(p)).tobytes() for p in new])
    cut = re.compile(pattern).findall

    def run(text: str) -> bytes:
        return words.of(cut(text)) if _PLAIN.fullmatch(text) else array("H", whole.encode_ordinary(text)).tobytes()

    return run
