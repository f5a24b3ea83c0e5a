"""Token ids of whole texts."""

import functools
import json
import re

import numpy as np

# fixed value: the split pattern of byte-level BPE vocabularies of this kind
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of a text that are encoded at once, where it can be cut.
SEGMENT = 1 << 16
#: White space in a row that the fast encoder's pattern search still bears; a stretch with more goes to the library.
SAFE_RUN = 50_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(rf"\s{{{SAFE_RUN}}}")


def segments(text: str, size: int = SEGMENT):
    """Consecutive parts of a text of about size characters, cut before a single space between other characters.

    The split pattern lets a space start a piece or stand in a run of white
    space, never end a piece that begins with something else: so the parts'
    pieces are the whole text's. A text without such a space is one part.
    """
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in such a file: itself if it prints, else one from 256 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + n): b for n, b in enumerate(rest)}


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def ranks_of(whole: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file of the tokenizers library, or None if ids are not in the order of the merges."""
    model, split = whole["model"], whole["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if model["type"] != "BPE" or whole["normalizer"] is not None or not plain:
        return None
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merged]
    if None in ids or any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    signs = _byte_signs()
    return {bytes(signs[c] for c in token): n for token, n in model["vocab"].items() if all(c in signs for c in token)}


class Encoder:
    """Ids by a byte-level BPE file of the tokenizers library.

    With special, the file's added tokens are cut out of a text first and get
    their own ids, as by the library's default; else they are ordinary text.
    Where the file's ids are in the order of its merges, tiktoken applies the
    same merges by rank, several times faster, and long texts are encoded part
    by part; else, and for a part with SAFE_RUN white-space characters in a row,
    the library itself encodes. size is the number of ids.
    """

    def __init__(self, path: str, special: bool = False):
        whole = _read(path)
        self.path, self.special = path, special
        self.size = 1 + max([*whole["model"]["vocab"].values(), *(t["id"] for t in whole["added_tokens"])])
        ranks = ranks_of(whole)
        self.added = {t["content"]: t["id"] for t in whole["added_tokens"]} if special else {}
        plain = not any(t.get(k) for t in whole["added_tokens"] for k in ("lstrip", "rstrip", "single_word")) or not special
        self.coder = None
        if ranks and plain:
            import tiktoken

            ranks = {token: n for token, n in ranks.items() if n not in self.added.values()}
            self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            longest_first = sorted(self.added, key=len, reverse=True)
            self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = not self.special
        return tokenizer

    def _by_library(self, text):
        return self.library.encode(text, add_special_tokens=False).ids

    def _ordinary(self, text):
        if len(text) < SAFE_RUN:
            return self.coder.encode_ordinary(text)
        out = []
        for part in segments(text):
            out += self._by_library(part) if _RUN.search(part) else self.coder.encode_ordinary(part)
        return out

    def encode(self, text: str) -> list[int]:
        if self.coder is None:
            return self._by_library(text)
        if not self.added or not any(token in text for token in self.added):
            return self._ordinary(text)
        out = []
        for n, part in enumerate(self.marks.split(text)):
            if n % 2:
                out.append(self.added[part])
            elif part:
                out += self._ordinary(part)
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of a text; a null has none."""
        return np.array(self.encode(text) if text else [], np.uint32)


@functools.lru_cache(maxsize=1)
def encoder(path: str, special: bool = False) -> Encoder:
    return Encoder(path, special)
