"""Token ids of a public byte-level BPE with word ends, by white-space separated word.

The vocabulary file's own library defines the ids. Encoding is independent for
each word, so answers are kept for words already seen, in two generations of
bounded size. New words of Latin letters, digits and punctuation are split here
and merged many at a time by a faster merger that orders merges by the rank of
the merged token; ``merge_ranks`` shows from the file alone whether that gives
the same ids. All other words, and files for which it doesn't, are encoded by
the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched, pairwise

_LATIN = [chr(c) for c in range(0x250) if c != 0x130]
_L = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
#: Characters beyond the letters of the splitting rule, in lower case too, and the start of special tokens.
_OTHER = re.compile(f"[^\n{''.join(re.escape(c) for c in _LATIN if c.isprintable() and c > ' ' and c.lower() in _LATIN)}]|<\\|")
#: The library's rules that the splitting above stands for.
RULES = {
    "end_of_word_suffix": "</w>",
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "normalizers": ["NFC", "Replace", "Lowercase"],
}
#: Bytes that one generation of kept words may take, by estimate.
KEPT_BYTES = 32 << 20
#: Characters of texts that are looked up together.
GROUP_CHARS = 1 << 18


def _byte_values() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others for 256 and up."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merged(symbols: list[str], order: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging of one word as it is defined: the earliest listed pair first, from the left."""
    while len(symbols) > 1:
        first = min(pairwise(symbols), key=lambda p: order.get(p, len(order)))
        if first not in order:
            break
        out, i = [], 0
        while i < len(symbols):
            step = 2 if tuple(symbols[i : i + 2]) == first else 1
            out.append("".join(symbols[i : i + step]))
            i += step
        symbols = out
    return symbols


@lru_cache
def merge_ranks(path: str) -> frozenset[int] | None:
    """Whether merging by the merged token's id gives the ids of the pair list: the ids then to leave out, else None.

    Parts that cover a token exactly are a state of merging that token alone, as
    nothing has crossed its ends. If merging a token alone ends in it, its last
    two parts are its listed pair, so no other pair of parts can ever make it;
    a token that it doesn't end in is never made in any word. What remains is
    that ids grow in the order of the list.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec["normalizer"].get("normalizers", [])
    split = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
    if model["end_of_word_suffix"] != RULES["end_of_word_suffix"] or split != [RULES["pattern"]] or [s["type"] for s in steps] != RULES["normalizers"]:
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, order = model["vocab"], {p: i for i, p in enumerate(pairs)}
    made = [vocab["".join(p)] for p in pairs]
    base = [i for t, i in vocab.items() if len(t.removesuffix("</w>")) == 1]
    if any(a >= b for a, b in pairwise(made)) or len(base) != 512 or max(base) >= made[0]:
        return None
    suffix = lambda t: [*t[:-5], t[-5:]] if t.endswith("</w>") else [*t]
    return frozenset(i for t, i in vocab.items() if len(_merged(suffix(t), order)) > 1)


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes; ``unmade`` is what ``merge_ranks`` gave."""

    def __init__(self, path: str, unmade: frozenset[int] | None):
        import numpy as np
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.model._resize_cache(0)  # words are kept here
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.ranks = None
        if unmade is not None:
            import tiktoken

            value, special = _byte_values(), {t.content for t in self.lib.get_added_tokens_decoder().values()}
            # A space, which no word holds, stands for the end of a word.
            text = lambda t: bytes(map(value.__getitem__, t.removesuffix("</w>"))) + (b" " if t.endswith("</w>") else b"")
            ranks = {text(t): i for t, i in vocab.items() if i not in unmade and t not in special}
            self.ranks = tiktoken.Encoding("words", pat_str=r"\S+ ", mergeable_ranks=ranks, special_tokens={})
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def _keep(self, words: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(words, ids, strict=True))
        self.held += 230 * len(words) + sum(map(len, words)) + sum(map(len, ids))

    def _learn(self, words: list[str]) -> None:
        """Encodes new words; each part of a word ends with its only id that ends a word."""
        import numpy as np

        plain, rest = [], words
        if self.ranks and not _OTHER.search("\n".join(words)):
            plain, rest = words, []
        elif self.ranks:
            rest = [w for w in words if _OTHER.search(w)]
            plain = list(set(words).difference(rest))
        if plain:
            marked = _SPLIT.sub(r"\g<0> ", "\n".join(plain).lower())
            packed = self.ranks.encode_to_numpy(marked)
            ends = np.append(0, np.flatnonzero(self.last[packed]) + 1)
            parts = np.fromiter((w.count(" ") for w in marked.split("\n")), np.int64, len(plain))
            raw, at = packed.tobytes(), (4 * ends[np.append(0, np.cumsum(parts))]).tolist()
            self._keep(plain, [raw[a:b] for a, b in pairwise(at)])
        if rest:
            self._keep(rest, [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(rest, add_special_tokens=False)])

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if self.held > KEPT_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        # The library doesn't take these four for white space, str.split() does.
        split = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        new = set().union(*filter(None, split)).difference(self.young)
        if self.old:
            seen = [w for w in new if w in self.old]
            self._keep(seen, [self.old[w] for w in seen])
            new.difference_update(seen)
        for words in batched(new, 4096):
            self._learn(list(words))
        for text, s in zip(texts, split, strict=True):
            if s is None:
                yield array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                yield b"".join(map(self.young.__getitem__, s))

    def texts(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        some, chars = [], 0
        for text in texts:
            some.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self._group(some)
                some, chars = [], 0
        yield from self._group(some)

    def text(self, text: str) -> bytes:
        return next(self.texts([text]))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str, unmade: frozenset[int] | None) -> WordIds:
    """One vocabulary for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path, unmade)
    return _LOADED[path]
