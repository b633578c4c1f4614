"""Byte-pair encoding with a bounded memo of pre-tokens.

Byte-level BPE never merges across pre-tokens, so the ids of a text are those of its
pre-tokens in turn; each distinct pre-token goes to the tokenizers library once and its
ids are reused while the memo lasts. Texts that may hold an added token, which the library
looks for before it makes pre-tokens, go to the library as they are.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable

import numpy as np

from loamgraph.llm._common import resident

#: The contractions and white space of the byte-level vocabulary's pre-token pattern (fixed values).
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = r"\t-\r \x85\xa0  -     　"
#: Bounds of the memo: pre-tokens, and their characters.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 16_000_000
#: Missing words are encoded so many at a time, as one text.
JOINED = 2000


def _pattern(letter: str, digit: str, other: str) -> str:
    # Letters come first, as most pre-tokens are words; no contraction begins like them.
    return rf" ?{letter}+|{CONTRACTIONS}| ?{digit}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@functools.lru_cache(maxsize=1)
def _finders() -> tuple:
    """Splitters for texts of ASCII, of Latin-1 and any; classes written out are faster than properties."""
    import regex

    every = [chr(i) for i in range(256)]
    letters, digits = ("".join(c for c in every if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
    return (
        re.compile(_pattern("[A-Za-z]", "[0-9]", rf"[^{SPACE}A-Za-z0-9]")).findall,
        re.compile(_pattern(f"[{letters}]", f"[{digits}]", f"[^{SPACE}{letters}{digits}]")).findall,
        regex.compile(_pattern(r"\p{L}", r"\p{N}", rf"[^{SPACE}\p{{L}}\p{{N}}]")).findall,
    )


def pre_tokens(text: str) -> list[str]:
    ascii_only, latin, full = _finders()
    if text.isascii():
        return ascii_only(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return full(text)
    return latin(text)


def added_token_hint(tokenizer) -> re.Pattern:
    """Matches in every text that holds an added token, whatever the tokenizer's normalizer does to letters: by the signs the token begins with."""
    tokens = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    signs = {re.match(r"[!-/:-@\[-`{-~]*", t).group() for t in tokens}
    return re.compile("|".join(map(re.escape, sorted(signs))) if signs else "(?!)")


class PieceEncoder:
    """Texts to ids, as little-endian unsigned 16-bit (or 32-bit) integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self._special = added_token_hint(self.tokenizer).search
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self._bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        for token, i in vocabulary.items():
            self._bytes[i] = len(token)
        self._memo: dict[str, bytes] = {}
        self._chars = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Words that begin with a blank part again where they were joined, so many are encoded as one text; the tokens' bytes tell their ends."""
        words, rest = [], []
        for w in pieces:
            (words if w[0] == " " and w[1:].isalpha() else rest).append(w)
        size = self.dtype.itemsize
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = self._ids(["".join(part)])[0]
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in part])
            reached = np.cumsum(self._bytes[ids])
            last = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
            if not np.array_equal(reached[last], ends):
                rest += part
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(part, ((last + 1) * size).tolist()):
                self._memo[w] = data[start:stop]
                start = stop
        self._memo.update(zip(rest, [x.tobytes() for x in self._ids(rest)] if rest else ()))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        whole = [i for i, x in enumerate(texts) if self._special(x)]
        ids = iter(self._ids([texts[i] for i in whole]) if whole else ())
        by_library = {i: x.tobytes() for i, x in zip(whole, ids)}
        pieces = [() if i in by_library else pre_tokens(x) for i, x in enumerate(texts)]
        if len(self._memo) > MEMO_ENTRIES or self._chars > MEMO_CHARS:
            self._memo.clear()
            self._chars = 0
        new = list(set().union(*pieces).difference(self._memo))
        self._chars += sum(map(len, new))
        self._learn(new)
        get = self._memo.__getitem__
        return [by_library[i] if i in by_library else b"".join(map(get, p)) for i, p in enumerate(pieces)]


def piece_encoder(path: str) -> PieceEncoder:
    """One for each Python worker, kept from task to task."""
    return resident(("pieces", path), lambda: PieceEncoder(path))
