"""Byte-pair encoding, word by word with a bounded memo, where no token crosses a blank.

For vocabularies with an end-of-word suffix that lower letters, drop white space and take
runs of letters as pre-tokens: the ids of a text are those of what stands between its blanks,
in turn, and a full stop or comma after letters is a pre-token of its own. Each distinct word
goes to the tokenizers library once while the memo lasts. Texts that may hold an added token,
and all texts if the tokenizer works otherwise, go to the library as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np

from loamgraph.llm._common import resident
from loamgraph.llm.bpe import PieceEncoder, added_token_hint, piece_encoder

#: The steps before the model for which words can be taken one by one (fixed values).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bounds of the memo: words, and their characters.
MEMO_WORDS, MEMO_CHARS = 500_000, 12_000_000
#: Words of letters are encoded so many at a time, as one text.
JOINED = 2000


def _latin(text: str) -> bool:
    """No sign beyond Latin-1: normal form C and lower case then take each letter by itself."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _word_by_word(settings: dict) -> bool:
    split = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return bool(settings["model"].get("end_of_word_suffix")) and (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and bool(split.get("invert"))


class WordEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers in bytes."""

    dtype = np.dtype("<u4")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.tokenizer, self._letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self._letters):
            t.no_truncation()
            t.no_padding()
        self._splits = _word_by_word(settings)
        if self._splits:  # words of lower letters need no normalizer and no pattern
            self._letters.normalizer = None
            self._letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = settings["model"]["end_of_word_suffix"]
            self._ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self._ends[i] = token.endswith(suffix)
        self._special = added_token_hint(self.tokenizer).search
        self._memo: dict[str, bytes] = {"": b""}
        self._chars = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        memo, letters, marked, rest = self._memo, set(), [], []
        for w in new:
            stem = w[:-1] if w[-1] in ".," else w
            if stem.isalpha() and stem.islower() and _latin(stem):
                if stem not in memo:
                    letters.add(stem)
                if stem is not w:
                    marked.append(w)
            else:
                rest.append(w)
        stems = list(letters)
        for at in range(0, len(stems), JOINED):
            part = stems[at : at + JOINED]
            ids = np.array(self._letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part):  # a word with an end within
                memo.update(zip(part, self._ids(part)))
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(part, stops):
                memo[w] = data[start:stop]
                start = stop
        memo.update(zip(rest, self._ids(rest) if rest else ()))
        ends = dict(zip(".,", self._ids([".", ","])))
        for w in marked:
            memo[w] = memo[w[:-1]] + ends[w[-1]]
        self._chars += sum(map(len, new)) + sum(map(len, stems))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, x in enumerate(texts) if not self._splits or self._special(x)]
        by_library = dict(zip(whole, self._ids([texts[i] for i in whole]) if whole else ()))
        words = [() if i in by_library else (x.lower() if _latin(x) else x).replace("\n", " ").replace("\t", " ").split(" ") for i, x in enumerate(texts)]
        if len(self._memo) > MEMO_WORDS or self._chars > MEMO_CHARS:
            self._memo, self._chars = {"": b""}, 0
        self._learn(list(set().union(*words).difference(self._memo)))
        get = self._memo.__getitem__
        return [by_library[i] if i in by_library else b"".join(map(get, w)) for i, w in enumerate(words)]


def encoder(path: str) -> WordEncoder | PieceEncoder:
    """The encoder that suits the vocabulary, one for each Python worker."""
    with open(path, encoding="utf-8") as f:
        words = bool(json.load(f)["model"].get("end_of_word_suffix"))
    return resident(("words", path), lambda: WordEncoder(path)) if words else piece_encoder(path)
