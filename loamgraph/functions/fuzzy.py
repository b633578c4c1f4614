"""Similarity of names by longest common subsequences, from 0 to 100."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations of first names.
ABBREVIATIONS = {
    "wm": "william", "chas": "charles", "geo": "george", "jas": "james", "jno": "john", "thos": "thomas", "robt": "robert", "benj": "benjamin",
    "danl": "daniel", "edw": "edward", "fredk": "frederick", "saml": "samuel",
}


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of columns at a time."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


#: Kinds of bigrams and of letters that are told apart, and pairs taken at once.
BIGRAMS, LETTERS, AT_ONCE = 128, 64, 1 << 18


def codes(strings: list[str]) -> np.ndarray:
    """A row of characters for each of these strings of one length."""
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).reshape(len(strings), -1)


def _counts(of: np.ndarray, kinds: int) -> np.ndarray:
    at = np.arange(len(of))[:, None] * kinds + of % kinds
    return np.bincount(at.ravel(), minlength=len(of) * kinds).reshape(len(of), kinds)


def common_of(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """common() of rows r of x with rows c of y, which have up to 63 characters in x."""
    letters, of_x = np.unique(x, return_inverse=True)
    of_x = of_x.reshape(x.shape)
    where = np.zeros((len(x), len(letters) + 1), np.uint64)
    for i in range(x.shape[1]):
        where[np.arange(len(x)), of_x[:, i]] |= np.uint64(1 << i)
    at = np.minimum(np.searchsorted(letters, y), len(letters) - 1)
    of_y = np.where(letters[at] == y, at, len(letters))
    full = np.uint64((1 << x.shape[1]) - 1)
    row = np.full(len(r), full)
    for i in range(y.shape[1]):
        hit = row & where[r, of_y[c, i]]
        row = (row + hit | row - hit) & full
    return x.shape[1] - np.bitwise_count(row).astype(np.int64)


class Strings:
    """Strings of one length with their numbers of bigrams and letters."""

    def __init__(self, strings: list[str]):
        self.strings, self.codes = strings, codes(strings)
        self.bigrams = _counts(self.codes[:, :-1] * np.uint32(31) + self.codes[:, 1:] * np.uint32(7), BIGRAMS).astype(np.float32)
        self.letters = np.minimum(_counts(self.codes, LETTERS), 255).astype(np.uint8)


def alike_pairs(x: Strings, y: Strings, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose ratio is ``least`` (of 1) or more; of one and the same strings each pair once.

    What is common to strings of m and n characters, L at least, leaves 3 L - m - n - 1 of its pairs
    of neighbours side by side in both, so they share as many bigrams and L letters. Bigrams are
    counted as a product of matrices.
    """
    m, n = x.codes.shape[1], y.codes.shape[1]
    need = int(np.ceil((least - 1e-5) * (m + n) / 2))
    r, c = np.divmod(np.flatnonzero(x.bigrams @ y.bigrams.T >= 3 * need - m - n - 1), len(y.strings))
    if x is y:
        r, c = r[r < c], c[r < c]
    found = []
    for a in range(0, len(r), AT_ONCE):
        i, j = r[a : a + AT_ONCE], c[a : a + AT_ONCE]
        keep = np.minimum(x.letters[i], y.letters[j]).sum(1, dtype=np.uint8) >= need if max(m, n) < 256 else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        if min(m, n) > 63:
            held = np.array([common(x.strings[p], y.strings[q]) for p, q in zip(i.tolist(), j.tolist())], np.int64)
        else:
            held = common_of(x.codes, y.codes, i, j) if m <= n else common_of(y.codes, x.codes, j, i)
        found.append((i[held >= need], j[held >= need]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (r, c)


def ratio(a: str, b: str) -> float:
    """Twice what is common, of both lengths; two empty strings are alike."""
    n = len(a) + len(b)
    return 200 * common(a, b) / n if n else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: what both share against each whole, and the wholes against one another."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_a, only_b = (" ".join(sorted(s - (x & y))) for s in (x, y))
    if both and not (only_a and only_b):
        return 100.0
    gap = 1 if both else 0
    size_a, size_b = (len(both) + gap + len(s) for s in (only_a, only_b))
    far = len(only_a) + len(only_b) - 2 * common(only_a, only_b)
    scores = [100 - 100 * far / (size_a + size_b)]
    if both:
        scores += [100 - 100 * (gap + len(s)) / (len(both) + n) for s, n in ((only_a, size_a), (only_b, size_b))]
    return max(scores)


def _short_for(a: str, b: str) -> bool:
    a = a.rstrip(".")
    return b.startswith(a) if len(a) == 1 else a == b or ABBREVIATIONS.get(a, a) == b


def parts_score(a: str, b: str) -> float:
    """How well the parts of two plain names in lower case pair up, from 0 to 1: equal 1, initials and abbreviations 0.8, alike their ratio."""
    x, y = sorted((a.split(), b.split()), key=len) if len(a.split()) != len(b.split()) else (a.split(), b.split())
    if not x or not y:
        return 0.0
    free, got = list(range(len(y))), 0.0
    for p in x:
        for i in free:
            q = y[i]
            alike = ratio(p, q) if min(len(p), len(q)) > 2 else 0.0
            worth = 1.0 if p == q else 0.8 if _short_for(p, q) or _short_for(q, p) else alike / 100 if alike >= 80 else 0.0
            if worth:
                got += worth
                free.remove(i)
                break
    return 0.7 * got / len(x) + 0.3 * got / len(y)


_MARKS, _BLANKS = re.compile(r"[™®©.\-']"), re.compile(r"\s+")


def plain(name: str | None) -> str:
    name = name or ""
    parts = name.split(",")
    if len(parts) == 2:
        name = f"{parts[1].strip()} {parts[0].strip()}"
    return _BLANKS.sub(" ", _MARKS.sub(" ", name)).strip()


def match_score(a: str | None, b: str | None, person: bool) -> float:
    """The best of several measures, from 0 to 1; sets of words count for others than persons only, as families share a name."""
    x, y = plain(a).lower(), plain(b).lower()
    scores = [ratio(x, y) / 100, token_sort(x, y) / 100, parts_score(x, y)]
    return max(scores if person else [*scores, 0.95 * token_set(x, y) / 100])


def first_names_fit(a: str | None, b: str | None) -> bool:
    """Whether two names may be of one person by their first names."""
    x, y = ([p for p in plain(n).lower().split() if len(p) > 1] for n in (a, b))
    if not x or not y:
        return True
    p, q = x[0], y[0]
    return p == q or ABBREVIATIONS.get(p, p) == ABBREVIATIONS.get(q, q) or min(len(p), len(q)) > 2 and ratio(p, q) >= 80


def _ratios(strings: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """ratio() of strings i with strings j, those of two lengths at once."""
    size = np.array([len(x) for x in strings])
    m, n = size[i], size[j]
    out = np.full(len(i), 100.0)
    swap = m > n
    short, long = np.where(swap, j, i), np.where(swap, i, j)
    of = np.minimum(m, n) * (size.max(initial=0) + 1) + np.maximum(m, n)
    order = np.argsort(of, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
        a, b = size[short[at[0]]], size[long[at[0]]]
        if not a:
            out[at] = 100.0 if not b else 0.0
        elif a > 63:
            out[at] = [ratio(strings[p], strings[q]) for p, q in zip(short[at].tolist(), long[at].tolist())]
        else:
            x, r = np.unique(short[at], return_inverse=True)
            y, c = np.unique(long[at], return_inverse=True)
            out[at] = 200 * common_of(codes([strings[k] for k in x]), codes([strings[k] for k in y]), r, c) / (a + b)
    return out


def _numbered(a: pd.Series, b: pd.Series) -> tuple[list, np.ndarray, np.ndarray]:
    """Values of both, each once, and the numbers of those of a and of b."""
    at, values = pd.factorize(pd.concat([a, b], ignore_index=True), use_na_sentinel=False)
    return [None if x is None or x != x else x for x in values], at[: len(a)], at[len(a) :]


def token_sorts(a: pd.Series, b: pd.Series) -> np.ndarray:
    names, i, j = _numbered(a, b)
    return _ratios([" ".join(sorted((x or "").split())) for x in names], i, j)


def match_scores(a: pd.Series, b: pd.Series, person: bool) -> np.ndarray:
    """match_score() of many pairs. Of two different single words of which the ratio is 80 or more all measures are the ratio, or less."""
    names, i, j = _numbered(a, b)
    words = [plain(x).lower() for x in names]
    single = np.array([bool(w) and len(w.split()) == 1 and w == w.strip() for w in words])
    out, plainly = np.empty(len(i)), single[i] & single[j]
    out[plainly] = _ratios(words, i[plainly], j[plainly]) / 100
    for k in np.flatnonzero(~plainly | (out < 0.8)).tolist():
        out[k] = match_score(names[i[k]], names[j[k]], person)
    return out


def _of_two(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return run


def ratios(a: Column, b: Column) -> Column:
    return _of_two(ratio, "double")(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(token_sorts(a, b))

    return run(a, b)


def match(a: Column, b: Column, person: bool) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(match_scores(a, b, person))

    return run(a, b)


def scores(a: Column, b: Column, person: Column) -> Column:
    """(words, best): token_sort_ratio() and match(), by the rules that a column tells, at once."""

    @F.pandas_udf("words double, best double")
    def run(a: pd.Series, b: pd.Series, person: pd.Series) -> pd.DataFrame:
        best = np.empty(len(a))
        for flag in (True, False):
            at = (person == flag).to_numpy()
            if at.any():
                best[at] = match_scores(a[at], b[at], flag)
        return pd.DataFrame({"words": token_sorts(a, b), "best": best})

    return run(a, b, person)


def first_names(a: Column, b: Column) -> Column:
    """Whether first names fit; true where a name is null."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for k in np.flatnonzero(a.notna() & b.notna()).tolist():
            out[k] = first_names_fit(a.iat[k], b.iat[k])
        return pd.Series(out)

    return run(a, b)
