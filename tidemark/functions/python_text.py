"""The text comparisons of text.py for Python code inside folds, with bounded memory of normalized forms."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

from .. import schema as s

_DROP = regex.compile(r"[\s\p{P}\p{S}]")
_STABLE, _VARIANT = regex.compile(r"一\p{Han}{3,}"), regex.compile(r"[-−—–]\p{Han}{3,}")


@lru_cache(maxsize=10_000)
def normalize(text: str) -> str:
    return _DROP.sub("", unicodedata.normalize("NFKC", text)).lower()


def same(a: str, b: str) -> bool:
    return normalize(a) == normalize(b) and a.count("\n") == b.count("\n")


def partial(short: str, whole: str) -> bool:
    if short.count("\n") != whole.count("\n"):
        return False
    a, b = normalize(short), normalize(whole)
    missing = len(b) - len(a)
    if len(a) < s.PARTIAL_LENGTH or missing <= 0 or len(a) / len(b) < s.PARTIAL_RATIO or missing > max(s.PARTIAL_LEAST, int(s.PARTIAL_SHARE * len(b))):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


@lru_cache(maxsize=10_000)
def similarity(a: str, b: str) -> float:
    x, y = normalize(a), normalize(b)
    if not x or not y:
        return float(x == y)
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return 1 - row[-1] / max(len(x), len(y))


def related(a: str, b: str) -> bool:
    return partial(a, b) or partial(b, a) or similarity(a, b) >= s.RELATED


def stroke(stable: str, variant: str) -> bool:
    return bool(_STABLE.fullmatch(stable) and _VARIANT.fullmatch(variant)) and stable[1:] == variant[1:]
