"""Whether a text is in the language of the intact answers: character models of words, fitted on all intact answers.

Three models of the characters of a word: of four in a row from intact answers, the same from the sources, and of
two in a row from both. A word speaks for the answers' language by how much likelier the first model makes it than
the likelier of the other two. The source's language is known by its own model; words of a language that neither
holds are likelier by the two-character model, which knows no language well. No words of other languages
are listed anywhere.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

_EDGE = "\x02"
_LETTERS = 60  # characters among which an unseen one is sought, about
WORD_MOST = 6.0  # what a word can add or take away at most
LEAST_EVIDENCE = 3.0  # in nats, that a text must give before it is called foreign or not
LEAST_WORDS = 3  # of fewer words, each must be likelier in the sources' language


class CharModel:
    """Characters by the order - 1 before them, interpolated with all shorter contexts (Witten-Bell)."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.counts: list[Counter[str]] = [Counter() for _ in range(order + 1)]  # of strings by length
        self.contexts: list[Counter[str]] = [Counter() for _ in range(order)]  # what comes before, by length
        self.kinds: list[Counter[str]] = [Counter() for _ in range(order)]  # different characters after a context
        self.cache: dict[str, float] = {}

    def fit(self, words: dict[str, float]) -> CharModel:
        for w, n in words.items():
            s = _EDGE * (self.order - 1) + w + _EDGE
            for i in range(self.order - 1, len(s)):
                for k in range(1, self.order + 1):
                    g = s[i - k + 1 : i + 1]
                    self.kinds[k - 1][g[:-1]] += g not in self.counts[k]
                    self.counts[k][g] += n
                    self.contexts[k - 1][g[:-1]] += n
        return self

    def log(self, word: str) -> float:
        """Log-probability of the word, its end included."""
        out = self.cache.get(word)
        if out is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            out, s = 0.0, _EDGE * (self.order - 1) + word + _EDGE
            for i in range(self.order - 1, len(s)):
                p = 1 / _LETTERS
                for k in range(1, self.order + 1):
                    context = s[i - k + 1 : i]
                    total = self.contexts[k - 1].get(context, 0.0)
                    if not total:
                        break
                    t = self.kinds[k - 1][context]
                    p = (self.counts[k].get(s[i - k + 1 : i + 1], 0.0) + t * p) / (total + t)
                out += math.log(p)
            self.cache[word] = out
        return out


@dataclass
class Language:
    """Fitted models. own: of the answers; other: of the sources; loose: two characters in a row of both."""

    own: CharModel = field(default_factory=lambda: CharModel(4))
    other: CharModel = field(default_factory=lambda: CharModel(4))
    loose: CharModel = field(default_factory=lambda: CharModel(2))
    threshold: float = 0.0
    fitted: bool = False
    cache: dict[str, float] = field(default_factory=dict)

    def speaks(self, word: str) -> float:
        """How much the word speaks for the answers' language (over 0) or against it."""
        out = self.cache.get(word)
        if out is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            x = self.own.log(word) - max(self.other.log(word), self.loose.log(word))
            out = self.cache[word] = max(-WORD_MOST, min(WORD_MOST, x))
        return out

    def evidence(self, words: Iterable[str]) -> tuple[float, int]:
        """(sum over the words, their number)."""
        x = [self.speaks(w) for w in words]
        return sum(x), len(x)

    def foreign(self, words: Iterable[str]) -> bool | None:
        """Whether the words are in another language; None where they say too little."""
        if not self.fitted:
            return None
        words = list(words)
        total, n = self.evidence(words)
        if not n or abs(total - self.threshold * n) < LEAST_EVIDENCE:
            return None
        if n < LEAST_WORDS and total < self.threshold * n:  # a word or two that no model knows may be rare ones
            return True if all(self.other.log(w) > max(self.own.log(w), self.loose.log(w)) + LEAST_EVIDENCE for w in words) else None
        return total < self.threshold * n


def fit(answers: list[list[str]], sources: list[list[str]]) -> Language:
    """fit_counts of these words."""
    own, other = (Counter(w for ws in x for w in ws if w.isalpha()) for x in (answers, sources))

    def middle(x: Language) -> float:
        mine = sorted(total / n for total, n in map(x.evidence, answers) if n >= 3)
        return mine[len(mine) // 2] if mine else 0.0

    return fit_counts(own, other, middle)


def fit_counts(own: Counter[str], other: Counter[str], middle: Callable[[Language], float]) -> Language:
    """Models of the lower-cased words of intact answers and of their sources, without names and figures.

    Words count by the logarithm of how often they come, so that a few frequent ones don't make the model. The
    threshold, by word, lies halfway between the middle evidence of the answers and unseen words of the sources, which
    to the models are words of a language they don't know.
    """
    out = Language()
    if not own:
        return out
    weigh = lambda c: {w: 1 + math.log(n) for w, n in sorted(c.items())}

    def models(own: Counter[str], other: Counter[str]) -> Language:
        x = Language(fitted=True)
        x.own.fit(weigh(own))
        x.other.fit(weigh(other))
        x.loose.fit(weigh(own + other))
        return x

    level: list[float] = []
    for half in (0, 1):
        in_half = lambda w: zlib.crc32(w.encode()) & 1 == half  # noqa: B023, E731
        x = models(own, Counter({w: n for w, n in other.items() if in_half(w)}))
        level += [x.speaks(w) for w in other if not in_half(w) and w not in own]
    out = models(own, other)
    if level:
        out.threshold = min(0.0, (middle(out) + math.fsum(level) / len(level)) / 2)
    return out
