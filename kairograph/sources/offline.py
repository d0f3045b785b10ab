"""Deterministic stand-ins for models, for tests and offline use."""

from __future__ import annotations

import hashlib
import math


class HashEmbedder:
    """Bag of tokens: each token adds one at one place and takes one at another, both from its digest."""

    dim = 16

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for token in text.lower().split():
                digest = hashlib.sha256(token.encode()).digest()
                v[int.from_bytes(digest[:4], "big") % self.dim] += 1
                v[int.from_bytes(digest[4:8], "big") % self.dim] -= 1
            size = math.sqrt(sum(x * x for x in v))
            out.append([x / size for x in v] if size else v)
        return out


class OverlapReranker:
    """Share of the query's tokens that a passage holds."""

    def rank(self, query: str, passages: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(p.lower().split())) / max(len(asked), 1) for p in passages]


class CueJudge:
    """A transition cue in the new fact and a word of over two characters in common."""

    def contradictions(self, new_fact: str, candidates: list[str]) -> list[int]:
        from kairograph.functions.text import TRANSITION_CUES

        words = lambda t: {w for w in t.lower().split() if len(w) > 2}
        if not any(c in new_fact.lower() for c in TRANSITION_CUES):
            return []
        return [k for k, c in enumerate(candidates) if words(c) & words(new_fact)]


class StemClassifier:
    """The first known name that shares its leading word with the predicate."""

    def classify(self, predicate: str, span: str, known: list[str]) -> str | None:
        stem = predicate.lower().split("_")[0]
        return next((k for k in known if k.split("_")[0] == stem), None)


class ListSynthesizer:
    """The first facts, and how many more there are."""

    most = 5

    def synthesize(self, facts: list[str]) -> str:
        more = len(facts) - self.most
        return "; ".join(facts[: self.most]) + (f"; and {more} related" if more > 0 else "")


class OverlapTieBreaker:
    """The one name with the most words of mention and context; None on a tie or without a common word."""

    def pick(self, mention: str, context: str, names: list[str]) -> int | None:
        said = set(f"{mention} {context}".lower().split())
        counts = [len(said & set(n.lower().split())) for n in names]
        best = max(counts)
        return counts.index(best) if best and counts.count(best) == 1 else None


class HeadSummarizer:
    """``name: fact; fact`` over the first three facts."""

    def summarize(self, name: str, facts: list[str]) -> str:
        return f"{name}: {'; '.join(facts[:3])}" if facts else name
