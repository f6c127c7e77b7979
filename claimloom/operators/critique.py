"""The critique of a corpus: missing assumptions, patterns and fragile warrants in one go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from claimloom.operators.corpus import Corpus
from claimloom.operators.model_hooks import Client, missing_assumptions
from claimloom.operators.patterns import detect_patterns
from claimloom.operators.scoring import score_corpus, warrant_fragility


@dataclass(frozen=True)
class Critique:
    """missing_assumptions by ``model_hooks``, patterns by ``patterns``, warrant_fragility by ``scoring``."""

    missing_assumptions: DataFrame
    patterns: DataFrame
    warrant_fragility: DataFrame


def critique(c: Corpus, client: Callable[[], Client] | Client | None = None) -> Critique:
    """All three for every graph; without a client there are no missing assumptions. Empty tables give empty ones."""
    return Critique(missing_assumptions(c, client), detect_patterns(c.units, c.relations), warrant_fragility(c, score_corpus(c)))
