"""From scored articles to those of a digest, by one set of options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from gistmill import rules
from gistmill.functions.scoring import category_weight, min_score_filter
from gistmill.operators.dedup import top_titles
from gistmill.operators.select import rank_articles


@dataclass(frozen=True)
class Options:
    """What a digest takes: weights of categories, the least score, the ratio from which titles are the same, and how many rows."""

    category_weights: dict[str, float] = field(default_factory=lambda: dict(rules.CATEGORY_WEIGHTS))
    category_default: float = rules.CATEGORY_DEFAULT
    min_score: float = 1.0
    duplicate_threshold: float = 0.75
    top_n: int = 50

    def with_overrides(self, config: dict) -> Options:
        """These options with those that a configuration names; unknown names are an error."""
        return replace(self, **config)


def digest_articles(scored: DataFrame, options: Options | None = None) -> DataFrame:
    """Weighs, drops low scores and similar titles, and ranks the first ``top_n``."""
    o = options or Options()
    rows = min_score_filter(category_weight(scored, o.category_weights, o.category_default), o.min_score)
    return rank_articles(top_titles(rows, o.top_n, o.duplicate_threshold))
