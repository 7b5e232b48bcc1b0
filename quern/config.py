"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that are not indexed, token lengths, and the limits and weights of search and linking.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that",
    "the", "to", "was", "will", "with", "or", "but", "if", "then", "this", "can", "add", "use", "place", "put", "serve",
    "until", "about", "over", "into", "through", "during", "before", "after", "above", "below", "up", "down", "out", "off",
    "again", "further", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "now",
    "recipe", "recipes",
)
MIN_TOKEN, MAX_TOKEN = 3, 25
TOP_K, FIELD_TOP_K = 5, 10
SIMILARITY = 0.45
MIN_ABSTRACT = 50
MAX_RETRIES = 3
SKIPPED_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".css", ".js", ".xml")
FIELD_BOOSTS = {
    "recipe_title": 3.0, "wiki_title": 2.0, "ingredients": 2.5, "description": 1.5,
    "wiki_description": 1.0, "method": 1.0, "chef": 0.5,
}


@dataclass(frozen=True)
class Config:
    """Settings that a run may change; each default is the fixed value above."""

    top_k: int = TOP_K
    field_top_k: int = FIELD_TOP_K
    similarity: float = SIMILARITY
    min_abstract: int = MIN_ABSTRACT
    max_retries: int = MAX_RETRIES
    title_order: str = "reference"
    tokenizer: str = ""
    boosts: dict[str, float] = field(default_factory=lambda: dict(FIELD_BOOSTS))
