"""A search request, its bounds, and its result columns."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from fathomry.functions.languages import supported_languages

MODES = ("vector", "bm25", "hybrid", "graph", "multi")


@dataclass(frozen=True)
class QueryRequest:
    query: str
    mode: str = "hybrid"
    top_k: int = 5
    similarity_threshold: float = 0.3
    alpha: float = 0.5
    source_types: list[str] | None = None
    languages: list[str] | None = None
    file_paths: list[str] | None = None
    entity_types: list[str] | None = None
    relationship_types: list[str] | None = None
    rerank: bool = False
    explain: bool = False
    vector: list[float] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if not self.query.strip() or len(self.query) > 1000:
            raise ValueError("a query has 1 to 1000 characters")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k lies between 1 and 50")
        for name in ("similarity_threshold", "alpha"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        unknown = set(self.languages or ()) - set(supported_languages())
        if unknown:
            raise ValueError(f"unsupported languages: {', '.join(sorted(unknown))}")

    def key_parts(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("explain",)}
