"""Settings from the environment, with fallbacks for what doesn't parse."""

from __future__ import annotations

import dataclasses
import logging
import os

log = logging.getLogger("litloom")


@dataclasses.dataclass
class Settings:
    """The names (in capitals) and defaults of the settings."""

    entrez_email: str = ""
    entrez_api_key: str = ""
    max_results: int = 200
    batch_size: int = 100
    rate_limit_no_key: float = 3.0
    rate_limit_with_key: float = 10.0
    kg_similarity_threshold: float = 0.75
    min_shared_neighbors: int = 2
    hypothesis_top_gaps: int = 5
    gemini_api_key: str = ""
    gemini_model: str = "gemini-2.0-flash"
    log_level: str = "INFO"
    random_seed: int = 42
    historical_cutoff_year: int | None = None

    @classmethod
    def from_env(cls, env=None, this_year: int | None = None) -> Settings:
        import datetime

        env = os.environ if env is None else env
        given = {}
        for f in dataclasses.fields(cls):
            raw = env.get(f.name.upper())
            if raw in (None, ""):
                continue
            kind = int if f.name == "historical_cutoff_year" else type(f.default)
            try:
                given[f.name] = kind(raw)
            except ValueError:
                log.warning("%s=%r is no %s; the default holds", f.name.upper(), raw, kind.__name__)
        limit = (this_year or datetime.datetime.now(datetime.UTC).year) + 1
        if not 1900 <= given.get("historical_cutoff_year", 1900) <= limit:
            given.pop("historical_cutoff_year")
        return cls(**given)

    @property
    def min_interval(self) -> float:
        """Seconds between requests."""
        rate = self.rate_limit_with_key if self.entrez_api_key else self.rate_limit_no_key
        return 1.0 / rate if rate > 0 else 0.0
