"""The whole pipeline as one lazy plan: articles to ranked hypotheses."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.operators import analysis, clean, extract, gaps, graph, hypotheses
from litloom.session import cut


@dataclasses.dataclass
class Pipeline:
    """articles need article_ord and the article columns.

    ``cleaned`` normalises and deduplicates first, which lower-cases titles and abstracts, so that rules
    that need capitals find nothing; ``preserve_case`` keeps capitals. ``intended`` joins evidence by
    subject and object; by default the ends are read from columns plain relations don't fill, as callers
    of the original expect. Extracted relations are cut off by a checkpoint, since several outputs read them.
    """

    articles: DataFrame
    query: str = ""
    cutoff: int | None = None
    min_year: int | None = None
    top_gaps: int = 50
    top_hypotheses: int = 5
    cleaned: bool = True
    preserve_case: bool = False
    intended: bool = False
    recognise: Callable[[DataFrame], DataFrame] | None = None
    generator: Callable[[DataFrame], DataFrame] | None = None

    @cached_property
    def corpus(self) -> DataFrame:
        a = clean.clean_articles(self.articles, preserve_case=self.preserve_case) if self.cleaned else self.articles
        return clean.year_window(a, self.min_year, self.cutoff)

    @cached_property
    def _extracted(self) -> tuple[DataFrame, DataFrame]:
        found, rels = extract.extract(self.corpus, self.recognise)
        return found, cut(extract.canonical_order(rels))

    @property
    def entities(self) -> DataFrame:
        return self._extracted[0]

    @property
    def relations(self) -> DataFrame:
        return self._extracted[1]

    @cached_property
    def evidence(self) -> DataFrame:
        return graph.evidence(self.relations)

    @property
    def edges(self) -> DataFrame:
        return graph.merge_edges(self.evidence.unionByName(graph.temporal_rows(self.evidence, self.cutoff)))

    @cached_property
    def gaps(self) -> DataFrame:
        return cut(gaps.find_gaps(self.evidence, self.cutoff, self.top_gaps))

    def hypotheses(self) -> DataFrame:
        ends = {"source": X.node_key(F.col("subject")), "target": X.node_key(F.col("object"))} if self.intended else {}
        return hypotheses.run(self.gaps, self.relations, self.query, self.top_hypotheses, self.generator, **ends)

    def statistics(self) -> DataFrame:
        return graph.statistics(self.evidence)

    def metadata(self) -> DataFrame:
        return analysis.metadata(self.corpus, self.entities, self.relations, self.statistics(), self.gaps, self.hypotheses(), self.query, self.cutoff)
