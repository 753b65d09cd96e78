"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
_TEXTS = T.ArrayType(_S)


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ITEM = _of(pmid=_S, sentence=_S, year=_I)
_ITEMS = T.ArrayType(ITEM)
ARTICLE = _of(pmid=_S, title=_S, abstract=_S, authors=_TEXTS, journal=_S, year=_I, mesh_terms=_TEXTS, keywords=_TEXTS, doi=_S)
ENTITY = _of(text=_S, normalized=_S, entity_type=_S, pmid=_S, sentence=_S, confidence=_D)
RELATION = _of(subject=_S, predicate=_S, object=_S, sentence=_S, pmid=_S, publication_year=_I, polarity=_S, certainty=_S, confidence=_D, source=_S, subject_type=_S, object_type=_S)
GAP = _of(node_a=_S, node_b=_S, node_a_type=_S, node_b_type=_S, score=_D, method=_S, common_neighbors=_TEXTS, novelty_status=_S, evidence_pmids=_TEXTS, max_year=_I)
HYPOTHESIS = _of(
    hypothesis_id=_S, hypothesis=_S, entities=_TEXTS, mechanistic_rationale=_S, supporting_evidence=_ITEMS, contradicting_evidence=_ITEMS, novelty_status=_S, confidence=_D,
    testable_prediction=_S, suggested_experiment=_S, limitations=_S, alternative_explanations=_S, devils_advocate=_S, falsifiability=_S,
    evidence_score=_D, novelty_score=_D, plausibility_score=_D, feasibility_score=_D, final_score=_D, query=_S, generated_at=_S, method=_S,
)
