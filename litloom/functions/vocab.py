"""Fixed values of the evidence pipeline: word lists, patterns and tables that results depend on."""

from __future__ import annotations

ENTITY_TYPES = ("GENE", "DISEASE", "CHEMICAL", "PROTEIN", "PATHWAY", "BIOLOGICAL_PROCESS", "OTHER")
POLARITIES = ("positive", "negative", "uncertain", "conditional")
CERTAINTIES = ("certain", "probable", "possible", "speculative")
NOVELTY = ("KNOWN", "CONTRADICTED", "PARTIALLY_SUPPORTED", "INDIRECTLY_SUPPORTED", "INSUFFICIENT_EVIDENCE", "UNEXPLORED")

# (fallback is a gene?, confidence, pattern); i: ignore case. Order decides ties.
_WORD = r"(?iU)\b\w+\s+{}\b"
GENE = r"[A-Z][A-Z0-9]{1,9}[0-9]|[A-Z]{2,}[0-9]+[A-Z]*"
DISEASES = (
    r"(?iU)\b(?:cancer|tumor|tumour|carcinoma|sarcoma|lymphoma|leukemia|leukaemia|melanoma|glioma|neuroblastoma)\b",
    *(_WORD.format(x) for x in ("cancer", "disease", "syndrome", "disorder")),
)
CHEMICALS = (
    *(rf"(?U)\b[a-z]+{x}\b" for x in ("mab", "nib", "zumab", "tinib")),
    r"(?iU)\b(?:tamoxifen|cisplatin|doxorubicin|methotrexate)\b",
)
PATHWAYS = (
    r"(?U)\b(?:PI3K|MAPK|mTOR|NF-κB|Wnt|Notch|Hedgehog|JAK|STAT|p53|Ras|ERK)\b",
    *(_WORD.format(x) for x in ("pathway", "signaling", "cascade")),
)
PROCESS = r"(?iU)\b(?:apoptosis|autophagy|necrosis|ferroptosis|pyroptosis|proliferation|angiogenesis|metastasis|inflammation|differentiation)\b"
PROTEIN = r"(?iU)\b[\w-]+\s+(?:protein|kinase|receptor|ligand|enzyme|transporter)\b"
# What a text must hold for a pattern to match at all: plain words, found at a fraction of the cost.
_HOLDS = (
    "[0-9]", "(?iu)cancer|tumou?r|carcinoma|sarcoma|lymphoma|leuka?emia|melanoma|glioma|neuroblastoma", *(f"(?iu){x}" for x in ("cancer", "disease", "syndrome", "disorder")),
    "mab", "nib", "zumab", "tinib", "(?iu)tamoxifen|cisplatin|doxorubicin|methotrexate", "PI3K|MAPK|mTOR|NF-κB|Wnt|Notch|Hedgehog|JAK|STAT|p53|Ras|ERK", *(f"(?iu){x}" for x in ("pathway", "signaling", "cascade")),
    "(?iu)osis|phagy|ration|genesis|stasis|mation|tiation", "(?iu)protein|kinase|receptor|ligand|enzyme|transporter",
)
SPAN_PATTERNS = (
    (0.82, rf"(?U)\b(?:{GENE})\b"),
    *((0.86, p) for p in DISEASES),
    *((0.85, p) for p in CHEMICALS),
    *((0.84, p) for p in PATHWAYS),
    (0.78, PROCESS),
    (0.80, PROTEIN),
)
SPAN_HOLDS = dict(zip((p for _, p in SPAN_PATTERNS), _HOLDS, strict=True))
GENE_STOP_WORDS = tuple("AND ARE AS AT BY DNA FOR FROM HAS HAVE IL IN IS IT NOT OF ON OR RNA THE TO USA WAS WHO WITH".split())
KNOWN_GENES = tuple("AKT1 ALK APC BRAF BRCA1 BRCA2 CDK4 EGFR ERBB2 HER2 JAK2 KRAS MAPK1 MTOR MYC NFKB1 NRAS PIK3CA PTEN STAT3 TP53 VEGFA".split())

# Triggers in order: (pattern, predicate or None for the matched word's, polarity, passive?).
TRIGGERS = (
    (r"(?:is|are|was|were)\s+(?:activated|stimulated|induced|promoted|upregulated)\s+by", "activates", "positive", True),
    (r"(?:is|are|was|were)\s+(?:inhibited|suppressed|blocked|downregulated|reduced)\s+by", "inhibits", "negative", True),
    ("activates?|activated|stimulates?|stimulated|induces?|induced|promotes?|promoted|upregulates?|upregulated|increases?|increased|enhances?|enhanced|activating|inducing|promoting", None, "positive", False),
    ("inhibits?|inhibited|suppresses?|suppressed|blocks?|blocked|downregulates?|downregulated|decreases?|decreased|reduces?|reduced|attenuates?|attenuated|inhibiting|suppressing", None, "negative", False),
    (r"associated\s+with|linked\s+to|linked\s+\w+\s+to|related\s+to|associated\s+\w+\s+with|connection\s+between|relationship\s+between", "associated_with", "positive", False),
    (r"correlates?\s+with|correlation\s+with|correlating\s+with|expression\s+correlates|mutation\s+correlates|activity\s+correlates", "correlates_with", "positive", False),
    (r"binds?\s+to|binds?\s+\w+|interacts?\s+with|interaction\s+with|binding\s+to|interacting\s+with", None, "positive", False),
    ("targets?", "targets", "positive", False),
    (r"requires?|required|requiring|depends?\s+on|dependent\s+on", "requires", "positive", False),
)

NEGATION_CUES = ("not", "no", "never", "neither", "nor", "without", "lack", "absent", "failed to", "did not", "does not", "cannot", "unable to")
SPECULATIVE_CUES = ("hypothesize", "speculate", "speculative", "perhaps")
POSSIBLE_CUES = ("may", "might", "could", "possibly", "potentially")
PROBABLE_CUES = ("likely", "suggest", "indicate", "appear", "seem")
CONDITIONAL_CUES = ("if", "whether", "dependent on", "depending on", "when")
CONTRADICTION = r"(?iU)\b(?:no association|not associated|no effect|did not|failed to|absence of|unrelated)\b"


def inflections() -> dict[str, str]:
    """Word form -> predicate, from the stems by rule."""
    out: dict[str, str] = {}
    for stem in "activate stimulate induce promote upregulate increase enhance downregulate decrease reduce attenuate require".split():
        for form in (stem, stem + "s", stem + "d", stem[:-1] + "ing"):
            out[form] = stem + "s"
    for stem, predicate in (("inhibit", "inhibits"), ("suppress", "suppresses"), ("block", "blocks"), ("interact", "interacts_with"), ("target", "targets")):
        third = stem + ("es" if stem.endswith("ss") else "s")
        for form in (stem, third, stem + "ed", stem + "ing"):
            out[form] = predicate
    out |= dict.fromkeys(("bind", "binds", "bound", "binding"), "binds")
    return out | dict.fromkeys(("associated_with", "linked_to", "related_to"), "associated_with")


BIOLOGICAL_PREDICATES = tuple(
    "activates stimulates induces promotes upregulates increases enhances inhibits suppresses blocks downregulates decreases reduces attenuates "
    "targets binds interacts_with associated_with correlates_with requires".split()
)
TYPE_PAIRS = (("GENE", "DISEASE"), ("GENE", "GENE"), ("CHEMICAL", "GENE"), ("CHEMICAL", "DISEASE"), ("PROTEIN", "PATHWAY"), ("GENE", "PATHWAY"), ("PROTEIN", "PROTEIN"))
GAP_WEIGHTS = {"jaccard": 0.35, "adamic_adar": 0.25, "resource_allocation": 0.2, "common_neighbors": 0.2}

# Relation confidence: base by predicate, penalty by certainty, and by polarity.
CONFIDENCE_BASE = {"activates": 0.86, "inhibits": 0.86, "targets": 0.86, "binds": 0.8, "interacts_with": 0.8, "associated_with": 0.72, "correlates_with": 0.72}
CONFIDENCE_OTHER = 0.75
CERTAINTY_PENALTY = {"certain": 0.0, "probable": 0.08, "possible": 0.14, "speculative": 0.2}
POLARITY_PENALTY = {"conditional": 0.08, "uncertain": 0.05}

NOVELTY_SCORES = {"UNEXPLORED": 1.0, "INDIRECTLY_SUPPORTED": 0.8, "PARTIALLY_SUPPORTED": 0.5, "INSUFFICIENT_EVIDENCE": 0.6, "KNOWN": 0.0, "CONTRADICTED": 0.1}
NOVELTY_SCORE_DEFAULT = 0.6
NOVELTY_RANK = {"UNEXPLORED": 0, "INDIRECTLY_SUPPORTED": 1, "PARTIALLY_SUPPORTED": 2, "INSUFFICIENT_EVIDENCE": 3, "KNOWN": 4, "CONTRADICTED": 5}
FINAL_WEIGHTS = {"evidence_score": 0.35, "novelty_score": 0.30, "plausibility_score": 0.25, "feasibility_score": 0.10}
TYPE_GROUPS = {"drug": ("CHEMICAL", "DRUG", "COMPOUND", "SMALL_MOLECULE"), "gene": ("GENE", "PROTEIN", "TARGET", "ENZYME"), "disease": ("DISEASE", "DISORDER", "PHENOTYPE")}
FEASIBILITY = ((0.8, ("in vitro", "cell line", "assay")), (0.6, ("mouse model", "animal model")), (0.4, ("clinical trial", "patient")))
FEASIBILITY_DEFAULT = 0.5
