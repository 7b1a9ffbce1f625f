"""Tables of an evidence knowledge graph: explicit schemas and controlled vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, I, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
LIST = T.ArrayType(S)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


#: ``ord`` is the place in the source; it defines every order that a query promises.
NODE = _table(
    ord=L, id=S, type=S, name=S, description=S, aliases=LIST, domains=LIST, external_ids=LIST,
    codes_auto=LIST, codes_checked_at=TS, created_at=TS, updated_at=TS,
)
CLAIM = _table(
    ord=L, id=S, type=S, subject=S, object=S, population=S, mechanism=S, setting=S, direction=S, certainty=S, status=S,
    rec_strength=S, dose=S, comparator=S, effect_measure=S, effect_value=D, effect_note=S, created_at=TS, updated_at=TS,
)
EVIDENCE = _table(id=S, claim=S, ev_ord=L, source_id=S, source_node=S, quote=S, study_design=S, confidence=D, extracted_by=S)
#: Which evidence a claim lists, in order; an id need not exist.
LISTED = _table(claim=S, ev_ord=L, evidence=S)
RELATION = _table(ord=L, id=S, type=S, subject_claim=S, object_claim=S)
VOCAB = _table(vocab=S, ordinal=I, value=S)
EMBEDDING = _table(id=S, owner_type=S, owner_id=S, model=S, vector=T.ArrayType(D))
TOPIC = _table(
    id=S, topic=S, status=S, priority=I, attempts=I, last_error=S, notes=S, source=S, source_detail=S, created_at=TS, updated_at=TS,
)
AGENT_RUN = _table(id=L, agent=S, topic_id=S, claim_id=S, outcome=S, summary=S, created_at=TS)
ASK_LOG = _table(
    id=L, question=S, answer=S, model=S, ok=B, error=S, claim_ids=LIST, citations=LIST, num_claims=I, ip=S, user_agent=S,
    latency_ms=I, input_tokens=I, output_tokens=I, gap_status=S, created_at=TS,
)
CONTACT = _table(id=L, name=S, email=S, message=S, user_agent=S, handled=B, created_at=TS)
SETTING = _table(key=S, value=S)
SOURCE_META = _table(
    source_id=S, exists=B, lookup_failed=B, pmid=S, doi=S, title=S, journal=S, year=S, authors=LIST, abstract=S,
    pubtypes=LIST, type=S, study_design=S,
)

# Fixed values of the data model, in their fixed order.
NODE_TYPES = (
    "disease", "symptom", "outcome", "population", "intervention", "exercise", "nutrition", "drug", "mechanism", "scale",
    "tool", "research", "paper", "guideline", "expert", "organization", "technology", "theory", "model",
    "knowledge_gap", "research_question", "intervention_component",
)
RELATIONSHIPS = (
    "treats", "prevents", "improves", "worsens", "causes", "increases_risk_of", "reduces_risk_of", "diagnoses",
    "assesses", "measures", "is_a", "part_of", "recommends", "related", "explains", "informs", "generates",
    "operates_through", "contributes_to",
)
DEFINITIONAL = ("is_a", "part_of", "assesses", "measures", "diagnoses", "related", "explains", "informs", "generates")
DIRECTIONS = ("increase", "decrease", "no_effect", "mixed")
CERTAINTIES = ("high", "moderate", "low", "very_low")
STATUSES = ("curated", "unverified", "needs_refinement", "skeleton")
SETTINGS = ("home", "community", "ltc", "hospital", "rehab", "any")
DESIGNS = (
    "systematic_review_or_meta_analysis", "rct", "cohort", "case_control", "cross_sectional", "case_report",
    "expert_opinion", "guideline",
)
DOMAINS = (
    "gerontology", "health informatics", "nutrition", "exercise", "sleep", "mental health", "frailty", "falls",
    "dementia", "caregiving", "palliative care", "rehabilitation", "AI in healthcare", "digital health", "behavior change",
)
PREFIXES = (
    "MONDO", "HP", "MESH", "RXNORM", "CHEBI", "FOODON", "GO", "LOINC", "ROR", "ORCID", "DOI", "PMID", "PMCID", "SNOMED",
    "ICD11", "ATC",
)
PROTECTIVE = ("reduces_risk_of", "improves", "treats", "prevents")
OPEN_STATUSES = ("unverified", "needs_refinement", "skeleton")
WEAK_CERTAINTIES = ("low", "very_low")

VOCABULARIES: dict[str, tuple[str, ...]] = {
    "nodeTypes": NODE_TYPES,
    "relationshipTypes": RELATIONSHIPS,
    "definitionalRelationships": DEFINITIONAL,
    "directions": DIRECTIONS,
    "certainties": CERTAINTIES,
    "statuses": STATUSES,
    "settings": SETTINGS,
    "studyDesigns": DESIGNS,
    "domains": DOMAINS,
    "knownCuriePrefixes": PREFIXES,
}
