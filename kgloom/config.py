"""Domain settings as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The semantic roles, their groups in flattening order, and the axes of relation types.
ROLES = ("agent", "theme", "trigger", "purpose", "reason", "instrument", "beneficiary", "context", "origin", "destination", "time", "location")
ROLE_GROUPS = {"agent": 0, "theme": 1, "trigger": 2, "purpose": 2, "reason": 2, "instrument": 2, "beneficiary": 2, "context": 3, "origin": 4, "destination": 4, "time": 5, "location": 5}
AXES = ("ONTOLOGICAL", "DYNAMIC", "STRUCTURAL")
KINDS = ("relation", "entity")
MIN_QUOTE = 40

#: Labels too general for an entity; a relation with one of them is refused.
GENERIC_LABELS = (
    "agent", "theme", "trigger", "purpose", "reason",
    "instrument", "beneficiary", "context", "origin",
    "destination", "co_agent", "location", "time",
    "person", "organisation", "place", "object",
    "concept", "event", "document", "information",
    "data", "file",
)

#: What each role asks, for prompts.
ROLE_QUESTIONS = {
    "agent": "who or what does it",
    "theme": "who or what is it done to, or about",
    "trigger": "what set it off",
    "purpose": "what is it meant to achieve",
    "reason": "why did it come about",
    "instrument": "by what means",
    "beneficiary": "for whose good or ill",
    "context": "under what circumstances",
    "origin": "from where or whom",
    "destination": "to where or whom",
    "time": "when",
    "location": "where",
}


@dataclass(frozen=True)
class SeedType:
    label: str
    definition: str


@dataclass(frozen=True)
class SeedOntology:
    entity_types: tuple[SeedType, ...] = ()
    relation_types: tuple[SeedType, ...] = ()
    alignment_threshold: float = 0.80


@dataclass(frozen=True)
class ValidationRule:
    """A rule with a SQL predicate over relations that holds for valid ones."""

    name: str
    severity: str
    message: str
    predicate: str


@dataclass(frozen=True)
class DomainConfig:
    name: str = "default"
    language: str = "en"
    seed: SeedOntology = field(default_factory=SeedOntology)
    context: str = ""
    generic_labels: tuple[str, ...] = GENERIC_LABELS
    rules: tuple[ValidationRule, ...] = ()
    chunk_tokens: int = 1024
    chunk_overlap: int = 128
    embedding_size: int = 64
    embedding_batch_tokens: int = 8192
    merge_distance: float = 0.15
    cluster_distance: float = 0.25
    auto_merge_cosine: float = 0.90
    drift_threshold: float = 0.25
    drift_least: int = 10
    staleness_documents: int = 50
    low_confidence: float = 0.3
    max_chunks: int = 5
    max_entities: int = 30
    max_relations: int = 20
    scanned_entities: int = 500
    neighbours: int = 10
    prompt_types: int = 50
    attempts: int = 3
    resolution_enabled: bool = True
    arbitration_enabled: bool = True
    qc_enabled: bool = True
    role_context_of_first_document: bool = False
