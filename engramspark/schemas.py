"""Constants, vocabularies and table schemas of the memory graph, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

EVIDENCE_RANK = {"unverified": 0, "single_source": 1, "corroborated": 2, "official": 3}
EVIDENCE_DELTA = {"unverified": -0.10, "single_source": 0.0, "corroborated": 0.08, "official": 0.15}
EVIDENCE_QUALITY = {"unverified": 0.0, "single_source": 0.3, "corroborated": 0.7, "official": 1.0}

SELF_BANDS = {"low": 1, "medium": 2, "high": 3}
PROVENANCE_BANDS = {"official": 3, "corroborated": 3, "single_source": 2, "unverified": 1}
TRUST_BANDS = {"certainty": SELF_BANDS, "confidence": SELF_BANDS, "evidence_level": PROVENANCE_BANDS}

BELIEF_EDGES = ("CONTRADICTS", "SUPERSEDES", "SUPPORTS")
DISPUTE_BASES = ("agent", "evidence-assessor")
WALKED_EDGES = ("CONTAINS", "CONTRADICTS", "CREATED_FROM", "DEPENDS_ON", "DERIVED_FROM", "REFERENCED", "SUPERSEDES", "SUPPORTS")
KIND_PRIORITY = {"fact": 0, "event": 1, "decision": 2}

#: canonical relation -> spellings that fold into it
RELATIONS: dict[str, frozenset[str]] = {
    "CAUSES": frozenset("brings_about induces leads_to results_in triggers".split()),
    "CONTAINS": frozenset("comprises encompasses has_component has_part includes".split()),
    "CONTRADICTS": frozenset("conflicts_with contravenes disproves negates opposes refutes".split()),
    "DEPENDS_ON": frozenset("based_on contingent_on depends_upon needs predicated_on relies_on requires".split()),
    "IMPLEMENTS": frozenset("conforms_to fulfills realizes satisfies".split()),
    "PART_OF": frozenset("belongs_to component_of contained_in member_of subset_of".split()),
    "RELATES_TO": frozenset("associated_with concerns connected_to linked_to pertains_to related_to".split()),
    "SUPERSEDES": frozenset("deprecates obsoletes overrides replaces supplants".split()),
    "SUPPORTS": frozenset("confirms corroborates reinforces substantiates validates".split()),
    "USES": frozenset("calls consumes employs invokes leverages utilizes".split()),
}

STOPWORDS = tuple(
    sorted(
        set(
            "a about above after again all also an and any are as at be been before being below between both but by can could did do does down during each either "
            "every few for from further had has have he her here him his how i if in into is it its just may me might more most my neither no nor not of off on once "
            "only or other our out over own re same shall she should so some such than that the their them then there these they this those through to too under until "
            "up very was we were what when where which while who whom why will with would yet you your".split()
        )
    )
)


@dataclass(frozen=True)
class Config:
    """Every tunable of the engine; what the library read from the environment is a field here."""

    recency_half_life: float = 45.0
    recency_max: float = 0.12
    event_half_life: float = 45.0
    event_max: float = 0.12
    mmr_lambda: float = 0.72
    cross_encoder_weight: float = 0.6
    seeds: int = 5
    anchors_per_seed: int = 6
    siblings_per_anchor: int = 5
    hub_degree: int = 12
    bridge_factor: float = 0.9
    bridges: int = 8
    nodes_per_bridge: int = 2
    bridge_results: int = 4
    fact_limit: int = 3
    fact_results: int = 2
    fact_factor: float = 0.9
    contested: int = 3
    sibling_reserve: int = 3
    sibling_strong: float = 0.40
    sibling_chars: int = 20_000
    context_top: int = 20
    context_chars: int = 8_000
    context_bridges: int = 2
    context_facts: int = 2
    supersede_overlap: float = 0.6
    depends_overlap: float = 0.4
    fact_duplicate: float = 0.75
    decision_duplicate: float = 0.82
    neighbours: int = 5
    neighbour_score: float = 0.6
    ripple: int = 20
    churn_weights: tuple[float, float, float] = (0.5, 0.3, 0.2)
    chain_depth: int = 10
    profile_days: int = 30
    batch: int = 20
    deprecation_ratio: float = 0.5
    least_age_days: int = 7
    least_reason: int = 10
    least_chars: int = 60
    corroboration: int = 2
    salience: int = 2
    chunk_chars: int = 18_000
    chunks: int = 6
    correlate_days: int = 14
    anchor_slack: int = 20
    session_ttl: int = 3_600
    recall_gap: int = 5
    park_after: int = 2
    ledger_rows: int = 2_000
    walked: tuple[str, ...] = field(default=WALKED_EDGES)


DEFAULT = Config()

TABLES = {
    "spaces": "project string, space_path string, space_class string",
    "items": "item_kref string, project string, space_path string, slug string, kind string, deprecated boolean",
    "revisions": (
        "kref string, item_kref string, number int, created_at timestamp, deprecated boolean, published boolean, latest boolean, tags array<string>, "
        "metadata map<string,string>, title string, summary string, content string, memory_type string, evidence_level string, source string, event_date string, "
        "event_date_confidence string, valid_from string, valid_to string, grounding_stale boolean, embedding array<float>"
    ),
    "edges": "source_kref string, target_kref string, edge_type string, basis string, metadata map<string,string>",
    "messages": "project string, session_id string, idx int, role string, content string, ts timestamp",
    "commits": "repo string, hash string, author string, author_date timestamp, subject string, body string, parents array<string>, files array<string>",
    "ledger": "key string, attempts int, deterministic_attempts int, first_seen timestamp, last_seen timestamp, last_error_class string, parked_at timestamp",
}
