"""The vocabularies, patterns and defaults that stored data and results depend on."""

# fixed values
PREDICATES = (
    "uses", "depends_on", "prefers", "rejects", "avoids", "replaces", "conflicts_with", "deploys_to", "part_of",
    "equivalent_to", "implements", "contains", "configured_with", "requires_version", "runs_on", "connects_to", "generates", "tested_by",
)
# fixed values
ENTITY_TYPES = (
    "language", "framework", "database", "service", "tool", "library", "file", "environment", "protocol", "container",
    "package_manager", "api", "platform", "config_file", "testing_framework", "ci_tool", "monitoring_tool", "identity_provider", "message_broker", "or_other_tool",
)
# fixed values
ROLES = ("user", "assistant", "system", "tool")
# fixed values
MARKER_PROFILE = {"preference": "preference", "rejection": "avoidance", "correction": "context", "style": "style"}
# fixed values
EXCLUSIVE = ("runs_on", "requires_version", "deploys_to")
# fixed values
OPPOSING = (("prefers", "rejects"), ("prefers", "avoids"), ("uses", "rejects"), ("uses", "avoids"), ("depends_on", "conflicts_with"))
# fixed values
ROUTES = (
    ("steers clear", ("avoids",)),
    ("avoids", ("avoids", "rejects")), ("avoid", ("avoids", "rejects")),
    ("configured with", ("configured_with",)), ("configuration", ("configured_with",)), ("configured", ("configured_with",)), ("set up with", ("configured_with",)),
    ("conflicts", ("conflicts_with",)), ("conflict", ("conflicts_with",)), ("incompatible", ("conflicts_with",)),
    ("connects to", ("connects_to",)), ("connected to", ("connects_to",)), ("talks to", ("connects_to",)), ("integrates with", ("connects_to",)),
    ("contains", ("contains",)), ("includes", ("contains",)), ("made up of", ("contains",)),
    ("part of", ("contains", "part_of")),
    ("depends on", ("depends_on",)), ("depend on", ("depends_on",)), ("dependency", ("depends_on",)), ("dependencies", ("depends_on",)), ("needs", ("depends_on",)),
    ("requires", ("depends_on", "requires_version")),
    ("deploys to", ("deploys_to",)), ("deployed", ("deploys_to",)), ("deployment", ("deploys_to",)), ("released to", ("deploys_to",)),
    ("equivalent", ("equivalent_to",)), ("same as", ("equivalent_to",)), ("synonymous", ("equivalent_to",)),
    ("generates", ("generates",)), ("produces", ("generates",)), ("outputs", ("generates",)),
    ("implements", ("implements",)), ("implementation", ("implements",)), ("fulfills", ("implements",)),
    ("built with", ("implements", "runs_on", "uses")),
    ("component of", ("part_of",)), ("belongs to", ("part_of",)),
    ("prefers", ("prefers",)), ("prefer", ("prefers",)), ("preferred", ("prefers",)), ("favors", ("prefers",)),
    ("rejects", ("rejects",)), ("rejected", ("rejects",)), ("refuses", ("rejects",)),
    ("replaces", ("replaces",)), ("replaced", ("replaces",)), ("supersedes", ("replaces",)), ("instead of", ("replaces",)),
    ("version", ("requires_version",)),
    ("runs on", ("runs_on",)), ("running on", ("runs_on",)), ("executes on", ("runs_on",)),
    ("technologies", ("runs_on", "uses")), ("tech stack", ("runs_on", "uses")),
    ("tested by", ("tested_by",)), ("tested with", ("tested_by",)), ("testing", ("tested_by",)), ("tests", ("tested_by",)),
    ("uses", ("uses",)), ("using", ("uses",)), ("utilizes", ("uses",)), ("works with", ("uses",)),
)
# fixed values
CORRECTION = (
    r"\bno,|\b(actually|not\s+(?:quite|really|exactly)|don'?t\s+use|stopped\s+using|switched\s+(?:to|from)|replaced|moved\s+(?:off|away))\b"
    r"|\bthat'?s\s+wrong\b|\bwrong\b|\bincorrect\b|\bfix:|\bthe\s+right\s+(?:answer|way)\b|\binstead\s+of\b|\brather\s+than\b|\buse\s+\S+\s+not\s+\S+"
    r"|\bnee,|\b(eigenlijk|gebruik\s+geen|niet\s+gebruiken|gestopt\s+met|overgestapt(?:\s+(?:van|naar|op))?|vervangen)\b|\b(?:dat\s+klopt\s+niet|niet\s+correct|verkeerd|fout)\b"
    r"|\bde\s+juiste\s+(?:manier|antwoord)\b|\bin\s+plaats\s+van\b|\bliever\s+dan\b"
)
# fixed values
PREFERENCE = (
    r"\b(i\s+prefer|i\s+like|i\s+want|we\s+use|we\s+chose|let'?s\s+use|we\s+rely\s+on|we\s+depend\s+on)\b"
    r"|\b(ik\s+prefereer|ik\s+heb\s+(?:een\s+)?voorkeur\s+voor|ik\s+wil|ik\s+gebruik\s+graag|(?:we|wij)\s+gebruiken|we\s+kozen(?:\s+voor)?|we\s+hebben\s+gekozen|laten\s+we\s+\S+\s+gebruiken|we\s+vertrouwen\s+op|we\s+zijn\s+afhankelijk\s+van)\b"
)
# fixed values
ARTICLES = r"^(the|an?|de|het|een|der|die|das|dem|den|ein|eine|le|la|les|un|une|des|el|los|las|una|unos|unas|il|lo|gli|uno|os|as|um|uma)\s+"
# fixed values
USER_ROLE = r"(^user[-_]|human|client|telegram|discord|slack)"
# fixed values
AGENT_ROLE = r"(agent|hermes|assistant|ai[-_]|bot|llm)"
# fixed values
DEFAULTS = {
    "salience_min_chars": 30, "fts_top_k": 5, "graph_top_k_per_entity": 3, "graph_semantic_top_k": 10, "graph_predicate_top_k": 10, "graph_top_k": 8,
    "recency_days": 30.0, "recent_days": 7.0, "predicate_boost": 1.5, "overlap_weight": 0.5, "overlap_threshold": 20, "overlap_max": 5,
    "decay_window": 30, "retract_threshold": 0.15, "zombie_neg": 2, "reinforce_window": 30, "profile_max": 16, "insights_max": 12,
    "dream_budget": 50, "baseline_budget": 10, "max_chunks": 50000, "retention_days": 90, "rerank_ambiguity": 0.6, "embedding_max_scan": 5000,
}
