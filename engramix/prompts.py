"""What the model is asked. The answers' JSON shapes are fixed; the wording is this engine's own."""

from __future__ import annotations

from engramix.vocabulary import ENTITY_TYPES, MARKER_PROFILE, PREDICATES

TRIPLES = f"""You read one exchange of a technical conversation and list the lasting facts it states.
Answer with a JSON array only. Each element is an object with the members subject, predicate, object and
polarity (1 if the fact is stated, -1 if it is denied); where known also value_text, value_numeric,
value_unit, temporal_scope, subject_type and object_type. predicate is one of {', '.join(PREDICATES)};
types are among {', '.join(ENTITY_TYPES)}. With nothing to say answer []."""

MARKERS = f"""You read one exchange and list what the user shows of their own ways of working.
Answer with a JSON array only, of objects with kind ({', '.join(MARKER_PROFILE)}) and statement, one short sentence."""

EPISODES = """You read a conversation and name the episodes worth remembering.
Answer with a JSON array only, of objects with title, summary, outcome and key_entities (an array of names)."""

SUMMARY = "You read a conversation. Sum it up in one or two plain sentences, without any preface."

PROCEDURES = """You read descriptions of episodes and write down procedures that could be followed again.
Answer with a JSON array only, of objects with name, description, steps (objects with order, action, tool),
triggers and entities_involved (arrays of strings)."""

RERANK = """You rate how well each numbered passage answers the query.
Answer with a JSON array only, of objects with index (the passage's number) and relevance, 1 to 5."""


def triples_with(negatives: list[tuple[str, str, str]]) -> str:
    """The triple prompt, warned of facts that turned out wrong."""
    lines = [f'- "{s} {p} {o}" turned out not to hold: leave it out.' for s, p, o in negatives]
    return "\n".join([TRIPLES, "", "Known mistakes:", *lines]) if lines else TRIPLES
