"""Prompts for models that stand behind the protocols; plain text, filled from a configuration."""

from __future__ import annotations

from kgloom.config import AXES, ROLE_QUESTIONS, ROLES, DomainConfig

AXIS_HINTS = dict(zip(AXES, ("what something is, at any time", "what happens, with a beginning and an end", "how parts are organised or depend on each other")))


def role_lines(roles: tuple[str, ...] = ROLES) -> str:
    """Each role with the question that it answers."""
    return "\n".join(f"- {r}: {ROLE_QUESTIONS[r]}?" for r in roles)


def _domain(config: DomainConfig) -> str:
    return f"Domain: {config.name}. Language of names and definitions: {config.language}.\n{config.context}".strip()


def extraction(config: DomainConfig, text: str, types: str = "", known: str = "") -> tuple[str, str]:
    """Instructions and request for finding relations without roles."""
    axes = "\n".join(f"- {a}: {h}" for a, h in AXIS_HINTS.items())
    told = "\n\n".join(x for x in (_domain(config), "Find every relation that the document states; leave its participants out for now.", f"Choose one axis for each:\n{axes}", "Describe it so that it can be read alone, name its verb in the infinitive, and quote the passages it rests on word for word, 40 characters or more each.", types, known) if x)
    return told, f"Document:\n{text}"


def roles(config: DomainConfig, description: str, quotes: str, text: str, types: str = "", known: str = "") -> tuple[str, str]:
    """Instructions and request for filling one relation's roles."""
    told = "\n\n".join(x for x in (_domain(config), "Say who or what takes part in the relation, by role:", role_lines(), f"Labels say what kind of thing it is; these are too general: {', '.join(config.generic_labels)}.", "Write names as the text has them.", types, known) if x)
    return told, f"Relation: {description}\nQuotes:\n{quotes}\n\nDocument:\n{text}"


def merging(spellings: list[tuple[str, str, str, str, str]]) -> str:
    """Asks whether spellings (name, label, definition, role, relation) are one thing; each (label, name) is shown once."""
    seen: dict[tuple[str, str], str] = {}
    for name, label, definition, role, relation in spellings:
        seen.setdefault((label, name), f"- {name} [{label}]: {definition} (as {role} in: {relation})")
    return "Do these all name the same thing? Short forms may; equal names in different fields do not.\n" + "\n".join(seen.values())


def review(config: DomainConfig, text: str, relations: list[str]) -> str:
    """Asks what an extraction has missed."""
    found = "\n".join(f"- {r}" for r in relations) or "- none"
    return f"{_domain(config)}\n\nCompare the document with the relations found in it. Name passages whose relation is missing, and relations whose roles look incomplete, and estimate from 0 to 1 how much is covered.\n\nFound:\n{found}\n\nDocument:\n{text}"


def governance(config: DomainConfig, candidates: list[tuple[str, str, str]], types: str = "") -> str:
    """Asks for decisions on candidate types (kind, label, definition): accept, merge into a known type, or reject."""
    seed = [f"- {t.label} ({kind}): {t.definition}" for kind, part in (("entity", config.seed.entity_types), ("relation", config.seed.relation_types)) for t in part]
    given = "Given types, to which others closer than a cosine of {:.0%} belong:\n{}".format(config.seed.alignment_threshold, "\n".join(seed)) if seed else ""
    asked = "\n".join(f"- {label} ({kind}): {definition}" for kind, label, definition in candidates)
    return "\n\n".join(x for x in (_domain(config), given, types, f"Accept, merge or reject each of these:\n{asked}") if x)
