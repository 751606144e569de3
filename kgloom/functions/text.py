"""Text rules as column expressions: identifiers, matching keys, title case, embedding texts, quote overlap."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Space separators (Unicode Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Every code point that is one ASCII character once decomposed and freed of marks, and those characters."""
    pairs = []
    for point in range(0x80, sys.maxunicode + 1):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(plain) == 1 and ord(plain) < 0x80:
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """Base letters of accented ones; marks go.  Letters whose base is not ASCII stay as they are."""
    accented, plain = accent_table()
    return F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}", "")


def sanitize_identifier(name: Column, style: str = "upper") -> Column:
    """An identifier: no accents, ``&`` as AND, other runs as one underscore; ``style`` is upper, title or lower.

    An underscore that a leading digit would ask for is stripped again with the others, so ``3com`` is ``3COM``.
    """
    text = F.regexp_replace(without_accents(name), r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(text, "&", "_AND_")
    text = F.regexp_replace(text, "[^a-zA-Z0-9_]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "^_+|_+$", ""), "_+", "_")
    return {"upper": F.upper, "lower": F.lower, "title": title}[style](text)


def normalise(name: Column) -> Column:
    """The key that names are matched on: no accents, lower case, letters, digits and single spaces."""
    text = F.lower(without_accents(name))
    text = F.regexp_replace(text, r"(?U)[^a-z0-9\s]", "")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def norm_key(label: Column, name: Column) -> Column:
    return F.concat(normalise(label), F.lit("||"), normalise(name))


def title(text: Column) -> Column:
    """Title case in which every run of letters begins with a capital, also behind digits and apostrophes."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.when(F.startswith(w, F.lit("ß")), F.lit("Ss")).otherwise(F.upper(F.substring(w, 1, 1))), F.substr(w, F.lit(2)))), "")


def title_label(text: Column) -> Column:
    return title(F.trim(text))


def relation_label(verb: Column, target: Column) -> Column:
    return sanitize_identifier(F.concat(verb, F.lit("_"), F.replace(target, F.lit(" "), F.lit("_"))))


def property_key(key: Column) -> Column:
    return F.lower(F.replace(F.trim(key), F.lit(" "), F.lit("_")))


def generic_text(agent_label: Column, relation: Column, theme_label: Column) -> Column:
    return F.concat_ws(" ", agent_label, relation, theme_label)


def specific_text(agent_label: Column, agent: Column, relation: Column, theme_label: Column, theme: Column) -> Column:
    return F.format_string("%s (%s) %s %s (%s)", agent_label, agent, relation, theme_label, theme)


def mention_text(name: Column, label: Column, definition: Column) -> Column:
    return F.concat_ws(" | ", name, label, definition)


def type_text(label: Column, definition: Column) -> Column:
    return F.concat(label, F.lit(": "), definition)


def entity_class_text(label: Column, definition: Column) -> Column:
    return F.concat(F.lit("Entity class: "), label, F.lit(". Definition: "), definition)


def relation_text(generic: Column, definition: Column) -> Column:
    return F.concat(F.lit("Generic: "), generic, F.lit(". Definition: "), definition)


def comma_list(text: Column) -> Column:
    """Trimmed non-empty items between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def coverage_score(text: Column) -> Column:
    """A number clamped to 0..1; 0.5 for what is no number."""
    number = text.try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def overlap_prefix(text: Column, quote: Column) -> Column:
    """Length of the longest prefix of ``quote`` anywhere in ``text``; texts of up to 10 characters and missing quotes have none.

    Containment of prefixes is monotone, so the length is found by halving, in as many steps as the quote's length has bits.
    """
    bounds = F.aggregate(
        F.sequence(F.lit(1), F.length(F.bin(F.length(quote) + 1)) + 1),
        F.struct(F.lit(0).alias("lo"), F.length(quote).alias("hi")),
        lambda s, _: _halved(s, text, quote),
    )
    return F.when(F.length(text) <= 10, 0).otherwise(F.coalesce(bounds["lo"], F.lit(0)))


def _halved(state: Column, text: Column, quote: Column) -> Column:
    mid = F.floor((state["lo"] + state["hi"] + 1) / 2).cast("int")
    fits = F.contains(text, F.substr(quote, F.lit(1), mid))
    return F.struct(F.when(fits, mid).otherwise(state["lo"]).alias("lo"), F.when(fits, state["hi"]).otherwise(F.greatest(mid - 1, state["lo"])).alias("hi"))


def trimmed(text: Column) -> Column:
    """Without the space separators around it, as SQL trims."""
    return F.trim(text, F.lit(SPACES))


def object_path(path: Column) -> Column:
    """Bucket and key of a ``bucket/key`` path."""
    parts = F.split(path, "/", 2)
    return F.struct(F.get(parts, 0).alias("bucket"), F.get(parts, 1).alias("key"))
