"""Classification of items by type and content (C6, C30); the dictionaries are the caller's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dictionary import first_class


def first_match(text: Column, parts: Sequence[tuple[str, str]]) -> Column:
    """The name of the first pattern, in any case, that a text holds; null if none."""
    hits = F.array_compact(F.array(*(F.when(text.rlike("(?i)" + pattern), F.lit(name)) for pattern, name in parts))) if parts else F.array().cast("array<string>")
    return F.try_element_at(hits, F.lit(1))


def type_category(type_name: Column, text: Column | None = None, types: Mapping[str, tuple[str, str | None]] | None = None, parts: Mapping[str, Sequence[tuple[str, str]]] | None = None) -> Column:
    """(category, subcategory) of a type name.

    ``types`` gives both by name, without the prefix that names may bear; ``parts`` gives patterns and
    subcategories by category, for those whose subcategory is null. A name that isn't known is guessed from
    what it contains, and a missing one is Unknown.
    """
    clean = F.regexp_replace(type_name, "^SIGNATURE_TYPE_", "")
    known = [F.lit(x) for t, (c, _) in (types or {}).items() for x in (t, c)]
    fixed = [F.lit(x) for t, (_, s) in (types or {}).items() if s for x in (t, s)]
    look = lambda pairs: F.when(clean.isNotNull(), F.element_at(F.create_map(*pairs), clean)) if pairs else F.lit(None).cast("string")
    category, subcategory = look(known), look(fixed)
    text = F.coalesce(text if text is not None else F.lit(""), F.lit(""))
    refined = F.coalesce(F.lit(None).cast("string"), *(F.when(category == c, first_match(text, p)) for c, p in (parts or {}).items()))
    guess = F.when(clean.contains("HSTR"), "Other/Strings").when(clean.contains("HASH"), "Hash/Other").when(clean.contains("SCRIPT"), "Script/Other").otherwise("Unknown")
    named = type_name.isNotNull() & (type_name != "")
    return F.struct(F.when(named, F.coalesce(category, guess)).otherwise("Unknown").alias("category"), F.when(named & category.isNotNull(), F.coalesce(subcategory, refined)).alias("subcategory"))


def classify_by(df: DataFrame, text: str, dictionary: DataFrame, into: str = "class", fallback: str = "Other") -> DataFrame:
    """First entry (by ``priority``, then term) of a dictionary (term, priority, class) whose term the text contains, in any case.

    A term counts wherever it stands in the text, for dictionaries of any size. Null and empty terms are left
    out; null and empty texts get the fallback.
    """
    return first_class(df, text, dictionary, into, fallback)
