"""Cleaning of extracted page text, by expressions that stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# Where a page's text ends, and what is deleted from it.
STOPS = ("Additional Information & Resources", "References", "Scientific Articles on PubMed", "Disclaimers", "Return to top")
DELETED = (
    "Skip navigation",
    "A\\s*\\.gov\\s*website belongs to an official government.*?the \\.gov website\\.",
    "Share sensitive information only on official,\\s*secure websites\\.",
    "You Are Here:\\s*Home",
    "Search MedlinePlus",
    "GO\\b",
    "About MedlinePlus.*",
    "National Library of Medicine.*",
)
#: A text with none of these, in any case, holds nothing to delete but "GO", whatever has been deleted before.
SIGNS = ("navigation", "official", "you are here", "medlineplus", "medicine")


def truncate_at(text: Column, stops=STOPS) -> Column:
    """What stands before the first of the stops."""
    return reduce(lambda t, stop: F.when(t.contains(stop), F.substring_index(t, stop, 1)).otherwise(t), stops, text)


def clean_text(text: Column, legacy: bool = True, stops=STOPS, deleted=DELETED) -> Column:
    """Cut at the stops, delete boilerplate, tidy white space and punctuation.

    `legacy` deletes "GO" inside words too ("vertigo" -> "verti"); otherwise only the word.
    """
    text = F.replace(truncate_at(text, stops), F.lit("\t"), F.lit(" "))
    delete = lambda patterns: reduce(lambda t, p: F.regexp_replace(t, "(?isu)" + ("\\bGO\\b" if not legacy and p == "GO\\b" else p), ""), patterns, text)
    out = delete(deleted)
    if deleted is DELETED:
        # Folded as the patterns fold case; the dotted capital i folds to two characters, so it asks for a look.
        folded = F.lower(F.upper(text))
        signs = reduce(lambda found, sign: found | folded.contains(sign), SIGNS, text.contains("\u0130"))
        out = F.when(signs, out).otherwise(delete([p for p in deleted if p == "GO\\b"]))
    out = F.regexp_replace(out, "(?md)[ \\t]+$", "")
    out = F.regexp_replace(out, "\\n(?U:[\\s\\x1c-\\x1f])*([,.;:!?])", "$1")
    return T.strip(F.regexp_replace(out, "\\n{3,}", "\n\n"))
