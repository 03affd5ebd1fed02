"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ranges of the two scripts that routes know.
CYRILLIC = r"\x{0400}-\x{052F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}"
LATIN = r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}"
CYRILLIC_TARGETS = ("ru", "uk")


def _count(text: Column, characters: str) -> Column:
    """How many characters are of the set, by what is left without them: runs go at once, and no match is kept; 0 for null."""
    return F.coalesce(F.char_length(text) - F.char_length(F.regexp_replace(text, f"{characters}+", "")), F.lit(0)).cast("long")


def letters_of(text: Column, script: str) -> Column:
    return _count(text, rf"[{script}&&\p{{L}}]")


def script_counts(text: str | Column) -> dict[str, Column]:
    """Letters by script: cyr, lat, other."""
    text = F.col(text) if isinstance(text, str) else text
    cyr, lat = letters_of(text, CYRILLIC), letters_of(text, LATIN)
    return {"cyr": cyr, "lat": lat, "other": _count(text, r"\p{L}") - cyr - lat}


def word_key(text: str | Column) -> Column:
    """Comparable form of ASCII text: small letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def fold(text: str | Column) -> Column:
    """Case folding as far as the corpus needs it: small letters, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


#: What the leak rule overlooks. A name is tried from its first letter alone (or right after an address), not from each letter anew.
_QUOTED = "«[^»]*»|“[^”]*”|\"[^\"]*\""
_ADDRESS = r"(?i)https?://\S+|www\.\S+|(?:(?<![\p{L}\p{N}_-])|\G)[\p{L}\p{N}_-]++\.(?:com|net|org|ru|io|me|dev|art|adult|co)(?:/\S*)?"


def own_words(text: str | Column, allowed: tuple[str, ...] = ()) -> Column:
    """The text without quotes, addresses and allowed terms."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _QUOTED, " "), _ADDRESS, " ")
    for term in allowed:
        if term.strip():
            text = F.replace(text, F.lit(term.strip()), F.lit(" "))
    return text


def token_counts(text: Column) -> Column:
    """Struct of letters by script (cyr, lat, other). Latin ones count in tokens of four or more that have no digit, are not all
    capitals, and do not begin with one unless a sentence does so there."""
    # Whole tokens of letters alone, with the mark before them if they start a sentence; every letter is in some token, so the other scripts are counted at once.
    mark, part = r"[.!?…\n\r]", r"[\p{L}\p{N}_'’]"
    whole = rf"(?:{mark}[^\p{{L}}\p{{N}}_'’.!?…\n\r]*+)?(?<!{part})[\p{{L}}'’]++(?![\p{{N}}_])"
    letter, capital = rf"[{LATIN}&&\p{{L}}]", rf"[{LATIN}&&\p{{Lu}}]"
    tokens = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(whole), F.lit(0))
    tokens = F.transform(tokens, lambda t: F.struct(t.alias("t"), letters_of(t, LATIN).alias("n")))

    def add(total: Column, e: Column) -> Column:
        small = e["t"].rlike(rf"[{LATIN}&&\p{{L}}&&[^\p{{Lu}}]]")
        name = e["t"].rlike(rf"^(?:(?!{letter})[\p{{L}}'’])*+{capital}")  # without a mark before it, so not at a start
        return total + F.when((e["n"] >= 4) & small & ~name, e["n"]).otherwise(0)

    lat = F.coalesce(F.aggregate(tokens, F.lit(0).cast("long"), add), F.lit(0).cast("long"))
    c = script_counts(text)
    return F.struct(c["cyr"].alias("cyr"), lat.alias("lat"), c["other"].alias("other"))


def once(df: DataFrame, counts: Column) -> DataFrame:
    """df with the fields of a struct as columns, found once for each row: an expression of several passes over a text would else be repeated in every
    filter and condition that names it."""
    return df.select("*", F.inline(F.array(counts)))
