"""Text functions as Column expressions; Java patterns carry (?iuUd) so that they match as Unicode text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import GENERIC, NUMBERED, SURNAMES

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
WHITE = r"[\s\x{1c}-\x{1f}]"
PARTICLES = ["de", "del", "la", "las", "los", "y", "i"]


def trim_white(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{WHITE}+|{WHITE}+\z", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, rf"(?U){WHITE}+"), lambda w: w != "")


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{Mn}", "")


def normalize_text(x: Column) -> Column:
    return F.regexp_replace(strip_accents(trim_white(F.lower(x))), rf"(?U){WHITE}+", " ")


def normalize_mention(x: Column) -> Column:
    treated = F.regexp_replace(
        normalize_text(x),
        r"(?iuUd)^(?:el|la|los|las)\s+|(?:sr\.?|sra\.?|srta\.?|dr\.?|dra\.?|lic\.?|ing\.?|don|doña|señor|señora)\s+"
        r"|(?:imputad[oa]|víctima|victima|denunciante|testig[oa]|menor|niñ[oa])\s+",
        "",
    )
    return F.regexp_replace(trim_white(treated), r"\.", "")


def name_tokens(x: Column) -> Column:
    return F.filter(words(x), lambda w: ~w.isin(PARTICLES))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")


def surnames(tokens: Column, known=SURNAMES) -> Column:
    """Tokens likely to be surnames: those known; else both ends, since court order puts them first."""
    hits = F.array_distinct(F.filter(tokens, lambda t: t.isin(*known)))
    ends = F.array_distinct(F.array(F.element_at(tokens, 1), F.element_at(tokens, -1)))
    return F.when(F.size(tokens) <= 1, tokens).when(F.size(hits) > 0, hits).otherwise(ends)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


# Weights of the tax number's check digit.
CHECK = [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]


def valid_cuit(x: Column) -> Column:
    d = digits(x)
    total = sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate(CHECK)), F.lit(0))
    rest = F.lit(11) - total % 11
    check = F.when(rest == 11, 0).when(rest == 10, 9).otherwise(rest)
    return F.coalesce((F.length(d) == 11) & (F.substring(d, 11, 1).try_cast("int") == check), F.lit(False))


def valid_dni(x: Column) -> Column:
    return F.length(digits(x)).between(7, 8)


def guard_formula(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(F.coalesce(x, F.lit("")))


def placeholder(cat: Column, original: Column, number: Column, mode: str) -> Column:
    """Mode cat: [LABEL_n]; gen: one label a category; ini: initials of persons and companies, else as cat."""
    label = lambda other: F.coalesce(F.create_map(*(F.lit(x) for kv in other.items() for x in kv))[cat], cat)
    if mode == "gen":
        return F.concat(F.lit("["), label(GENERIC), F.lit("]"))
    numbered = F.concat(F.lit("["), label(NUMBERED), F.lit("_"), number.cast("string"), F.lit("]"))
    if mode != "ini":
        return numbered
    skip = [*PARTICLES, "S.A.", "S.R.L.", "S.A.S.", "S.A.U."]
    parts = F.filter(words(original), lambda w: ~w.isin(skip) & (F.length(w) > 1))
    short = F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), "")
    bare = F.when(cat == "PERSONA", F.lit("[NOMBRE]")).otherwise(F.lit("[EMPRESA]"))
    return F.when(cat.isin("PERSONA", "EMPRESA"), F.when(F.size(parts) > 0, short).otherwise(bare)).otherwise(numbered)


def fold_search(x: Column) -> Column:
    """Case- and accent-blind text of the same length, for searching with offsets that hold in the original."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)
