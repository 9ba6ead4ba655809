"""Validity of spans as Column expressions over (cat, surface, left, right), right beginning at the span.

Null surfaces are never valid; null surroundings count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexicon import ADMIN, STOP, Lexicon
from ..functions.text import digits, normalize_text, trim_white, words
from .detect import LEGAL
from .rules import MONTHS, NOT_STREET, PLATE

J, JI = "(?uUd)", "(?iuUd)"
# Words, phrases and contexts of the validity rules.
VERBS = r"\b(?:que|manifiesta|declara|considera|solicita|respondió|respondio|recibió|recibio|encontró|encontro|guardó|guardo|mantuvo|trata|fue|había|habia|pudo|desde|hacia|sobre|bajo|también|tambien)\b"
PHRASES = [
    "manifiesta que", "respondió que", "considera que", "guardó una", "guardó el", "recibió una", "recibió mensajes", "solo pudo", "es y hostigamiento",
    "encontró rayones", "la cerradura", "también recibió", "declara como", "solicita que", "nota de", "aportar una", "de parte de", "conversaciones previas",
    "negó los hechos", "afirmó que", "dispuso correr", "requirió a",
]
CITATION = r"\b(?:c/|s/)\s*$|\b(?:c/|s/)\s+\w"
NOT_PERSON = ["juzgado", "fiscal", "tribunal", "conversaciones", "negó", "nego", "afirmó", "afirmo", "dispuso", "requirió", "requirio", "de parte"]
NOT_NAME = ["como", "relato", "firma", "aclaracion", "ficticio", "nota", "cami"]
BAD_STREET = rf"^\s*(?:calle|c\/|av\.?|avda\.?|avenida)\s+(?:{NOT_STREET})\b"
NO_ADDRESS = ["territorio", "república", "republica", "se encuentren", "que se encuentren", "en el marco", "de la nacion", "de la nación", "territorio de la", "territorio nacional"]
RISK = ["riesgo", "situacion de calle", "situación de calle", "garantia", "garantía", "proteccion", "protección", "derechos"]
STREETS = r"\b(?:calle|c\/|av\.?|avda\.?|avenida|bv\.?|boulevard|pasaje|pje\.?|plaza|pza\.?|ruta|rt\.?|camino|barrio|b°|manzana|mza\.?|lote|lt\.?|dpto\.?|depto\.?|piso|torre|n[°º]\.?|nro\.?)\b"
DOCKET = r"\b(?:expediente|expte\.?|causa|autos|f\.?\s?s\.?|l\.?\s?e\.?|exp\.?|cuij|n[uú]mero|nro\.?|n[°º]\.?)\b"
STRONG = r"\bJ-\d{2}-\d{6,9}-\d/\d{4}-\d\b|\bEXP\.?\s+\d{2,8}(?:[\-/]\d{2,6})+\b"
MONEY = r"(\$|pesos?|monto|suma|capital|condena|condenar|indemnizaci[oó]n|honorarios|inter[eé]s|intereses|liquidaci[oó]n|total|importe)"
ID_LABEL = r"\b(?:dni|d\.?n\.?i\.?|documento|du)\s*(?:n[°º]\.?)?\s*$"
COURT = r"^(?:juzgado|fiscal|tribunal|cámara|camara|defensor|ministerio|procuración|procuracion)"
NO_COURT = ["papeler", "cerrajer", "unidad funcional", "edificio", "dispuso", "requirió", "requirio", "acompañara", "acompanara", "correr traslado", "presentación", "presentacion", "comunicaciones mantenidas"]
COURT_TALK = (
    r"\b(?:quien|quienes|cual|cuales|cuya|cuyo|cuyas|cuyos|se\s+(?:apart[óo]|expid[ióo]|pronunci[óo]|expres[óo])|apart[óo]|aparte|revise|revisa|revisar[áa]?|"
    r"considera|consider[óeao]|considere|manifest[óaeo]|declara|declare|declar[óao]|resolverá|resolvera|dispuso|disponga|dispone|sentencia|sentenci[óa]|"
    r"hechos|fundamentos|recurso|recursos)\b"
)
CUT_OFF = r"\b(?:nro|n[°º]|art|inc|sec|dpto|depto|nº)\s*\.?\s*$"
IDENTITY = ["cédula", "cedula", "pasaporte", "passport", "documento", "c.i.", "identidad"]


def _has(x: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out |= F.contains(x, F.lit(p))
    return out


def _last(x: Column, n: int) -> Column:
    return F.right(x, F.lit(n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def held(value: Column) -> Column:
    """The value, worked out once a row: the optimizer takes it for undetermined, so it neither repeats it in filters nor merges it away."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def view(surface: Column, left: Column, right: Column, body: Callable[[Column], Column]) -> Column:
    """body of a struct: the trimmed surface s, low, parts (words), left, right."""
    empty = F.lit("")
    first = F.struct(trim_white(surface).alias("s"), F.coalesce(left, empty).alias("left"), F.coalesce(right, empty).alias("right"))
    second = lambda p: F.struct(p["s"].alias("s"), p["left"].alias("left"), p["right"].alias("right"), F.lower(p["s"]).alias("low"), words(p["s"]).alias("parts"))
    return let(first, lambda a: let(second(a), body))


def narrative(p: Column, lex: Lexicon) -> Column:
    s, low, parts = p["s"], p["low"], p["parts"]
    dull = F.size(F.filter(F.transform(parts, normalize_text), lambda w: w.isin(*lex.formulas, *STOP)))
    return (
        (F.length(s) > 40) | _has(low, PHRASES) | ((F.size(parts) >= 4) & s.rlike(JI + VERBS)) | (F.size(parts) >= 8)
        | (dull >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2))) | F.contains(low, F.lit(" que ")) | F.startswith(low, F.lit("que "))
    )


def person(p: Column, told: Column, lex: Lexicon) -> Column:
    """told: whether the surface is narrative."""
    return let(F.filter(p["parts"], lambda w: F.length(w) > 1), lambda parts: let(F.transform(parts, normalize_text), lambda flat: let(normalize_text(p["s"]), lambda low: _person(p["s"], low, told, parts, flat, lex))))


def _person(s: Column, low: Column, told: Column, parts: Column, flat: Column, lex: Lexicon) -> Column:
    given, known = F.exists(flat, lambda w: w.isin(*lex.given)), F.exists(flat, lambda w: w.isin(*lex.names))
    surname, admin = F.exists(flat, lambda w: w.isin(*lex.surnames)), F.exists(flat, lambda w: w.isin(*ADMIN))
    bad = (
        (F.length(s) < 3) | told | s.rlike(JI + CITATION) | low.isin(*lex.formulas, *STOP, *NOT_NAME) | _has(low, NOT_PERSON) | (F.size(parts) == 0)
        | (admin & ~given) | F.forall(flat, lambda w: w.isin(*ADMIN))
    )
    rest = F.when(s.rlike(J + r"[A-ZÁÉÍÓÚÑ]\."), known).when(F.size(parts) == 1, known).otherwise((F.size(parts) <= 5) & (surname | (given & (F.size(parts) >= 2))))
    return ~bad & rest


def docket(p: Column, lex: Lexicon) -> Column:
    s, low, digit = p["s"], p["low"], p["s"].rlike(r"(?U)\d")
    fine = digit | F.contains(s, F.lit("/")) | F.contains(s, F.lit("-"))
    bad = low.rlike(J + r"^no\w+") & ~digit | low.rlike(J + r"^exp(?!ediente|te|\.?\s+\d|\.?\s+j-)") | ~s.rlike(JI + DOCKET) & ~digit
    return ~low.isin(*lex.formulas) & (s.rlike(JI + STRONG) | ~bad & fine)


def address(p: Column, lex: Lexicon) -> Column:
    s, left, right, low = (p[c] for c in ("s", "left", "right", "low"))
    street, digit, comma = s.rlike(JI + STREETS), s.rlike(r"(?U)\d"), F.contains(s, F.lit(","))
    near = F.concat(left, F.substring(right, 1, 30)).rlike(JI + STREETS)
    year = s.rlike(r"^(?:19\d\d|20\d\d|2100)$")
    bad = s.rlike(JI + BAD_STREET) | _has(low, NO_ADDRESS) | year | normalize_text(s).isin(*lex.names) | (low.isin("cami", "tomi", "sauce viejo") & ~street)
    good = (
        F.when(s.rlike(r"^(?U)\d{1,5}$"), near).when(s.rlike(r"^(?i)[A-Z]\d{4}[A-Z]{3}$"), True)
        .when(street, digit | comma | (near & (F.length(s) > 18) & ~_has(low, RISK))).otherwise(near & (F.length(s) > 18) & (digit | comma))
    )
    return ~bad & good


def phone(s: Column) -> Column:
    return let(digits(s), lambda d: _phone(s, d))


def _phone(s: Column, d: Column) -> Column:
    bad = (F.length(d) == 8) & ~F.startswith(s, F.lit("+")) | (F.length(d) >= 8) & F.startswith(d, F.lit("0205"))
    return ~bad & F.length(d).between(10, 13) & s.rlike(r"[+\- ]")


def identity_number(p: Column) -> Column:
    s, left, right = p["s"], p["left"], p["right"]
    labelled = _last(left, 24).rlike(JI + ID_LABEL)
    around = F.concat(_last(left, 80), F.lit(" "), F.substring(right, F.lit(1), F.length(s) + 40))
    money = around.rlike(JI + MONEY) | F.endswith(trim_white(_last(left, 3)), F.lit("$"))
    return F.length(digits(s)).between(7, 8) & (labelled | ~money)


def court(p: Column) -> Column:
    s, low = p["s"], p["low"]
    good = (F.length(s).between(8, 55)) & (F.size(p["parts"]) <= 6) & low.rlike(J + COURT)
    return good & ~_has(low, NO_COURT) & ~s.rlike(JI + COURT_TALK) & ~s.rlike(JI + CUT_OFF)


def plate(s: Column) -> Column:
    head = F.lower(F.regexp_extract(s, J + r"^([A-Za-zÁÉÍÓÚÑáéíóúñ]{2,4})\b", 1))
    return ~head.isin(*LEGAL) & F.regexp_replace(s, r"(?U)[\s\-]", "").rlike(JI + rf"^(?:{PLATE})$")


def other(p: Column) -> Column:
    s = p["s"]
    born, low = s.rlike(JI + rf"^\d{{1,2}}\s+de\s+{MONTHS}\s+de\s+\d{{4}}$"), F.lower(p["left"])
    code = s.rlike(JI + r"^[A-Z0-9][\w\-]{5,16}$") & s.rlike(r"(?U)\d") & _has(_last(low, 50), IDENTITY)
    return F.when(born, _has(_last(low, 40), ["nacid", "nacimiento"])).otherwise(code)


def caption(p: Column) -> Column:
    around = F.concat(_last(p["left"], 90), F.substring(p["right"], 1, 140))
    return around.rlike(JI + r"\bc\s*\.?/|\bcontra\b") & around.rlike(JI + r"\bs\s*\.?/|\bsobre\b")


def valid(cat: Column, surface: Column, left: Column, right: Column, lex: Lexicon) -> Column:
    """Whether a span may stand, by its category; EMPRESA, EMAIL and CUIT always may."""
    return F.coalesce(view(surface, left, right, lambda p: _valid(cat, p, lex)), F.lit(False))


def _valid(cat: Column, p: Column, lex: Lexicon) -> Column:
    s = p["s"]
    party = F.size(p["parts"]).between(2, 6) | (s.rlike(J + r"\p{Lu}") & (F.upper(s) == s))
    by_cat = (
        F.when(cat == "PERSONA", let(narrative(p, lex), lambda told: F.when(caption(p) & ~told, party).otherwise(person(p, told, lex))))
        .when(cat == "EXPEDIENTE", docket(p, lex)).when(cat == "DOMICILIO", address(p, lex)).when(cat == "TELEFONO", phone(s))
        .when(cat == "DNI", identity_number(p)).when(cat == "ORGANISMO", court(p)).when(cat == "PATENTE", plate(s)).when(cat == "OTRO", other(p)).otherwise(True)
    )
    return (F.length(s) >= 2) & by_cat


def valid_manual(cat: Column, surface: Column, left: Column, right: Column, lex: Lexicon) -> Column:
    """The relaxed test of a hand-made selection: persons need only not be narrative, citation or institution."""

    def test(p):
        relaxed = ~narrative(p, lex) & ~p["s"].rlike(JI + CITATION) & ~_has(p["low"], ["juzgado", "fiscal", "tribunal", "dispuso", "de parte"])
        return (F.length(p["s"]) >= 2) & F.when(cat == "PERSONA", relaxed).otherwise(_valid(cat, p, lex))

    return F.coalesce(view(surface, left, right, test), F.lit(False))
