"""The detection rules as data, in order of priority: an earlier rule's span keeps later ones out.

A rule is a pattern with the group that gives the span and, where needed, the name of a check on it (see
detect.CHECKS). Patterns follow Python's `re`. Address rules are one entry of several patterns whose spans merge.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    cat: str
    pattern: str
    check: str = ""
    group: int = 0
    fold: bool = True
    layer: str = "regex"
    strip: bool = False
    exact: bool = field(default=False)  # the span is the group's first equal text inside the match
    guard: str = ""  # a part that every match holds: texts without it are not scanned


# The formats that the detection must find, as patterns.
UP, LOW, ANY = "[A-ZÁÉÍÓÚÑ]", "[a-záéíóúñ]", "[A-ZÁÉÍÓÚÑa-záéíóúñ]"
COMPANY = (
    r"(?:S\.?\s?A\.?|S\.?\s?R\.?\s?L\.?|S\.?\s?A\.?\s?S\.?|S\.?\s?A\.?\s?U\.?|S\.?\s?C\.?|S\.?\s?C\.?\s?A\.?|S\.?\s?H\.?"
    r"|S\.?A\.?C\.?I\.?F\.?I\.?A\.?|S\.?A\.?I\.?C\.?F\.?I\.?A\.?|S\.?A\.?C\.?I\.?F\.?I\.?|S\.?A\.?I\.?C\.?F\.?I\.?"
    r"|S\.?A\.?C\.?I\.?F\.?|S\.?A\.?I\.?C\.?F\.?|S\.?A\.?C\.?I\.?|S\.?A\.?I\.?C\.?"
    r"|Cooperativa|Coop\.?|Mutual|Asociaci[oó]n\s+Civil|Fundaci[oó]n)"
)
STREET = (
    r"(?:Calle|C\/|Av\.?|Avda\.?|Avenida|Bv\.?|Boulevard|Bulevar|Pasaje|Pje\.?|Plaza|Pza\.?|Ruta|Rt\.?|Camino|Barrio|B°|"
    r"Manzana|Mza\.?|Lote|Lt\.?|Dpto\.?|Depto\.?|Piso|Torre)"
)
NOT_STREET = (
    r"que|se|en|un|una|el|la|los|las|del|de|donde|cuando|cual|cuales|quien|quienes|todo|toda|todos|todas|cualquier|cualquiera"
)
ADDRESS_END = (
    r"(?=[;:\n]|$|\.(?!(?:\s*(?:piso|dto\.?|dpto\.?|depto\.?|torre|de\s+esta)|\s+[A-Za-záéíóúñ]\b|\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]{2,})))"
)
STREET_WORD = r"\b(?:calle|c\/|av\.?|avda\.?|avenida|piso|dpto\.?|depto\.?)\b"
MONTHS = r"(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)"
PLATE = r"[A-Z]{2}[\s\-]?\d{3}[\s\-]?[A-Z]{2}|[A-Z]{3}[\s\-]?\d{3}|[A-Z][\s\-]?\d{3}[\s\-]?[A-Z]{3}"
PARTY = UP + r"[A-ZÁÉÍÓÚÑa-záéíóúñ,&\.\-']{2,}(?:[ \t]+" + UP + r"[A-ZÁÉÍÓÚÑa-záéíóúñ,&\.\-']{2,}){0,5}"
ROLES = r"imputad[oa]|v[ií]ctima|denunciante|testig[oa]|querellante|damnificad[oa]|ofendid[oa]"
JOIN = r"(?:[ \t]+(?:de|del|la|las|los|y)[ \t]+)?"

ADDRESSES = [
    (
        rf"\b{STREET}\s*[A-ZÁÉÍÓÚÑa-záéíóúñ0-9·\.\-]+(?:\s+[A-ZÁÉÍÓÚÑa-záéíóúñ0-9·\.\-]+)*\s+\d{{1,5}}[A-Za-z]?"
        r"(?:\s*,\s*(?:piso|dto\.?|dpto\.?|depto\.?|torre|mz\.?|manzana|lote|n[°º]\.?\s*\d+)\s+[\w\d]+)+(?:\s*,\s*de\s+esta\s+ciudad)?",
        0, "longer5", "i",
    ),
    (rf"\b{STREET}\s+(?!{NOT_STREET}\b)[A-ZÁÉÍÓÚÑa-záéíóúñ0-9·\.\-\s,°º]+?" + ADDRESS_END, 0, "longer5", "i"),
    (
        r"\bdomicilio(?:\s+\w+){0,4}\s+constitu(?:ido|ida)\s+en\s+(?:la\s+)?(.+?)(?=(?:,\s*)?y\s+(?:electr\w*|como|con|domicilio)|[.;]\s*$|\.$)",
        1, "address8", "is",
    ),
    (
        r"\b(?:domicilio\s+(?:electr[oó]nico|fiscal|legal|autorizado)\s+(?:en\s+)?|domicilio|domiciliad[oa]|con\s+domicilio|sito)\s+"
        r"(?:en|real\s+en|fiscal\s+en)\s+(?:la\s+)?(.+?)(?=(?:,\s*)?y\s+(?:electr\w*|como|con|domicilio)|[.;]\s|$)",
        1, "address", "is",
    ),
    (r"\b([A-Z]\d{4}[A-Z]{3})\b", 1, "", ""),
]

RULES = [
    Rule("EXPEDIENTE", r"\b(?:EXP\s+)?J-\d{2}-\d{6,9}-\d/\d{4}-\d\b"),
    Rule("EXPEDIENTE", r"\bEXP\.?\s+\d{2,8}(?:[\-/]\d{1,6})+\b"),
    Rule(
        "CUIT",
        r"\b(?:CUIT|CUIL|C\.U\.I\.T\.|C\.U\.I\.L\.)\s*(?:N[°º]\.?|Nro\.?|n[uú]mero)?\s*[:#]?\s*(\d{2}[\s\-]*\d{8}[\s\-]*\d)",
        "cuit",
    ),
    Rule("CUIT", r"\b(\d{2}[\s\-]*\d{8}[\s\-]*\d)\b", "cuit", fold=False),
    Rule("CUIT", r"\bdomicilio\s+(?:electr[oó]nico|fiscal|legal|autorizado)\s+(\d{11})\b", "cuit", group=1),
    Rule("DNI", r"\b(\d{1,2}\.\d{3}\.\d{3})\b", "dni", fold=False),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", fold=False),
    Rule("TELEFONO", r"(?:\+54\s?(?:9\s?)?\d{2,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}|(?:15|11)[-.\s]?\d{3,4}[-.\s]?\d{3,4})\b", "phone", fold=False),
    Rule("EMPRESA", rf"\b((?:{UP}[\wÁÉÍÓÚÑáéíóúñ&\-\.]*\s+){{1,6}}{COMPANY})\b", "longer4", guard=rf"\s{COMPANY}\b"),
    Rule("DOMICILIO", "", "addresses"),
    Rule("EXPEDIENTE", r"\b(?:expediente|expte\.?|causa|autos)\s+(?:n[°º]\.?\s*)?[:#]?\s*([A-Z0-9][A-Z0-9\-\/\.]{3,28})\b", "digit"),
    Rule("EXPEDIENTE", r"\b(?:expediente|expte\.?|causa)\s+n[°º]\.?\s*(\d[\d\-\/\.]{2,20})\b"),
    Rule("EXPEDIENTE", r"\b(?:FS|F\.?\s?S\.?|LE|L\.?\s?E\.?)\s*[:#]?\s*(\d{1,6}[/\-]\d{2,6})\b"),
    Rule("EXPEDIENTE", r"\b(?:n[uú]mero|nro\.?|n[°º]\.?)\s*[:#]?\s*(\d{2,8}[/\-]\d{2,4}(?:[\-/]\d{1,6})?)\b"),
    Rule(
        "ORGANISMO",
        r"\b(?:Juzgado|Juz\.?|Fiscalía|Fiscalia|Defensoría|Defensoria|Tribunal|Cámara|Camara|Procuración|Procuracion|Ministerio Público|MPF|SCBA|CSJN|"
        rf"Unidad Fiscal|UF\s?\d+|Sala\s+[IVXLC\d]+)\s+(?:{UP}[\wáéíóúñÁÉÍÓÚÑ\s\.\-]+?)(?=[\.;,\n]|$)",
        "longer8",
        strip=True,
    ),
    Rule("PERSONA", rf"(?P<a>{PARTY})\s+(?:C\s*\.?/|CONTRA)\s+(?P<b>{PARTY})(?=\s+(?:S\s*\.?/|SOBRE\b)|[.;,\n]|$)", "parties", layer="ruler", guard=r"\s(?:C\s*\.?/|CONTRA)\s"),
    Rule(
        "PERSONA",
        rf"\b(?:Sr\.?|Sra\.?|Srta\.?|Dr\.?|Dra\.?|Lic\.?|Ing\.?|señor|señora|señorita|don|doña)[ \t]+({UP}{LOW}+{JOIN}(?:[ \t]+{UP}{LOW}+){{1,5}})",
        group=1, exact=True,
    ),
    Rule(
        "PERSONA",
        rf"\b(?:{ROLES}|menor|niñ[oa]|adolescente|progenitor[oa]|representante[ \t]+legal|parte|actor[oa]|demandad[oa])[ \t]*[:,\.]?[ \t]*"
        rf"(?:(?:Sr|Sra|Dr|Dra)\.?[ \t]+)?({UP}{LOW}+(?:[ \t]+(?:(?:de|del|la|las|los|y)[ \t]+)?{UP}{LOW}+){{1,5}})",
        group=1, layer="ruler", exact=True,
    ),
    Rule("PERSONA", rf"\b({UP}{LOW}+[ \t]+(?:{UP}\.[ \t]*){{1,3}}{UP}{LOW}+)\b", fold=False),
    Rule("PERSONA", rf"\b(?:Sr|Sra|Srta)\.?[ \t]+({UP}{LOW}+)\b", group=1, layer="ruler"),
    Rule(
        "PERSONA",
        r"\b(?:Sr\.?|Sra\.?|Srta\.?|Dr\.?|Dra\.?|Lic\.?|Ing\.?|se[ñn]or|se[ñn]ora|se[ñn]orita|don|do[ñn]a)[ \t]+"
        rf"({UP}{{2,}}(?:[ \t]+(?:DE|DEL|LA|LAS|LOS|Y)[ \t]+)?(?:[ \t]*{UP}{{2,}}){{0,3}})\b",
        "capitals", group=1, layer="ruler", strip=True,
    ),
    Rule("PERSONA", rf"\b({UP}{ANY}{{2,}}),[ \t]+({UP}{ANY}{{2,}}(?:[ \t]+{UP}{ANY}{{2,}}){{0,3}})\b", "known", fold=False),
    Rule("PERSONA", rf"\b({UP}{LOW}{{2,}}(?:[ \t]+(?:(?:de|del|la|las|los|y)[ \t]+)?{UP}{LOW}{{2,}}){{1,5}})\b", "capitalised", fold=False),
    Rule("PERSONA", rf"\b({UP}{{2,}}(?:[ \t]+{UP}{{2,}}){{1,4}})\b", "known", fold=False),
    Rule("PERSONA", rf"\b(?:{ROLES}|sospechos[oa]|investigad[oa])\s+(?:[:,\.\s]+)?({UP}{LOW}{{3,}})\b", "name", group=1, layer="ruler"),
    Rule("PATENTE", rf"\b({PLATE})\b"),
    Rule("DOMICILIO", rf"\b((?:avenida|av\.?|avda\.?|calle|c/)\s+{UP}[\wÁÉÍÓÚÑáéíóúñ\s\.\'-]{{2,45}}?\s+n[°ºo\*]?\.?\s*\d{{1,5}})\b"),
    Rule("TELEFONO", r"\b(?:11|15|\d{4})[\s\-]\d{2,4}[\s\-]\d{4}\b", fold=False),
    Rule(
        "OTRO",
        r"\b(?:c[eé]dula|pasaporte|passport|c\.?\s*i\.?)\s+(?:colombian[oa]|argentino|extranjer[oa]|uruguay[oa]|dominicano|n[°º]\.?)?\s*"
        r"(?:n[°ºo\.]?|nro\.?)?\s*[:#]?\s*([A-Z0-9][\w\-]{5,16})\b",
        group=1,
    ),
    Rule("OTRO", rf"\b(?:nacido|nacida|fecha de nacimiento)[^\.\n]{{0,40}}?(\d{{1,2}}\s+de\s+{MONTHS}\s+de\s+\d{{4}})\b", group=1),
    Rule("EMPRESA", rf"\b(?:Hotel|Automotores|Local|Comercio|TOTOS)\s+({UP}[\wÁÉÍÓÚÑáéíóúñ\s&\-\.]{{2,40}}?)\b", "shop"),
]

#: The caption pattern of the catalog ends before one of these, and is at most so long where spaces run short.
CAPTION_END, CAPTION_LENGTH, LONG_SPACE = r"s\\?/|sobre\b", 400, r"\s{40}"

# Categories of the catalog's entities, and marks in descriptions of entries that stay out.
ENTITIES = {
    "RGX_CARATULA": "PERSONA", "RGX_PERSONA_ROL": "PERSONA", "RGX_LUGAR": "EMPRESA", "RGX_DOMICILIO": "DOMICILIO", "RGX_EXPEDIENTE": "EXPEDIENTE",
    "RGX_DNI": "DNI", "RGX_PASAPORTE": "DNI", "RGX_CUIL_CUIT": "CUIT", "RGX_CBU": "OTRO", "RGX_CUENTA_BANC": "OTRO", "RGX_CUENTA_BANCARIA": "OTRO",
    "RGX_TERMINACION_TARJETA": "OTRO", "RGX_CHEQUE": "OTRO", "RGX_URL": "OTRO", "RGX_EMAIL": "EMAIL", "RGX_TELEFONO": "TELEFONO", "RGX_PATENTE": "PATENTE",
    "RGX_IP": "OTRO",
}
OUT = ["desnudo", "aspiradora de numeros sueltos", "nacionalidad", "direcciones ipv4", "domicilios contextuales"]
