"""The rule catalog: external patterns that fill what the ordered rules leave, best score first.

A catalog is a parameter: a JSON array of objects with nombre_entidad, regex, score, descripcion and activa. The file is
the intended way to give one; the standard entries below serve without it. An entry whose pattern does not compile is
left out with a warning, on the driver, before any task starts.
"""

from __future__ import annotations

import json
import re
import warnings

# Entity, score and pattern of the standard catalog's entries.
STANDARD = [
    ('RGX_CARATULA', 0.96, '(?i)(["\\\'"]?[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ0-9\\s\\u00A0\\r\\n\\-.,&]{3,100}?(?:\\s+c\\.\\s+|\\s+c/\\s+|\\s+c\\\\/\\s+|\\bcontra\\b|\\bS\\.R\\.L\\.?\\b|\\bS\\.A\\.?\\b)[a-zA-ZÁÉÍÓÚÑáéíóúñüÜ0-9\\s\\u00A0\\r\\n\\-.,&]{0,80}?)(?=[\\s\\u00A0\\r\\n]*(?:s/|s\\\\/|sobre\\b))'),
    ('RGX_PERSONA_ROL', 0.96, '(?i)\\b(?:Dr[aa]?|DRA?|DR|Lic|Sres?|Sras?|Sr)\\b\\.?[\\s\\u00A0\\r\\n:]+([A-ZÁÉÍÓÚÑÜ][a-zA-ZÁÉÍÓÚÑáéíóúñüA-ZÁÉÍÓÚÑÜ]+(?:[\\s\\u00A0\\r\\n]+(?:de|la|las|los|del|y)?[\\s\\u00A0\\r\\n]*[A-ZÁÉÍÓÚÑÜ][a-zA-ZÁÉÍÓÚÑáéíóúñüA-ZÁÉÍÓÚÑÜ]+){1,5})'),
    ('RGX_PERSONA_ROL', 0.9, '\\b([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\\s\\u00A0\\.]{4,40}?)\\b[\\s\\u00A0\\r\\n]+(?:ABOGAD[OA]|Lp[\\s\\u00A0]*\\d+|D\\.?N\\.?I\\.?|C\\.U\\.I\\.[TL]\\.?|CUIT|CUIL|T[°º*])'),
    ('RGX_LUGAR', 0.85, '(?i)\\b(?:hotel(?:[\\s\\u00A0]+residencial)?|quiosco|kiosco|barber[íi]a|local|comercio)\\b(?:[\\s\\u00A0]+denominado|[\\s\\u00A0]+llamado|[\\s\\u00A0]+en[\\s\\u00A0]+el|[\\s\\u00A0]+["“])[\\s\\u00A0]*([A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+(?:[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+){0,2})["”]?'),
    ('RGX_LUGAR', 0.85, '(?i)\\b(?:denominad[oa]s?|llamad[oa]s?|conocid[oa]s?)[\\s\\u00A0]+(?:como[\\s\\u00A0]+)?(?:["“\\\']?)[\\s\\u00A0]*([A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+(?:[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+){0,3})[\\s\\u00A0]*(?:["”\\\']?)'),
    ('RGX_DOMICILIO', 0.9, '(?i)(?:(?:sit[oa]s?|ubicad[oa]s?)[\\s\\u00A0\\r\\n]+en[\\s\\u00A0\\r\\n]+(?:la[\\s\\u00A0\\r\\n]+)?(?:(?:calle|avenida|pasaje|psje\\.)[\\s\\u00A0\\r\\n]+)?|domicilios?[\\s\\u00A0\\r\\n]+(?:en|de)[\\s\\u00A0\\r\\n]+(?:la[\\s\\u00A0\\r\\n]+)?(?:(?:calle|avenida|pasaje|psje\\.)[\\s\\u00A0\\r\\n]+)?|(?:calle|avenida|pasaje|psje\\.)[\\s\\u00A0\\r\\n]+)([A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+(?:[\\s\\u00A0\\r\\n]+(?:de|la|las|los|el|del|y|e|DE|LA|EL|DEL)?[\\s\\u00A0\\r\\n]*[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+){0,3}[\\s\\u00A0\\r\\n]*(?:N[°º*oO]?\\.?|Nro\\.?|n[°º])?[\\s\\u00A0\\r\\n]*\\d{1,5}(?:[\\s\\u00A0\\r\\n,]+(?:piso|pb|oficina|of\\.?|depto\\.?|dto\\.?|departamento|habitaci[oó]n|hab\\.?)[\\s\\u00A0\\r\\n]*["\\\']?[\\d°ºA-Za-z\\.]+["\\\']?)*)'),
    ('RGX_DOMICILIO', 0.85, '(?i)(?:(?:sit[oa]s?|situad[oa]s?|ubicad[oa]s?)[\\s\\u00A0\\r\\n]+en[\\s\\u00A0\\r\\n]+(?:la[\\s\\u00A0\\r\\n]+)?(?:(?:calle|avenida|pasaje)[\\s\\u00A0\\r\\n]+)?|domicilios?[\\s\\u00A0\\r\\n]+(?:en|de)[\\s\\u00A0\\r\\n]+(?:la[\\s\\u00A0\\r\\n]+)?(?:(?:calle|avenida|pasaje)[\\s\\u00A0\\r\\n]+)?|(?:calle|avenida|pasaje)[\\s\\u00A0\\r\\n]+)([A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ\\s\\u00A0\\r\\n\\-\\.]+?(?:N[°º*oO]?\\.?|Nro\\.?)?[\\s\\u00A0\\r\\n]*\\d{1,5}(?:[,\\s\\u00A0\\r\\n]+(?:piso|pb|oficina|of\\.?|depto\\.?|dto\\.?|departamento|habitaci[oó]n|hab\\.?|torre|manzana|casa)[,\\s\\u00A0\\r\\n]*["\\\']?[\\w°ºA-Za-z\\-\\.]+["\\\']?(?:[,\\s\\u00A0\\r\\n]+(?:piso|pb|oficina|of\\.?|depto\\.?|dto\\.?|departamento|habitaci[oó]n)[,\\s\\u00A0\\r\\n]*["\\\']?[\\w°ºA-Za-z\\-\\.]+["\\\']?)*)*)'),
    ('RGX_DOMICILIO', 0.95, '(?i)\\b(?:CIRC|Circunscripci[óo]n)[\\s\\u00A0\\.\\-]*[A-Za-z0-9]+[\\s\\u00A0]*(?:SECC|Secci[óo]n)[\\s\\u00A0\\.\\-]*[A-Za-z0-9]+(?:[\\s\\u00A0]*(?:MANZ|Manzana|MZ|LOTE|PARCELA|CASA|BIS)[\\s\\u00A0\\.\\-]*[A-Za-z0-9]+)*\\b'),
    ('RGX_DOMICILIO', 0.85, '(?m)^[\\s\\u00A0]*[-–—][\\s\\u00A0]*([A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+(?:[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+){0,4}[\\s\\u00A0]+\\d{1,5}(?:[\\s\\u00A0,]+(?:(?:\\d+[°º]?[\\s\\u00A0]*)?(?:piso|pb|depto|dto|dpt|departamento|habitaci[óo]n)[\\s\\u00A0]*[\\d°ºA-Za-z]*))*?)'),
    ('RGX_DOMICILIO', 0.8, '(?i)(?:(?<=calle )|(?<=avenida )|(?<=av\\. ))[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñ]+(?:[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñ]+){0,2}\\b'),
    ('RGX_EXPEDIENTE', 0.95, '(?i)\\b(?:Expedientes?(?:[\\s\\u00A0]+SAC)?|EXPTE?\\.?|EXP\\b)[\\s\\u00A0]*(?:N[°ºoO]?\\.?|Nro\\.?)?[\\s\\u00A0]*:?[\\s\\u00A0]*(?:(?:I[\\s\\u00A0]*P[\\s\\u00A0]*P|D[\\s\\u00A0]*E[\\s\\u00A0]*B|S[\\s\\u00A0]*U[\\s\\u00A0]*X)[\\s\\u00A0]*)?((?!\\b(?:Nro|N[°ºoO*])\\b|Rgx_)[A-Za-z0-9]+(?:[\\s\\u00A0]*[\\-\\./][\\s\\u00A0]*[A-Za-z0-9]+)*)'),
    ('RGX_DNI', 0.95, '(?i)Pasaporte(?:[\\s\\u00A0]+[A-Za-z]+)?[\\s\\u00A0]*(\\d+[A-Z0-9\\-]*)'),
    ('RGX_DNI', 0.95, '(?i)\\bD\\.?N\\.?I\\.?[\\s\\u00A0\\r\\n]*(?:[Nn][°ºoO*]?\\.?[\\s\\u00A0\\r\\n]*)?:?[\\s\\u00A0\\r\\n]*([0-9O][0-9O\\.\\s\\u00A0\\r\\n]{4,12}[0-9O])(?![0-9a-zA-Z])'),
    ('RGX_CUIL_CUIT', 0.96, '(?i)(?<![a-zA-Z])(?:CUIL|CUIT|C\\.U\\.I\\.L\\.|C\\.U\\.I\\.T\\.)[\\s\\u00A0\\r\\n]*(?:N[\\s\\u00A0\\r\\n]*[°º*oO]?\\.?|Nro\\.?)?[\\s\\u00A0\\r\\n]*:?[\\s\\u00A0\\r\\n]*([0-9]{2}[\\s\\u00A0\\r\\n\\-]?[0-9]{8}[\\s\\u00A0\\r\\n\\-]?[0-9])(?![0-9a-zA-Z])'),
    ('RGX_CBU', 0.95, '(?i)\\b(?:CBU|C\\.B\\.U\\.)[\\s\\u00A0]*(?:Nro\\.?|N[°º*oO]?\\.?|[:\\-])?[\\s\\u00A0]*(\\d{22})\\b'),
    ('RGX_CUENTA_BANC', 0.95, '(?i)\\b(?:cuenta|cc|ca|c/c|c/a)[\\s\\u00A0]*(?:n[°ºoO]?\\.?[\\s\\u00A0]*)?:?[\\s\\u00A0]*([0-9\\-]+)'),
    ('RGX_URL', 0.95, '(?i)(https?:\\/\\/(?:www\\.)?[-a-zA-Z0-9@:%._\\+~#=]{1,256}\\.[a-zA-Z0-9()]{1,6}\\b(?:[-a-zA-Z0-9()@:%_\\+.~#?&\\/=]*))'),
    ('RGX_EMAIL', 0.95, '([a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,})'),
    ('RGX_TELEFONO', 0.88, '(?i)(?:tel[ée]fonos?|tel\\.?|celulares?|cel\\.?|fijos?|l[ií]neas?)[\\s\\u00A0\\r\\n\\:\\.\\-]*(\\+?(?:[0-9][\\s\\u00A0\\r\\n\\.\\-—–\\/]*){7,15}[0-9])'),
    ('RGX_PATENTE', 0.95, '(?i)\\b([A-Z]{2}[\\s\\u00A0\\-]?[0-9]{3}[\\s\\u00A0\\-]?[A-Z]{2}|[A-Z]{3}[\\s\\u00A0\\-]?[0-9]{3}|[A-Z][0-9]{3}[A-Z]{3})\\b'),
    ('RGX_CUENTA_BANCARIA', 0.93, '(?i)(?:cuenta[s]?(?:[\\s\\u00A0]+(?:caja[\\s\\u00A0]+de[\\s\\u00A0]+ahorros?|corriente|sueldo|de[\\s\\u00A0]+ahorro)[s]?)?(?:[\\s\\u00A0]+en[\\s\\u00A0]+\\w+)?|cta\\.?)[\\s\\u00A0]+(?:en[\\s\\u00A0]+\\w+[\\s\\u00A0]+)?(?:N[°º]?[\\s\\u00A0]*)?([0-9]{10,21})(?![0-9])'),
    ('RGX_TERMINACION_TARJETA', 0.95, '(?i)terminad[ao][\\s\\u00A0]+(?:con|en)[\\s\\u00A0]+(?:N[°º]?[\\s\\u00A0]*)?([0-9]{4,6})\\b'),
    ('RGX_TELEFONO', 0.9, '(?i)(?:tel[ée]fonos?|tel\\.?|e[\\-\\s]?mail|email)?[\\s\\u00A0:]*(\\d{4}[\\-]\\d{4}[\\/]\\d{4})'),
    ('RGX_PASAPORTE', 0.95, '(?i)\\b(?:pasaporte|passport)(?:[\\s\\u00A0]+(?:dominicano|argentino|extranjero|uruguayo|chileno|boliviano|paraguayo|peruano|venezolano|colombiano|brasilero|brasileño|n[°º]\\.?))?[\\s\\u00A0:]*([A-Z0-9][\\w\\-\\.]{5,20})'),
    ('RGX_DOMICILIO', 0.92, '(?i)(?:sit[oa]s?|ubicad[oa]s?|domicilios?)[\\s\\u00A0\\r\\n]+en[\\s\\u00A0\\r\\n]+(?:la[\\s\\u00A0\\r\\n]+)?((?:Av\\.|Avda\\.|Avta\\.|Gral\\.|Tte\\.|Cnel\\.|Pte\\.)[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+(?:[\\s\\u00A0]+[A-ZÁÉÍÓÚÑ][a-zA-ZÁÉÍÓÚÑáéíóúñüÜ]+){0,2}(?:[\\s\\u00A0,]*\\d{1,5})?(?:[\\s\\u00A0\\r\\n,]+(?:piso|pb|oficina|of\\.?|depto\\.?|dto\\.?|departamento|habitaci[oó]n)[\\s\\u00A0\\r\\n]*["\\\']?[\\d°ºA-Za-z\\.]+["\\\']?)*)'),
]


def load(path: str | None = None) -> list[tuple[str, float, str]]:
    """(entity, score, pattern) of the active entries that are mapped to a category, in order of use."""
    from .rules import ENTITIES, OUT

    found = STANDARD
    if path:
        with open(path, encoding="utf-8") as f:
            rows = json.load(f)
        found = [
            (r.get("nombre_entidad", ""), float(r.get("score") or 0.8), r["regex"])
            for r in rows
            if r.get("activa", True) and r.get("regex") and not any(m in (r.get("descripcion") or "").lower() for m in OUT)
        ]
    return sorted((r for r in found if r[0] in ENTITIES and _compiles(r[2])), key=lambda r: (-r[1], r[0]))


def _compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error as e:
        warnings.warn(f"catalog pattern left out, {e}: {pattern[:80]}", stacklevel=3)
        return False
    return True
