"""Case files with known spans: texts for the rules of the rule layer and for many catalog entries, near misses among them.

A case is a list of parts: literal text, V (an SQL expression over k, the row's number) or H (a hit: its category, layer,
whether the validity rules let it stand, and its text in parts). Texts and expected spans are put together from the same
parts by plain SQL that Spark and other engines read alike, so spans follow by counting characters, not by scanning.
"""

from __future__ import annotations

from typing import NamedTuple


class V(NamedTuple):
    sql: str


class H(NamedTuple):
    cat: str
    layer: str
    valid: bool
    parts: tuple


def hit(cat: str, *parts, layer: str = "regex", valid: bool = True) -> H:
    return H(cat, layer, valid, parts)


def one_of(*values: str, step: int = 1) -> V:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return V(f"CASE FLOOR(k / {step}) % {len(values)} {arms} ELSE '{values[-1]}' END")


def digits(n: int, factor: int = 7919) -> V:
    return V(f"LPAD(CAST((k * {factor}) % {10**n} AS STRING), {n}, '0')")


def lead(n: int) -> V:
    """n digits that don't begin with a zero."""
    return V(f"CAST({10 ** (n - 1)} + (k * 7907) % {9 * 10 ** (n - 1)} AS STRING)")


# Tax numbers whose check digit is right, and one off.
CUITS = ("20-12345678-6", "27-23456789-1", "30-50001091-2", "20 22333444 0")
WRONG = ("20-12345678-5", "27-23456789-4", "30-50001091-5")
PERSON = one_of("Juan Carlos Pérez", "Marta Gómez", "Lucía Benítez", "Pedro Álvarez", step=3)
CAPITALS = one_of("JUAN CARLOS PEREZ", "MARTA GOMEZ", "LUCIA BENITEZ", step=3)
LAST = one_of("Gómez", "Pérez", "Benítez", "Sosa", step=3)
STREET = one_of("Belgrano", "Moreno", "San Martín", "Corrientes", step=5)
RULER, V2 = {"layer": "ruler"}, {"layer": "regex_v2"}
NO = {"valid": False}

#: (category, rule, parts); rules are numbered as the rule layer orders them, catalog entries as the catalog does.
CASES = [
    ("EXPEDIENTE", "1 court code", ["Obra en ", hit("EXPEDIENTE", one_of("EXP J-01-", "J-02-"), digits(6), "-1/2021-0"), " la constancia."]),
    ("EXPEDIENTE", "1 court code, short", ["Obra en J-1-", digits(3), "-1/2021-0 la constancia."]),
    ("EXPEDIENTE", "2 docket", ["Ver ", hit("EXPEDIENTE", one_of("EXP. ", "exp "), lead(5), "-2021/7"), " agregado."]),
    ("EXPEDIENTE", "11 labelled code", ["en ", hit("EXPEDIENTE", one_of("autos AB-", "causa N° ", "Expte. n°: "), lead(4), "/2021"), " se ordena"]),
    ("EXPEDIENTE", "11 labelled word", ["en autos principales se ordena"]),
    ("EXPEDIENTE", "12 labelled number", ["en la ", hit("EXPEDIENTE", "causa N° ", lead(3)), " se ordena"]),
    ("EXPEDIENTE", "13 FS and LE", ["registro ", hit("EXPEDIENTE", one_of("FS ", "LE ", "L.E. "), lead(4), "/2021"), " archivado"]),
    ("EXPEDIENTE", "14 number", ["oficio ", hit("EXPEDIENTE", one_of("nro. ", "n° ", "número "), lead(4), "/2021-3"), " librado"]),
    ("EXPEDIENTE", "14 no number", ["oficio nro. ", lead(4), " librado"]),
    ("EXPEDIENTE", "c10 catalog docket", ["Expediente SAC ", hit("EXPEDIENTE", lead(7), **V2), ", agregado"]),
    ("EXPEDIENTE", "c10 catalog word", ["Expte ", hit("EXPEDIENTE", one_of("abcdef", "qwerty"), **V2, **NO), ", agregado"]),
    ("CUIT", "3 labelled", ["Registra ", hit("CUIT", one_of("CUIT N° ", "CUIL: ", "C.U.I.T. "), one_of(*CUITS, step=3)), " activo."]),
    ("CUIT", "3 wrong check digit", ["Registra CUIT ", one_of(*WRONG), " activo."]),
    ("CUIT", "4 bare", ["Registra el ", hit("CUIT", one_of(*CUITS)), " activo."]),
    ("CUIT", "5 electronic domicile", ["fija domicilio ", one_of("electrónico", "fiscal"), " ", hit("CUIT", "20123456786"), " aqui"]),
    ("CUIT", "c2 catalog", ["CUIT*: ", one_of(*WRONG), " y nada"]),
    ("DNI", "6 dotted", ["Exhibe documento ", hit("DNI", lead(2), ".", digits(3), ".", digits(3, 31)), " vigente."]),
    ("DNI", "6 short", ["Exhibe documento ", lead(2), ".", digits(3), ".", digits(2), " vigente."]),
    ("DNI", "6 money", [one_of("por la suma de ", "honorarios: ", "pagó $ "), hit("DNI", lead(2), ".", digits(3), ".", digits(3, 31), **NO), " en efectivo"]),
    ("DNI", "6 money, labelled", ["por la suma reclamada, DNI ", hit("DNI", lead(2), ".", digits(3), ".", digits(3, 31)), " en efectivo"]),
    ("DNI", "c7 catalog, O for 0", ["Su DNI: ", hit("DNI", lead(2), "O", digits(5), **V2), ", vigente"]),
    ("DNI", "c6 passport", ["Pasaporte Libre ", hit("DNI", lead(7), **V2, **NO), ", vigente, total pagado"]),
    ("DNI", "c11 passport", ["passport: ", hit("DNI", "P.", lead(7), **V2), " vigente"]),
    ("EMAIL", "7 address", ["escribir a ", hit("EMAIL", one_of("maria.lopez", "j_perez+x"), digits(3), "@estudio.com.ar"), " hoy"]),
    ("EMAIL", "7 no domain", ["escribir a maria", digits(3), "@estudio hoy"]),
    ("TELEFONO", "8 international", ["llamar al ", hit("TELEFONO", "+54 9 11 4", digits(3), "-", digits(4)), " hoy"]),
    ("TELEFONO", "8 national", ["llamar al ", hit("TELEFONO", one_of("11 4", "15 4"), digits(3), "-", digits(4)), " hoy"]),
    ("TELEFONO", "8 short", ["llamar al 4", digits(3), "-", digits(4), " hoy"]),
    ("TELEFONO", "8 inside a longer number", ["tel 0", hit("TELEFONO", "11-4567-", digits(4)), " hoy"]),
    ("TELEFONO", "28 separated", ["tel ", hit("TELEFONO", "4", digits(3), " 456 ", digits(4)), " fijo"]),
    ("TELEFONO", "c19 pair", ["tel. ", hit("TELEFONO", "4", digits(3), "-", digits(4), "/", digits(4, 31), **V2), " fijo"]),
    ("TELEFONO", "c20 labelled", ["cel. ", hit("TELEFONO", "3", digits(2), ".41", digits(3), "2.", digits(3), **V2, **NO), ", fijo"]),
    ("TELEFONO", "c20 labelled, with a dash", ["línea ", hit("TELEFONO", "3", digits(2), "-41", digits(3), "/", digits(3), **V2), ", fijo"]),
    ("EMPRESA", "9 suffix", [hit("EMPRESA", one_of("Pinturas Del Sur ", "Molino Norte ", "Aceros Unidos "), one_of("S.R.L", "S.A", "SACIFIA", "Cooperativa", step=3)), " entrega el informe."]),
    ("EMPRESA", "9 no suffix", ["Molino Norte SRX entrega el informe."]),
    ("EMPRESA", "31 shop", ["un ", hit("EMPRESA", one_of("TOTOS Norte", "Comercio Sur", "Local Oeste")), ", cerrado"]),
    ("EMPRESA", "c23 named shop", ["kiosco llamado ", hit("EMPRESA", one_of("Aurora", "Luna"), **V2), ", cerrado"]),
    ("EMPRESA", "c24 called", ["un bar conocido como ", hit("EMPRESA", one_of("Aurora", "Luna"), **V2), ", cerrado"]),
    ("DOMICILIO", "10a compound", ["vive en ", hit("DOMICILIO", one_of("calle ", "Avenida "), STREET, " ", lead(4), ", piso 3, depto B"), "; sigue"]),
    ("DOMICILIO", "10b generic", ["vive en ", hit("DOMICILIO", one_of("calle ", "Avenida ", "pasaje "), STREET, " ", lead(4)), "; sigue"]),
    ("DOMICILIO", "10b refused beginnings", ["vive en calle ", hit("DOMICILIO", one_of("Lavalle ", "Defensa "), lead(4), **V2, **NO), "; sigue"]),
    ("DOMICILIO", "10c constituted", ["con domicilio constituido en ", hit("DOMICILIO", STREET, " ", lead(4), ", Rosario", **NO), " y electrónico aparte"]),
    ("DOMICILIO", "10c with a street word", ["con domicilio constituido en ", "la ", hit("DOMICILIO", "calle ", STREET, " ", lead(4), " y electrónico aparte")]),
    ("DOMICILIO", "10d sited", ["cargo ", one_of("sito en ", "domicilio real en "), hit("DOMICILIO", STREET, " ", lead(4), **NO), " y como sede"]),
    ("DOMICILIO", "10e postal code", ["codigo postal ", hit("DOMICILIO", one_of("B", "C"), lead(4), "ABC"), " de zona"]),
    ("DOMICILIO", "27 avenue and number", ["en ", hit("DOMICILIO", "avenida ", STREET, " N° ", lead(4)), "; esquina"]),
    ("DOMICILIO", "c22 bulleted", ["- ", hit("DOMICILIO", one_of("Belgrano", "Moreno", "Corrientes"), " ", lead(4), **V2, **NO), "\nfin"]),
    ("ORGANISMO", "15 court", ["interviene ", hit("ORGANISMO", one_of("Juzgado Civil Nro ", "Tribunal Oral "), lead(1)), "; sigue"]),
    ("ORGANISMO", "15 prosecutor", ["interviene ", hit("ORGANISMO", one_of("Fiscalía General Adjunta", "Defensoría Oficial Civil")), ", sigue"]),
    ("ORGANISMO", "15 with a verb", ["interviene ", hit("ORGANISMO", one_of("Juzgado Civil declara nulo", "Cámara Penal considera tal"), **NO), ", sigue"]),
    ("ORGANISMO", "15 chamber's room", ["interviene ", hit("ORGANISMO", one_of("Sala II Segunda Norte", "Sala IV Cuarta Oeste"), **NO), ", sigue"]),
    ("ORGANISMO", "15 too long", ["interviene ", hit("ORGANISMO", "Juzgado Civil Comercial Laboral Penal Rural Minero", **NO), ", sigue"]),
    ("PERSONA", "16 caption", [hit("PERSONA", CAPITALS, **RULER), " C/ ", hit("PERSONA", one_of("ZUTANO FULANO", "RIOS MARIA"), **RULER), " S/ daños"]),
    ("PERSONA", "16 caption without a subject", [hit("PERSONA", CAPITALS, **RULER), " CONTRA ", hit("PERSONA", "ZUTANO FULANO", **RULER, **NO), "."]),
    ("PERSONA", "17 title", ["ante ", one_of("la Dra. ", "el Sr. ", "don "), hit("PERSONA", PERSON), ", se firma"]),
    ("PERSONA", "17 title, unknown name", ["ante el Lic. ", hit("PERSONA", one_of("Zutano Fulano", "Mengano Perengano"), **NO), ", se firma"]),
    ("PERSONA", "18 role", ["comparece ", one_of("el imputado ", "la víctima ", "el testigo "), hit("PERSONA", PERSON, **RULER), ", y declara"]),
    ("PERSONA", "18 role inside a word", ["los menor", hit("PERSONA", "es involucrados", layer="ruler", **NO), ", y declaran"]),
    ("PERSONA", "19 initials", ["firma ", hit("PERSONA", "Juan ", one_of("J. ", "A. B. "), LAST), " ayer"]),
    ("PERSONA", "19 initials, unknown name", ["firma ", hit("PERSONA", "Zutano J. Mengano", **NO), " ayer"]),
    ("PERSONA", "20 title and surname", ["saluda ", one_of("la Sra. ", "el Sr. "), hit("PERSONA", LAST, **RULER), ", hoy"]),
    ("PERSONA", "20 administrative surname", ["saluda la Sra. ", hit("PERSONA", "Carrera", **RULER, **NO), ", hoy"]),
    ("PERSONA", "21 title and capitals", ["ante el Ing. ", hit("PERSONA", one_of("PEREZ", "GOMEZ"), **RULER), ", hoy"]),
    ("PERSONA", "22 surname first", ["firma ", hit("PERSONA", one_of("PEREZ, ", "Gómez, "), one_of("Pedro", "Marta", step=3)), "."]),
    ("PERSONA", "22 cut at a comma", ["firma GOMEZ, ", hit("PERSONA", "Pedro Luis"), "."]),
    ("PERSONA", "23 capitalised", ["firma ", hit("PERSONA", PERSON), " ayer"]),
    ("PERSONA", "23 unknown names", ["firma ", one_of("Zutano Fulano", "Norte Grande"), " ayer"]),
    ("PERSONA", "23 cut at y", ["firma ", hit("PERSONA", PERSON), " y nadie"]),
    ("PERSONA", "24 capitals", ["firma ", hit("PERSONA", CAPITALS), " ayer"]),
    ("PERSONA", "25 role and surname", ["la víctima ", hit("PERSONA", LAST, **RULER), ", hoy"]),
    ("PERSONA", "25 role, unknown", ["la víctima ", one_of("Zutano", "Mengana"), ", hoy"]),
    ("PATENTE", "26 plates", ["rodado ", hit("PATENTE", one_of("AB123CD", "ABC 123", "A123BCD", "XY-456-ZT")), ", en cochera"]),
    ("PATENTE", "26 law", ["según ", hit("PATENTE", one_of("Ley ", "Art "), lead(3), **NO), ", vigente"]),
    ("PATENTE", "26 too short", ["rodado AB ", digits(2), " CD, en cochera"]),
    ("OTRO", "29 card", ["su ", one_of("cédula colombiana N° ", "pasaporte N° "), hit("OTRO", "AB", lead(6)), " vigente"]),
    ("OTRO", "30 birth date", [one_of("nacido en Rosario el ", "fecha de nacimiento: "), hit("OTRO", lead(1), " de mayo de 19", lead(2)), ", según acta"]),
    ("OTRO", "30 other date", ["firmado el ", lead(1), " de mayo de 19", lead(2), ", según acta"]),
    ("OTRO", "c4 CBU", ["CBU ", hit("OTRO", lead(2), "34567890123456789", digits(3), **V2, **NO), ", activa"]),
    ("OTRO", "c5 account", ["cuenta ", hit("OTRO", lead(3), "-", digits(3), **V2, **NO), ", activa"]),
    ("OTRO", "c13 card ending", ["tarjeta terminada en ", hit("OTRO", lead(4), **V2, **NO), ", activa"]),
    ("OTRO", "c14 URL", ["ver ", hit("OTRO", "http://www.sitio", digits(3), ".com.ar/pagina?x=1", **V2, **NO), " hoy"]),
    ("OTRO", "c15 bank account", ["cuenta corriente en pesos N° ", hit("OTRO", lead(2), "34567890123", **V2, **NO), ", activa"]),
]



#: (predicate, category, text to the left, surface, text to the right of its start, may stand, may stand if selected by hand).
VALIDITY = [
    ("too short", "EMPRESA", "", "S", "S", False, False),
    ("no rule for companies", "EMPRESA", "", "presidente de la Mutual", "", True, True),
    ("known given name and surname", "PERSONA", "", "Juan Pérez", "", True, True),
    ("given name, unknown surname", "PERSONA", "", "Juan Zutano", "", True, True),
    ("one known word", "PERSONA", "", "Pérez", "", True, True),
    ("one unknown word", "PERSONA", "", "Zutano", "", False, True),
    ("two unknown words", "PERSONA", "", "Zutano Fulano", "", False, True),
    ("six words", "PERSONA", "", "Juan Luis Carlos Pedro Pablo Pérez", "", False, True),
    ("stop word of two", "PERSONA", "", "Ana Mendoza", "", False, False),
    ("stop word of four", "PERSONA", "", "Ana María de Pérez", "", True, True),
    ("administrative word", "PERSONA", "", "Zutano Pérez General", "", False, True),
    ("administrative word with a given name", "PERSONA", "", "Juan Carrera", "", True, True),
    ("all administrative", "PERSONA", "", "Salud Pública", "", False, True),
    ("citation", "PERSONA", "", "Pérez c/ Gómez", "", False, False),
    ("institution inside", "PERSONA", "", "Juzgado Pérez", "", False, False),
    ("dispuso inside", "PERSONA", "", "Dispuso Juan Pérez", "", False, False),
    ("narrative phrase", "PERSONA", "", "Juan manifiesta que Pérez", "", False, False),
    ("narrative verb among four words", "PERSONA", "", "Juan Pérez solicita Gómez", "", False, False),
    ("verb among three words", "PERSONA", "", "Juan solicita Pérez", "", True, True),
    ("over 40 characters", "PERSONA", "", "Juan Carlos Maximiliano Ezequiel Gutiérrez", "", False, False),
    ("contains que", "PERSONA", "", "Juan que Pérez", "", False, False),
    ("not a name", "PERSONA", "", "Firma", "", False, True),
    ("initial and known word", "PERSONA", "", "Zutano J. Pérez", "", True, True),
    ("initial, none known", "PERSONA", "", "Zutano J. Mengano", "", False, True),
    ("caption around", "PERSONA", "autos ", "Zutano Fulano", "Zutano Fulano c/ Otro s/ daños", True, True),
    ("caption without a subject", "PERSONA", "autos ", "Zutano Fulano", "Zutano Fulano c/ Otro", False, True),
    ("caption, one word in lower case", "PERSONA", "autos ", "Zutano", "Zutano c/ Otro s/ daños", False, True),
    ("caption, capitals", "PERSONA", "contra ", "ZUTANO", "ZUTANO sobre daños", True, True),
    ("docket with a number", "EXPEDIENTE", "", "expediente 123", "", True, True),
    ("docket by strong format", "EXPEDIENTE", "", "J-01-123456-1/2021-0", "", True, True),
    ("docket without a digit", "EXPEDIENTE", "", "expediente principal", "", False, False),
    ("docket with a dash only", "EXPEDIENTE", "", "expediente ab-cd", "", True, True),
    ("docket beginning with no", "EXPEDIENTE", "", "notifíquese", "", False, False),
    ("docket beginning with exp", "EXPEDIENTE", "", "expresa 12", "", False, False),
    ("docket, no label, no digit", "EXPEDIENTE", "", "abc/def", "", False, False),
    ("docket that is a formula", "EXPEDIENTE", "", "autos", "", False, False),
    ("street and number", "DOMICILIO", "", "calle Moreno 123", "", True, True),
    ("street that is narrative", "DOMICILIO", "", "calle donde 123", "", False, False),
    ("street without a number", "DOMICILIO", "", "calle Moreno", "", False, False),
    ("street, comma", "DOMICILIO", "", "calle Moreno, Rosario", "", True, True),
    ("blocked phrase", "DOMICILIO", "", "calle 12 del territorio nacional", "", False, False),
    ("year", "DOMICILIO", "calle ", "1999", "1999", False, False),
    ("number near a street", "DOMICILIO", "la calle Moreno n° ", "123", "123", True, True),
    ("number alone", "DOMICILIO", "el día ", "123", "123", False, False),
    ("postal code", "DOMICILIO", "", "B1234ABC", "", True, True),
    ("no street word, street near, long", "DOMICILIO", "vive en calle ", "Corrientes y Moreno 1234", "", True, True),
    ("no street word, street near, short", "DOMICILIO", "vive en calle ", "Corrientes 1234", "", False, False),
    ("no street word, none near", "DOMICILIO", "vive en ", "Corrientes y Moreno 1234", "", False, False),
    ("situation of risk", "DOMICILIO", "", "persona en situación de calle", "", False, False),
    ("a name", "DOMICILIO", "", "juan", "", False, False),
    ("phone with spaces", "TELEFONO", "", "341 412 3456", "", True, True),
    ("phone without marks", "TELEFONO", "", "3414123456", "", False, False),
    ("phone of eight digits", "TELEFONO", "", "4123-4567", "", False, False),
    ("phone of fourteen digits", "TELEFONO", "", "+54 341 4123 456789", "", False, False),
    ("phone beginning 0205", "TELEFONO", "", "0205-4123456", "", False, False),
    ("number in a sum", "DNI", "la suma de ", "12.345.678", "12.345.678", False, False),
    ("number after a peso sign", "DNI", "$ ", "12.345.678", "12.345.678", False, False),
    ("labelled number in a sum", "DNI", "honorarios de DNI ", "12.345.678", "12.345.678", True, True),
    ("number before a sum", "DNI", "", "12.345.678", "12.345.678 por el monto", False, False),
    ("six digits", "DNI", "", "123.456", "123.456", False, False),
    ("plain number", "DNI", "", "1.234.567", "1.234.567 y firma", True, True),
    ("court", "ORGANISMO", "", "Juzgado Civil Nro 5", "", True, True),
    ("court of seven words", "ORGANISMO", "", "Juzgado a b c d e f", "", False, False),
    ("court with a verb", "ORGANISMO", "", "Juzgado que declara", "", False, False),
    ("court cut off", "ORGANISMO", "", "Juzgado Civil Nro", "", False, False),
    ("no institution", "ORGANISMO", "", "Sala Segunda", "", False, False),
    ("functional unit", "ORGANISMO", "", "Tribunal Unidad Funcional", "", False, False),
    ("plate", "PATENTE", "", "AB 123 CD", "", True, True),
    ("legal reference", "PATENTE", "", "Inc 123", "", False, False),
    ("plate of two letters", "PATENTE", "", "AB 123", "", False, False),
    ("date of birth", "OTRO", "nacida el ", "5 de mayo de 1980", "", True, True),
    ("another date", "OTRO", "firmado el ", "5 de mayo de 1980", "", False, False),
    ("identity code", "OTRO", "pasaporte N° ", "AB123456", "", True, True),
    ("code without an identity word", "OTRO", "factura N° ", "AB123456", "", False, False),
    ("code without a digit", "OTRO", "pasaporte N° ", "ABCDEFGH", "", False, False),
    ("e-mail", "EMAIL", "", "a@b.co", "", True, True),
    ("tax number", "CUIT", "", "20123456786", "", True, True),
]

#: (rule, mentions (category, surface, start), groups (members, confidence, reasons)); ids are the mentions' places in the list.
LINKS = [
    ("exact after titles", [("PERSONA", "Dr. Juan Pérez", 0), ("PERSONA", "Juan Pérez", 500)], [("0 1", "alta", "exact")]),
    ("initials, one given as a letter", [("PERSONA", "J. C. Pérez", 0), ("PERSONA", "Juan Carlos Pérez", 500)], [("0 1", "alta", "initials_match")]),
    ("initials, other first letter", [("PERSONA", "M. Pérez", 0), ("PERSONA", "Juan Pérez", 500)], []),
    ("same first name, longer", [("PERSONA", "Juan Pérez", 0), ("PERSONA", "Juan Pérez Gómez", 500)], [("0 1", "alta", "initials_match")]),
    ("same first name, name between", [("PERSONA", "Juan Pérez", 0), ("PERSONA", "Juan Carlos Pérez", 500)], []),
    ("shared surname, score over 92", [("PERSONA", "Juana Pérez", 0), ("PERSONA", "Juan Pérez", 500)], [("0 1", "alta", "shared_surname")]),
    ("shared surname, score 85 to 92", [("PERSONA", "Luciana Gómez", 0), ("PERSONA", "Lucia Gómez", 500)], [("0 1", "media", "shared_surname")]),
    ("shared surname, low score", [("PERSONA", "Marta Pérez", 0), ("PERSONA", "Pablo Pérez", 500)], []),
    ("other surname", [("PERSONA", "Juan Pérez", 0), ("PERSONA", "Juan Gómez", 500)], []),
    ("unknown surnames, both ends count", [("PERSONA", "Zutano Fulano", 0), ("PERSONA", "Zutano Fulan", 500)], [("0 1", "alta", "initials_match")]),
    ("numbers, one digit off", [("DNI", "12.345.678", 0), ("DNI", "12.345.679", 500)], [("0 1", "media", "fuzzy_medium")]),
    ("numbers, three digits off", [("DNI", "12.345.678", 0), ("DNI", "12.345.901", 500)], []),
    ("companies, one letter off", [("EMPRESA", "Aceros Unidos del Sur SA", 0), ("EMPRESA", "Aceros Unidos del Sud SA", 500)], [("0 1", "alta", "fuzzy_high")]),
    ("companies, words in another order", [("EMPRESA", "Unidos Aceros del Sur", 0), ("EMPRESA", "Aceros Unidos del Sur", 500)], [("0 1", "alta", "fuzzy_high")]),
    ("other categories", [("EMPRESA", "Juan Pérez", 0), ("PERSONA", "Juan Pérez", 500)], []),
    ("near one identifier", [("PERSONA", "J. Pérez", 0), ("DNI", "12.345.678", 60), ("PERSONA", "Juan Pérez", 200)], [("0 2", "alta", "initials_match|shared_identifier")]),
    ("far from the identifier", [("PERSONA", "J. Pérez", 0), ("DNI", "12.345.678", 60), ("PERSONA", "Juan Pérez", 261)], [("0 2", "alta", "initials_match")]),
    ("near, but other persons", [("PERSONA", "Marta Pérez", 0), ("CUIT", "20123456786", 60), ("PERSONA", "Juan Gómez", 100)], []),
    ("two identifiers between", [("PERSONA", "Juan Pérez", 0), ("DNI", "12.345.678", 60), ("CUIT", "20123456786", 90), ("PERSONA", "Juan Pérez", 150)], [("0 3", "alta", "exact|shared_identifier")]),
    ("chain of three", [("PERSONA", "J. Pérez", 0), ("EMAIL", "a@b.co", 300), ("PERSONA", "Juan Pérez", 500), ("PERSONA", "Juan Pérez Gómez", 900)], [("0 2 3", "alta", "initials_match")]),
    ("two groups", [("EMAIL", "x@y.co", 0), ("PERSONA", "Ana Sosa", 300), ("EMPRESA", "Aceros SA", 400), ("PERSONA", "Ana Sosa", 600), ("EMPRESA", "Aceros SA", 900)], [("1 3", "alta", "exact"), ("2 4", "alta", "exact")]),
    ("digits only", [("CUIT", "20123456786", 0), ("CUIT", "20123456786", 500)], []),
    ("short surfaces", [("PERSONA", "Ana", 0), ("PERSONA", "Ana", 500)], []),
    ("short address", [("DOMICILIO", "Sur 12", 0), ("DOMICILIO", "Sur 12", 500)], []),
    ("short address with a street word", [("DOMICILIO", "calle Sur 12", 0), ("DOMICILIO", "calle Sur 12", 500)], [("0 1", "alta", "exact")]),
    ("alone", [("PERSONA", "Juan Pérez", 0)], []),
]


#: The document that every review case begins with: text, detections (category, text, placeholder, places), one group.
REVIEWED = "Ana vio a Ana y a Luis en Sur SA; Ana Sosa"
DETECTED = [("PERSONA", "Ana", "[PERSONA_1]", [(0, 3), (10, 13)]), ("PERSONA", "Luis", "[PERSONA_2]", [(18, 22)]), ("EMPRESA", "Sur SA", "[EMPRESA_1]", [(26, 32)]), ("PERSONA", "Ana Sosa", "[PERSONA_3]", [(34, 42)])]
_D = "0/PERSONA/Ana/[PERSONA_1]/true//2", "1/PERSONA/Luis/[PERSONA_2]/true//1", "2/EMPRESA/Sur SA/[EMPRESA_1]/true//1", "3/PERSONA/Ana Sosa/[PERSONA_3]/true//1"
_G = "sug_0/suggested//Ana/m0,m1"
_T = "{0} vio a {0} y a {1} en {2}; {3}"


def _said(*names: str) -> str:
    return _T.format(*names)


_ALL = ("[PERSONA_1]", "[PERSONA_2]", "[EMPRESA_1]", "[PERSONA_3]")
#: (rule, actions, detections (id/category/text/placeholder/enabled/group/places), groups (id/status/placeholder/texts/mentions), preview, refused).
REVIEWS = [
    ("remove", [("remove", {"id": "1"})], [_D[0], "1" + _D[2][1:], "2" + _D[3][1:]], [_G], _said("[PERSONA_1]", "Luis", "[EMPRESA_1]", "[PERSONA_3]"), ""),
    ("remove, unknown", [("remove", {"id": "9"})], [*_D], [_G], _said(*_ALL), "1"),
    ("remove from its group", [("confirm", {"cluster": "sug_0"}), ("remove", {"id": "0"})], ["0" + _D[1][1:], "1" + _D[2][1:], "2" + _D[3][1:]], ["sug_0/confirmed/[PERSONA_1]//"], _said("Ana", *_ALL[1:]), ""),
    ("update category", [("update", {"id": "1", "cat": "EMPRESA"})], [_D[0], "1/EMPRESA/Luis/[EMPRESA_2]/true//1", _D[2], _D[3]], [_G], _said("[PERSONA_1]", "[EMPRESA_2]", "[EMPRESA_1]", "[PERSONA_3]"), ""),
    ("update placeholder", [("update", {"id": "1", "placeholder": " [X] "})], [_D[0], "1/PERSONA/Luis/[X]/true//1", _D[2], _D[3]], [_G], _said("[PERSONA_1]", "[X]", "[EMPRESA_1]", "[PERSONA_3]"), ""),
    ("update, blank placeholder", [("update", {"id": "1", "placeholder": "  "})], [*_D], [_G], _said(*_ALL), "1"),
    ("update enabled", [("update", {"id": "2", "enabled": "false"})], [*_D[:2], "2/EMPRESA/Sur SA/[EMPRESA_1]/false//1", _D[3]], [_G], _said("[PERSONA_1]", "[PERSONA_2]", "Sur SA", "[PERSONA_3]"), ""),
    ("confirm", [("confirm", {"cluster": "sug_0"})], ["0/PERSONA/Ana/[PERSONA_1]/true/sug_0/2", *_D[1:]], ["sug_0/confirmed/[PERSONA_1]/Ana/m0,m1"], _said(*_ALL), ""),
    ("confirm enables", [("update", {"id": "0", "enabled": "false"}), ("confirm", {"cluster": "sug_0"})], ["0/PERSONA/Ana/[PERSONA_1]/true/sug_0/2", *_D[1:]], ["sug_0/confirmed/[PERSONA_1]/Ana/m0,m1"], _said(*_ALL), ""),
    ("create and confirm", [("create_cluster", {"ids": "1,3"}), ("confirm", {"cluster": "manual_1"})], [_D[0], "1/PERSONA/Luis/[PERSONA_1]/true/manual_1/1", _D[2], "3/PERSONA/Ana Sosa/[PERSONA_1]/true/manual_1/1"], [_G, "manual_1/confirmed/[PERSONA_1]/Luis,Ana Sosa/m2,m4"], _said("[PERSONA_1]", "[PERSONA_1]", "[EMPRESA_1]", "[PERSONA_1]"), ""),
    ("second group's number", [("confirm", {"cluster": "sug_0"}), ("create_cluster", {"ids": "1"}), ("confirm", {"cluster": "manual_2"})], ["0/PERSONA/Ana/[PERSONA_1]/true/sug_0/2", "1/PERSONA/Luis/[PERSONA_2]/true/manual_2/1", *_D[2:]], ["sug_0/confirmed/[PERSONA_1]/Ana/m0,m1", "manual_2/confirmed/[PERSONA_2]/Luis/m2"], _said(*_ALL), ""),
    ("add to a group", [("confirm", {"cluster": "sug_0"}), ("add_to_cluster", {"cluster": "sug_0", "ids": "3"})], ["0/PERSONA/Ana/[PERSONA_1]/true/sug_0/2", _D[1], _D[2], "3/PERSONA/Ana Sosa/[PERSONA_1]/true/sug_0/1"], ["sug_0/confirmed/[PERSONA_1]/Ana,Ana Sosa/m0,m1,m4"], _said("[PERSONA_1]", "[PERSONA_2]", "[EMPRESA_1]", "[PERSONA_1]"), ""),
    ("split", [("split", {"cluster": "sug_0", "mention_ids": "m1"})], [*_D], ["sug_0/suggested//Ana/m0", "sug_0_split_1/suggested//Ana/m1"], _said(*_ALL), ""),
    ("remove a surface", [("add_to_cluster", {"cluster": "sug_0", "ids": "3"}), ("confirm", {"cluster": "sug_0"}), ("remove_surface", {"cluster": "sug_0", "surface": " ana sosa "})], ["0/PERSONA/Ana/[PERSONA_1]/true/sug_0/2", _D[1], _D[2], "3/PERSONA/Ana Sosa/[PERSONA_1]/true//1"], ["sug_0/suggested//Ana/m0,m1", "sug_0_split_3/suggested//Ana Sosa/m4"], _said("[PERSONA_1]", "[PERSONA_2]", "[EMPRESA_1]", "[PERSONA_1]"), ""),
    ("remove a surface, unknown", [("remove_surface", {"cluster": "sug_0", "surface": "luis"})], [*_D], [_G], _said(*_ALL), "1"),
    ("absorb", [("create_cluster", {"ids": "1"}), ("absorb", {"cluster": "sug_0", "source": "manual_1"})], [*_D], ["sug_0/suggested//Ana,Luis/m0,m1,m2"], _said(*_ALL), ""),
    ("absorb itself", [("absorb", {"cluster": "sug_0", "source": "sug_0"})], [*_D], [_G], _said(*_ALL), "1"),
    ("merge", [("create_cluster", {"ids": "1"}), ("merge", {"clusters": "sug_0,manual_1"})], [*_D], ["merged_2/suggested//Ana,Luis/m0,m1,m2"], _said(*_ALL), ""),
    ("merge one", [("merge", {"clusters": "sug_0,none"})], [*_D], [_G], _said(*_ALL), "1"),
    ("patch, confirmed", [("confirm", {"cluster": "sug_0"}), ("patch_cluster", {"cluster": "sug_0", "placeholder": "[ACTORA]"})], ["0/PERSONA/Ana/[ACTORA]/true/sug_0/2", *_D[1:]], ["sug_0/confirmed/[ACTORA]/Ana/m0,m1"], _said("[ACTORA]", *_ALL[1:]), ""),
    ("patch, suggested", [("patch_cluster", {"cluster": "sug_0", "placeholder": "[ACTORA]"})], [*_D], ["sug_0/suggested/[ACTORA]/Ana/m0,m1"], _said(*_ALL), ""),
    ("reject", [("reject", {"cluster": "sug_0"})], [*_D], [], _said(*_ALL), ""),
    ("ignore", [("ignore", {"ids": "0,2"})], ["0/PERSONA/Ana/[PERSONA_1]/false//2", _D[1], "2/EMPRESA/Sur SA/[EMPRESA_1]/false//1", _D[3]], [_G], _said("Ana", "[PERSONA_2]", "Sur SA", "[PERSONA_3]"), ""),
    ("ignore similar", [("ignore_similar", {"id": "0"})], ["0/PERSONA/Ana/[PERSONA_1]/false//2", _D[1], _D[2], "3/PERSONA/Ana Sosa/[PERSONA_3]/false//1"], [_G], _said("Ana", "[PERSONA_2]", "[EMPRESA_1]", "Ana Sosa"), ""),
    ("join similar", [("join_similar", {"id": "3"})], ["0/PERSONA/Ana/[PERSONA_1]/true/manual_1/2", _D[1], _D[2], "3/PERSONA/Ana Sosa/[PERSONA_1]/true/manual_1/1"], [_G, "manual_1/confirmed/[PERSONA_1]/Ana,Ana Sosa/m4,m0,m1"], _said("[PERSONA_1]", "[PERSONA_2]", "[EMPRESA_1]", "[PERSONA_1]"), ""),
    ("join similar, none", [("join_similar", {"id": "1"})], [*_D], [_G], _said(*_ALL), "1"),
    ("select by hand", [("add_manual", {"cat": "PERSONA", "start": "4", "end": "7"})], [*_D, "4/PERSONA/vio/[PERSONA_4]/true//1"], [_G], _said(*_ALL).replace(" vio ", " [PERSONA_4] "), ""),
    ("select by hand, narrative", [("add_manual", {"cat": "PERSONA", "start": "0", "end": "32"})], [*_D], [_G], _said(*_ALL), "1"),
    ("select by hand, no number", [("add_manual", {"cat": "DNI", "start": "4", "end": "7"})], [*_D], [_G], _said(*_ALL), "1"),
    ("select by hand, bad range", [("add_manual", {"cat": "PERSONA", "start": "40", "end": "99"})], [*_D], [_G], _said(*_ALL), "1"),
    ("select what is there", [("add_manual", {"cat": "EMPRESA", "start": "26", "end": "32"})], [*_D], [_G], _said(*_ALL), ""),
    ("add places", [("add_bulk", {"cat": "OTRO", "original": "vio", "positions": "4-7,4-7", "placeholder": "[V]"})], [*_D, "4/OTRO/vio/[V]/true//1"], [_G], _said(*_ALL).replace(" vio ", " [V] "), ""),
    ("add places, out of range", [("add_bulk", {"cat": "OTRO", "original": "vio", "positions": "4-99"})], [*_D], [_G], _said(*_ALL), "1"),
    ("unknown action", [("explode", {"id": "1"}), ("ignore", {"ids": "2"})], [*_D[:2], "2/EMPRESA/Sur SA/[EMPRESA_1]/false//1", _D[3]], [_G], _said("[PERSONA_1]", "[PERSONA_2]", "Sur SA", "[PERSONA_3]"), "1"),
]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_of(parts) -> str:
    """One SQL expression for the parts' text."""
    out = []
    for p in parts:
        if isinstance(p, H):
            out.append(sql_of(p.parts))
        else:
            # Line ends are spelt out, since engines read a backslash differently.
            out.append(f"({p.sql})" if isinstance(p, V) else " || CHR(10) || ".join(quoted(s) for s in p.split("\n")))
    return " || ".join(out) if out else "''"


def chosen(cases, values) -> str:
    """CASE over the row's case number."""
    return "CASE c " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def texts(table: str, key: str, cases) -> str:
    """SELECT doc_id, rule, text: each row of the table is one case, by its key."""
    rules = chosen(cases, [quoted(r) for _, r, _ in cases])
    return f"SELECT k AS doc_id, {rules} AS rule, {chosen(cases, [sql_of(p) for _, _, p in cases])} AS text FROM (SELECT {key} AS k, {key} % {len(cases)} AS c FROM {table}) AS x"


def spans(table: str, key: str, cases) -> str:
    """SELECT doc_id, rule, cat, surface, start, end, layer, valid: what is to be found in those texts."""
    rows = []
    for i, (_, rule, parts) in enumerate(cases):
        for j, p in enumerate(parts):
            if isinstance(p, H):
                before, own = f"LENGTH({sql_of(parts[:j])})", sql_of(p.parts)
                rows.append(
                    f"SELECT k AS doc_id, {quoted(rule)} AS rule, '{p.cat}' AS cat, {own} AS surface, CAST({before} AS INTEGER) AS \"start\", "
                    f"CAST({before} + LENGTH({own}) AS INTEGER) AS \"end\", '{p.layer}' AS layer, {str(p.valid).lower()} AS valid FROM x WHERE c = {i}"
                )
    return f"WITH x AS (SELECT {key} AS k, {key} % {len(cases)} AS c FROM {table})\n" + "\nUNION ALL ".join(rows)


def validity_rows(table: str, key: str) -> tuple[str, str]:
    """(SELECT of inputs, SELECT of the outcome) of the validity cases, each row of the table one case."""
    columns = {"rule": 0, "cat": 1, "left_text": 2, "surface": 3, "right_text": 4}
    base = f"(SELECT {key} AS k, {key} % {len(VALIDITY)} AS c FROM {table}) AS x"
    given = ", ".join(f"{chosen(VALIDITY, [quoted(v[i] or (v[3] if i == 4 else '')) for v in VALIDITY])} AS {n}" for n, i in columns.items())
    told = ", ".join(f"{chosen(VALIDITY, [str(v[i]).lower() for v in VALIDITY])} AS {n}" for n, i in (("valid", 5), ("valid_manual", 6)))
    rule = f"{chosen(VALIDITY, [quoted(v[0]) for v in VALIDITY])} AS rule, {chosen(VALIDITY, [quoted(v[3]) for v in VALIDITY])} AS surface"
    return f"SELECT k, {given} FROM {base}", f"SELECT k, {rule}, {told} FROM {base}"


def link_rows(table: str, key: str) -> tuple[str, str]:
    """(SELECT of mentions, SELECT of the groups they give) of the linking cases."""
    mentions, groups = [], []
    for i, (rule, found, wanted) in enumerate(LINKS):
        for j, (cat, surface, start) in enumerate(found):
            mentions.append(
                f"SELECT k AS doc_id, {j} AS ord, 'm{j}' AS mention_id, '{cat}' AS cat, {quoted(surface)} AS surface, {start} AS s, {start + len(surface)} AS e FROM x WHERE c = {i}"
            )
        part = {n: int(members.split()[0]) for members, _, _ in wanted for n in map(int, members.split())}
        firsts = sorted({part.get(j, j) for j in range(len(found))})
        for members, confidence, reasons in wanted:
            ids = [int(n) for n in members.split()]
            surfaces = "|".join(dict.fromkeys(found[n][1] for n in ids))
            groups.append(
                f"SELECT k AS doc_id, {quoted(rule)} AS rule, 'sug_{firsts.index(ids[0])}' AS cluster_id, '{found[ids[0]][0]}' AS cat, {quoted(surfaces)} AS surfaces, "
                f"'{'|'.join(f'm{n}' for n in ids)}' AS mentions, '{confidence}' AS confidence, '{reasons}' AS reasons FROM x WHERE c = {i}"
            )
    head = f"WITH x AS (SELECT {key} AS k, {key} % {len(LINKS)} AS c FROM {table})\n"
    return head + "\nUNION ALL ".join(mentions), head + "\nUNION ALL ".join(groups)


def review_rows(table: str, key: str) -> str:
    """SELECT doc_id, rule, detections, clusters, anonymized_text, refused of the review cases, each row of the table one case."""
    told = [(r, ";".join(d), ";".join(g), text, refused) for r, _, d, g, text, refused in REVIEWS]
    columns = ", ".join(f"{chosen(REVIEWS, [quoted(t[i]) for t in told])} AS {n}" for i, n in enumerate(("rule", "detections", "clusters", "anonymized_text", "refused")))
    return f"SELECT k AS doc_id, {columns} FROM (SELECT {key} AS k, {key} % {len(REVIEWS)} AS c FROM {table}) AS x"
