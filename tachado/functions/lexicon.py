"""Word lists of the detection rules: given names, surnames, court formulas, and the fixed lists.

Names and formulas are a parameter: a folder with JSON arrays (nombres.json, apellidos.json,
formulas_judiciales.json). Without one, short lists of common Argentine names serve.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

GIVEN = """
juan jose maria carlos luis jorge ana miguel roberto marta laura silvia daniel pablo diego sandra patricia monica claudia marcelo alejandro
gustavo fernando ricardo eduardo sergio mario oscar hector ruben raul alberto antonio francisco manuel pedro martin nicolas lucas matias
sebastian gabriel andres facundo agustin tomas santiago ignacio ramiro ezequiel leandro cristian maximiliano federico mariano hernan
lucia sofia valentina camila florencia julieta micaela agustina paula natalia carolina veronica andrea gabriela valeria romina cecilia
mariana alicia susana graciela norma teresa rosa elena beatriz cristina liliana estela adriana karina yamila mariela noelia
""".split()  # fmt: skip
SURNAMES = """
gonzalez rodriguez gomez fernandez lopez diaz martinez perez garcia sanchez romero sosa torres alvarez ruiz ramirez flores acosta benitez
medina herrera suarez aguirre gimenez gutierrez pereyra rojas molina castro ortiz silva nunez luna juarez cabrera rios morales godoy moreno
ferreyra dominguez carrizo peralta castillo ledesma quiroga vega vera muniz ojeda ponce villalba cardozo navarro coronel vazquez ramos
caceres arias cordoba figueroa mendez correa paz roldan farias lucero mansilla campos maldonado vargas leiva escobar bravo ayala mendoza
franco lopes carrera caeiro speroni bressan villarreal blanco soria rivero barrios avila duarte toledo
""".split()  # fmt: skip
FORMULAS = """
autos vistos considerando resulta resuelvo notifiquese registrese archivese oportunamente proveer traslado demanda contestacion actora
demandada expediente secretaria fojas foja escrito presento solicito digo fundamento derecho peticion justicia oficiese cumplase
""".split()  # fmt: skip

# Words that never stand in a name.
STOP = """
el la los las un una y o de del que con por para en su sus se no si pero este esta tribunal supremo corte juzgado juzgados fiscalia fiscalía
defensoria defensoría ministerio camara cámara sala articulo artículo codigo código ley decreto resolucion resolución sentencia auto
providencia disposicion disposición nacion nación provincia provincial nacional federal capital buenos aires cordoba córdoba mendoza santa
fe rosario según segun conforme mediante donde cuando como cual quien quienes cuyo cuya sr sra srta dr dra
""".split()  # fmt: skip
# Administrative words that are no surname unless a given name stands by.
ADMIN = """
otros mismo misma mismos mismas general generales especial especiales comun común comunes carrera carreras ceremonias ceremonia
publicodiferencias diferencias publico público publica pública privado privada privados privadas municipal municipales provincial
provinciales estatal estatales nacional nacionales federal federales internacional internacionales sobre bajo contra ante empleo empleos
salud educacion educación vivienda trabajo trabajos
""".split()  # fmt: skip
# Categories in their order, placeholders' labels where they differ from the category's name.
CATEGORIES = ["PERSONA", "DNI", "CUIT", "EMPRESA", "EMAIL", "TELEFONO", "DOMICILIO", "PATENTE", "EXPEDIENTE", "ORGANISMO", "OTRO"]
NUMBERED = {"OTRO": "DATO"}
GENERIC = {"PERSONA": "NOMBRE", "TELEFONO": "TELÉFONO", "OTRO": "DATO"}


@dataclass(frozen=True)
class Lexicon:
    given: frozenset
    surnames: frozenset
    formulas: frozenset

    @property
    def names(self) -> frozenset:
        return self.given | self.surnames


def load(folder: str | None = None) -> Lexicon:
    def words(name: str, default: list[str]) -> frozenset:
        path = os.path.join(folder, name) if folder else ""
        if not os.path.isfile(path):
            return frozenset(() if folder else default)
        with open(path, encoding="utf-8") as f:
            return frozenset(json.load(f))

    return Lexicon(words("nombres.json", GIVEN), words("apellidos.json", SURNAMES), words("formulas_judiciales.json", FORMULAS))
