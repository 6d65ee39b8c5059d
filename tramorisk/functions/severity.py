"""Severity weights and categories of an incident."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tramorisk.functions.text import ascii_fold, literal_map, normalize_text

# Severity of each exact modality.
MODALITY_SEVERITY = {
    "SICARIATO": 5,
    "FEMINICIDIO": 5,
    "HOMICIDIO CALIFICADO - ASESINATO": 5,
    "PARRICIDIO": 5,
    "HOMICIDIO SIMPLE": 5,
    "HOMICIDIO POR PAF": 5,
    "HOMICIDIO POR EMOCION VIOLENTA": 5,
    "SECUESTRO": 5,
    "ROBO AGRAVADO A MANO ARMADA": 4,
    "ROBO AGRAVADO EN BANDA": 4,
    "ROBO AGRAVADO DURANTE LA NOCHE O EN LUGAR DESOLADO": 4,
    "ROBO AGRAVADO": 4,
    "EXTORSION AGRAVADA": 4,
    "EXTORSION": 4,
    "ROBO DE CELULAR": 3,
    "ROBO DE PASAPORTE": 3,
    "ROBO": 3,
    "ROBO FRUSTRADO": 3,
    "ASALTO Y ROBO DE VEHICULOS": 3,
    "HURTO AGRAVADO EN CASA HABITADA": 2,
    "HURTO AGRAVADO DURANTE LA NOCHE": 2,
    "HURTO AGRAVADO": 2,
    "HURTO DE VEHICULO": 2,
    "HURTO DE CELULAR": 1,
    "HURTO DE ACCESORIOS Y AUTOPARTES DE VEHICULOS": 1,
    "HURTO": 1,
    "HURTO DE USO": 1,
    "HURTO FRUSTRADO": 1,
}
# Keyword severities, first match wins.
KEYWORD_SEVERITY = (("HOMICIDIO", 5), ("ASESINATO", 5), ("SECUESTRO", 5), ("EXTORSION", 4),
                    ("ROBO AGRAVADO", 4), ("ROBO", 3), ("HURTO AGRAVADO", 2), ("HURTO", 1))
# Words that make a modality recognisable.
RECOGNISED_WORDS = ("HURTO", "ROBO", "EXTORSION", "HOMICIDIO", "SECUESTRO")
DEFAULT_SEVERITY = 1
SEVERE_FROM = 4
# Category words by priority, as singular and plural labels.
CATEGORY_SINGULAR = (("HOMICIDIO", "homicidio"), ("EXTORSION", "extorsion"), ("ROBO", "robo"), ("HURTO", "hurto"))
CATEGORY_PLURAL = (("HOMICIDIO", "homicidios"), ("ASESINATO", "homicidios"), ("EXTORSION", "extorsiones"),
                   ("ROBO", "robos"), ("HURTO", "hurtos"))


@dataclass(frozen=True)
class SeverityRules:
    """Editable severity rules by code and by phrase."""

    # Fixed values of the default rule file.
    by_subtype: dict[str, int] = field(default_factory=lambda: {
        "10101": 5, "10103": 3, "10401": 2, "10409": 5, "10501": 1, "10502": 3, "10508": 4, "11201": 2,
        "13002": 1, "13003": 1, "50801": 5, "70101": 4, "70102": 2, "70104": 4, "70704": 3, "71001": 5,
        "71002": 3, "71101": 5, "71102": 5})
    by_modality: dict[str, int] = field(default_factory=lambda: {"1140109": 3, "5040124": 2, "5040125": 3})
    by_phrase: dict[str, int] = field(default_factory=lambda: {
        "SECUESTRO": 5, "VIOLACION SEXUAL": 5, "ROBO AGRAVADO": 4, "HURTO AGRAVADO": 2, "EXPLOSIV": 4,
        "ARMA DE FUEGO": 4})
    default: int = 1


def _lookup(table: dict[str, int], key: Column) -> Column:
    return literal_map(table)[key].cast("int")


def _text_severity(normal: Column) -> Column:
    ladder = F.lit(DEFAULT_SEVERITY)
    for word, value in reversed(KEYWORD_SEVERITY):
        ladder = F.when(normal.contains(word), F.lit(value)).otherwise(ladder)
    return F.coalesce(_lookup(MODALITY_SEVERITY, normal), ladder)


def severity_of_normal(modality: Column, subtype: Column) -> Column:
    """Severity 1-5 of normalised texts; the subtype speaks only where the
    modality is unknown."""
    known = _lookup(MODALITY_SEVERITY, modality).isNotNull()
    for word in RECOGNISED_WORDS:
        known = known | modality.contains(word)
    return F.when(known, _text_severity(modality)).otherwise(_text_severity(subtype)).cast("int")


def severity(modality: Column, subtype: Column) -> Column:
    """Severity of raw texts; for whole tables ``score_incidents`` is cheaper."""
    return severity_of_normal(normalize_text(modality, None), normalize_text(subtype, None))


def score_incidents(df: DataFrame, modality: str = "modalidad", subtype: str = "subtipo", plural: bool = False) -> DataFrame:
    """Add peso, categoria and grave; each text is normalised once per row."""
    normal = df.withColumn("_m", normalize_text(F.col(modality), None)).withColumn("_s", normalize_text(F.col(subtype), None))
    scored = normal.withColumn("peso", severity_of_normal(F.col("_m"), F.col("_s"))).withColumn(
        "categoria", category_of_normal(F.concat_ws(" ", "_s", "_m"), plural))
    return scored.withColumn("grave", is_severe(F.col("peso"))).drop("_m", "_s")


def configured_severity(subtype_code: Column, modality_code: Column, subtype: Column, modality: Column,
                        rules: SeverityRules | None = None) -> Column:
    """Largest severity among text, code and phrase rules."""
    rules = rules or SeverityRules()
    name = ascii_fold(F.upper(F.coalesce(modality, F.lit(""))))
    parts = [F.lit(rules.default), severity(modality, subtype),
             F.coalesce(_lookup(rules.by_subtype, subtype_code), F.lit(0)),
             F.coalesce(_lookup(rules.by_modality, modality_code), F.lit(0))]
    parts += [F.when(name.contains(phrase), F.lit(value)).otherwise(F.lit(0))
              for phrase, value in rules.by_phrase.items()]
    return F.greatest(*parts).cast("int")


def category_of_normal(text: Column, plural: bool = False) -> Column:
    label = F.lit("otros" if plural else "otro")
    for word, name in reversed(CATEGORY_PLURAL if plural else CATEGORY_SINGULAR):
        label = F.when(text.contains(word), F.lit(name)).otherwise(label)
    return label


def category(subtype: Column, modality: Column, plural: bool = False) -> Column:
    """Category by word priority over subtype and modality together."""
    return category_of_normal(normalize_text(F.concat_ws(" ", subtype, modality), None), plural)


def is_severe(weight: Column) -> Column:
    return (weight >= SEVERE_FROM).cast("int")
