"""Labels, age bands and codes that results depend on.

The tuples down to ``UNKNOWN_MUNICIPALITIES`` are fixed values: they must equal
the published method's lists for results to agree.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
INJURIES = (
    "Injuries - Falls",
    "Injuries - Homicide",
    "Injuries - Others",
    "Injuries - Road",
    "Injuries - Suicide",
    "Injuries - Other transport injuries",
)
OTHER = ("other_causes_all", "other_causes-lri", "other_desnutricao_all_ages")
MATERNAL = (
    "materna_ectopica",
    "materna_hipertensiva",
    "materna_trab_parto",
    "materna_aborto_induzido",
    "materna_tardia",
    "materna_aborto_espontaneo",
    "materna_sepsis",
    "materna_indiretas",
    "materna_outras",
    "materna_hemorragia",
    "materna_materna_hiv",
)
TRANSMISSIBLE = (
    "trans_dengue",
    "trans_encefatlite",
    "trans_schistosomiasis",
    "trans_chagas",
    "trans_tuberculose",
    "trans_hiv_aids",
    "trans_doenças_diarreicas",
    "trans_varicela",
    "trans_leishmaniose",
    "trans_zoonoticas",
    "trans_hepatite",
    "trans_meningites",
    "trans_sexualmente_transmissíveis",
    "trans_desnutricao",
    "trans_febre_amarela",
    "trans_infec_urinaria",
    "trans_malaria",
)
CHRONIC = (
    "dcnt_neoplasms",
    "dcnt_chronic respiratory",
    "dcnt_diabetes",
    "dcnt_cardiovascular",
)
NEONATAL = (
    "anom_congenitas",
    "aspiracao_pulmunar",
    "lri_post_neo",
    "infant_neonatal_encefalopatia",
    "infant_subita",
    "infant_neonatal_hemolitica",
    "obst_intestinal",
    "infant_neonatal_prematuridade",
    "infant_neonatal_other",
    "infant_neonatal_sepsis",
)
PNEUMONIA = "_pneumo"

GARBAGE = (
    "_injuries",
    "_inj (hom,sui)",
    "_inj (hom,suic, fall,road)",
    "_inj (hom,sui,transp)",
    "_inj (hom,suic,other)",
    "_maternas",
    "_infant_neonat",
    "_x59",
    "_y34",
    "_pneumo",
    "_all",
)

NEONATAL_AGES = ("Early Neonatal", "Late Neonatal", "Post Neonatal")
BANDS = tuple(str(a) for a in range(0, 95, 5))
MALE, FEMALE, UNKNOWN = "Masculino", "Feminino", "IGN"
AGE_CLASSES = ("<10", "10 a 59", "60 emais")

# State code + "0000" stands for "municipality unknown".
UNKNOWN_MUNICIPALITIES = tuple(
    f"{uf}0000"
    for uf in (
        "11 12 13 14 15 16 17 21 22 23 24 25 26 27 28 29 "
        "31 32 33 35 41 42 43 50 51 52"
    ).split()
)
# --- end of fixed values ----------------------------------------------------

FAMILIES = {
    "injuries": INJURIES,
    "other": OTHER,
    "maternal": MATERNAL,
    "transmissible": TRANSMISSIBLE,
    "chronic": CHRONIC,
    "neonatal": NEONATAL,
    "pneumonia": (PNEUMONIA,),
}
TARGETS = tuple(label for family in FAMILIES.values() for label in family)
# What a direct-weight stage shares out proportionally.
POOLED = TRANSMISSIBLE + MATERNAL + OTHER

AGES = NEONATAL_AGES + BANDS
SEXES = (MALE, FEMALE)
MATERNAL_AGES = tuple(b for b in BANDS if 10 <= int(b) <= 55)
UNDER_FIVE = NEONATAL_AGES + ("0",)

# (sex, age) cells of the dense grid and the column that holds each of them when
# a municipality-year-cause is kept as one row: m00..m21, f00..f21.
CELLS = tuple(
    (sex, age, f"{letter}{i:02d}")
    for letter, sex in zip("mf", SEXES)
    for i, age in enumerate(AGES)
)


def age_class(age: str) -> str:
    """Age class of the age-dependent weights."""
    if age in NEONATAL_AGES or int(age) < 10:
        return AGE_CLASSES[0]
    return AGE_CLASSES[1] if int(age) < 60 else AGE_CLASSES[2]


def possible(cause: str | None, sex: str, age: str) -> bool:
    """Maternal causes exist only in women aged 10-59; every other cell is possible."""
    return cause not in MATERNAL or (sex == FEMALE and age in MATERNAL_AGES)
