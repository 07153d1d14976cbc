"""Other names of the design disciplines: abbreviations, trade words, other languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical name -> stems that take any ending of a profession, and whole names.
STEMS = {
    "Mechanical Engineering": "mechanical, mech, mech'l, hvac, air conditioning, m",
    "Electrical Engineering": "electrical, elec, elect, elect'l, power & lighting, power",
    "Structural Engineering": "structural, struct, str, structures, seismic, seismic / structural",
    "Civil Engineering": "civil, site civil, grading & drainage",
    "Plumbing Engineering": "plumbing, plbg, sanitary plumbing, piping & plumbing",
    "Fire Protection": "fire protection, fire prot, fire sprinkler, fp, sprinkler, fire suppression",
    "Landscape Architecture": "landscape, planting & irrigation, irrigation",
    "Acoustics": "acoustics, acoustical, acoust, sound, noise & vibration",
    "Low Voltage and Technology": "low voltage, low volt, technology, data / telecom, telecom, structured cabling, it infrastructure",
    "Geotechnical Engineering": "geotechnical, geotech, soils, soils & foundations",
    "Lighting Design": "lighting, ltg, illumination",
    "Food Service Design": "food service, foodservice, food svc, kitchen, kitchen equipment",
    "Audiovisual Design": "audiovisual, audio visual, av, a/v, theater & av",
    "Roofing Consulting": "roofing, roof, rfg, waterproofing & roof",
    "Energy Modeling": "energy, energy model, building energy",
    "Door Hardware": "door hardware, hardware, hdwe, finish hardware, door & frame hardware",
    "Vertical Transportation": "vertical transportation, vert transp, elevator, lifts & escalators, escalator",
    "Accessibility": "accessibility, access, barrier free, ada",
    "Commissioning": "commissioning, commish, cx",
    "Hazardous Materials": "hazardous materials, haz mat, hazmat, abatement, asbestos & lead",
    "Cost Estimating": "cost, cost est, cost estimating, estimating",
    "Surveying": "land survey, topographic survey, survey, topographic",
}
ENDINGS = ("engineering", "engineer", "engineers", "engr", "eng", "design", "designer", "specialist")
#: Names that take no ending.
NAMES = {
    "Mechanical Engineering": "heating & cooling design, ingeniero mecanico, ingenieria mecanica, ingenieur mecanique, genie mecanique, mep mechanical, hvac, me",
    "Electrical Engineering": "ee, ingeniero electrico, ingenieria electrica, ingenieur electrique, electrical",
    "Structural Engineering": "se, ingeniero estructural, ingenieria estructural, ingenieur structure, structures, structural",
    "Civil Engineering": "ce, ingeniero civil, ingenieria civil, ingenieur civil, genie civil, site civil, civil",
    "Plumbing Engineering": "ingenieur plomberie, plomberie, fontaneria, ingeniero de plomeria, plomeria, plumbing, piping & plumbing",
    "Fire Protection": "sprinklers, fire sprinklers, proteccion contra incendios, protection incendie, fire suppression",
    "Landscape Architecture": "la, landscape arch, landscape architect, landscape architects, landscaping, paisajismo, paysagiste, architecte paysagiste",
    "Acoustics": "acoustician, acustica, acoustique, noise & vibration",
    "Low Voltage and Technology": "low volt, data / telecom, structured cabling, it infrastructure, technology",
    "Geotechnical Engineering": "geotech, geotecnia, geotechnique, soils & foundations",
    "Surveying": "surveyor, land surveyor, surveyors, pls, topografia, topographe, topographic survey, survey, geometre",
    "Cost Estimating": "cost est, estimator, cost estimator, quantity surveyor, quantity survey, cost, estimating",
    "Roofing Consulting": "roof, rfg, waterproofing & roof, waterproofing & roofing, roofing, techado",
    "Food Service Design": "foodservice, food svc, kitchen, cocina industrial",
    "Lighting Design": "lighting, iluminacion, eclairage",
    "Hazardous Materials": "asbestos & lead survey, asbestos survey, abatement, materiales peligrosos, hazmat, haz mat",
    "Commissioning": "cxa, commissioning agent, commish agent, commissioning authority, cx agent, commissioning provider",
    "Energy Modeling": "energy analyst, energy model, energy modeler, building energy analysis, energy analysis, energy modelling, energy",
    "Audiovisual Design": "av, a/v, theater & av, audio visual, audiovisual",
    "Door Hardware": "hardware, hdwe, finish hardware, herrajes",
    "Vertical Transportation": "elevator, elevators, lifts & escalators, escalators, lifts",
    "Accessibility": "casp, access, barrier free, accesibilidad, accessibilite, ada",
}


def other_names() -> list[tuple[str, str]]:
    """(canonical name, other name): every stem with every ending, longer stems alone, and the names without ending."""
    rows = []
    for canonical, stems in STEMS.items():
        rows += [(canonical, f"{stem} {ending}") for stem in stems.split(", ") for ending in ENDINGS]
        rows += [(canonical, stem) for stem in stems.split(", ") if len(stem) > 4]
    return rows + [(canonical, name) for canonical, names in NAMES.items() for name in names.split(", ")]


def discipline_names(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """(discipline_code, discipline_name) of the list itself and of all other names; the bounded lists above, not data."""
    others = spark.createDataFrame(other_names(), "canonical string, other string")
    named = refs.join(others, F.col("discipline_name") == F.col("canonical")).select("discipline_code", F.col("other").alias("discipline_name"))
    return refs.select("discipline_code", "discipline_name").unionByName(named).distinct()
