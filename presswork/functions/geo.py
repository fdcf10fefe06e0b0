"""Places: a gazetteer of districts with aliases, and the earliest one a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Districts and aliases in the order that breaks ties.
GAZETTEER: dict[str, tuple[str, ...]] = {
    "Hyderabad": ("hyderabad", "హైదరాబాద్", "ghmc", "charminar", "old city"),
    "Secunderabad": ("secunderabad", "సికింద్రాబాద్", "cantonment"),
    "Warangal": ("warangal", "వరంగల్", "hanamkonda", "హనుమకొండ"),
    "Karimnagar": ("karimnagar", "కరీంనగర్"),
    "Nizamabad": ("nizamabad", "నిజామాబాద్"),
    "Khammam": ("khammam", "ఖమ్మం"),
    "Nalgonda": ("nalgonda", "నల్గొండ"),
    "Mahabubnagar": ("mahabubnagar", "mahbubnagar", "మహబూబ్‌నగర్", "palamuru"),
    "Adilabad": ("adilabad", "ఆదిలాబాద్"),
    "Siddipet": ("siddipet", "సిద్దిపేట"),
    "Sangareddy": ("sangareddy", "సంగారెడ్డి"),
    "Rangareddy": ("rangareddy", "ranga reddy", "రంగారెడ్డి"),
    "Medak": ("medak", "మెదక్"),
    "Kodangal": ("kodangal", "కొడంగల్"),
    "Madhira": ("madhira", "మధిర"),
    "Gajwel": ("gajwel", "గజ్వేల్"),
    "Sircilla": ("sircilla", "సిరిసిల్ల", "rajanna sircilla"),
    "Suryapet": ("suryapet", "సూర్యాపేట"),
    "Nagarkurnool": ("nagarkurnool", "నాగర్‌కర్నూల్"),
    "Vikarabad": ("vikarabad", "వికారాబాద్"),
    "Bhadrachalam": ("bhadrachalam", "భద్రాచలం", "bhadradri"),
    "Yadadri": ("yadadri", "యాదాద్రి", "bhuvanagiri", "bhongir"),
}
#: State that the gazetteer covers, and its centre.
COVERED_STATE = "telangana"
CENTRE = (17.9784, 79.5941)


def gazetteer(spark: SparkSession) -> DataFrame:
    """The gazetteer as a table: district, district_pos, alias, alias_pos."""
    rows = [(d, i, a, j) for i, (d, aliases) in enumerate(GAZETTEER.items()) for j, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "district string, district_pos int, alias string, alias_pos int")


def earliest_district(text: Column, places: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The district whose alias begins first in a text; ties go to the one listed first. Null if none."""
    listed = GAZETTEER if places is None else places
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(i).alias("pos"), F.lit(d).alias("district")) for i, (d, names) in enumerate(listed.items()) for a in names])
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.transform(table, lambda g: F.struct(F.position(g["alias"], low).alias("at"), g["pos"].alias("pos"), g["district"].alias("district")))
    return F.array_min(F.filter(found, lambda g: g["at"] > 0))["district"]


def location_tag(text: Column) -> Column:
    """location_found, district, city, state, lat, lng of a text."""
    district = earliest_district(text)
    hit = district.isNotNull()
    none = F.lit(None).cast("double")
    return F.struct(
        hit.alias("location_found"),
        F.coalesce(district, F.lit("")).alias("district"),
        F.coalesce(district, F.lit("")).alias("city"),
        F.when(hit, "Telangana").otherwise("India").alias("state"),
        F.when(hit, F.lit(CENTRE[0])).otherwise(none).alias("lat"),
        F.when(hit, F.lit(CENTRE[1])).otherwise(none).alias("lng"),
    )


def resolve_location(state: Column, text: Column) -> Column:
    """state, district, location: the text decides only for sources of the covered state; the state is the source's."""
    covered = F.contains(F.lower(F.coalesce(state, F.lit(""))), F.lit(COVERED_STATE))
    district = F.when(covered, F.coalesce(earliest_district(text), F.lit(""))).otherwise("")
    return F.struct(state.alias("state"), district.alias("district"), district.alias("location"))
