"""Regions and provinces: dictionaries and free-text lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fixed_lookup
from .text import fold

# ---------------------------------------------------------------------------
# Official codes, display names and accepted spellings.
# ---------------------------------------------------------------------------
REGIONS = {
    "ceuta": "Ceuta",
    "andalucia": "Andalucía",
    "cataluna": "Cataluña",
    "galicia": "Galicia",
    "pais-vasco": "País Vasco",
    "aragon": "Aragón",
    "asturias": "Asturias",
    "baleares": "Illes Balears",
    "canarias": "Canarias",
    "cantabria": "Cantabria",
    "castilla-la-mancha": "Castilla-La Mancha",
    "castilla-y-leon": "Castilla y León",
    "extremadura": "Extremadura",
    "la-rioja": "La Rioja",
    "madrid": "Madrid",
    "melilla": "Melilla",
    "murcia": "Murcia",
    "navarra": "Navarra",
    "valencia": "Comunitat Valenciana",
}
DEFAULT_REGION = "ceuta"
REGION_ALIASES = {
    "catalunya": "cataluna",
    "cataluna": "cataluna",
    "euskadi": "pais-vasco",
    "paisvasco": "pais-vasco",
    "pais vasco": "pais-vasco",
    "islas baleares": "baleares",
    "illes balears": "baleares",
    "comunidad valenciana": "valencia",
    "comunitat valenciana": "valencia",
    "comunidad de madrid": "madrid",
    "principado de asturias": "asturias",
    "region de murcia": "murcia",
    "castilla la mancha": "castilla-la-mancha",
    "castilla leon": "castilla-y-leon",
}
# Province code, display name, region code.
PROVINCES = [
    ("almeria", "Almería", "andalucia"),
    ("cadiz", "Cádiz", "andalucia"),
    ("cordoba", "Córdoba", "andalucia"),
    ("granada", "Granada", "andalucia"),
    ("huelva", "Huelva", "andalucia"),
    ("jaen", "Jaén", "andalucia"),
    ("malaga", "Málaga", "andalucia"),
    ("sevilla", "Sevilla", "andalucia"),
    ("huesca", "Huesca", "aragon"),
    ("teruel", "Teruel", "aragon"),
    ("zaragoza", "Zaragoza", "aragon"),
    ("asturias", "Asturias", "asturias"),
    ("baleares", "Illes Balears", "baleares"),
    ("cantabria", "Cantabria", "cantabria"),
    ("las-palmas", "Las Palmas", "canarias"),
    ("tenerife", "Santa Cruz de Tenerife", "canarias"),
    ("albacete", "Albacete", "castilla-la-mancha"),
    ("ciudad-real", "Ciudad Real", "castilla-la-mancha"),
    ("cuenca", "Cuenca", "castilla-la-mancha"),
    ("guadalajara", "Guadalajara", "castilla-la-mancha"),
    ("toledo", "Toledo", "castilla-la-mancha"),
    ("avila", "Ávila", "castilla-y-leon"),
    ("burgos", "Burgos", "castilla-y-leon"),
    ("leon", "León", "castilla-y-leon"),
    ("palencia", "Palencia", "castilla-y-leon"),
    ("salamanca", "Salamanca", "castilla-y-leon"),
    ("segovia", "Segovia", "castilla-y-leon"),
    ("soria", "Soria", "castilla-y-leon"),
    ("valladolid", "Valladolid", "castilla-y-leon"),
    ("zamora", "Zamora", "castilla-y-leon"),
    ("barcelona", "Barcelona", "cataluna"),
    ("girona", "Girona", "cataluna"),
    ("lleida", "Lleida", "cataluna"),
    ("tarragona", "Tarragona", "cataluna"),
    ("alicante", "Alicante", "valencia"),
    ("castellon", "Castellón", "valencia"),
    ("valencia", "València", "valencia"),
    ("badajoz", "Badajoz", "extremadura"),
    ("caceres", "Cáceres", "extremadura"),
    ("a-coruna", "A Coruña", "galicia"),
    ("lugo", "Lugo", "galicia"),
    ("ourense", "Ourense", "galicia"),
    ("pontevedra", "Pontevedra", "galicia"),
    ("madrid", "Madrid", "madrid"),
    ("la-rioja", "La Rioja", "la-rioja"),
    ("murcia", "Murcia", "murcia"),
    ("navarra", "Navarra", "navarra"),
    ("araba", "Araba/Álava", "pais-vasco"),
    ("bizkaia", "Bizkaia", "pais-vasco"),
    ("gipuzkoa", "Gipuzkoa", "pais-vasco"),
    ("ceuta", "Ceuta", "ceuta"),
    ("melilla", "Melilla", "melilla"),
]
PROVINCE_ALIASES = {
    "alava": "araba",
    "araba/alava": "araba",
    "vitoria": "araba",
    "vizcaya": "bizkaia",
    "guipuzcoa": "gipuzkoa",
    "lerida": "lleida",
    "gerona": "girona",
    "la coruna": "a-coruna",
    "coruna": "a-coruna",
    "a coruna": "a-coruna",
    "orense": "ourense",
    "islas baleares": "baleares",
    "illes balears": "baleares",
    "palma": "baleares",
    "santa cruz de tenerife": "tenerife",
    "castellon de la plana": "castellon",
    "castello": "castellon",
    "valencia/valencia": "valencia",
    "principado de asturias": "asturias",
    "oviedo": "asturias",
    "region de murcia": "murcia",
    "comunidad de madrid": "madrid",
    "navarra/nafarroa": "navarra",
    "nafarroa": "navarra",
}


def province_frame(spark: SparkSession) -> DataFrame:
    """(provincia, nombre, comunidad): the provinces and their region."""
    return spark.createDataFrame(PROVINCES, "provincia string, nombre string, comunidad string")


def region_frame(spark: SparkSession) -> DataFrame:
    """(comunidad, nombre, orden): the regions in display order."""
    rows = [(code, name, i) for i, (code, name) in enumerate(REGIONS.items())]
    return spark.createDataFrame(rows, "comunidad string, nombre string, orden int")


def _spellings(spark: SparkSession, codes: dict[str, str], aliases: dict[str, str]) -> DataFrame:
    """(texto, codigo, rango): codes before aliases before display names."""
    rows = [(c, c, 0) for c in codes] + [(a, c, 1) for a, c in aliases.items()]
    base = spark.createDataFrame(rows, "texto string, codigo string, rango int")
    names = spark.createDataFrame([(n, c, 2) for c, n in codes.items()], "texto string, codigo string, rango int")
    return base.unionByName(names.withColumn("texto", fold(F.col("texto"))))


def _lookup(df: DataFrame, column: str, out: str, codes: dict[str, str], aliases: dict[str, str], dashed: Column) -> DataFrame:
    """Code of a free text, or null; an unknown text never gets a default.

    Spellings are tried as written, then with dashes for spaces, then as a
    display name. Each try is a lookup in a table of fixed size.
    """
    table = _spellings(df.sparkSession, codes, aliases)
    written = table.where("rango < 2").groupBy("texto").agg(F.min_by("codigo", "rango").alias("codigo"))
    named = table.where("rango = 2").groupBy("texto").agg(F.min("codigo").alias("codigo"))
    keyed = df.withColumn("__k", fold(F.col(column))).withColumn("__d", dashed)
    for key, source, name in (("__k", written, "__1"), ("__d", written, "__2"), ("__k", named, "__3")):
        keyed = fixed_lookup(keyed, source.select(F.col("texto").alias(key), F.col("codigo").alias(name)), [key])
    return keyed.withColumn(out, F.coalesce("__1", "__2", "__3")).drop("__k", "__d", "__1", "__2", "__3")


def region_code(df: DataFrame, column: str, out: str = "comunidad") -> DataFrame:
    """Region code of a free-text column."""
    dashed = F.translate(F.col("__k"), " ", "-")
    return _lookup(df, column, out, REGIONS, REGION_ALIASES, dashed)


def province_code(df: DataFrame, column: str, out: str = "codigo_provincia") -> DataFrame:
    """Province code of a free-text column."""
    names = {code: name for code, name, _ in PROVINCES}
    dashed = F.translate(F.col("__k"), " /", "--")
    return _lookup(df, column, out, names, PROVINCE_ALIASES, dashed)


def row_region(df: DataFrame, province: str = "provincia", region: str = "comunidad_autonoma", out: str = "comunidad") -> DataFrame:
    """Region of a row: from its province first, then from the region text."""
    spark = df.sparkSession
    placed = province_code(df, province, "__prov")
    by_province = province_frame(spark).select(F.col("provincia").alias("__prov"), F.col("comunidad").alias("__r1"))
    placed = region_code(fixed_lookup(placed, by_province, ["__prov"]), region, "__r2")
    return placed.withColumn(out, F.coalesce("__r1", "__r2")).drop("__prov", "__r1", "__r2")


def set_province(df: DataFrame, written: str, province: str = "provincia", region: str = "comunidad_autonoma") -> DataFrame:
    """Both columns written from a new province text; unknown text clears both.

    The region column holds the display name, as it always has.
    """
    spark = df.sparkSession
    names = (
        province_frame(spark).select("provincia", "comunidad")
        .join(region_frame(spark).select("comunidad", F.col("nombre").alias("__n")), "comunidad")
        .select(F.col("provincia").alias("__p"), "__n")
    )
    out = fixed_lookup(province_code(df, written, "__p"), names, ["__p"])
    return out.withColumns({province: F.col("__p"), region: F.col("__n")}).drop("__p", "__n")
