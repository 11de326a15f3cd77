"""State dimension and state boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (statistics-office code, state code, state name).
STATES = [
    ("11", "RO", "Rondônia"),
    ("12", "AC", "Acre"),
    ("13", "AM", "Amazonas"),
    ("14", "RR", "Roraima"),
    ("15", "PA", "Pará"),
    ("16", "AP", "Amapá"),
    ("17", "TO", "Tocantins"),
    ("21", "MA", "Maranhão"),
    ("22", "PI", "Piauí"),
    ("23", "CE", "Ceará"),
    ("24", "RN", "Rio Grande do Norte"),
    ("25", "PB", "Paraíba"),
    ("26", "PE", "Pernambuco"),
    ("27", "AL", "Alagoas"),
    ("28", "SE", "Sergipe"),
    ("29", "BA", "Bahia"),
    ("31", "MG", "Minas Gerais"),
    ("32", "ES", "Espírito Santo"),
    ("33", "RJ", "Rio de Janeiro"),
    ("35", "SP", "São Paulo"),
    ("41", "PR", "Paraná"),
    ("42", "SC", "Santa Catarina"),
    ("43", "RS", "Rio Grande do Sul"),
    ("50", "MS", "Mato Grosso do Sul"),
    ("51", "MT", "Mato Grosso"),
    ("52", "GO", "Goiás"),
    ("53", "DF", "Distrito Federal"),
]


def states(spark: SparkSession) -> DataFrame:
    """The 27 states: ``ibge_code``, ``uf``, ``state_name``."""
    rows = ", ".join(f"('{code}', '{uf}', '{name}')" for code, uf, name in STATES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS states(ibge_code, uf, state_name)")


def with_state_name(df: DataFrame, code: str = "customer_state", name: str = "state_name") -> DataFrame:
    """Add the name of a state code; an unknown code stands for itself."""
    dim = states(df.sparkSession).select(F.col("uf").alias("_uf"), F.col("state_name").alias("_name"))
    joined = df.join(F.broadcast(dim), F.col(code) == F.col("_uf"), "left")  # 27 rows
    return joined.withColumn(name, F.coalesce("_name", F.col(code))).drop("_uf", "_name")


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON collection: ``uf``, ``state_name``, ``geometry`` as JSON text."""
    schema = """
        features array<struct<
            properties: struct<uf: string, state_name: string>,
            geometry: struct<type: string, coordinates: string>
        >>
    """
    collections = spark.read.schema(schema).option("multiLine", True).json(path)
    feature = collections.select(F.explode("features").alias("f"))
    geometry = F.format_string('{"type":"%s","coordinates":%s}', "f.geometry.type", "f.geometry.coordinates")
    return feature.select(
        F.col("f.properties.uf").alias("uf"),
        F.col("f.properties.state_name").alias("state_name"),
        F.when(F.col("f.geometry.type").isNotNull(), geometry).alias("geometry"),
    )


def with_boundary(metrics: DataFrame, boundaries: DataFrame, code: str = "customer_state") -> DataFrame:
    """Attach the polygon of each state, joined on its code."""
    return metrics.join(boundaries.withColumnRenamed("uf", code), code, "left")


def recode_ibge(boundaries: DataFrame, ibge_code: str = "codarea") -> DataFrame:
    """Add ``uf`` and ``state_name`` to features that carry only the statistics-office code."""
    dim = states(boundaries.sparkSession).withColumnRenamed("ibge_code", ibge_code)
    return boundaries.join(F.broadcast(dim), ibge_code, "left")  # 27 rows
