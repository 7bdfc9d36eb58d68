"""The survey's whitespace tables: a master list and one file per object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.preprocess import rezero
from fluxloom.operators.subset import seeded_order

#: Filter codes of the object files.
FILTERS = {0: "sdssu", 1: "sdssg", 2: "sdssr", 3: "sdssi", 4: "sdssz"}
#: Classes of spectroscopically confirmed and of photometrically classified objects.
SPECTROSCOPIC = ("SNIa", "SNIa?", "SNII", "SNIb", "SNIc")
PHOTOMETRIC = ("pSNIa", "pSNII", "pSNIbc", "zSNIa", "zSNII", "zSNIbc")


def _parts(line: str = "value"):
    return F.split(F.trim(line), r"\s+")


def master_list(spark: SparkSession, path: str, kind: str | None = None, classes: Sequence[str] | None = None, n: int | None = None, seed: int = 0) -> DataFrame:
    """(name, class): objects of the list, of one kind or some classes, optionally ``n`` at random."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("_p", _parts()).where(F.size("_p") > 5)
    rows = rows.select(F.concat(F.lit("SMP_"), F.lpad(F.col("_p")[0], 6, "0"), F.lit(".dat")).alias("name"), F.col("_p")[5].alias("class"), F.col("_p").alias("fields"))
    wanted = {"spectro": SPECTROSCOPIC, "photo": PHOTOMETRIC}.get(kind)
    rows = rows if wanted is None else rows.where(F.col("class").isin(*wanted))
    rows = rows if classes is None else rows.where(F.col("class").isin(*classes))
    return rows if n is None else rows.orderBy(seeded_order("name", seed), "name").limit(n)


def info(rows: DataFrame, photo: tuple[int, int] = (103, 104), helio: tuple[int, int] = (11, 12)) -> DataFrame:
    """name, target (1 Ia, 2 II, 3 Ibc), z and z_err: heliocentric, else photometric; null where missing."""
    value = lambda i: F.expr(f"try_cast(nullif(try_element_at(fields, {i + 1}), '\\\\N') AS DOUBLE)")
    target = F.when(F.col("class").contains("Ia"), 1).when(F.col("class").rlike("I[bc]"), 3).when(F.col("class").contains("II"), 2)
    use = value(helio[0]).isNotNull()
    return rows.select("name", target.alias("target"), F.coalesce(value(helio[0]), value(photo[0])).alias("z"), F.when(use, value(helio[1])).otherwise(value(photo[1])).alias("z_err"))


def parse_observations(lines: DataFrame) -> DataFrame:
    """(name, value, line number) to observations: four header lines, flags below 1024 only."""
    rows = lines.where("line >= 4").withColumn("_p", _parts()).where((F.size("_p") >= 9) & (F.expr("try_cast(_p[0] AS INT)") < 1024))
    band = F.element_at(F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair]), F.col("_p")[2].cast("int"))
    number = lambda i: F.col("_p")[i].cast("double")
    return rezero(rows.select(F.col("name").alias("object_id"), number(1).alias("mjd"), band.alias("filter"), number(7).alias("flux"), number(8).alias("flux_error"), number(3).alias("mag"), number(4).alias("mag_error"), F.lit(27.5).alias("zp"), F.lit("ab").alias("zpsys")))


def read_lines(spark: SparkSession, folder: str, pattern: str = "SMP_*.dat") -> DataFrame:
    """(name, line, value): the lines of each file with their numbers; a file of one object is one row first."""
    whole = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = whole.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.split("value", "\n").alias("_l"))
    return rows.select("name", F.posexplode("_l").alias("line", "value"))
