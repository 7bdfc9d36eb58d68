"""Column vocabulary and fixed dimension tables of the light-curve model."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Passbands of the two surveys with their effective wavelengths in angstrom, in order.
PASSBANDS = {
    "lsstu": 3685.0, "lsstg": 4802.0, "lsstr": 6231.0, "lssti": 7542.0, "lsstz": 8690.0, "lssty": 9736.0,
    "desg": 4686.0, "desr": 6166.0, "desi": 7480.0, "desz": 8932.0,
}
LSST = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz", "lssty")
DES = ("desg", "desr", "desi", "desz")

#: Class codes of the photometric challenge.
TYPE_NAMES = {1: "Ia", 2: "II", 21: "IIn", 22: "IIP", 23: "IIL", 3: "Ibc", 32: "Ib", 33: "Ic", 66: "other"}

#: Missing values of the file formats; inside the library they are null.
MISSING = -9.0


@dataclass(frozen=True)
class LightCurves:
    """A dataset: observations (long), objects (one row each) and models on a grid."""

    observations: DataFrame
    objects: DataFrame
    models: DataFrame | None = None
    filters: tuple[str, ...] = field(default=LSST)


def passbands(spark: SparkSession) -> DataFrame:
    """(filter, ordinal, wavelength): a dimension of ten rows."""
    return spark.createDataFrame([(f, i, w) for i, (f, w) in enumerate(PASSBANDS.items())], "filter string, ordinal int, wavelength double")


def wavelength(filter_: Column) -> Column:
    """The passband's wavelength as an expression; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in PASSBANDS.items() for x in pair]), filter_)


def present(value: Column, missing: float = MISSING) -> Column:
    """Null for NaN and for the missing value."""
    return F.when(~F.isnan(value.cast("double")) & (value != missing), value)
