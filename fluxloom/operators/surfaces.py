"""Template surfaces, flux by phase and wavelength, seen through passbands: joins and sums.

A surface is a table (template, phase, wavelength, flux per wavelength), a passband one of (filter, wavelength, transmission); both
are piecewise linear. A band's flux is the number of photons that pass, in units in which a source of 0 magnitudes (AB) has
10^(0.4 zp): the sum over a grid of wavelengths, ``step`` apart, of flux, wavelength and transmission, over the same sum for the
flat reference spectrum. Nothing is looked up by search: each interval of a table makes the grid points that lie in it, and
these meet on their number.

The sum over wavelengths is linear in flux, so it is taken once at each phase of a template, for each redshift and band, and
observations interpolate between the two phases around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.runtime import broadcast_if_small, materialised

#: The reference spectrum of 0 magnitudes in erg / s / cm^2 / Hz, and the speed of light in angstrom / s.
AB_FLUX, LIGHT = 3.631e-20, 2.99792458e18


def read_bands(spark: SparkSession, folder: str, prefix: str = "", suffix: str = ".dat", bands: Sequence[str] = "ugrizy", survey: str = "lsst") -> DataFrame:
    """(filter, wavelength, transmission) from files of two columns, ``<prefix><band><suffix>``; lines that begin with # are skipped."""
    lines = spark.read.text([f"{folder}/{prefix}{b}{suffix}" for b in bands]).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.trim("value").alias("value"))
    part = F.split("value", r"[\s,]+")
    band = F.expr(f"substring(file, {len(prefix) + 1}, length(file) - {len(prefix) + len(suffix)})")
    rows = lines.where("value <> '' AND NOT startswith(value, '#')")
    return rows.select(F.concat(F.lit(survey), band).alias("filter"), part[0].cast("double").alias("wavelength"), part[1].cast("double").alias("transmission"))


def _intervals(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """``by``, x0, y0, x1, y1: neighbouring rows in the order of ``x``."""
    order = W.partitionBy(*by).orderBy(x)
    return rows.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1")).where("x1 > x0")


def _between(x: Column) -> Column:
    return F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))


def _points(low: Column, high: Column, step: float) -> Column:
    """The numbers j of the grid points j * step from ``low`` up to ``high``, without that."""
    first, last = F.ceil(low / step), F.ceil(high / step) - 1
    return F.when(first <= last, F.sequence(first, last))


def band_weights(bands: DataFrame, step: float = 5.0) -> DataFrame:
    """(filter, j, weight): what a flux of 1 at wavelength j * step adds to a band; sums to 10^0 for the reference spectrum."""
    points = _intervals(bands, ["filter"], "wavelength", "transmission").withColumn("j", F.explode(_points(F.col("x0"), F.col("x1"), step)))
    wave = F.col("j") * step
    points = points.select("filter", "j", _between(wave).alias("t"), wave.alias("wave"))
    whole = points.groupBy("filter").agg(F.sum(F.col("t") / F.col("wave")).alias("_s"))
    return points.join(whole, "filter").select("filter", "j", (F.col("t") * F.col("wave") / (F.col("_s") * AB_FLUX * LIGHT)).alias("weight"))


def band_curves(surfaces: DataFrame, bands: DataFrame, redshifts: DataFrame, zp: float = 27.5, step: float = 5.0) -> DataFrame:
    """(template, filter, z, phase, flux) at each phase of each template, for each z of the column ``z`` of ``redshifts``.

    ``phase`` is in the object's own time; wavelengths are stretched and the flux per wavelength thinned by 1 + z.
    """
    weights = materialised(band_weights(bands, step))
    names = [r[0] for r in weights.select("filter").distinct().orderBy("filter").collect()]  # bands are few
    cell = 100.0
    asked = redshifts.select(F.col("z").cast("double").alias("z")).where("z > -1").distinct().withColumn("filter", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    points = asked.join(broadcast_if_small(weights), "filter").withColumn("rest", F.col("j") * step / (1 + F.col("z")))
    # intervals of a surface and grid points meet in cells of wavelengths
    pieces = _intervals(surfaces, ["template", "phase"], "wavelength", "flux")
    pieces = materialised(pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell)))))
    met = points.withColumn("cell", F.floor(F.col("rest") / cell)).join(broadcast_if_small(pieces), "cell").where("x0 <= rest AND rest < x1")
    flux = met.select("template", "filter", "z", "phase", (F.col("weight") * _between(F.col("rest")) / (1 + F.col("z"))).alias("f"))
    return flux.groupBy("template", "filter", "z", "phase").agg((F.sum("f") * 10 ** (0.4 * zp)).alias("flux"))


def packed_curves(curves: DataFrame) -> DataFrame:
    """(template, filter, z, curve): the phases and fluxes of a curve as one array, in order."""
    return curves.groupBy("template", "filter", "z").agg(F.sort_array(F.collect_list(F.struct("phase", "flux"))).alias("curve"))


def curve_at(curve: Column, phase: Column) -> Column:
    """A curve read at a phase; 0 outside."""
    n = F.size(F.filter(curve, lambda p: p["phase"] <= phase))
    a, b = F.get(curve, n - 1), F.get(curve, F.least(n, F.size(curve) - 1))
    inside = (n > 0) & ((n < F.size(curve)) | (phase == a["phase"]))
    slope = F.when(b["phase"] > a["phase"], (b["flux"] - a["flux"]) / (b["phase"] - a["phase"])).otherwise(0.0)
    return F.when(inside, a["flux"] + slope * (phase - a["phase"])).otherwise(0.0)


def band_flux(times: DataFrame, surfaces: DataFrame, bands: DataFrame, zp: float = 27.5, step: float = 5.0) -> DataFrame:
    """``times`` (template, filter, z, t0, amplitude, mjd and more) with model_flux."""
    curves = materialised(packed_curves(band_curves(surfaces, bands, times, zp, step)))
    rows = times.withColumn("_z", F.col("z").cast("double"))
    curves = curves.withColumnsRenamed({"template": "_t", "filter": "_f", "z": "_cz"})
    rows = rows.join(broadcast_if_small(curves, 1 << 16), (F.col("template") == F.col("_t")) & (F.col("filter") == F.col("_f")) & (F.col("_z") == F.col("_cz")), "left")
    phase = (F.col("mjd") - F.col("t0")) / (1 + F.col("_z"))
    return rows.withColumn("model_flux", F.coalesce(F.col("amplitude") * curve_at(F.col("curve"), phase), F.lit(0.0))).drop("_z", "_t", "_f", "_cz", "curve")


def fit_surfaces(obs: DataFrame, surfaces: DataFrame, bands: DataFrame, redshifts: DataFrame, key: str = "object_id", days: float = 1.0, rounds: int = 3, zp: float = 27.5, step: float = 5.0) -> DataFrame:
    """(key, template, z, t0, amplitude, chisq, n_points): the best template, start and amplitude at each object's redshift.

    ``redshifts`` (key, z) may hold several z for an object; the best counts. Starts are ``days`` apart over all that let a
    template meet the object's times; each further round divides the step by ten around each template's best. The
    amplitude of a start has a closed form, so a round is one join and one sum. Of equal fits the first template, redshift and
    start wins. Objects without a redshift, or that no template meets, have no row.
    """
    good = obs.where("flux_error > 0").select(key, "filter", "mjd", "flux", "flux_error")
    asked = redshifts.select(F.col(key).alias("_k"), F.col("z").cast("double").alias("z")).where("z > -1").distinct()
    curves = materialised(packed_curves(band_curves(surfaces, bands, asked, zp, step)))
    rows = good.join(asked, F.col(key) == F.col("_k")).drop("_k").join(broadcast_if_small(curves, 1 << 16), ["filter", "z"])
    rows = materialised(rows)
    span = curves.select("template", "z", F.get("curve", F.lit(0))["phase"].alias("a"), F.element_at("curve", -1)["phase"].alias("b")).groupBy("template", "z").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = good.groupBy(key).agg(F.min("mjd").alias("from"), F.max("mjd").alias("to")).join(asked, F.col(key) == F.col("_k")).join(F.broadcast(span), "z")
    first, last = F.col("from") - F.col("b") * (1 + F.col("z")), F.col("to") - F.col("a") * (1 + F.col("z"))
    starts = spans.select(key, "template", "z", F.explode(F.sequence(F.floor(first / days), F.ceil(last / days))).alias("_i")).select(key, "template", "z", (F.col("_i") * days).alias("t0"))
    best, width = None, days
    for _ in range(rounds):
        asked_at = rows.join(starts.groupBy(key, "template", "z").agg(F.collect_set("t0").alias("starts")), [key, "template", "z"]).withColumn("t0", F.explode("starts"))
        m = curve_at(F.col("curve"), (F.col("mjd") - F.col("t0")) / (1 + F.col("z")))
        parts = asked_at.select(key, "template", "z", "t0", (F.col("flux") / F.col("flux_error")).alias("y"), (m / F.col("flux_error")).alias("m"))
        sums = parts.groupBy(key, "template", "z", "t0").agg(F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("y") * F.col("m")).alias("ym"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count("*").alias("n_points"))
        amplitude = F.greatest(F.col("ym") / F.col("mm"), F.lit(0.0))
        fits = sums.where("mm > 0").withColumn("amplitude", amplitude).withColumn("chisq", F.col("yy") - 2 * F.col("amplitude") * F.col("ym") + F.col("amplitude") * F.col("amplitude") * F.col("mm"))
        best = materialised(fits.groupBy(key, "template", "z").agg(F.min_by(F.struct("t0", "amplitude", "chisq", "n_points"), F.struct("chisq", "t0")).alias("b")).select(key, "template", "z", "b.*"))
        width /= 10
        starts = best.select(key, "template", "z", F.explode(F.transform(F.sequence(F.lit(-10), F.lit(10)), lambda i: F.col("t0") + i * width)).alias("t0"))
    return best.groupBy(key).agg(F.min_by(F.struct("template", "z", "t0", "amplitude", "chisq", "n_points"), F.struct("chisq", "template", "z", "t0")).alias("b")).select(key, "b.*")
