import numpy as np

from fluxloom.schema import LightCurves
from fluxloom.sources import fits, plasticc, sdss, sinks, snana, spcc


def test_text_objects(spark, tmp_path):
    body = "HOST_GALAXY_PHOTO-Z: 0.5 +- 0.05\nSIM_COMMENT: SN Type = II , MODEL = IIP\nOBS: 56177.2 g NULL 1.5 0.2\nOBS: 56180.2 r NULL 2.5 0.3\n"
    (tmp_path / "SN1.DAT").write_text(body)
    (tmp_path / "SN2.DAT").write_text("HOST_GALAXY_PHOTO-Z: 0.1 +- 0.01\n")
    (tmp_path / "names.LIST").write_text("SN2.DAT\nSN1.DAT\n")
    data = spcc.read(spark, str(tmp_path))
    assert [(r.object_id, r.z, r.z_err, r.target, r.initial_observation_time) for r in data.objects.collect()] == [("SN1.DAT", 0.5, 0.05, 22, 56177.2)]
    assert sorted((round(r.mjd, 6), r.filter, r.flux) for r in data.observations.collect()) == [(0.0, "desg", 1.5), (3.0, "desr", 2.5)]
    assert [r.object_id for r in spcc.names_in_list(spark, str(tmp_path / "names.LIST"), [0]).collect()] == ["SN1.DAT"]


def test_challenge_csv_is_cached(spark, tmp_path):
    (tmp_path / "t.csv").write_text("object_id,mjd,passband,flux,flux_err,detected_bool\n7,100.5,2,3.5,0.5,1\n7,101.5,0,1.0,0.5,0\n")
    (tmp_path / "t_metadata.csv").write_text("object_id,ddf_bool,hostgal_specz,hostgal_photoz,hostgal_photoz_err,target\n7,1,-9,0.4,0.1,42\n")
    for _ in range(2):
        data = sinks.load_dataset(spark, str(tmp_path / "t.csv"))
        assert sorted((r.object_id, r.mjd, r.filter, r.detected) for r in data.observations.collect()) == [("7", 0.0, "lsstr", True), ("7", 1.0, "lsstu", False)]
        assert data.objects.first().z == 0.4 and data.objects.first().ddf


def test_photometry_clean_up(spark):
    rows = spark.createDataFrame([(" 12 ", 5.0, " Y ", 4096, 1.0, 0.1)], "SNID string, MJD double, BAND string, PHOTFLAG int, FLUXCAL double, FLUXCALERR double")
    r = snana.clean_photometry(rows).first()
    assert (r.object_id, r.filter, r.detected, r.flux) == ("12", "lssty", True, 1.0)
    head = snana.clean_metadata(spark.createDataFrame([("1", 142, 0.3)], "SNID string, SNTYPE int, REDSHIFT_FINAL double")).first()
    assert (head.target, head.z) == (42, 0.3)
    kinds = snana.simulated_class(spark.createDataFrame([(120,), (132,), (5,)], "sntype int"), spectra=False).collect()
    assert [(k.target, k.spectroscopic) for k in kinds] == [(3, False)]
    assert [r.target for r in snana.generic_class(spark.createDataFrame([(142,), (5,)], "sntype int")).collect()] == [4, None]


def test_master_list(spark, tmp_path):
    fields = ["12", "a", "b", "c", "d", "SNIa"] + ["x"] * 5 + ["\\N", "\\N"] + ["x"] * 90 + ["0.25", "0.02"]
    (tmp_path / "m.dat").write_text("# head\n" + " ".join(fields) + "\n")
    rows = sdss.master_list(spark, str(tmp_path / "m.dat"), "spectro")
    r = sdss.info(rows).first()
    assert (r.name, r.target, r.z, r.z_err) == ("SMP_000012.dat", 1, 0.25, 0.02)
    (tmp_path / "SMP_000012.dat").write_text("h\nh\nh\nh\n0 53616.0 2 0 0 0 0 10.5 0.5\n1024 53617.0 2 0 0 0 0 1 1\n")
    obs = sdss.parse_observations(sdss.read_lines(spark, str(tmp_path))).collect()
    assert [(o.mjd, o.filter, o.flux) for o in obs] == [(0.0, "sdssr", 10.5)]


def _card(key, value):
    return (f"{key:8}= {value:>20}" if not value.startswith("'") else f"{key:8}= {value}").ljust(80)


def _fits(columns):
    dtype = np.dtype([(n, k) for n, k, _, _ in columns])
    rows = np.zeros(len(columns[0][3]), dtype)
    for n, _, _, values in columns:
        rows[n] = values
    block = lambda cards: "".join([*cards, "END".ljust(80)]).ljust(2880).encode()
    head = block([_card("SIMPLE", "T"), _card("BITPIX", "8"), _card("NAXIS", "0")])
    cards = [_card("XTENSION", "'BINTABLE'"), _card("BITPIX", "8"), _card("NAXIS", "2"), _card("NAXIS1", str(dtype.itemsize)), _card("NAXIS2", str(len(rows))), _card("PCOUNT", "0"), _card("GCOUNT", "1"), _card("TFIELDS", str(len(columns)))]
    for i, (n, _, form, _) in enumerate(columns, 1):
        cards += [_card(f"TTYPE{i}", f"'{n}'"), _card(f"TFORM{i}", f"'{form}'")]
    body = rows.tobytes()
    return head + block(cards) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits_pairs(spark, tmp_path):
    (tmp_path / "A_HEAD.FITS").write_bytes(_fits([("SNID", "S4", "4A", [b"1 ", b"2"]), ("PTROBS_MIN", ">i4", "1J", [1, 3]), ("PTROBS_MAX", ">i4", "1J", [2, 3])]))
    (tmp_path / "A_PHOT.FITS").write_bytes(_fits([("MJD", ">f8", "1D", [1.0, 2.0, 3.0]), ("FLUXCAL", ">f4", "1E", [5.0, -1.0, 7.0])]))
    head, phot = fits.head_and_phot(spark, str(tmp_path), "SNID string, PTROBS_MIN int, PTROBS_MAX int", "MJD double, FLUXCAL float")
    assert head.count() == 2
    assert sorted((r.SNID, r.MJD, r.FLUXCAL) for r in phot.collect()) == [("1", 1.0, 5.0), ("2", 3.0, 7.0)]


def test_sinks(spark, tmp_path):
    obs = spark.createDataFrame([("a", 0.0, "lsstr", 1.0, 0.1), ("b", 1.0, "lsstg", 2.0, 0.1)], "object_id string, mjd double, filter string, flux double, flux_error double")
    data = LightCurves(obs, obs.select("object_id"))
    sinks.save_folder(data, str(tmp_path / "f"))
    assert sinks.load_folder(spark, str(tmp_path / "f")).count() == 2
    sinks.save_dataset(data, str(tmp_path / "d"))
    assert sinks.load_dataset(spark, str(tmp_path / "d")).observations.count() == 2
    sinks.save_run(spark, {"seed": 1}, str(tmp_path / "r"))
    assert sinks.load_run(spark, str(tmp_path / "r"))["seed"] == 1
    other = obs.selectExpr("concat(object_id, '2') AS object_id", "mjd + 5 AS mjd", "filter", "flux", "flux_error")
    more = sinks.append_objects(data, other, other.select("object_id"))
    assert more.observations.where("object_id LIKE '%2'").agg({"mjd": "max"}).first()[0] == 0.0


def test_wavelets_saved_and_read(spark, tmp_path, small):
    from fluxloom.operators import features as T
    from fluxloom.sources.fixtures import grid_models

    bands = ("lsstu", "lsstg", "lsstr", "lssti", "lsstz")
    packed = T.swt(T.pack_models(grid_models(spark, small)), "flux", 2)
    sinks.save_coefficients(packed, 2, str(tmp_path / "w"))
    direct = {r.object_id: r.features for r in T.feature_vector(packed, 2, bands).collect()}
    assert {r.object_id: r.features for r in sinks.load_feature_space(spark, str(tmp_path / "w"), bands).collect()} == direct
