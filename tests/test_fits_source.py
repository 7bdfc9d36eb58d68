"""The FITS data source: row ranges, conditions that narrow them, objects' ranges, stored numbers, against the decoder of whole files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from fluxloom.sources import fits


def _card(key, value):
    return (f"{key:8}= {value:>20}" if not value.startswith("'") else f"{key:8}= {value}").ljust(80)


def _block(cards):
    return "".join([*cards, "END".ljust(80)]).ljust(-(-80 * (len(cards) + 1) // 2880) * 2880).encode()


def _file(*tables):
    """Each table: (columns of (name, numpy type, form, values), further cards)."""
    out = _block([_card("SIMPLE", "T"), _card("BITPIX", "8"), _card("NAXIS", "0")])
    for columns, more in tables:
        dtype = np.dtype([(c[0], *c[1]) if isinstance(c[1], tuple) else (c[0], c[1]) for c in columns])
        rows = np.zeros(len(columns[0][3]), dtype)
        for n, _, _, values in columns:
            rows[n] = values
        cards = [_card("XTENSION", "'BINTABLE'"), _card("BITPIX", "8"), _card("NAXIS", "2"), _card("NAXIS1", str(dtype.itemsize)), _card("NAXIS2", str(len(rows))), _card("PCOUNT", "0"), _card("GCOUNT", "1"), _card("TFIELDS", str(len(columns)))]
        for i, (n, _, form, _) in enumerate(columns, 1):
            cards += [_card(f"TTYPE{i}", f"'{n}'"), _card(f"TFORM{i}", f"'{form}'")]
        body = rows.tobytes()
        out += _block(cards + [_card(k, v) for k, v in more.items()]) + body.ljust(-(-len(body) // 2880) * 2880, b"\0")
    return out


def _pair(folder, name, sizes, seed=0):
    """A head and a photometry file, an end marker behind each object's rows."""
    r, at, low, high, n = np.random.default_rng(seed), 1, [], [], sum(sizes) + len(sizes)
    for size in sizes:
        low.append(at)
        high.append(at + size - 1)
        at += size + 1
    ids = [f"{name}{i}".encode() for i in range(len(sizes))]
    (folder / f"{name}_HEAD.FITS").write_bytes(_file(([("SNID", "S12", "12A", ids), ("PTROBS_MIN", ">i4", "1J", low), ("PTROBS_MAX", ">i4", "1J", high)], {})))
    (folder / f"{name}_PHOT.FITS").write_bytes(_file(([("MJD", ">f8", "1D", np.arange(n) + 0.5), ("FLT", "S2", "2A", [b"r "] * n), ("FLUXCAL", ">f4", "1E", r.normal(5, 20, n))], {})))
    return {ids[i].decode(): (low[i], high[i]) for i in range(len(sizes))}


@pytest.fixture
def archive(tmp_path):
    spans = {n: _pair(tmp_path, n, sizes, k) for k, (n, sizes) in enumerate({"A": [3, 0, 50], "B": [4000, 9000, 7], "C": [1] * 40}.items())}
    return tmp_path, spans


def _plain(path, name):
    (table,) = fits.tables((path / name).read_bytes())
    return table


def test_whole_tables_by_ranges(spark, archive):
    path, _ = archive
    fits.register(spark)
    df = spark.read.format("fits").option("pattern", "*PHOT*").option("rows", 500).load(str(path))
    assert df.dtypes == [("MJD", "double"), ("FLT", "string"), ("FLUXCAL", "float"), ("file", "string"), ("row", "bigint")]
    assert df.rdd.getNumPartitions() == 1 + 27 + 1
    got = sorted(df.collect(), key=lambda r: (r.file, r.row))
    want = [(*x, name, i + 1) for name in ("A_PHOT.FITS", "B_PHOT.FITS", "C_PHOT.FITS") for i, x in enumerate(_plain(path, name).itertuples(index=False))]
    assert [tuple(r) for r in got] == [(m, f, float(x), n, i) for m, f, x, n, i in want]


def _reader(options, ddl):
    return fits.FitsReader(options, T.StructType.fromDDL(ddl))


def test_only_asked_rows_are_fetched(spark, archive):
    path, _ = archive
    reader = _reader({"path": str(path), "pattern": "{B,C}_PHOT*"}, "MJD double, file string, row long")
    left = list(reader.pushFilters([GreaterThan(("row",), 6000), LessThanOrEqual(("row",), 6100), IsNotNull(("MJD",))]))
    assert left == [IsNotNull(("MJD",))]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in rows] == [100] and rows[0].column("row").to_pylist() == list(range(6001, 6101))
    width = fits._layout(str(path / "B_PHOT.FITS"), 0).dtype.itemsize
    assert reader.bytes_read == 100 * width  # headers were read in planning
    reader = _reader({"path": str(path), "pattern": "B_PHOT*"}, "MJD double, row long")
    assert list(reader.pushFilters([In(("row",), (5, 6, 900, None, 10**9))])) == []
    assert [(p.first, p.last) for p in reader.partitions()] == [(4, 6), (899, 900)]


def test_objects_ranges(spark, archive):
    path, spans = archive
    options = {"path": str(path), "pattern": "*PHOT*", "head": "HEAD", "snid": json.dumps(["A2", "B2", "C7", "C9", "none"])}
    reader = _reader(options, "SNID string, MJD double, FLUXCAL float, row long")
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = []
    for name, ids in (("A", ["A2"]), ("B", ["B2"]), ("C", ["C7", "C9"])):
        table = _plain(path, f"{name}_PHOT.FITS")
        want += [(i, table.MJD[k], float(table.FLUXCAL[k]), k + 1) for i in ids for k in range(spans[name][i][0] - 1, spans[name][i][1])]
    assert got == want
    width = fits._layout(str(path / "B_PHOT.FITS"), 0).dtype.itemsize
    heads = sum(fits.RangeFile(str(path / f"{n}_HEAD.FITS")).layout("", 0).rows for n in "ABC") * fits._layout(str(path / "A_HEAD.FITS"), 0).dtype.itemsize
    assert reader.bytes_read == heads + width * (50 + 7 + 1 + 1 + 3)  # C7 and C9 are near enough to be fetched at once
    pushed = _reader(options | {"snid": ""}, "SNID string, MJD double, FLUXCAL float, row long")
    assert list(pushed.pushFilters([EqualTo(("SNID",), "B2")])) == []
    assert sum(b.num_rows for p in pushed.partitions() for b in pushed.read(p)) == 7


def test_pushed_conditions_in_a_query(spark, archive):
    path, spans = archive
    fits.register(spark)
    df = spark.read.format("fits").option("pattern", "*PHOT*").option("head", "HEAD").load(str(path))
    assert df.where("SNID IN ('A0', 'B1')").count() == 9003
    rows = spark.read.format("fits").option("pattern", "B_PHOT*").load(str(path)).where("row > 12000 AND row <= 12010 AND MJD > 12003")
    assert sorted(r.row for r in rows.collect()) == list(range(12004, 12011)) and rows.rdd.getNumPartitions() == 1


def test_pairs_of_many_objects(spark, archive):
    """Objects from a DataFrame of any size: their rows and no others, the same as by row numbers."""
    path, spans = archive
    ids = spark.createDataFrame([("A0",), ("A1",), ("B1 ",), ("C3",)], "SNID string")
    head, phot = fits.head_and_phot(spark, str(path), "SNID string, PTROBS_MIN int, PTROBS_MAX int", "MJD double, FLUXCAL float", False, ids)
    assert sorted(r.SNID for r in head.collect()) == ["A0", "A1", "B1", "C3"]
    counts = {r.SNID: (r.n, r.low, r.high) for r in phot.groupBy("SNID").agg(F.count("*").alias("n"), F.min("MJD").alias("low"), F.max("MJD").alias("high")).collect()}
    assert counts == {i: (b - a + 1, a - 0.5, b - 0.5) for i, (a, b) in (("A0", spans["A"]["A0"]), ("B1", spans["B"]["B1"]), ("C3", spans["C"]["C3"]))}


def test_overlapping_and_long_spans(spark, archive):
    path, _ = archive
    file, layout = fits.RangeFile(str(path / "B_PHOT.FITS")), fits._layout(str(path / "B_PHOT.FITS"), 0)
    arrow = fits.to_arrow_schema(T.StructType.fromDDL("SNID string, row long"))
    first, last = np.array([0, 100, 90, 12000]), np.array([13000, 120, 9000, 12001])
    got = [(r["SNID"], r["row"]) for b in fits._spans(file, layout, arrow, first, last, np.array(["a", "b", "c", "d"], object), "f") for r in b.to_pylist()]
    assert sorted(got) == sorted((i, k + 1) for i, a, b in zip("abcd", first, last, strict=True) for k in range(a, b))


def test_stored_numbers(spark, tmp_path):
    columns = [("ID", ">i2", "1I", [-32768, 5]), ("X", ">i4", "1J", [7, -999]), ("Y", ">i2", "1I", [2, 3]), ("OK", "u1", "1L", [ord("T"), ord("F")]), ("V", (">f4", (2,)), "2E", [[1, 2], [3, 4]]), ("T", "S3", "3A", [b"ab", b""])]
    more = {"TZERO1": "32768", "TSCAL1": "1", "TNULL2": "-999", "TSCAL3": "0.5", "TZERO3": "10"}
    (tmp_path / "a.FITS").write_bytes(_file(([("Q", ">i8", "1K", [1, 2, 3])], {}), (columns, more)))
    fits.register(spark)
    df = spark.read.format("fits").option("table", 1).load(str(tmp_path / "a.FITS"))
    assert dict(df.dtypes) | {"file": 0, "row": 0} == {"ID": "bigint", "X": "int", "Y": "double", "OK": "boolean", "V": "array<float>", "T": "string", "file": 0, "row": 0}
    assert [tuple(r) for r in df.orderBy("row").collect()] == [(0, 7, 11.0, True, [1.0, 2.0], "ab", "a.FITS", 1), (32773, None, 11.5, False, [3.0, 4.0], "", "a.FITS", 2)]
    assert spark.read.format("fits").schema("Q long, lacking double").load(str(tmp_path)).agg(F.sum("Q"), F.count("lacking")).first()[:] == (6, 0)
    with pytest.raises(Exception, match="no binary table 5"):
        spark.read.format("fits").option("table", 5).load(str(tmp_path)).count()


def test_truncated_file_is_told(spark, tmp_path):
    _pair(tmp_path, "A", [5000])
    data = (tmp_path / "A_PHOT.FITS").read_bytes()
    (tmp_path / "A_PHOT.FITS").write_bytes(data[:20_000])
    with pytest.raises(ValueError, match="ends before row"):
        reader = _reader({"path": str(tmp_path), "pattern": "*PHOT*"}, "MJD double")
        [list(reader.read(p)) for p in reader.partitions()]
