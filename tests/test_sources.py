"""File sources on small files."""

import json

import pytest

from panelmill.sources import files as S


def write(path, text):
    path.write_text(text)
    return str(path)


def test_wide_tiers(spark, tmp_path):
    head = "id,rank,RegionName,RegionType,2020-01-31,2020-02-29,2021-01-31\n"
    top = write(tmp_path / "top.csv", head + '1,1,"A, TX",msa,1,2,3\n2,2,"B, NY",msa,4,x,6\n3,3,US,country,7,8,9\n')
    low = write(tmp_path / "low.csv", head + '1,1,"A, TX",msa,1,2,3\n2,2,"B, NY",msa,4,5,6\n1,1,"A, TX",msa,10,20,30\n')
    a, b = (S.wide_csv(spark, p, end="2020-12") for p in (top, low))
    assert {(r.name, r.ym): r.value for r in a.collect()} == {("A, TX", "2020-01"): 1, ("A, TX", "2020-02"): 2, ("B, NY", "2020-01"): 4, ("B, NY", "2020-02"): None}
    rows = {(r.name, r.tier, r.ym): r.value for r in S.two_tiers(a, b).collect()}
    assert rows[("A, TX", "bottom", "2020-02")] == 20 and ("B, NY", "top", "2020-01") not in rows and ("B, NY", "bottom", "2020-01") in rows


def test_long_panel_last_row_wins_and_sparse_units_go(spark, tmp_path):
    p = write(tmp_path / "long.csv", "date,code,rate\n2020-01-01,1,5\n2020-01-15,1,6\n2020-02-01,1,\n2020-02-01,2,bad\n2020-01-01,2,\n")
    rows = {(r.unit, r.ym): r.value for r in S.long_panel(spark, p, "code", "date", "rate", most_missing=1).collect()}
    assert rows == {("1", "2020-01"): 6.0, ("1", "2020-02"): None}


def test_lookups(spark, tmp_path):
    x = write(tmp_path / "x.csv", 'name,code\n"Austin-Round Rock, TX-LA",12.0\n"Austin, TX",99\n')
    rows = {(r.city, r.state): r.code for r in S.crosswalk(spark, x, "name", "code").collect()}
    assert rows == {("austin", "tx"): "00012"}
    c = write(tmp_path / "c.csv", " cbsa , lat,lon\n00012,30,-97\n")
    got = S.centroids(spark, c, spark.createDataFrame([("00012",), ("1",)], "code string")).collect()
    assert {(r.code, r.matched) for r in got} == {("00012", True), ("1", False)}
    v = write(tmp_path / "v.csv", "cbsa_code,date,pop\n00012,2020-01-01,5\n12,2020-01-31,7\n")
    assert [tuple(r) for r in S.covariate_lookup(spark, v, "cbsa_code", "date", ["pop"]).collect()] == [("12", "2020-01", 7.0)]


def test_annual_series_and_wide_round_trip(spark, tmp_path):
    s = write(tmp_path / "s.tsv", "id\tarea\tcode\tmeasure\ta\tb\ttitle\nLAUMT13\tB\tc\t03\t\t\tRate: X (U)\nLAUMT23\tB\tc\t03\t\t\tRate: X (U)\nLAUMT34\tB\tc\t03\t\t\tRate: Y (U)\n")
    d = write(tmp_path / "d.tsv", "id\tyear\tperiod\tvalue\n" + "".join(f"{i}\t{y}\tM13\t{v}\n" for i in ("LAUMT13", "LAUMT23") for y, v in ((2000, 1.25), (2001, 2))) + "LAUMT13\t2000\tM01\t9\n")
    panel = S.annual_series(spark, s, d, 2)
    assert {r.unit for r in panel.collect()} == {"X", "X #2"}
    S.write_wide(panel, str(tmp_path / "wide"))
    back = {(r.year, r.unit): r.value for r in S.metro_wide(spark, str(tmp_path / "wide")).collect()}
    assert back[(2001, "X")] == 2.0 and len(back) == 4


def test_permits(spark, tmp_path):
    row = lambda period, code, header, name, unit: ",".join([period, "1", code, header, name, *(["1", str(unit), "2"] * 8)])
    p = write(tmp_path / "p.txt", "\n".join([row("202001", "123", "2", "A", 5), row("202001", "99999", "2", "N", 5), row("202001", "124", "5", "S", 5), row("bad", "123", "2", "A", 1), row("202002", "123", "2", "A", "x")]) + "\n")
    rows = {(r.cbsa_code, str(r.date)): (r.units, r.value) for r in S.permits(spark, [p]).collect()}
    assert rows == {("00123", "2020-01-01"): (20.0, 8.0), ("00123", "2020-02-01"): (0.0, 8.0)}
    assert S.permit_panel(S.permits(spark, [p])).count() == 2
    assert S.dated_files(["ma0112c.txt", "ma9901c.txt", "ma0001c.txt", "other"]) == [("ma0001c.txt", 2000, 1), ("ma0112c.txt", 2001, 12)]


def test_counties(spark, tmp_path):
    p = write(tmp_path / "c.json", "\n".join(json.dumps({"GeoFips": f, "TimePeriod": "2001", "DataValue": v}) for f, v in (("01001", "1,000"), ("01003", "(NA)"), ("01000", "5"), ("02001", "7"))))
    counties = S.county_series(spark, p, "gdp", 2001)
    x = spark.createDataFrame([("01001", "10"), ("01003", "10")], "county_fips string, cbsa_code string")
    assert [tuple(r) for r in S.county_to_metro(counties, x, "gdp").collect()] == [("10", 2001, 1000.0)]


def test_fingerprint_and_config(spark, tmp_path):
    import hashlib

    a, b = write(tmp_path / "a", "one"), write(tmp_path / "b", "two")
    h = lambda t: hashlib.sha256(t).hexdigest()
    assert S.fingerprint(spark, [a]) == h(b"one")[:16]
    assert S.fingerprint(spark, [a, b]) == h(b"one")[:8] + h(b"two")[:8]
    assert S.read_config(write(tmp_path / "c.json", '{"dgp": {"r": 1}}'))["dgp"]["r"] == 1


def test_header_words():
    assert S.looks_like_date("2020-01-31") and not S.looks_like_date("RegionName")
    assert S.column_with_words(["x", "CBSA Code here"], ["cbsa", "code"]) == "CBSA Code here"
    with pytest.raises(KeyError):
        S.column_any_case(["a"], "b")


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    g = {"features": [{"properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    assert S.geojson_rings(spark, write(tmp_path / "g.json", json.dumps(g))).count() == 12


def test_centroids_from_a_tab_file(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes("CSAFP\tGEOID\tNAME\tINTPTLAT\tINTPTLONG   \n1\t10100\tA\t45.5\t-98.3  \n1\t\tB\t1\t2\n1\t10300\tSe\xf1or\t\t-1\n2\t 10400 \tC\t 3.5\t4\n".encode("latin1"))
    rows = S.build_centroids(spark, str(tmp_path / "g.txt"))
    assert sorted(map(tuple, rows.collect())) == [("10100", "45.5", "-98.3"), ("10400", "3.5", "4")]
    S.write_centroids(rows, str(tmp_path / "out"))
    codes = spark.createDataFrame([("10100",), ("99999",)], "code string")
    assert {r.code: r.matched for r in S.centroids(spark, str(tmp_path / "out"), codes).collect()} == {"10100": True, "99999": False}


def test_states_of_codes(spark):
    from panelmill.operators import panel as P

    areas = spark.createDataFrame([("00123", "Town, TX", 1), ("123", "Town, QQ-OK", 2), ("77", "Nowhere", 3)], "code string, name string, position long")
    values = spark.createDataFrame([("0123", 1.0), ("123", 3.0), ("77", 9.0), ("5", 9.0)], "code string, value double")
    assert [tuple(r) for r in P.state_means(values, P.state_of_codes(areas)).collect()] == [("OK", 2.0, 2)]


def workbook(path, rows, title="List 1"):
    """A workbook of one sheet: shared strings, numbers, an inline string and gaps."""
    import zipfile
    from xml.sax.saxutils import escape

    strings, xml = [], []
    for r, cells in rows:
        out = []
        for c, v in enumerate(cells):
            ref = ("" if c < 26 else chr(64 + c // 26)) + chr(65 + c % 26) + str(r)
            if isinstance(v, (int, float)):
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif isinstance(v, bytes):
                out.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v.decode())}</t></is></c>')
            elif v is not None:
                out.append(f'<c r="{ref}" t="s"><v>{len(strings)}</v></c>')
                strings.append(v)
        xml.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Notes" sheetId="2" r:id="rId2"/><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(xml)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")


def test_crosswalk_from_a_workbook(spark, tmp_path):
    from panelmill.sources import sheets

    head = ["CBSA Code", None, "CBSA  Title", "Metropolitan/Micropolitan Statistical Area", "County", "FIPS State Code", "FIPS County Code"]
    metro = "Metropolitan Statistical Area"
    rows = [
        (1, ["A list of CBSA codes & titles"]),
        (3, head),
        (4, ["10180", None, "Abilene, TX ", metro, "Callahan", 48, 59]),
        (5, [b"10180", None, "Abilene, TX ", metro, "Callahan", "48", "059"]),
        (7, [10420.0, None, "Akron <OH>", metro, "Portage", 39.0, 133]),
        (8, ["10100", None, "Aberdeen, SD", "Micropolitan Statistical Area", "Brown", 46, 13]),
        (9, ["Note: revised"]),
    ]
    workbook(tmp_path / "list.xlsx", rows)
    got = {tuple(r) for r in sheets.county_crosswalk(spark, str(tmp_path / "list.xlsx"), "List 1").collect()}
    assert got == {("48059", "10180", "Abilene, TX"), ("39133", "10420", "Akron <OH>")}
    assert {tuple(r) for r in sheets.county_crosswalk(spark, str(tmp_path), "List 1").collect()} == got
    with pytest.raises(ValueError, match="no row"):
        sheets.read_sheet(spark, str(tmp_path / "list.xlsx"), [["absent"]], "List 1")
    assert list(sheets.sheet_rows((tmp_path / "list.xlsx").read_bytes())) == []
    assert sheets._column("AB12") == 27


def test_results_are_kept_by_digest(spark, tmp_path):
    from panelmill.sources.materialised import forget, materialised

    source, kept, calls = str(tmp_path / "in"), str(tmp_path / "kept"), []
    spark.range(5).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source).selectExpr("sum(id) AS s")

    def value(**parameters):
        return materialised(spark, kept, "total", [source], parameters, build).first().s

    assert value(q=1) == 10 and value(q=1) == 10 and len(calls) == 1
    assert value(q=2) == 10 and len(calls) == 2
    spark.range(7).write.mode("overwrite").parquet(source)
    assert value(q=1) == 21 and len(calls) == 3
    assert not [p for p in (tmp_path / "kept" / "total").iterdir() if p.name.startswith(".") and p.is_dir()]
    forget(spark, kept, "total")
    assert value(q=1) == 21 and len(calls) == 4


def test_table_function_equals_windows(spark, sf):
    from panelmill.functions import tablefunctions
    from panelmill.operators import diagnostics as D
    from panelmill.sources import tables as T

    panel = T.shipments(spark, sf).select("unit_ix", "t_ix", "y")
    panel.createOrReplaceTempView("adf_panel")
    tablefunctions.register(spark)
    rows = spark.sql("SELECT * FROM adf_row(TABLE(SELECT unit_ix, t_ix, y FROM adf_panel) PARTITION BY unit_ix ORDER BY t_ix)").collect()
    want = {r.unit_ix: (r.t_stat, r.unit_root) for r in D.adf_statistics(panel, "y").collect()}
    assert {r.unit_ix for r in rows} >= set(want) and len(rows) == len({r.unit_ix for r in rows})
    for r in rows:
        assert abs(r.t_stat - want.get(r.unit_ix, (0.0,))[0]) < 1e-6
