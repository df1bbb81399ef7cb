import pytest
from pyspark.sql import functions as F

from cellwright.plans import panel, register
from cellwright.rules import register as codes
from cellwright.sources.tables import read_dictionary, settle_dictionary


def card(**fields):
    return "".join(str(fields.get(name, "")).ljust(width)[:width] for name, width in codes.CARD_WIDTHS)


CARDS = [
    card(last_name="ALPHA", first_name="A", ind_number="00001", file_no="1", camp="2", assembly="-", prev_address="11112",
         brth_cntry_pnts="1", school_jap="A", high_educ="K", arrival_us="05", sex_marrge="7", race_raw="4", birth_yr="00",
         birthplace="90", educ="I", qual_occ_1="0-1", qual_occ_2="001"),
    card(last_name="ALPHA", first_name="A", ind_number="00001", file_no="1", camp="9"),
    card(last_name="BE\\TA", first_name="B", ind_number="00002"),
    card(last_name="", first_name="C", ind_number="00003"),
    card(last_name="DELTA", first_name="D", ind_number=""),
    card(last_name="EPSILON", first_name="E", ind_number="00004", camp="R", assembly="0", prev_address="99999",
         brth_cntry_pnts="2", school_jap="&", arrival_us="--", sex_marrge="-", race_raw="", birth_yr="43", birthplace="13", educ="C"),
    card(last_name="ZETA", first_name="Z", ind_number="00005", birth_yr="&&", birthplace="5-", sex_marrge="A", race_raw="1", brth_cntry_pnts="W"),
    card(last_name="ETA", first_name="H", ind_number="00006", birth_yr="42", birthplace="82", sex_marrge="9", race_raw="2", arrival_us="99"),
    card(last_name="THETA", first_name="T", ind_number="00007", birth_yr="99", birthplace="00", brth_cntry_pnts="5", race_raw="4"),
]


@pytest.fixture(scope="module")
def compiled(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cards") / "cards.txt"
    path.write_text("\n".join(CARDS) + "\n")
    adr = path.parent / "adr.csv"
    adr.write_text(
        "prev_address,state,county,city,NHGISST,NHGISCTY,ICPSRFIP,STATEFIP,COUNTYICP\n"
        "11112,Washington,Clallam,Port Angeles,530,0090,53009,53,90\n11110,Washington,Clallam,NA,530,0090,53009.5,53,90\n"
    )
    occ = path.parent / "occ.csv"
    occ.write_text("code,value,label\n0-1,1001,Art\n001,0,Accounts\n0-1,9,hidden\n")
    occupations, hidden = settle_dictionary(read_dictionary(spark, str(occ)))
    assert [r["value"] for r in hidden.collect()] == [9]
    lines = register.read_card_lines(spark, str(path))
    whole = register.drop_duplicate_cards(register.cut_cards(lines))
    late = register.cut_cards(register.drop_duplicate_lines(lines))
    assert sorted(map(str, whole.collect())) == sorted(map(str, late.select(*whole.columns).collect()))
    out = register.compile_register(lines, register.read_addresses(spark, str(adr)), occupations)
    return {r["ind_number"]: r for r in out.collect()}, out


def test_layout_is_80_wide():
    assert sum(width for _, width in codes.CARD_WIDTHS) == 80 and all(len(c) == 80 for c in CARDS)
    layout = {f.name: (f.start, f.end) for f in register.CARD_LAYOUT}
    assert layout["ind_number"] == (39, 44) and layout["file_no_2"] == (76, 80) and layout["qual_occ_1"] == (55, 57)


def test_rows_kept(compiled):
    rows, out = compiled
    assert sorted(rows) == ["00001", "00004", "00005", "00006", "00007"]
    assert out.columns == codes.REGISTER_COLUMNS


def test_first_card(compiled):
    r = compiled[0]["00001"]
    assert (r["camp"], r["assembly"], r["SEX"], r["RACE"], r["BIRTHYR"], r["YRIMMIG"]) == ("Poston", "Sacramento", 2, 5, 1900, 1905)
    assert (r["BPL"], r["birthplace"], r["bpl_pop"], r["bpl_mom"], r["NATIVITY"], r["generation"]) == (501, "Japan, Unspecified", 501, 501, 5, "Issei")
    assert (r["DEGFIELD"], r["high_deg"], r["EDUC"], r["school_jap"]) == (11, "masters", 11, 10)
    assert (r["bpl_grp"], r["byr_grp"]) == ("Japan", "1899-1901")
    assert (r["state"], r["city"], r["NHGISCTY"], r["STATEFIP"], r["COUNTYICP"]) == ("Washington", "Port Angeles", "0090", 53, 90)
    assert (r["qual_occ_1"], r["qual_occ_2"]) == (1001, 0)


def test_other_cards(compiled):
    rows, _ = compiled
    e = rows["00004"]
    assert (e["camp"], e["SEX"], e["RACE"], e["BIRTHYR"], e["BPL"], e["YRIMMIG"], e["school_jap"]) == ("miscoded", 2, None, 1843, 6, None, None)
    assert e["NATIVITY"] == 3 and e["generation"] is None and e["state"] is None and e["bpl_grp"] == "West Coast (AZ, CA, OR, WA)"
    z = rows["00005"]
    assert (z["SEX"], z["BIRTHYR"], z["BPL"], z["birthplace"], z["RACE"], z["byr_grp"]) == (None, None, 51, "Virginia", 0, None)
    h = rows["00006"]
    assert (h["RACE"], h["BIRTHYR"], h["BPL"], h["YRIMMIG"], h["NATIVITY"], h["generation"]) == (5, 1942, 150, 1899, 5, "Issei")
    t = rows["00007"]
    assert (t["BPL"], t["NATIVITY"], t["generation"], t["BIRTHYR"], t["byr_grp"]) == (99, 1, "Sansei", 1899, "1899-1901")


def test_marital_status_follows_the_codebook(spark):
    cards = register.cut_cards(spark.createDataFrame([(i, card(sex_marrge=c)) for i, c in enumerate("0129-&7")], "card_order long, value string"))
    got = [r["marst"] for r in sorted(register.label_cards(cards).select("card_order", "marst").collect())]
    assert got == [None, 1, 2, 4, 5, None, 2]


def test_cells_from_both_sources(compiled, spark):
    from cellwright.operators.cells import cell_propensity
    from cellwright.rules.census import CELL_KEYS

    _, out = compiled
    people = spark.createDataFrame(
        [(1940, 53, 90, 5, 2, 1900, 501)] * 4 + [(1950, 53, 90, 5, 2, 1900, 501), (1940, None, None, 5, None, None, None)],
        "YEAR int, " + ", ".join(f"{k} int" for k in CELL_KEYS),
    )
    cells = cell_propensity(register.register_cells(out), register.census_cells(people), CELL_KEYS)
    found = cells.where((F.col("STATEFIP") == 53) & (F.col("BIRTHYR") == 1900)).first()
    assert (found["n_treated"], found["n_population"], found["prop"]) == (1, 4, 0.25)


def test_panel_from_long_rows_to_sample(spark):
    columns = "HIK string, YEAR int, STATEFIP int, COUNTYICP int, RACE int, SEX int, BIRTHYR int, BPL int, INCWAGE double, OCC1950 int, EMPSTAT int, CLASSWKR int, EDUCD int"
    rows = [
        ("a", 1940, 6, 10, 5, 1, 1904, 501, 100.0, 100, 1, 1, 60), ("a", 1950, 53, 10, 5, 1, 1905, 501, 150.0, 100, 1, 2, 60),
        ("b", 1940, 6, 10, 4, 2, 1910, 6, 0.0, 700, 3, 0, 30), ("b", 1950, 6, 10, 4, 2, 1910, 6, 50.0, 710, 1, 2, 30),
        ("c", 1940, 6, 30, 5, 1, 1900, 6, None, 500, 1, 2, 30), ("c", 1950, 6, 30, 5, 1, 1900, 6, 90.0, 500, 1, 2, 30),
        ("d", 1940, 6, 30, 5, 1, 1900, 6, 70.0, 500, 1, 2, 30),
        ("e", 1940, 6, 30, 5, 1, 1930, 6, 70.0, 500, 1, 2, 30), ("e", 1950, 6, 30, 5, 1, 1930, 6, 70.0, 500, 1, 2, 30),
        ("f", 1940, None, 30, 5, 1, 1900, 6, 70.0, 500, 1, 2, 30), ("f", 1950, 6, 30, 1, 1, 1900, 6, 70.0, 500, 1, 2, 30),
    ]
    people = spark.createDataFrame(rows, columns)
    wide = panel.clean_wide(panel.collect_panel(people))
    by = {r["HIK"]: r for r in wide.collect()}
    assert sorted(by) == ["a", "b", "c", "d", "f"]
    assert (by["a"]["birthyr_adj"], by["a"]["migrate10"], by["a"]["sex_adj"], by["a"]["race_adj"], by["a"]["same_occ"]) == (1904, 1, "Male", "Japanese", 1)
    assert by["a"]["earning_growth"] == 0.5 and by["b"]["earning_growth"] is None and by["b"]["migrate10"] == 0
    county_only = {r["HIK"]: r["migrate10"] for r in panel.clean_wide(panel.collect_panel(people), ("COUNTYICP",)).collect()}
    assert county_only["a"] == 0
    only = panel.collect_panel(people, people.where("YEAR = 1940 AND RACE IN (4)").select("HIK"))
    assert [r["HIK"] for r in only.collect()] == ["b"]

    cells = spark.createDataFrame([(6, 10, 5, 1, 1903, 501, 3, 4), (6, 10, 4, 2, 1910, 6, 0, 5)], "STATEFIP int, COUNTYICP int, RACE int, SEX int, BIRTHYR int, BPL int, n_treated int, n_population int")
    exposed = panel.attach_propensities(wide, cells)
    got = {r["HIK"]: r for r in exposed.collect()}
    assert got["a"]["int_prob"] == 0.75 and got["a"]["county_intprop"] == 3 / 9 and got["b"]["int_prob"] == 0.0 and got["c"]["int_prob"] is None
    long = panel.clean_long(exposed)
    assert long.count() == 2 * wide.count()
    a = {r["YEAR"]: r for r in long.where("HIK = 'a'").collect()}
    assert (a[1940]["selfemp"], a[1950]["wagewrk"], a[1940]["employed"], a[1950]["age_adj"]) == (1, 1, 1, 46)
    assert a[1940]["occ_grp"] == "Farmers (owners and tenants)"
    sample = panel.estimation_sample(long)
    assert sorted(r["HIK"] for r in sample.collect()) == ["a", "b"]
    assert {"INCWAGE_1940", "INCWAGE_1950", "int_prob", "age_adj_1950"} <= set(sample.columns)
