from pyspark.sql import functions as F

from cellwright.functions import numeric as N
from cellwright.functions import recode as R
from cellwright.functions import rules
from cellwright.rules import regions
from cellwright.sources.fixed_width import Field


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema).withColumn("_at", F.monotonically_increasing_id())
    return [tuple(r)[1:] for r in sorted(df.select("_at", *[c.alias(n) for n, c in columns.items()]).collect())]


def test_codes_compare_as_text(spark):
    mapping = {"0": "zero", "-": "dash"}
    got = values(spark, [("0",), ("00",), ("-",), (None,)], "c string", v=R.map_codes(F.col("c"), mapping))
    assert got == [("zero",), (None,), ("dash",), (None,)]
    kept = values(spark, [("0",), ("x",), (None,)], "c string", v=R.map_codes(F.col("c"), mapping, keep_unmatched=True))
    assert kept == [("zero",), ("x",), (None,)]


def test_first_rule_wins_and_shadowed_codes_are_reported():
    mapping, shadowed = R.groups_to_mapping([(11, ["C", "I"]), (12, ["D", "I"])])
    assert mapping["I"] == 11 and shadowed == ["I"]
    rows, hidden = rules.region_rows(regions.REGIONS)
    assert (6, 970, "Sonoma, CA") in hidden
    assert (6, 970, "North Coast CA") in rows


def test_bins_are_left_closed_with_a_clipped_last_label(spark):
    years = [(1859,), (1860,), (1862,), (1863,), (1940,), (1941,), (1942,), (1943,), (1944,), (None,)]
    got = [v for (v,) in values(spark, years, "y int", v=R.equal_width_bin(F.col("y")))]
    assert got == [None, "1860-1862", "1860-1862", "1863-1865", "1938-1940", "1941-1942", "1941-1942", "1941-1942", None, None]


def test_two_digit_years(spark):
    codes = [("00",), ("42",), ("43",), ("99",), ("&&",), ("0-",), (None,)]
    got = [v for (v,) in values(spark, codes, "c string", v=R.two_digit_year(F.col("c")))]
    assert got == [1900, 1942, 1843, 1899, None, None, None]
    bounded = [v for (v,) in values(spark, [("05",), ("-1",), ("100",)], "c string", v=R.bounded_two_digit_year(F.col("c")))]
    assert bounded == [1905, None, None]


def test_halves_round_to_even(spark):
    got = [v for (v,) in values(spark, [(1904, 1905), (1905, 1906), (1900, None)], "a int, b int", v=N.mid_year(F.col("a"), F.col("b")))]
    assert got == [1904, 1906, None]


def test_division_by_zero_is_missing(spark):
    rows = [(0.0, 0.0), (1.0, 0.0), (1.0, 4.0), (None, 1.0)]
    assert [v for (v,) in values(spark, rows, "a double, b double", v=N.ratio(F.col("a"), F.col("b")))] == [None, None, 0.25, None]


def test_membership_is_never_missing(spark):
    got = [v for (v,) in values(spark, [(1,), (9,), (None,)], "a int", v=~N.member(F.col("a"), [1, 2]))]
    assert got == [False, True, True]


def test_a_move_looks_at_the_whole_key(spark):
    rows = [(6, 10, 53, 10), (6, 10, 6, 10), (6, 10, None, 10), (6, 10, None, 20)]
    both = N.changed([(F.col("s0"), F.col("s1")), (F.col("c0"), F.col("c1"))])
    county = N.changed([(F.col("c0"), F.col("c1"))])
    got = values(spark, rows, "s0 int, c0 int, s1 int, c1 int", both=both, county=county)
    assert got == [(1, 0), (0, 0), (None, 0), (1, 1)]


def test_sentinels_become_missing_by_column(spark):
    df = spark.createDataFrame([(999998.0, 99999.0, 9996), (500.0, 99997.0, 1900), (None, None, None)], "INCWAGE double, INCOTHER double, BIRTHYR int")
    from cellwright.rules.census import SENTINELS

    got = [tuple(r) for r in R.blank_sentinels(df, SENTINELS).collect()]
    assert got == [(None, None, None), (500.0, 99997.0, 1900), (None, None, None)]


def test_regions_and_zone(spark):
    rows = [(6, 970), (6, 9999), (4, 10), (4, 30), (41, 10), (41, 50), (53, 390), (53, 630), (36, 610), (None, 5)]
    df = spark.createDataFrame(rows, "STATEFIP int, COUNTYICP int")
    out = rules.assign_region(df)
    out = out.withColumn("zone", rules.zone_flag(F.col("STATEFIP"), F.col("region")))
    got = {(r[0], r[1]): (r["region"], r["zone"]) for r in out.collect()}
    assert got[(6, 970)] == ("North Coast CA", 1)
    assert got[(6, 9999)] == (None, 1)
    assert got[(4, 10)] == ("Northern AZ", 0) and got[(4, 30)] == ("Southern AZ", 1)
    assert got[(41, 10)] == ("Eastern Oregon", 0) and got[(41, 50)] == ("Clackamas, OR", 1)
    assert got[(53, 390)] == ("Skamania-Klikatat, WA", 1) and got[(53, 630)] == ("Spokane, WA", 0)
    assert got[(36, 610)] == ("36", 0) and got[(None, 5)] == (None, 0)
    assert out.count() == len(rows)


def test_census_groups(spark):
    got = values(spark, [(6,), (1,), (501,), (15,), (None,), (2,)], "b int", g=rules.birthplace_group_number(F.col("b")))
    assert [g for (g,) in got] == [1, 2, 3, 4, 4, 4]
    occupations = values(spark, [(0,), (100,), (101,), (123,), (290,), (970,), (979,)], "o int", g=rules.occupation_group(F.col("o")))
    assert [g for (g,) in occupations] == [
        "Professional, Technical", "Farmers (owners and tenants)", None, "Farmer managers", "administration, management", "Laborers", None,
    ]
    cohorts = values(spark, [(1942,), (1928,), (1850,), (1950,)], "y int", c=rules.age_cohort(F.col("y")))
    assert [c for (c,) in cohorts] == ["0-13", "14-19", "60+", None]
    countries = values(spark, [(6,), (501,), (150,), (None,)], "b int", c=rules.birth_country_of_code(F.col("b")))
    assert [c for (c,) in countries] == ["USA", "Japan", "Other", "Other"]
    groups = values(
        spark,
        [("Chinese", None), ("Japanese", 0.0), ("Japanese", 0.9), ("Japanese", 0.4), ("Japanese", None)],
        "r string, p double",
        g=rules.exposure_group(F.col("r"), F.col("p")),
    )
    assert [g for (g,) in groups] == ["Chinese", "Unexposed", "Exposed", "(Dropped)", None]


def test_field_is_a_plain_record():
    assert Field("a", 1, 2) == ("a", 1, 2, 0, "string")
