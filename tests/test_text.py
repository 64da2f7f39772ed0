"""Address and name rules on hand-made cases."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from lintel.functions import text as T
from lintel.operators import geocode as G

COUNTIES = ("cork", "dublin", "galway", "carlow")


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values))))
    return df.select(column(*(F.col(f"v{i}") for i in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "shown"),
    [
        ("12 MAIN STREET, N/A, CORK.", "12 Main Street, Cork"),
        ("5B O'BRIEN'S ROW, MCCANN PARK", "5B O'Brien's Row, McCann Park"),
        ("PARISH OF ANNE STREET", "Parish of Anne Street"),
        ("6 THE SYCAMORE", "6 The Sycamore"),
        ("ST JAMES'S-ON-SEA ROAD", "St James's-on-sea Road"),
        ("already Mixed, case", "already Mixed, case"),
        ("  -  ", "-"),
        ("", ""),
    ],
)
def test_display(spark, raw, shown):
    assert one(spark, T.display, raw) == shown


@pytest.mark.parametrize(
    ("raw", "spelt"),
    [
        ("Apt1, 5 St. John's Rd", "apartment 1, 5 saint john's road"),
        ("5 Main St, Naas", "5 main street, naas"),
        ("Main St Lower, County Cork", "main street lower, co cork"),
        ("St Lower", "street lower"),
        ("No. 5 Mill Ave., Co. Dublin", "5 mill avenue, co dublin"),
        ("no", "no"),
    ],
)
def test_normalised(spark, raw, spelt):
    assert one(spark, lambda x: T.normalised(x, COUNTIES), raw) == spelt


@pytest.mark.parametrize(
    ("raw", "county", "unit", "key"),
    [
        ("Apartment 5 Block A, The Maltings, Cork", "cork", "apartment 5 block a", "themaltings"),
        ("Apt 5, Block A, The Maltings, Co Cork", "cork", "apartment 5 block a", "themaltings"),
        ("1 25 Main Road, Co. Cork", "cork", None, "1-25mainroad"),
        ("1-25 Main Road", "cork", None, "1-25mainroad"),
        ("125 Main Road Co Cork", "cork", None, "125mainroad"),
        ("Flat 2", "cork", "flat 2", ""),
        ("Dún Laoghaire", "dublin", None, "dunlaoghaire"),
    ],
)
def test_unit_and_key(spark, raw, county, unit, key):
    found = lambda x: T.expanded(x, COUNTIES)
    assert one(spark, lambda x: T.unit_of(found(x)), raw) == unit
    assert one(spark, lambda x: T.key_of(T.without_county(T.without_unit(found(x)), F.lit(county))), raw) == key


def test_codes(spark):
    assert one(spark, T.eircode, " d6w xy45 ") == "D6WXY45"
    assert one(spark, T.eircode, "B12 XY45") is None
    assert one(spark, T.district_of_eircode, "D08XY45") == "D8"
    assert one(spark, T.district_of_eircode, "D6WXY45") == "D6W"
    assert one(spark, T.district_of_eircode, "D23XY45") is None
    assert one(spark, lambda t: T.city_district(t, F.lit("dublin")), "5 navan road, dublin 6w") == "D6W"
    assert one(spark, lambda t: T.city_district(t, F.lit("dublin")), "dublin 23") is None


def test_public_id(spark):
    want = base64.b32encode(hashlib.sha256(b"cork|12mainst|").digest()).decode()[:12].lower()
    assert one(spark, lambda c, k: T.public_id(c, k, F.lit(None).cast("string")), "cork", "12mainst") == want


def test_names(spark):
    match = lambda a, b: T.names_match(T.name_tokens(a), T.name_tokens(b))
    assert one(spark, match, "St. John's Rd", "The Saint John Road")
    assert one(spark, match, "Pollerton", "Pollerton Big")
    assert not one(spark, match, "Pollerton", "Pollerton Hill")
    assert not one(spark, match, "12", "12")
    assert one(spark, T.slug, "Dún Laoghaire–Rathdown (East)") == "dun-laoghaire-rathdown-east"
    assert one(spark, T.area_name, "BALLYMUN OF THE HILL") == "Ballymun of the Hill"
    assert one(spark, T.area_name, "BallyMun") == "BallyMun"
    assert one(spark, G.name_variants, "Muinebeag (Bagenalstown)") == ["Bagenalstown", "Muinebeag", "Muinebeag (Bagenalstown)"]
    assert one(spark, G.name_variants, "Graigue-Tinnahinch") == ["Graigue", "Graigue-Tinnahinch", "Tinnahinch"]


def test_lenient_parameters(spark):
    assert one(spark, T.lenient_number, "1e6") is None and one(spark, T.lenient_number, "12.5") == 12.5
    assert one(spark, T.lenient_date, "2021-02-31") is None and str(one(spark, T.lenient_date, "2021-02-28")) == "2021-02-28"
    assert one(spark, lambda x: T.lenient_flag(x, True), "maybe") is True
    assert one(spark, T.csv_safe, "=1+1") == "'=1+1"


@pytest.mark.parametrize(
    ("address", "county", "queries"),
    [
        ("Apt 5, 12 Main St, Athenry, Co. Galway", "galway", ["12 Main St, Athenry", "Athenry"]),
        ("5 Abbey Glen, Athenry, Galway", "galway", ["5 Abbey Glen, Athenry, Galway", "5 Abbey Glen, Athenry", "Athenry, Galway", "Athenry"]),
        ("Off Navan Road, Kildare Town, Dublin 7", "dublin", ["Navan Road, Kildare, Dublin", "Navan Road, Kildare", "Kildare, Dublin", "Kildare"]),
    ],
)
def test_ladder(spark, address, county, queries):
    steps = one(spark, lambda a, c: F.transform(G.ladder(G.query_parts(a, c), c), lambda s: s["query"]), address, county)
    assert steps == queries
