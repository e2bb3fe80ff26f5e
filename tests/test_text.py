import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import fuzzy, normalize as N


def _names(spark, *raw):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    return {r.i: r for r in N.with_name(rows, "raw").collect()}


def test_names(spark):
    got = _names(
        spark, "ACME Private Limited", "Acme Pvt-Ltd", "ACME PVT. LTD.", "Léarning Labs", "Smt Rao [Services] (ID: 13882)", "www.shyamconsulting.com", "M/s Alpha",
        "Hrs Investments Investments Pvt (Ltd)", "8eth Synagouge", "Boulangerie S.A.R.L.", "The Company Limited", None, "Tom & Co | branch", "1st Street Deli 25015",
    )
    assert {got[i].core for i in range(3)} == {"acme"} and {got[i].legal for i in range(3)} == {"ltd pvt"}
    assert got[3].core == "learning labs"
    assert got[4].core == "rao"
    assert (got[5].web, got[5].cc) == (1, "shyamconsulting")
    assert got[6].core == "alpha"
    assert got[7].nm == "hrs investments pvt ltd"
    assert got[8].core == "beth synagouge"
    assert (got[9].core, got[9].legal) == ("boulangerie", "sarl")
    assert (got[10].core, got[10].legal) == ("company limited", "co ltd")
    assert (got[11].nm, got[11].core, got[11].cc) == ("", "", "")
    assert got[12].nm == "tom and co"
    assert got[13].nm == "1st street deli"


def test_addresses(spark):
    raw = ["1577/15, Eksar Road, Mumbai, Maharashtra", "N° 52 Rue X", "0042 Main St", "G-904", "12 Elm Avenue, New York", "", None, "Terrace Sainte Delaware Louisiana", "00 Zero"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = {r.i: r for r in N.with_address(rows, "raw").collect()}
    assert (got[0].nums, got[0].hn, got[0].hmain, got[0].ad) == ("1577 15", "1577-15", "1577", "eksar rd mumbai mh")
    assert (got[1].nums, got[1].ad) == ("52", "rue x")
    assert (got[2].hmain, got[2].adf) == ("42", "0042 main st")
    assert (got[3].hn, got[3].adf) == ("904", "g-904")
    assert got[4].ad == "elm ave ny"
    assert got[5].ad == got[6].ad == got[5].hn == ""
    assert got[7].ad == ""
    assert got[8].nums == "0"


def test_units_and_suffixes(spark):
    rows = spark.createDataFrame([(0, "17 BIS RUE X"), (1, "17 RUE X"), (2, "SHOP G-4"), (3, "Unit No. 007"), (4, None), (5, "21 a Main")], "i int, raw string")
    got = {r.i: r for r in N.with_units(rows, "raw").collect()}
    assert [got[i].hsuf for i in (0, 1, 5)] == ["b", "", "a"]
    assert "g4" in got[2].units and got[3].units == ["7"] and got[4].units == []


def test_translate(spark):
    assert N.transliterate("राम") == "raama" and N.transliterate("") == ""
    rows = spark.createDataFrame([("राम स्टोर X",), ("plain name",), (None,)], "s string")
    words = F.create_map(F.lit("स्टोर"), F.lit("store"))
    got = [r[0] for r in rows.select(N.translate_name(F.col("s"), words)).collect()]
    assert got == ["raama store X", "plain name", ""]
    segments = F.create_map(F.lit("महाराष्ट्र"), F.lit("maharashtra"))
    rows = spark.createDataFrame([("12 Road, महाराष्ट्र",), ("a,b",)], "s string")
    assert [r[0] for r in rows.select(N.translate_address(F.col("s"), segments)).collect()] == ["12 Road, maharashtra", "a, b"]


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_scores():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randrange(9))) for _ in range(2))
        assert fuzzy.lcs(a, b) == _lcs(a, b)
        for f in fuzzy.SCORERS.values():
            assert f(a, b) == pytest.approx(f(b, a)) and f(a, b) >= 0
        assert fuzzy.ratio(a, a) == 100 and fuzzy.jaro_winkler(a, a) == 1 and fuzzy.levenshtein(a, a) == 0
        n, m = sorted((a, b), key=len)
        windows = {(x, y[max(0, e - len(x)) : min(e, len(y))]) for x, y in ((n, m), (m, n)) if len(x) <= len(y) for e in range(1, len(y) + len(x))}
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max((fuzzy.ratio(*w) for w in windows), default=100.0) if n else (100.0 if not m else 0.0))
    assert fuzzy.token_set_ratio("new york mets", "mets new york new") == 100
    assert fuzzy.token_set_ratio("", "x") == 0 and fuzzy.ratio("", "") == 100
    assert fuzzy.token_sort_ratio("b a", "a b") == 100
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_scorer_column(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("ab", None), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(fuzzy.scorer("ratio")(F.col("a"), F.col("b"))).collect()] == [100.0, None, 100.0]
