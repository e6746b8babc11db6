"""Codes of areas beside house numbers of the same form, with answers by hand."""

from dealloom.operators import venue as V


def test_house_numbers_are_no_codes(spark):
    rows = [("80123 Market Street, Denver, CO 80202. ",), ("80999 Elm Way. ",), ("Denver, CO 80205 and 80210",), ("at 80 Elm Way, 80211",), (None,)]
    got = [(r.street_address, r.zip_code) for r in V.profiled(spark.createDataFrame(rows, "text string")).collect()]
    assert got == [("80123 Market Street", "80202"), ("80999 Elm Way", None), (None, "80205"), ("80 Elm Way", "80211"), (None, None)]
