"""Values of the reference's own cases."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import normalize as N
from tallyweave.functions import similarity as S
from tests.test_functions import value


@pytest.mark.parametrize(("text", "code"), [("Žižka Łódź", "ZIZKAODZ"), ("São-Ção", "SAOCAO"), (None, None), ("", "")])
def test_compact(spark, text, code):
    # a letter with a stroke has no plain form
    assert value(spark, N.compact(F.lit(text).cast("string"))) == code


@pytest.mark.parametrize(("text", "code"), [("26_S07.CH5_1", "S07CH51"), (" 26_S07", "S07"), ("S07.CH5_1", "S07CH51")])
def test_year_before_a_code(spark, text, code):
    assert value(spark, N.normalize_code(F.lit(text))) == code


@pytest.mark.parametrize("text", ["#FIELD!", " #blocked! ", "#UNKNOWN!", "#GETTING_DATA", "#N/A"])
def test_errors_of_spreadsheets(spark, text):
    assert value(spark, N.clean_plan_value(F.lit(text))) is None


def test_other_cells_stay(spark):
    assert value(spark, N.clean_plan_value(F.lit("#N/D"))) == "#N/D"
    assert value(spark, N.clean_plan_value(F.lit("x"))) == "x" and value(spark, N.clean_plan_value(F.lit("x"), True)) is None


def test_company_words(spark):
    assert value(spark, N.client_tokens(F.lit("Acme Unipessoal SAS INC"))) == ["ACME"]


@pytest.mark.parametrize(
    ("written", "truth", "bits"),
    [("60x5", "L60X60X5", 10.0), ("L60x60x5", "HEA60", -14.0), ("", "L60X60X5", 0.0), ("60x5", None, -3.0), ("Ø42", "Ø42.4X3", 6.0), ("IPE200", "IPE200X3", 7.0), ("100x50x6", "L100X50X6.05", 4.0), ("60x5", "L60X60X8", -10.0), ("abc", "ABC", 4.0), ("abc", "xyz", -4.0)],
)
def test_profile_score(spark, written, truth, bits):
    p = lambda s: N.parse_profile(F.lit(s).cast("string"))
    assert value(spark, S.profile_score(p(written), p(truth))) == pytest.approx(bits)


@pytest.mark.parametrize(("written", "truth", "bits"), [(1000, 1001, 6.0), (1000, 1006, 6.0 - 5 / 5.03 * 2), (1000, 2000, -8.0), (1000, None, -2.0)])
def test_length_score(spark, written, truth, bits):
    assert value(spark, S.length_score(F.lit(float(written)), F.lit(truth).cast("double"))) == pytest.approx(bits)


def test_look_alikes_need_no_alignment_far_away(spark):
    for a, b, g in (("AT1T515", "AT1TS15", 1 - 2 / 12), ("AT1T515", "AT1T145", 1 - 10 / 12), ("AT1T515", "XYZ", 0.0), ("0", "O", 1 - 2 / 12)):
        assert value(spark, S.look_alike_evidence(F.lit(a), F.lit(b))) == pytest.approx(min(g, 0.85))
