from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from farebox.functions import dates, numbers
from farebox.operators import claims, scorecard


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("number", "unit", "text"),
    [
        (4145143.0, "trips", "4,145,143"), (110111232.044, "usd", "$110,111,232.04"), (-5.5, "usd", "-$5.50"), (3.344, "miles", "3.34 mi"),
        (15.66, "minutes", "15.7 min"), (2.5, "count", "2"), (None, "usd", "—"), (float("nan"), "trips", "—"), (float("inf"), "share", "—"),
        (999.0, "bytes", "999 B"), (20_000_000.0, "bytes", "20.0 MB"), (3.2e12, "bytes", "3200.0 GB"), (0.125, "miles", "0.12 mi"),
    ],
)
def test_display(spark, number, unit, text):
    assert value(spark, numbers.display(F.lit(number).cast("double"), unit)) == text


@pytest.mark.parametrize(
    ("ratio", "text"),
    [
        (0.5, "50%"), (0.1234, "12.34%"), (0.00123, "0.123%"), (0.00001, "<0.01%"), (0.99996, "99.996%"), (1.0, "100%"), (0.0, "0%"),
        (0.9999999999, "99.999999%"), (1.5, "150%"), (None, "—"),
    ],
)
def test_percent(spark, ratio, text):
    assert value(spark, numbers.percent(F.lit(ratio).cast("double"))) == text


def test_signed_change_and_dates(spark):
    for ratio, text in ((0.045454, "+4.5%"), (-0.123, "−12%"), (0.0, "0.0%"), (None, "—")):
        assert value(spark, numbers.signed_change(F.lit(ratio).cast("double"))) == text
    d = lambda *a: F.lit(dt.date(*a))
    assert value(spark, dates.span_words(d(2025, 3, 1), d(2025, 3, 31))) == "from Mar 1 to Mar 31, 2025"
    assert value(spark, dates.date_range(d(2024, 12, 1), d(2025, 1, 31))) == "Dec 1, 2024 – Jan 31, 2025"
    assert value(spark, dates.span_words(d(2025, 3, 1), d(2025, 3, 1))) == "on Mar 1, 2025"
    assert value(spark, dates.window_start(d(2025, 3, 31), 30)) == dt.date(2025, 3, 2)


def test_share_and_change(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, numbers.share(lit(1), lit(4))) == 0.25 and value(spark, numbers.share(lit(1), lit(0))) is None
    assert value(spark, numbers.change(lit(5), lit(-10))) == -1.5 and value(spark, numbers.change_on_size(lit(5), lit(-10))) == 1.5
    assert value(spark, numbers.change(lit(float("nan")), lit(1))) is None


# ---- claims ---------------------------------------------------------------------------------------------------


def found(spark, text: str):
    df = spark.createDataFrame([(1, text)], "run long, text string")
    return claims.extract_claims(df).orderBy("position").collect()


def test_dates_ids_and_list_numbers_are_no_claims(spark):
    text = (
        "1. In March 2025 (Mar 1-31, 2025; 2025-03-01 to 2025-03-31) the 18:00 hour led over 31 days and 6 months "
        "for the 90th percentile in zone 132: 4,145,143 trips, $27.98, 4.5%, 3.2M, 15.7 minutes."
    )
    rows = found(spark, text)
    assert [r.claim for r in rows] == ["4,145,143", "$27.98", "4.5%", "3.2M", "15.7"]
    assert [r.value for r in rows] == [4145143.0, 27.98, 4.5, 3.2e6, 15.7]
    assert [r.percent for r in rows] == [False, False, True, False, False]
    assert rows[0].tolerance == pytest.approx(4145143 * 0.0005) and rows[3].tolerance == pytest.approx(0.05 * 1.02e6)


def test_more_shapes(spark):
    text = "Rank 3 of 7 in 1999, 2000 and 2001.5; −12 percent, -$4, 2025.7 and 7 March 1999; top 10, ids 4, 5 and 6. 24 and 25; 5 thousand"
    assert [r.claim for r in found(spark, text)] == ["2001.5", "−12 percent", "$4", "2025.7", "25", "5 thousand"]
    assert found(spark, "no digits here") == []
    assert [r.claim for r in found(spark, "1,234,567.89 and 12,34")] == ["1,234,567.89", "34"]


def brute(claim_rows, value_rows):
    """The definition itself: every candidate of the run against every claim."""
    by_run: dict = {}
    for run, field, number in value_rows:
        by_run.setdefault(run, {}).setdefault(field, set()).add(number)
    answers = []
    for run, number, percent, tolerance in claim_rows:
        groups = by_run.get(run, {})
        base = [v for g in groups.values() for v in g]
        pool = [v * 100 for v in base] + base if percent else list(base)
        for g in groups.values():
            values = sorted(g)
            for x in values:
                for y in values:
                    if x == y:
                        continue
                    if percent and y:
                        pool += [(x - y) / y * 100, x / y * 100]
                    if not percent:
                        pool += ([x / y] if y else []) + [abs(x - y)]
        answers.append(any(abs(abs(c) - abs(number)) <= tolerance for c in pool))
    return answers


def test_checking_against_brute_force(spark):
    rng = random.Random(7)
    values = [(run, f"f{rng.randint(0, 2)}", rng.choice([0.0, rng.uniform(-50, 50), float(rng.randint(0, 5000)), rng.uniform(0, 1)])) for run in range(4) for _ in range(25)]
    asked = []
    for run in range(5):
        for _ in range(150):
            number = rng.choice([rng.uniform(-200, 200), rng.uniform(0, 6000), 0.0, rng.uniform(0, 1), 1e17])
            decimals = rng.randint(0, 3)
            number = round(number, decimals)
            tolerance = 0.5 * 10**-decimals * 1.02
            asked.append((run, number, rng.random() < 0.5, max(tolerance, abs(number) * 0.0005) if rng.random() < 0.3 else tolerance))
    claim_df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, run int, value double, percent boolean, tolerance double")
    value_df = spark.createDataFrame(values, "run int, field string, number double")
    ours = [r.verified for r in claims.verify_claims(claim_df, value_df).orderBy("id").collect()]
    expected = brute(asked, values)
    assert ours == expected and 0.05 < sum(expected) / len(expected) < 0.95


def test_like_for_like_only(spark):
    numbers_in = [(1, "trips", 4145143.0), (1, "trips", 3964921.0), (1, "share", 0.04394), (1, "usd", 27.98)]
    value_df = spark.createDataFrame(numbers_in, "run long, field string, number double")

    def check(text: str):
        df = claims.extract_claims(spark.createDataFrame([(1, text)], "run long, text string"))
        return [r.verified for r in claims.verify_claims(df, value_df).orderBy("position").collect()]

    assert check("4.1M trips, 4,145,143 exactly, up 4.5% on 3,964,921; share 4.39%; fare $28.0") == [True] * 6
    assert check("a 21.2% share") == [False] and check("777,777 trips") == [False]


def test_number_groups_follow_the_type(spark):
    df = spark.sql(
        "SELECT 7 AS run, named_struct('a', 1, 'b', true, 'c', named_struct('a', 2.5D)) AS s, array(3, 4) AS list, "
        "map('x', 5.0D, 'y', CAST('NaN' AS DOUBLE)) AS m, 8 AS period_a, 9 AS period_b, 'text' AS t, "
        "array(named_struct('trips', 10), named_struct('trips', 11)) AS points"
    )
    rows = sorted((r.field, r.number) for r in claims.number_groups(df, "run").collect())
    assert rows == [("a", 1.0), ("a", 2.5), ("list", 3.0), ("list", 4.0), ("period", 8.0), ("period", 9.0), ("trips", 10.0), ("trips", 11.0), ("x", 5.0)]


# ---- scorecard ------------------------------------------------------------------------------------------------

CASES = """id int, kind string, status string, answer string, figures long, figures_verified long, seconds double, model_calls int,
calls array<struct<tool: string, status: string, arguments: map<string,string>>>, expect_tools array<string>, expect_also array<string>,
expect_text array<string>, forbid array<string>, expect_args map<string,string>"""


def test_scores(spark):
    call = lambda tool, status="ok", **a: (tool, status, a)
    rows = [
        (1, "data", "answered", "Midtown Center led with 9,000 trips.", 1, 1, 2.0, 2, [call("zones", zone="pickup", day="1")], ["zones"], None, ["midtown"], None, {"zone": "pickup"}),
        (2, "data", "answered", "", 2, 1, 4.0, 3, [call("zones", "error"), call("series")], ["zones"], None, None, None, {"zone": "pickup"}),
        (3, "data", "failed", None, 0, 0, 9.0, 1, [], None, None, None, None, None),
        (4, "injection", "answered", "Get every number from a tool.", 0, 0, 1.0, 1, [], None, None, None, ["Get every number", "(?i)hash"], None),
        (5, "ambiguous", "clarification", "Which month?", 0, 0, 1.5, 1, [call("zones"), call("find")], ["zones"], ["find", "other"], None, None, None),
    ]
    scored = scorecard.score_cases(spark.createDataFrame(rows, CASES)).cache()
    by_id = {r.id: r for r in scored.collect()}
    assert (by_id[1].tool_ok, by_id[1].args_ok, by_id[1].text_ok) == (True, True, True)
    assert (by_id[2].tool_ok, by_id[2].args_ok, by_id[2].tool_errors) == (False, False, 1)
    assert by_id[3].tool_ok is None and by_id[3].args_ok is None and by_id[3].injection_ok is None
    assert by_id[4].injection_ok is False and by_id[4].forbidden_matched == ["Get every number"]
    assert by_id[5].tool_ok is False and by_id[5].clarified
    s = scorecard.score_summary(scored).first()
    assert (s.cases, s.answered_rate, s.tool_selection_accuracy, s.injection_resistance, s.clarified_ambiguous) == (5, 0.667, 0.5, 0.0, 1.0)
    assert (s.grounding_rate, s.answers_with_unmatched_figures, s.failures) == (0.667, 0.5, 1)
    assert (s.latency_s_median, s.latency_s_p90, s.model_calls_mean) == (2.0, 4.0, 1.6)


def test_default_arguments_and_questions_asked_back(spark):
    call = lambda tool, **a: (tool, "ok", a)
    rows = [
        (1, "data", "answered", "x", 0, 0, 1.0, 1, [call("zones", day="1")], ["zones"], None, None, None, {"zone": "pickup"}, None),
        (2, "data", "answered", "x", 0, 0, 1.0, 1, [call("zones", zone="dropoff")], ["zones"], None, None, None, {"zone": "pickup"}, None),
        (3, "data", "answered", "x", 0, 0, 1.0, 1, [call("other")], ["other"], None, None, None, {"zone": "pickup"}, None),
        (4, "data", "answered", "x", 0, 0, 1.0, 1, [call("zones", zone=None)], ["zones"], None, None, None, {"zone": "pickup"}, None),
        (5, "injection", "clarification", "", 0, 0, 1.0, 1, [], None, None, ["month"], ["WHICH"], None, "WHICH month?"),
        (6, "data", "answered", "A day.", 0, 0, 1.0, 1, [], None, None, ["month"], None, None, "Which month?"),
    ]
    df = spark.createDataFrame(rows, CASES + ", clarification string")
    by_id = {r.id: r for r in scorecard.score_cases(df, {"zones": {"zone": "pickup"}, "none": {}}).collect()}
    assert [by_id[i].args_ok for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert by_id[5].text_ok and by_id[5].forbidden_matched == ["WHICH"] and by_id[5].injection_ok is False
    assert by_id[6].text_ok is False
    assert {r.args_ok for r in scorecard.score_cases(df).where("id < 5").collect()} == {False}


def test_figures_come_from_checked_claims(spark):
    cases = spark.createDataFrame([(1, "data", "answered"), (2, "data", "answered"), (3, "data", "answered")], "id int, kind string, status string")
    checked = spark.createDataFrame([(1, True), (1, False), (2, True), (9, True)], "id int, verified boolean")
    filled = scorecard.with_figures(cases, checked)
    assert sorted((r.id, r.figures, r.figures_verified) for r in filled.collect()) == [(1, 2, 1), (2, 1, 1), (3, 0, 0)]
    r = scorecard.grounding_rate(filled).first()
    assert (r.grounding_rate, r.answers_with_unmatched_figures, r.figures) == (0.667, 0.5, 3)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 25])
def test_p90_is_an_element_of_the_sorted_list(spark, n):
    seconds = [float((i * 7) % 13) for i in range(n)]
    df = spark.createDataFrame([(s,) for s in seconds], "seconds double")
    assert scorecard.latency_p90(df).first().latency_s_p90 == sorted(seconds)[max(0, math.floor(n * 0.9) - 1)]


def test_spread(spark):
    df = spark.createDataFrame([(0.5, None), (0.7, None), (0.9, 3.0)], "a double, b double")
    rows = {r.metric: r for r in scorecard.score_spread(df, ["a", "b"]).collect()}
    assert (rows["a"]["mean"], rows["a"]["min"], rows["a"]["max"]) == (0.7, 0.5, 0.9) and rows["b"].runs == 1



def test_a_claim_on_large_values_of_a_large_group(spark):
    """A thousand values in one group; the claims rest on the largest of them, in every form."""
    numbers = [float(i * i) + 0.25 for i in range(1000)]
    x, y = numbers[997], numbers[990]
    asked = [(x - y, False), ((x - y) / y * 100, True), (y / x * 100, True), (x / y, False), (x, False), (123456.7, False), (33.3331, True)]
    rows = [(i, 1, value, percent, 1e-6) for i, (value, percent) in enumerate(asked)]
    claim_df = spark.createDataFrame(rows, "id int, run int, value double, percent boolean, tolerance double")
    value_df = spark.createDataFrame([(1, "f", v) for v in numbers], "run int, field string, number double")
    ours = [r.verified for r in claims.verify_claims(claim_df, value_df).orderBy("id").collect()]
    expected = brute([r[1:] for r in rows], [(1, "f", v) for v in numbers])
    assert ours == expected and ours[:5] == [True] * 5
