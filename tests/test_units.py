"""Quantities: the parsers, and the model against brute force."""

from __future__ import annotations

import itertools
from datetime import datetime

import numpy as np
import pytest

from quern.operators import units as U


@pytest.mark.parametrize(
    ("line", "amount"),
    [
        ("2 x 180 G tins of dried apricots", (360, "g")), ("corn – g: 150", (150, "g")), ("rhubarb [in oz.] 3", (85, "g")), ("cardamom, ⅓ (teaspoon)", (2, "ml")),
        ("500-525 grams semolina", (500, "g")), ("one and a half cups of malt vinegar", (360, "ml")), ("half a pound of pear", (227, "g")), ("a cup of cold water", (240, "ml")),
        ("0,5 kilograms (17.6 oz) caster sugar", (500, "g")), ("6 fl. oz honey", (180, "ml")), ("150 to 170 millilitres dark ale", (150, "ml")), ("leek – pounds: three", (1361, "g")),
        ("1 1/2 kilograms of cod", (1500, "g")), ("4½oz rice", (128, "g")), ("buttermilk 1.25l", (1250, "ml")), ("2 lemons", None), ("5 cloves of garlic", None), ("a pinch of salt", None),
        ("To finish:", None), ("butter", None), ("", None), (None, None), ("1/0 g", (0, "g")),
    ],
)
def test_amounts(line, amount):
    assert U.parse_amount(line) == amount


@pytest.mark.parametrize(
    ("text", "got"),
    [
        ("1 hr 40 min", (100, True)), ("1h45", (105, True)), ("PT1H30M", (90, True)), ("PT1800S", (30, True)), ("0:05 h", (5, True)), ("about 4 hours", (240, True)), ("an hour and a half", (90, True)),
        ("half an hour", (30, True)), ("three quarters of an hour", (45, True)), ("2½ hours", (150, True)), ("3,5 Std.", (210, True)), ("2 days", (2880, True)), ("25'", (25, True)), ("35", (35, False)), ("2.5", (2.5, False)),
        ("10-20 min", (10, True)), ("1 hours and 15 minutes", (75, True)), ("12600 s", (210, True)), ("overnight", None), ("-", None), ("", None), (None, None), ("varies", None),
    ],
)
def test_durations(text, got):
    assert U.parse_duration(text) == got


def test_hints_need_a_unit_without_number():
    assert U.hints("Nice. Times given as hours.") == [0, 0, 8, 0]
    assert U.hints("All times are in minutes") == [0, 8, 0, 0]
    assert U.hints("Bake for 30 minutes; updated 3 days ago") == [0, 0, 0, 0]
    assert U.hints(None) == [0, 0, 0, 0]


def test_the_tree_gives_the_best_path():
    rng = np.random.default_rng(1)
    k = len(U.STATES)
    for n in (1, 2, 3, 5, 6):
        m = rng.integers(0, 1000, size=(n, k, k))
        levels = U.levels_of(m)
        exit_ = int(levels[-1][0][0].argmax())
        before, after = U.unfold(levels, 0, exit_)
        assert list(before[1:]) == list(after[:-1]) and before[0] == 0

        def total(p, m=m):
            return sum(int(m[i, a, b]) for i, (a, b) in enumerate(itertools.pairwise((0, *p))))

        assert total(after) == max(total(p) for p in itertools.product(range(k), repeat=n))


def test_a_step_weighs_the_jump_the_switch_and_the_hint():
    chain = U.Chain(rho=1.0 - 1e-9, variance=0.25, switch=0.2)
    got = U.steps(np.array([2.0]), np.array([False]), np.array([[0.0, 0.0, 3.0, 0.0]]), np.array([90.0]), np.array([False]), np.array([0]), chain)[0] / U.FIXED
    for a, (_, f) in enumerate(U.STATES):
        for b, (_, g) in enumerate(U.STATES):
            want = -0.5 * (np.log(2 * g / (90 * f)) / 0.5) ** 2 + np.log(0.2 / 4 + 0.8 * (a == b)) + 3.0 * (b == 2)
            assert got[a, b] == pytest.approx(want, abs=1e-4)


SCHEMA = "url string, title string, ingredients array<string>, prep_time string, description string, crawled_at timestamp_ntz"


def rows_of(df):
    return {(r["field"], r["url"], r["item_no"]): (r["amount"], r["unit"]) for r in df.collect()}


def test_bare_numbers_follow_hint_then_level_and_neighbours(spark):
    day = lambda k: datetime(2022, 1, k)
    rows = [("https://a.example/1", "x", None, "1 hr", None, day(1)), ("https://a.example/2", "x", None, "90 min", None, day(2)), ("https://a.example/3", "x", None, "2.5", "Prep is counted in hours.", day(3))]
    rows += [("https://a.example/4", "x", None, "1.5", None, day(4)), ("https://a.example/5", "x", None, "45", "(time in min) Good.", day(5)), ("https://a.example/6", "x", None, "50", None, day(6))]
    got = rows_of(U.convert_quantities(spark.createDataFrame(rows, SCHEMA)))
    assert [got["prep_time", f"https://a.example/{k}", -1] for k in range(1, 7)] == [(x, "min") for x in (60, 90, 150, 90, 45, 50)]


ROWS = "device string, k int, value double, stated boolean, hint array<double>"


def devices(n: int) -> list[tuple]:
    """A device with two thirds of the rows, one without device, and small ones; one row in seven is stated."""
    rng = np.random.default_rng(2)
    names = ["hot", "hot", "hot", "hot", None, "few"]
    return [(names[int(rng.integers(6))], int(rng.integers(n // 2)), float(np.exp(rng.normal(4, 1.2))) / (1.0, 60.0)[int(rng.integers(2))], bool(k % 7 == 0), [0.0] * 4) for k in range(n)]


def test_blocks_partitions_and_the_tree_do_not_show(spark, monkeypatch):
    df = spark.createDataFrame(devices(2500), ROWS)
    parts, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for block, n, fan in ((4096, 1, 4096), (64, 1, 2), (64, 4, 2), (500, 4, 4096), (500, 16, 3), (4096, 16, 2)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            monkeypatch.setattr(U, "FAN", fan)
            got = U.decode_units(df.repartition(3), "device", ["k"], block).select("device", "k", "value", "stated", "unit_state", "minutes").collect()
            found.append(sorted(map(str, got)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(found[0]) == 2500 and all(f == found[0] for f in found)


@pytest.mark.parametrize("level", [5.0, 30.0, 600.0])
def test_switches_are_read_from_jumps(spark, level):
    """A device of bare numbers that goes to another unit every 40 rows; one value in fifty is stated."""
    rng = np.random.default_rng(3)
    minutes = level * np.exp(np.cumsum(rng.normal(0, 0.05, 400)))
    unit = [U.STATES[1 + k // 40 % 2][1] for k in range(400)]
    rows = [("d", k, float(m if k % 50 == 0 else m / u), k % 50 == 0, [0.0] * 4) for k, (m, u) in enumerate(zip(minutes, unit))]
    got = {r["k"]: r["minutes"] for r in U.decode_units(spark.createDataFrame(rows, ROWS), "device", ["k"]).collect()}
    assert sum(got[k] == pytest.approx(minutes[k]) for k in range(400)) >= 396


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert U.convert_quantities(empty).count() == 0
    long = "x " * 50_000 + "30 min"
    rows = [(None, "t", ["1 kg a"], "1 h", None, None), ("u", None, None, None, None, None), ("v", "t", [], "", "", None), ("w", "t", [None, "", "1 kg a", "1 kg a"], long, None, None), ("w", "t", [None, "", "1 kg a", "1 kg a"], long, None, None)]
    got = rows_of(U.convert_quantities(spark.createDataFrame(rows, SCHEMA).withColumn("amount", U.F.lit("clash")).withColumn("device", U.F.lit(1))))
    assert got == {("ingredients", "w", 2): (1000, "g"), ("ingredients", "w", 3): (1000, "g"), ("prep_time", "w", -1): (30, "min")}
