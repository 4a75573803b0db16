"""Fixed domain values and the CASE-style labels built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the application's domain for equal results)
# ---------------------------------------------------------------------------
PRODUCTS = ["CardioMax", "DiabeCure", "NeuroCalm"]
PRODUCT_PRICE = {"CardioMax": 850, "DiabeCure": 620, "NeuroCalm": 1100}
POTENTIAL_LEVELS = ["High", "Medium", "Low"]
SCORE_WEIGHTS = {"High": 3, "Medium": 1.5, "Low": 0.5}          # efficiency score per call
POTENTIAL_MULTIPLIER = {"High": 1.5, "Medium": 1.0, "Low": 0.4}  # prescribing multiplier
POTENTIAL_PROBABILITIES = {"High": 0.2, "Medium": 0.5, "Low": 0.3}
AFFINITY = {                                                     # product x specialty
    ("CardioMax", "Cardiologist"): 0.80,
    ("CardioMax", "Internist"): 0.40,
    ("CardioMax", "General Physician"): 0.25,
    ("DiabeCure", "Diabetologist"): 0.85,
    ("DiabeCure", "General Physician"): 0.35,
    ("DiabeCure", "Internist"): 0.30,
    ("NeuroCalm", "Neurologist"): 0.80,
    ("NeuroCalm", "General Physician"): 0.20,
}
AFFINITY_DEFAULT = 0.15
FREQ_BOOST_PER_VISIT, FREQ_BOOST_CAP, PROBABILITY_CAP, PROBABILITY_SCALE = 0.10, 0.30, 0.95, 0.8
REP_STYLE_WEIGHTS = [                                            # by rep index mod 3
    {"High": 5, "Medium": 2, "Low": 1},                          # efficient
    {"High": 3, "Medium": 2, "Low": 2},                          # average
    {"High": 1, "Medium": 2, "Low": 4},                          # inefficient
]
SEGMENT_LABELS = {
    ("high", "high"): "🟢 High Value - Well Covered",
    ("high", "low"): "🔵 High Value - Under-visited",
    ("low", "high"): "🔴 Low Value - Over-visited",
    ("low", "low"): "🟡 Low Value - Low Coverage",
}
SEGMENT_ACTIONS = {
    "High Value - Well Covered": "Maintain coverage",
    "High Value - Under-visited": "Increase visit priority",
    "Low Value - Over-visited": "Reduce, redirect calls",
    "Low Value - Low Coverage": "Monitor only",
}
COVERAGE_FLAGS = ["Under-called High Value", "Over-called Low Value", "Well Covered",
                  "Standard Coverage"]
COVERAGE_LIMITS = {"High": 8, "Low": 6, "Medium": 6}  # High < 8, Low > 6, Medium >= 6 visits
ROI_FLAGS = ["ZERO RETURN", "Some Return"]
SCORE_BANDS = {"Green": 1.8, "Yellow": 1.4}           # Green >= 1.8, Yellow 1.4 to 1.8, else Red
# ---------------------------------------------------------------------------

# Integer forms of the fixed values, for exact arithmetic on any engine.
SCORE_WEIGHTS_X2 = {k: int(round(2 * v)) for k, v in SCORE_WEIGHTS.items()}          # 6, 3, 1
POTENTIAL_MULTIPLIER_X10 = {k: int(round(10 * v)) for k, v in POTENTIAL_MULTIPLIER.items()}
POTENTIAL_CUMULATIVE_X10 = []  # (level, cumulative probability in tenths)
_acc = 0.0
for _level in POTENTIAL_LEVELS:
    _acc += POTENTIAL_PROBABILITIES[_level]
    POTENTIAL_CUMULATIVE_X10.append((_level, int(round(10 * _acc))))
AFFINITY_BP = {k: int(round(10000 * v)) for k, v in AFFINITY.items()}
AFFINITY_DEFAULT_BP = int(round(10000 * AFFINITY_DEFAULT))
SCORE_BANDS_X100 = {k: int(round(100 * v)) for k, v in SCORE_BANDS.items()}


def product_of_mod3(expr: str) -> Column:
    """Product named by ``expr % 3``: 0 CardioMax, 1 DiabeCure, 2 NeuroCalm."""
    return F.expr(f"CASE ({expr}) % 3 WHEN 0 THEN 'CardioMax' WHEN 1 THEN 'DiabeCure' "
                  f"ELSE 'NeuroCalm' END")


def price_of(product: str = "product") -> Column:
    e = F.lit(None).cast("int")
    for name, price in reversed(list(PRODUCT_PRICE.items())):
        e = F.when(F.col(product) == name, F.lit(price)).otherwise(e)
    return e


def coverage_flag(potential: Column, visits: Column) -> Column:
    lim = COVERAGE_LIMITS
    return (F.when((potential == "High") & (visits < lim["High"]), F.lit(COVERAGE_FLAGS[0]))
            .when((potential == "Low") & (visits > lim["Low"]), F.lit(COVERAGE_FLAGS[1]))
            .when((potential == "Medium") & (visits >= lim["Medium"]), F.lit(COVERAGE_FLAGS[2]))
            .otherwise(F.lit(COVERAGE_FLAGS[3])))


def roi_flag(revenue: Column) -> Column:
    return F.when(revenue == 0, F.lit(ROI_FLAGS[0])).otherwise(F.lit(ROI_FLAGS[1]))


def score_band(score_x100: Column) -> Column:
    """Band of an efficiency score given as an exact integer x 100."""
    return (F.when(score_x100 >= SCORE_BANDS_X100["Green"], F.lit("Green"))
            .when(score_x100 >= SCORE_BANDS_X100["Yellow"], F.lit("Yellow"))
            .otherwise(F.lit("Red")))


def segment_label(rev_high: Column, visits_high: Column) -> Column:
    """4-way label from 'above the median of cluster means' tests (strict >)."""
    return (F.when(rev_high & visits_high, F.lit(SEGMENT_LABELS[("high", "high")]))
            .when(rev_high & ~visits_high, F.lit(SEGMENT_LABELS[("high", "low")]))
            .when(~rev_high & visits_high, F.lit(SEGMENT_LABELS[("low", "high")]))
            .otherwise(F.lit(SEGMENT_LABELS[("low", "low")])))


def drop_first_token(col: Column) -> Column:
    """'🟢 High Value - Well Covered' -> 'High Value - Well Covered' (split once on a space)."""
    return F.substring(col, F.locate(" ", col) + 1, 1 << 20)


def short_territory_name(col: Column) -> Column:
    return F.replace(col, F.lit(" Zone"), F.lit(""))


def segment_action(segment: Column) -> Column:
    """Recommended action for a segment label (emoji prefix ignored)."""
    name = drop_first_token(segment)
    e = F.lit(None).cast("string")
    for label, action in reversed(list(SEGMENT_ACTIONS.items())):
        e = F.when(name == label, F.lit(action)).otherwise(e)
    return e
