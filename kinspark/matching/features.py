"""Features of labelled pairs, from the attributes of both ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import edit_distance_share, exact, gauss, jaro_winkler, log_ratio, similar
from ..functions.text import matcher_form, to_number

# The comparisons of the logistic matcher, and the closed vocabularies of the distance matcher.
SIMILAR = {"manufacturer": 0.85, "model": 0.85, "location": 0.85, "cylinders": 0.70}
EXACT = ["year", "fuel_type", "traction", "body_type", "main_color", "transmission"]
GAUSS = {"price": (500.0, 2000.0), "mileage": (1000.0, 10000.0), "latitude": (0.01, 0.1), "longitude": (0.01, 0.1)}
STRINGS = ["manufacturer", "model", "year", "location", "cylinders", "body_type", "main_color", "latitude", "longitude"]
RATIOS = ["price", "mileage"]
VOCABULARIES = {
    "transmission": ["other", "automatic", "manual", "cvt", "dual clutch"],
    "fuel_type": ["gas", "other", "diesel", "hybrid", "electric", "biodiesel", "flex fuel vehicle", "compressed natural gas", "propane"],
    "traction": ["rwd", "4wd", "fwd", "awd", "4x2"],
}
LOGISTIC = [*[f"sim_{c}" for c in SIMILAR], *[f"same_{c}" for c in EXACT], *[f"near_{c}" for c in GAUSS]]


def logistic_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the 14 features of LOGISTIC; a missing value makes a feature 0."""
    jw = {f"_jw_{c}": jaro_winkler(f"{c}_A", f"{c}_B") for c in SIMILAR}
    a, b = (lambda c: F.col(f"{c}_A")), (lambda c: F.col(f"{c}_B"))
    out = pairs.withColumns(jw)
    out = out.withColumns(
        {f"sim_{c}": similar(F.col(f"_jw_{c}"), t) for c, t in SIMILAR.items()} | {f"same_{c}": exact(a(c), b(c)) for c in EXACT} | {f"near_{c}": gauss(a(c), b(c), *p) for c, p in GAUSS.items()}
    )
    return out.drop(*jw)


def _category(x: Column, y: Column, words: list[str]) -> dict[str, Column]:
    """Same known word, different known words, or neither of both."""
    known = x.isin(words) & y.isin(words)
    return {"same": F.coalesce((known & (x == y)).cast("double"), F.lit(0.0)), "other": F.coalesce((known & (x != y)).cast("double"), F.lit(0.0))}


def matcher_record(c: str, source: str | None = None) -> Column:
    """The value of field ``c`` as the distance matcher takes it, by the rule of its class.

    Strings: stripped, whole numbers without their fraction, spellings of nothing null.
    Numbers: null for what isn't one. Categories: as they are, ``nan`` null.
    """
    x = F.col(source or c)
    if c in RATIOS:
        return to_number(x)
    form = matcher_form(x) if c in STRINGS else x.cast("string")
    return F.when(~F.lower(form).isin(["", "nan", "none"] if c in STRINGS else ["nan"]), form)


def distance_features(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``pairs`` with distances of all fields and a flag for each missing one; the feature names."""
    # Forms, then distances, then features: each is computed once, in a projection of its own.
    fields = [*STRINGS, *RATIOS, *VOCABULARIES]
    lower = lambda c, x: x if c in RATIOS else F.lower(x)
    out = pairs.withColumns({f"_f_{c}_{s}": lower(c, matcher_record(c, f"{c}_{s}")) for c in fields for s in "AB"})
    raw = {c: edit_distance_share(F.col(f"_f_{c}_A"), F.col(f"_f_{c}_B")) for c in STRINGS} | {c: log_ratio(F.col(f"_f_{c}_A"), F.col(f"_f_{c}_B")) for c in RATIOS}
    out = out.withColumns({f"_d_{c}": d for c, d in raw.items()})
    cols: dict[str, Column] = {}
    for c in raw:
        cols |= {f"d_{c}": F.coalesce(f"_d_{c}", F.lit(0.0)), f"miss_{c}": F.col(f"_d_{c}").isNull().cast("double")}
    for c, words in VOCABULARIES.items():
        cols |= {f"{k}_{c}": v for k, v in _category(F.col(f"_f_{c}_A"), F.col(f"_f_{c}_B"), words).items()}
    return out.withColumns(cols).drop(*[f"_d_{c}" for c in raw], *[f"_f_{c}_{s}" for c in fields for s in "AB"]), list(cols)
