"""Every registered query of the main library against its SQL, on the smallest tables."""

import os

import pytest

from movelytics import plans

from .compare import SF, duck, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUICK = {n for n in plans.queries() if not n.startswith("m0")}


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(set(plans.oracles()) & QUICK))
def test_equals_sql(spark, con, name):
    same(plans.queries()[name](spark, SF).toPandas(), con.sql(plans.oracles()[name]).df())


def test_without_sql():
    """What has no SQL is tested by name below or in another module."""
    assert set(plans.queries()) - set(plans.oracles()) == {"s14_file_fingerprints", "o08_fitted_experts", *MODELS}


MODELS = {n for n in plans.queries() if n.startswith("m0")}


def test_files_are_unchanged(spark):
    import hashlib

    rows = plans.queries()["s14_file_fingerprints"](spark, SF).collect()
    assert len(rows) == 4 and all(r["unchanged"] for r in rows)
    assert all(hashlib.sha256(open(f"{SF}/{r['file']}", "rb").read()).hexdigest() == r["sha256"] for r in rows)


def test_simplex(spark):
    """Weights are on the simplex."""
    out = plans.queries()["a29_airport_simplex"](spark, SF).toPandas()
    weights = out[[c for c in out.columns if c.startswith("w")]]
    assert len(out) and (weights >= -1e-9).all().all() and (abs(weights.sum(axis=1) - 1) < 1e-6).all()


@pytest.mark.parametrize("name", ["g06_stand_centroids", "g07_runway_thresholds", "g08_crosswalk"])
def test_maps(spark, con, name):
    """Every airport with movements is on the map, once a key."""
    out = plans.queries()[name](spark, SF).toPandas()
    keys = [c for c in out.columns if out[c].dtype == object]
    assert len(out) and not out.duplicated(keys).any()
    assert set(out.airport) <= {r[0] for r in con.sql("select distinct 'A' || (user_id % 5) from events").fetchall()}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_give_a_value_for_every_row(spark, name):
    out = plans.queries()[name](spark, SF).toPandas()
    assert len(out) and not out.isna().all(axis=1).any()
    numbers = out.select_dtypes("number")
    assert numbers.notna().all().all() or name == "m07_movement_fit"


def test_fits_beat_a_constant(spark):
    """Out-of-fold estimates have a smaller error than the mean of the target; chances are calibrated better than the base rate and add up to 1."""
    import pandas as pd

    from movelytics.plans.models import features

    truth = features(spark, SF).select("mvt_id", "y").toPandas().set_index("mvt_id").y
    for name, column in (("m01_residual_fit", "estimate"), ("m08_stacked_correction", "estimate"), ("m09_saved_model", "fitted"), ("m02_airport_models", "fitted")):
        out = plans.queries()[name](spark, SF).toPandas().set_index("mvt_id")[column]
        both = pd.concat([out, truth], axis=1, join="inner")
        error, plain = ((both[column] - both.y) ** 2).mean(), ((both.y - truth.mean()) ** 2).mean()
        assert len(both) and error < 0.9 * plain, (name, error, plain)
    match = plans.queries()["m03_match_classifier"](spark, SF).toPandas()
    assert ((match.chance - match.match) ** 2).mean() < ((match.match.mean() - match.match) ** 2).mean() and match.chance.nunique() > 5
    source = plans.queries()["m04_source_classifier"](spark, SF).toPandas()
    p = source[[f"p{k}" for k in range(4)]]
    assert (abs(p.sum(axis=1) - 1) < 1e-5).all() and (p.values.argmax(1) == source.source).mean() > source.source.value_counts(normalize=True).min()


def test_fitted_experts(spark):
    """Every movement has its fourteen candidates, none negative or null, and the fitted ones beat the proxy out of fold."""
    from movelytics.plans.estimates import EXPERTS
    from movelytics.plans.models import features

    out = plans.queries()["o08_fitted_experts"](spark, SF).toPandas().set_index("mvt_id")
    truth = features(spark, SF).select("mvt_id", "y", "old").toPandas().set_index("mvt_id")
    assert len(out) == len(truth) + features(spark, SF, labelled=False).count() and out.index.is_unique
    assert out[list(EXPERTS)].notna().all().all() and (out[["baseline_direct", "missing_direct", "grouped"]] >= 0).all().all()
    both = out.join(truth, how="inner")
    error = lambda c: ((both[c] - both.y) ** 2).mean()
    assert error("baseline_direct") < error("old") and error("missing_direct") < both.y.var()


def test_airport_models_lose_no_rows(spark):
    from movelytics.plans.models import features

    assert plans.queries()["m02_airport_models"](spark, SF).count() == features(spark, SF).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_models(spark):
    assert plans.queries()["m07_movement_fit"](spark, SF).where("fitted is null").count() == 0
    both = plans.queries()["m06_tail_mixture"](spark, SF).toPandas()
    assert (both.estimate >= 0).all() and len(both)
