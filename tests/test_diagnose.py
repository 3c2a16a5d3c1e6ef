"""The whole diagnosis, its row-level findings and names of encoded features."""

import pytest
from pyspark.sql import functions as F

from tabscope.operators.prepare import encode_features, indicator_names, one_hot
from tabscope.plans import recommend as RC
from tabscope.plans.diagnose import diagnose


def table(spark, n=240):
    rows = [(i, float(i % 17), float((i * 7) % 23), ["red", "green", None][i % 3], i % 2 == 0, 3.0 * (i % 17) + (5.0 if i % 3 == 0 else 0.0), ["a", "b"][i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, sqft double, noise double, colour string, new boolean, price double, g string")


def test_diagnose_encodes_text_and_returns_every_table(spark):
    out = diagnose(table(spark).drop("g"), "price", split_key="id")
    assert {"gate", "importance", "domain", "insights", "interpretation", "lint_rows", "output_violations"} <= set(out)
    features = {r.feature for r in out["importance"].where("kind = 'standardized'").collect()}
    assert features == {"sqft", "noise", "colour_red", "new_true"}
    assert out["domain"].first()["domain"] == "real_estate"  # price, sqft
    top = out["insights"].where("rank = 1").first()
    assert top["root_cause"] and 0 < top["confidence"] <= 1 and 1 <= len(top["actions"]) <= 3
    quality = out["insights"].where("category = 'DATA_QUALITY'").first()  # colour has nulls
    assert quality is not None and quality["confidence"] == pytest.approx(0.7)
    assert out["output_violations"].collect() == []
    assert out["gate"].first()["valid"]
    assert out["confidence"].first()["domain"] == pytest.approx(0.55)


def test_diagnose_by_segment(spark):
    out = diagnose(table(spark), "price", ["sqft", "noise"], by=["g"], split_key="id")
    for name in ("gate", "insights", "interpretation", "confidence"):
        assert {r["g"] for r in out[name].select("g").collect()} == {"a", "b"}, name


def test_indicator_names_never_clash(spark):
    cats = {"a": ["x", "y", "b_c"], "a_b": ["k", "c"]}
    names = indicator_names(cats, ["A_Y", "a_y_enc", "id"])
    assert len({n.lower() for n in names.values()}) == len(names) and not {n.lower() for n in names.values()} & {"a_y", "a_y_enc", "id"}
    df = spark.createDataFrame([(1, "x", 10), (2, "y", 20), (3, None, 30)], "id int, a string, a_y int")
    out = one_hot(df, ["a"]).orderBy("id").collect()
    assert [(r["a_y"], r["a_y_enc"]) for r in out] == [(10, 0), (20, 1), (30, 0)]
    wide, used = encode_features(df, ["a", "a_y"])
    assert used == ["a_y_enc", "a_y"]
    assert [r["a_y_enc"] for r in wide.orderBy("id").select("a_y_enc").collect()] == [0, 1, 0]


def test_kept_recommendations_keep_their_evidence(spark):
    dec = spark.createDataFrame([("s", "MULTICOLLINEARITY", "HIGH", "5 pairs", ["x"], 0.05, 0.2), ("t", "MULTICOLLINEARITY", "HIGH", "4 pairs", ["y"], 0.5, 0.01)],
                                "g string, decision string, severity string, dominant_signal string, secondary_signals array<string>, r2_score double, best_improvement double")
    recs = RC.recommendations(dec, ["g"]).where("g = 's' OR seq = 9")
    off = recs.where("seq = 0").withColumns({"seq": F.lit(5), "action": F.lit("Call someone"), "g": F.lit("t")})
    validated, _ = RC.lint(dec, recs.unionByName(off), ["g"])
    rows = {(r["g"], r["fallback"]): r for r in validated.collect()}
    assert rows["s", False]["evidence"]["secondary_signals"] == ["x"]
    assert rows["t", True]["evidence"]["dominant_signal"] == "4 pairs"
    found = {(r["g"], r["kind"], r["code"]) for r in RC.lint_rows(dec, recs.unionByName(off), ["g"]).collect()}
    assert found == {("s", "flag", "collinear"), ("t", "flag", "negligible"), ("t", "correction", "mismatch"), ("t", "correction", "fallback")}
