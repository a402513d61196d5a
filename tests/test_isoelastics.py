"""Sets of isoelastics: orders of features, circularity, conversion, measurements."""

import pytest

from flowloom.catalog import Metadata
from flowloom.functions.physics import pixelation_delta
from flowloom.operators import lut
from pyspark.sql import functions as F

TEXT = '# BEGIN METADATA\n# {"channel_width": 20, "flow_rate": 0.04, "fluid_viscosity": 15, "lut identifier": "T"}\n# END METADATA\n#\n# area_um [um^2]\tdeform\temodulus [kPa]\n10\t0.1\t1\n30\t0.2\t1\n20\t0.15\t1\n10\t0.05\t2\n40\t0.1\t2\n'


def test_sets(spark):
    sets = lut.Isoelastics()
    assert sets.load(spark, TEXT) == "T" and sets.identifiers() == ["T"]
    plain = {r.emodulus: [tuple(p) for p in r.line] for r in sets.get("area_um", "deform", "T", 20).collect()}
    assert plain == {1.0: [(10, 0.1), (20, 0.15), (30, 0.2)], 2.0: [(10, 0.05), (40, 0.1)]}
    turned = {r.emodulus: [tuple(p) for p in r.line] for r in sets.get("circ", "area_um", "T", 20).collect()}
    assert {k: [(round(1 - c, 9), a) for c, a in v] for k, v in turned.items()} == {k: [(d, a) for a, d in v] for k, v in plain.items()}
    # twice as wide: areas by 4; stiffness by flow, viscosity and the cube of the width
    other = {round(r.emodulus, 9): [tuple(p) for p in r.line] for r in sets.get("area_um", "deform", "T", 40, 0.16, 5).collect()}
    assert other == {round(e * 4 / 3 / 8, 9): [(4 * a, d) for a, d in v] for e, v in plain.items()}
    delta = spark.range(1).select(pixelation_delta("area_um", "deform", 0.34, F.lit(10.0))).first()[0]
    assert sets.get("area_um", "deform", "T", 20, pixel_um=0.34).where("emodulus = 1").first().line[0].deform == pytest.approx(0.1 + delta)
    for bad in (("area_um", "circ", "none"), ("volume", "deform", "T"), ("area_um", "area_um", "T"), ("tilt", "deform", "T")):
        with pytest.raises(KeyError):
            sets.get(*bad, 20)
    with pytest.raises(ValueError, match="identifier"):
        sets.add(spark.range(0).selectExpr("1.0 x", "1.0 deform", "1.0 emodulus"), "area_um", "", 20, 0.04, 15)


def test_for_a_measurement(spark):
    sets = lut.Isoelastics()
    sets.load(spark, TEXT)
    meta = Metadata().update({"setup": {"channel width": 20, "flow rate": 0.04}, "imaging": {"pixel size": 0.34}})
    with pytest.warns(lut.MeaninglessStiffnessWarning):
        own = sets.get_for("area_um", "deform", meta, "T")
    assert sorted(r.emodulus for r in own.collect()) == [1.0, 2.0]
    assert sorted(r.emodulus for r in sets.get_for("area_um", "deform", meta, "T", viscosity=30.0).collect()) == [2.0, 4.0]
    meta.update({"setup": {"temperature": 20, "medium": "water"}})
    assert sorted(r.emodulus for r in sets.get_for("area_um", "deform", meta, "T", pixelated=True).collect())[0] == pytest.approx(1.002 / 15)
