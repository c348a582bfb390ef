import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake.functions import codec
from splatlake.operators.frame import SplatFrame
from splatlake.schema import PACKED
from tests.oracle import scene, words


@pytest.mark.parametrize("n", [1, 255, 256, 257, 700])
def test_words_equal_the_formulas(spark, n):
    data = scene(n)
    got = SplatFrame.from_dict(spark, data).pack().orderBy("gid").toPandas()
    want = words(*(data[k].astype("f8") for k in ("means", "scales", "quats", "opacities", "sh0")))
    for name in PACKED:
        for shift, bits in {"packed_position": ((21, 11), (11, 10), (0, 11)), "packed_scale": ((21, 11), (11, 10), (0, 11)), "packed_color": ((24, 8), (16, 8), (8, 8), (0, 8)), "packed_rotation": ((30, 2), (20, 10), (10, 10), (0, 10))}[name]:
            a, b = (got[name].to_numpy() >> shift) & (2**bits - 1), (want[name] >> shift) & (2**bits - 1)
            assert np.abs(a - b).max() <= 1, name


def test_edges(spark):
    data = scene(6)
    data["means"][:] = 3  # no range
    data["quats"][0] = 0
    data["quats"][1] = 1  # ties: the first is largest
    data["opacities"][:2] = [40, -40]
    data["scales"][0] = [50, -50, 0]
    rows = SplatFrame.from_dict(spark, data).pack().orderBy("gid").collect()
    assert [r.packed_position for r in rows] == [0] * 6
    assert [r.packed_color & 255 for r in rows[:2]] == [255, 0]
    assert rows[1].packed_rotation >> 30 == 0 and rows[0].packed_rotation >> 30 == 0
    assert max(r.max_scale_x for r in rows) == 20 and min(r.min_scale_y for r in rows) == -20


def test_there_and_back(spark):
    data = scene(600, 3)
    f = SplatFrame.from_dict(spark, data)
    back = SplatFrame.unpack(f.pack(), 3).to_dict()
    np.testing.assert_allclose(back["means"], data["means"], atol=1e-2)
    np.testing.assert_allclose(back["scales"], data["scales"], atol=1e-2)
    np.testing.assert_allclose(back["sh0"], data["sh0"], atol=2e-2)
    np.testing.assert_allclose(back["shN"], data["shN"], atol=1 / 32)
    q = data["quats"] / np.linalg.norm(data["quats"], axis=1, keepdims=True)
    assert np.abs((q * back["quats"]).sum(1)).min() > 0.999


def test_extreme_opacity_codes(spark):
    rows = spark.createDataFrame([(0,), (255,), (128,)], "w long").select(codec.unpack_opacity(F.col("w")).alias("o")).collect()
    assert [rows[0].o, rows[1].o] == [-10.0, 10.0] and abs(rows[2].o - np.log(128 / 127)) < 1e-9


def test_bounds_hold_their_rows(spark):
    f = SplatFrame.from_dict(spark, scene(513))
    bounds = f.chunk_bounds()
    assert bounds.count() == 3
    met = f.df.withColumn("chunk_id", F.shiftright("gid", 8)).join(bounds, "chunk_id")
    assert met.where("x < min_x or x > max_x or z < min_z or z > max_z").count() == 0


def test_packing_shuffles_once(spark):
    plan = SplatFrame.from_dict(spark, scene(10)).pack()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Join" not in plan
