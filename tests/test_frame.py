import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake.functions import activation
from splatlake.operators.frame import SplatFrame
from splatlake.state import FormatState
from tests.oracle import scene


@pytest.fixture(scope="module")
def small(spark):
    return SplatFrame.from_dict(spark, scene(20, 1))


def xs(frame):
    return [r.x for r in frame.df.orderBy("gid").collect()]


def test_round_trip_of_arrays(small):
    want, got = scene(20, 1), small.to_dict()
    for key in want:
        np.testing.assert_array_equal(got[key], want[key])
    assert len(small.unpacked(False)) == 5


@pytest.mark.parametrize("key", [slice(3, 9), slice(None, None, 4), slice(-5, None), slice(None, None, -1), slice(15, 2, -3), slice(5, -5, 2), slice(30, 40), slice(0, 0)])
def test_slices_follow_python(small, key):
    got = small[key]
    np.testing.assert_array_equal(np.array(xs(got), "f4"), scene(20, 1)["means"][key, 0])
    assert [r.gid for r in got.df.orderBy("gid").collect()] == list(range(len(got)))


def test_positions_keep_order_and_repeats(small):
    assert xs(small[[4, -1, 4, 0]]) == [float(v) for v in scene(20, 1)["means"][[4, -1, 4, 0], 0]]
    with pytest.raises(IndexError):
        small[[20]]
    with pytest.raises(TypeError):
        small["x"]
    with pytest.raises(IndexError):
        small[99]
    assert small[-1].x == scene(20, 1)["means"][-1, 0]
    assert len(small.gaussian(3)) == 1
    assert [r.x for r in small] == xs(small)


def test_dense_numbers_survivors_in_order(small):
    kept = small[F.col("x") > 0].dense()
    want = [float(v) for v in scene(20, 1)["means"][:, 0] if v > 0]
    assert xs(kept) == want and [r.gid for r in kept.df.orderBy("gid").collect()] == list(range(len(want)))


def test_masks(small):
    f = small.add_mask("a", F.col("x") > 0).add_mask("b", "y > 0")
    n = lambda c: f.df.where(c).count()
    m = scene(20, 1)["means"]
    assert n(f.combine_masks("and")) == ((m[:, 0] > 0) & (m[:, 1] > 0)).sum()
    assert n(f.combine_masks("or")) == ((m[:, 0] > 0) | (m[:, 1] > 0)).sum()
    assert n(f.combine_masks("and", [])) == 20 and n(f.combine_masks("or", [])) == 0
    assert f.apply_masks("and", ["b"]).masks == ("a", "b")
    assert f.remove_mask("a").masks == ("b",)
    for bad in (lambda: f.add_mask("a", "x > 0"), lambda: f.mask("c"), lambda: f.combine_masks("xor"), lambda: small.combine_masks(), lambda: f.remove_mask("z")):
        with pytest.raises(ValueError):
            bad()


def test_union_rules(small):
    a, b = small.add_mask("m", "x > 0"), small
    both = a + b
    assert len(both) == 40 and both.df.where("gid >= 20 and mask__m").count() == 0
    assert (a + b.add_mask("n", "y > 0")).masks == ("m",)
    assert (a + a.add_mask("n", "y > 0")).masks == ()
    assert len(sum([small, small, small])) == 60
    bulk = SplatFrame.concatenate([a, b, small])
    assert bulk.masks == () and xs(bulk) == xs(small) * 3
    assert SplatFrame.concatenate([a]) is a
    with pytest.raises(ValueError):
        SplatFrame.concatenate([])
    with pytest.raises(ValueError):
        a + b.denormalize()


def test_domains_there_and_back(small):
    linear = small.denormalize()
    assert linear.state.is_scales_linear and linear.denormalize() is linear
    got, want = linear.to_dict(), scene(20, 1)
    np.testing.assert_allclose(got["scales"], np.clip(np.exp(want["scales"]), 1e-4, 100), rtol=1e-5)
    np.testing.assert_allclose(got["opacities"], 1 / (1 + np.exp(-want["opacities"])), rtol=1e-5)
    np.testing.assert_allclose(np.linalg.norm(got["quats"], axis=1), 1, rtol=1e-5)
    np.testing.assert_allclose(linear.normalize().to_dict()["scales"], want["scales"], atol=1e-5)
    plain = small.denormalize(clamped=False, unit_rotations=False).to_dict()
    np.testing.assert_array_equal(plain["quats"], want["quats"])
    rgb = small.to_rgb()
    assert rgb.state.is_sh0_rgb
    np.testing.assert_allclose(rgb.to_sh().to_dict()["sh0"], want["sh0"], atol=1e-6)


def test_zero_rotation_becomes_unit(spark):
    data = scene(1)
    data["quats"][:] = 0
    assert SplatFrame.from_dict(spark, data).denormalize().to_dict()["quats"].tolist() == [[0, 0, 0, 1]]


@pytest.mark.parametrize(
    ("scales", "opacities", "want"),
    [([1.0, 2, 3], 0.5, ("linear", "linear")), ([10.0, 1, 1], 0.5, ("log", "linear")), ([-1.0, 1, 1], 0.5, ("log", "linear")), ([1.0, 1, 1], 5.0, ("linear", "log"))],
)
def test_detection(spark, scales, opacities, want):
    data = scene(4)
    data["scales"][:] = scales
    data["opacities"][:] = opacities
    state = SplatFrame.from_dict(spark, data, "auto").state
    assert (state.scales, state.opacities) == want


def test_detection_of_nothing(spark):
    state = SplatFrame.from_dict(spark, scene(0), "auto").state
    assert (state.scales, state.opacities) == ("log", "log")


def test_bad_arguments(spark, small):
    with pytest.raises(ValueError):
        SplatFrame.from_dict(spark, scene(1), "nonsense")
    with pytest.raises(KeyError):
        SplatFrame.from_dict(spark, {"means": np.zeros((1, 3))})
    with pytest.raises(KeyError):
        SplatFrame.from_columns(spark.range(1))
    with pytest.raises(ValueError):
        SplatFrame.from_dict(spark, scene(2) | {"scales": np.zeros((3, 3))})
    with pytest.raises(ValueError):
        FormatState().with_format(nothing=1)
    with pytest.raises(ValueError):
        activation.activations(min_scale=2, max_scale=1)
    with pytest.raises(ValueError):
        activation.deactivations(min_opacity=0)
    with pytest.raises(ValueError):
        small.to_dtype("half")
    assert small.to_dtype("double").df.schema["x"].dataType.typeName() == "double"
    assert FormatState.from_metadata(FormatState.linear(2).to_metadata()) == FormatState.linear(2)
    assert small.with_format(scales="linear").copy_format_from(small).state == small.state
    assert "masks=[]" in repr(small)


def test_conversion_is_one_codegen_stage(small):
    plan = small.denormalize().to_rgb().df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_rows_are_counted_off_after_a_filter(spark):
    import pytest

    from tests.oracle import scene

    f = SplatFrame.from_dict(spark, scene(100))
    kept = f.where("gid % 2 = 1")
    x = [r.x for r in f if r.gid % 2]
    assert kept.gaps and len(kept[0:10]) == 10 and [r.x for r in kept[0:10]] == x[:10] and [r.x for r in kept.take([-1, 0])] == [x[-1], x[0]]
    assert kept.row(-1).x == x[-1] and kept.gaussian(3).row(0).x == x[3]
    with pytest.raises(IndexError):
        kept.take([50])
    both = kept + f
    assert [r.gid for r in both] == list(range(150)) and [r.x for r in both][:50] == x
    assert [r.gid for r in SplatFrame.concatenate([f, kept, kept.add_mask("m", "x > 0")])] == list(range(200))
    assert kept.pack().agg({"gid": "max"}).first()[0] == 49 and kept.chunk_bounds().count() == 1
    assert kept.dense().gaps is False and kept.dense().dense().df.sameSemantics(kept.dense().dense().df) and kept.to_rgb().gaps
