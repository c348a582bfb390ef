import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake.operators.frame import SplatFrame
from splatlake.sources import sog
from splatlake.sources.files import detect_formats, load_files, read_files
from splatlake.sources.ply import decompress_bytes, detect_format, parse_header
from splatlake.sources.ply_sink import compress_to_bytes, compress_to_tables, compressed_header, output_path, plain_header
from splatlake.streaming.scenes import in_box, packed_rows_in_box, scene_extents, stream_scenes
from tests.oracle import scene


@pytest.mark.parametrize("degree", [0, 1, 3])
def test_plain_file_is_byte_exact(spark, tmp_path, degree):
    data = scene(300, degree)
    path = SplatFrame.from_dict(spark, data).write(str(tmp_path / "a.ply"))
    flat = np.concatenate([data["means"], data["sh0"], data["shN"].transpose(0, 2, 1).reshape(300, -1), data["opacities"][:, None], data["scales"], data["quats"]], axis=1)
    with open(path, "rb") as f:
        assert f.read() == plain_header(300, degree) + flat.astype("<f4").tobytes()
    assert detect_format(path) == (False, degree)
    back = SplatFrame.read(spark, path)
    assert back.degree == degree
    for key, v in back.to_dict().items():
        np.testing.assert_array_equal(v, data[key])


@pytest.mark.parametrize(("n", "degree"), [(1, 0), (256, 1), (513, 3), (0, 0)])
def test_compressed_file(spark, tmp_path, n, degree):
    f = SplatFrame.from_dict(spark, scene(n, degree))
    path = f.write(str(tmp_path / "a.ply"), compressed=True)
    assert path.endswith("a.compressed.ply") and detect_format(path) == (True, None)
    back = SplatFrame.read(spark, path)
    assert len(back) == n
    want = SplatFrame.unpack(f.pack(), degree).to_dict()
    for key, v in back.to_dict().items():
        np.testing.assert_allclose(v.reshape(want[key].shape), want[key], atol=1e-5)


def test_linear_rgb_frames_are_converted_on_write(spark, tmp_path):
    f = SplatFrame.from_dict(spark, scene(10)).denormalize(unit_rotations=False).to_rgb()
    back = SplatFrame.read(spark, f.write(str(tmp_path / "a.ply"))).to_dict()
    np.testing.assert_allclose(back["sh0"], scene(10)["sh0"], atol=1e-5)
    np.testing.assert_allclose(back["opacities"], scene(10)["opacities"], atol=1e-4)


def test_gid_filters_cut_the_scan(spark, tmp_path):
    path = SplatFrame.from_dict(spark, scene(1000)).write(str(tmp_path / "a.ply"))
    rows = SplatFrame.read(spark, path, ["x"]).df
    assert rows.columns == ["gid", "x"]
    assert [r.gid for r in rows.where("gid > 300 and gid <= 303").collect()] == [301, 302, 303]
    assert rows.where("gid = 5").count() == 1 and rows.where("gid >= 2000").count() == 0


def test_bytes(spark, tmp_path):
    scenes = SplatFrame.from_dict(spark, scene(300, 1)).df.withColumn("scene", F.explode(F.array(F.lit("a"), F.lit("b"))))
    made = compress_to_bytes(scenes, 1)
    assert made.count() == 2
    path = SplatFrame.from_dict(spark, scene(300, 1)).write(str(tmp_path / "a"), compressed=True)
    with open(path, "rb") as f:
        assert f.read() == bytes(made.where("scene = 'a'").first().content)
    back = decompress_bytes(made, 1, "scene", "content")
    assert back.groupBy("scene").count().collect()[0]["count"] == 300
    header, chunks, packed = compress_to_tables(SplatFrame.from_dict(spark, scene(300, 1)))
    assert header == compressed_header(300, 1) and chunks.count() == 2 and packed.count() == 300


def test_detection_refuses(tmp_path):
    def f(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    assert detect_format(str(tmp_path / "missing")) == (False, None)
    assert detect_format(f("junk", b"hello")) == (False, None)
    assert detect_format(f("empty", b"")) == (False, None)
    assert detect_format(f("names", plain_header(1, 0).replace(b"f_dc_0", b"red"))) == (False, None)
    five = compressed_header(1, 0).replace(b"packed_color\n", b"packed_color\nproperty uint more\n")
    assert detect_format(f("five", five)) == (False, None)
    assert detect_format(f("crlf", plain_header(1, 2).replace(b"\n", b"\r\n"))) == (False, 2)
    long = plain_header(1, 0).replace(b"element", b"".join(b"comment %d\n" % k for k in range(2000)) + b"element", 1)
    assert len(long) > 8192 and detect_format(f("long", long)) == (False, 0)
    assert parse_header(plain_header(7, 1)).element("vertex")[0] == 7


def test_reading_refuses(spark, tmp_path):
    with pytest.raises(ValueError):
        SplatFrame.read(spark, str(tmp_path / "missing.ply"))
    (tmp_path / "ascii.ply").write_bytes(plain_header(1, 0).replace(b"binary_little_endian", b"ascii"))
    with pytest.raises(ValueError):
        SplatFrame.read(spark, str(tmp_path / "ascii.ply"))
    (tmp_path / "short.ply").write_bytes(plain_header(10, 0) + b"\0" * 100)
    with pytest.raises(Exception, match="cut short"):
        SplatFrame.read(spark, str(tmp_path / "short.ply")).df.count()


def test_output_paths():
    assert output_path("a.ply", False) == ("a.ply", False)
    assert output_path("a.ply", True) == ("a.compressed.ply", True)
    assert output_path("a", True) == ("a.compressed.ply", True)
    assert output_path("a.ply_compressed", False) == ("a.ply_compressed", True)


def raw(data):
    """A stand-in decoder: images are height, width and bytes."""
    h, w = data[0], data[1]
    return np.frombuffer(data[2:], np.uint8).reshape(h, w, -1)


def bundle(linear):
    r = np.random.default_rng(1)
    image = lambda h, w, c=4: bytes([h, w]) + r.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()
    quats = r.integers(0, 256, (16, 4), dtype=np.uint8)
    quats[:, 3] = [252, 253, 254, 255, 7, *[254] * 11]
    labels = np.zeros((16, 4), np.uint8)
    labels[:, 0] = [*range(14), 63, 64]
    files = {"lo": image(4, 4), "hi": image(4, 4, 3), "q": bytes([4, 4]) + quats.tobytes(), "s": image(4, 4), "c": image(4, 4), "cent": bytes([1, 192]) + r.integers(0, 256, 192 * 4, dtype=np.uint8).tobytes(), "lab": bytes([4, 4]) + labels.tobytes()}
    meta = {k: {"files": f} for k, f in (("means", ["lo", "hi"]), ("quats", ["q"]), ("scales", ["s"]), ("sh0", ["c"]), ("shN", ["cent", "lab"]))}
    meta["means"] |= {"mins": [-1, -1, 0], "maxs": [1, 1, 0]}
    if linear:
        meta["means"]["shape"] = [16, 3]
        meta["scales"] |= {"mins": [-10, -9, -8], "maxs": [-2, -2, -2]}
        meta["sh0"] |= {"mins": [-2, -2, -2, -4], "maxs": [2, 2, 2, 6]}
        meta["shN"] |= {"shape": [16, 3], "mins": -0.5, "maxs": 0.5}
    else:
        meta |= {"count": 16}
        book = np.linspace(-2, 2, 256).tolist()
        meta["scales"]["codebook"] = meta["sh0"]["codebook"] = book
        meta["shN"] |= {"bands": 1, "count": 64, "codebook": book}
    return files, meta


@pytest.mark.parametrize("linear", [True, False])
@pytest.mark.parametrize("zipped", [True, False])
def test_texture_bundles(spark, tmp_path, linear, zipped):
    files, meta = bundle(linear)
    if zipped:
        path = tmp_path / "a.sog"
        with zipfile.ZipFile(path, "w") as z:
            for name, data in (files | {"meta.json": json.dumps(meta).encode()}).items():
                z.writestr(name, data)
    else:
        path = tmp_path / "folder"
        path.mkdir()
        for name, data in (files | {"meta.json": json.dumps(meta).encode()}).items():
            (path / name).write_bytes(data)
    f = sog.read_bundle(spark, str(path), raw)
    got = f.to_dict()
    assert f.degree == 1 and len(got["means"]) == 16
    lo, hi, s, c = (raw(files[k]).reshape(16, -1).astype("f8") for k in ("lo", "hi", "s", "c"))
    v = np.array([-1, -1, 0]) + np.array([2, 2, 1]) * (lo[:, :3] + 256 * hi[:, :3]) / 65535
    np.testing.assert_allclose(got["means"], np.sign(v) * (np.exp(np.abs(v)) - 1), atol=1e-5)
    book = np.linspace(-2, 2, 256)
    want = np.array([-10, -9, -8]) + s[:, :3] / 255 * np.array([8, 7, 6]) if linear else book[s[:, :3].astype(int)]
    np.testing.assert_allclose(got["scales"], want, atol=1e-5)
    p = np.clip(c[:, 3] / 255, 1e-6, 1 - 1e-6)
    np.testing.assert_allclose(got["opacities"], -4 + c[:, 3] / 255 * 10 if linear else np.log(p / (1 - p)), atol=1e-4)
    assert got["quats"][4].tolist() == [0, 0, 0, 1]
    np.testing.assert_allclose(np.linalg.norm(got["quats"][5:], axis=1) >= 0.99, True)
    cent = raw(files["cent"])[0]
    value = (lambda b: -0.5 + b / 255) if linear else (lambda b: book[b])
    np.testing.assert_allclose(got["shN"][3, 2], value(cent[3 * 3 + 2, :3]), atol=1e-5)
    assert np.all(got["shN"][15] == 0)  # label 64 is past the palette


def test_bundles_refuse(spark, tmp_path):
    files, meta = bundle(True)
    rows = lambda f: spark.createDataFrame([(k, bytearray(v)) for k, v in f.items()], "path string, content binary")
    with pytest.raises(ValueError, match="no q"):
        sog.decode_bundle(rows({k: v for k, v in files.items() if k != "q"}), meta, raw)
    with pytest.raises(ValueError, match="fewer pixels"):
        sog.decode_bundle(rows(files | {"s": bytes([1, 1, 0, 0, 0, 0])}), meta, raw)
    (tmp_path / "x").write_bytes(b"1")
    with pytest.raises(ValueError, match="meta.json"):
        sog.read_bundle(spark, str(tmp_path), raw)


def test_stream_of_scenes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        SplatFrame.from_dict(spark, scene(300, seed=k)).write(str(folder / f"s{k}"), compressed=True)
    stream = stream_scenes(spark, str(folder))
    q = scene_extents(stream).writeStream.format("memory").queryName("extents").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.sql("select n from extents").collect()) == [300, 300]


def test_box(spark):
    """Packed rows in a box are those whose decoded centres are in it, and the scan neither joins nor shuffles again."""
    packed = SplatFrame.from_dict(spark, scene(1000)).pack()
    low, high = (-0.5,) * 3, (0.5,) * 3
    want = sorted(r.gid for r in SplatFrame.unpack(packed).df.where(in_box(low, high)).collect())
    found = packed_rows_in_box(packed, low, high)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(r.gid for r in found.collect()) == want and want


def test_many_files(spark, tmp_path):
    """A folder of files of both kinds and several degrees, read by a pattern."""
    for k, degree in enumerate((0, 1, 3)):
        f = SplatFrame.from_dict(spark, scene(300 + k, degree))
        f.write(str(tmp_path / f"{k}.ply"))
        f.write(str(tmp_path / f"{k}.ply"), compressed=True)
    (tmp_path / "4.txt").write_bytes(b"\n")
    kinds = {r.scene.rsplit("/", 1)[-1]: (r.compressed, r.degree, r.n) for r in detect_formats(load_files(spark, str(tmp_path))).collect()}
    assert kinds == {"4.txt": (False, None, None)} | {f"{k}.ply": (False, d, 300 + k) for k, d in enumerate((0, 1, 3))} | {f"{k}.compressed.ply": (True, None, 300 + k) for k in range(3)}
    values = spark.createDataFrame([("a", None), ("b", bytearray())], "path string, content binary")
    assert {tuple(r) for r in detect_formats(values).collect()} == {("a", False, None, None), ("b", False, None, None)}
    rows = read_files(spark, str(tmp_path / "*.ply"))
    for k in range(3):
        for name in (f"{k}.ply", f"{k}.compressed.ply"):
            got = rows.where(F.col("scene").endswith(f"/{name}")).drop("scene").orderBy("gid").collect()
            want = SplatFrame.read(spark, str(tmp_path / name)).df.select(*rows.columns[1:]).orderBy("gid").collect()
            assert got == want
    with pytest.raises(Exception, match="of degree 1"):
        read_files(spark, str(tmp_path / "0.ply"), 1).collect()
    assert read_files(spark, [str(tmp_path / "1.ply"), str(tmp_path / "1.compressed.ply")], 1).count() == 602
    with pytest.raises(Exception, match="not a PLY file"):
        read_files(spark, str(tmp_path / "4.txt")).collect()


def test_width_of_harmonics_is_checked(spark):
    rows = SplatFrame.from_dict(spark, scene(10, 1)).df
    assert SplatFrame.from_columns(rows, degree=1).pack().count() == 10
    with pytest.raises(Exception, match="f_rest must have 45 values"):
        SplatFrame.from_columns(rows, degree=3).pack().collect()
