import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.model import RasterConfig
from timberline.sources import las, meshes, ply, tables


@pytest.fixture
def points(spark):
    r = np.random.default_rng(0)
    rows = [(i, *map(float, np.round(r.uniform(-50, 50, 3), 3)), float(i % 7), i % 3) for i in range(2500)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, intensity double, tree_id int")


def test_las_round_trip_by_ranges(spark, points, tmp_path):
    las.write_las(points, str(tmp_path / "a.las"), label="tree_id")
    for got in (las.read_las(spark, str(tmp_path), records=700), las.read_las_store(spark, str(tmp_path))):
        rows = {r.pid: r for r in got.collect()}
        assert len(rows) == 2500
        for r in points.collect():
            g = rows[r.pid]
            assert (g.x, g.y, g.z) == (pytest.approx(r.x, abs=6e-4), pytest.approx(r.y, abs=6e-4), pytest.approx(r.z, abs=6e-4)) and (g.intensity, g.pt_src_id) == (r.intensity, r.tree_id)
    assert las.read_las(spark, str(tmp_path), records=700).rdd.getNumPartitions() == 4
    las.write_las(points.limit(0), str(tmp_path / "none.las"))
    assert las.read_las(spark, str(tmp_path / "none.las")).count() == 0


@pytest.mark.parametrize("kind", [0, 3, 6])
def test_las_formats(spark, tmp_path, kind):
    dtype = np.dtype(las.FORMATS[kind])
    raw = np.zeros(5, dtype)
    raw["X"], raw["intensity"] = np.arange(5), 9
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", bytes((1, 4))
    import struct

    struct.pack_into("<HI", head, 94, 375, 375)
    struct.pack_into("<BHI", head, 104, kind, dtype.itemsize, 5)
    struct.pack_into("<6d", head, 131, 0.5, 1, 1, 100, 0, 0)
    (tmp_path / "k.las").write_bytes(bytes(head) + raw.tobytes())
    got = las.read_las(spark, str(tmp_path / "k.las")).orderBy("pid").collect()
    assert [r.x for r in got] == [100, 100.5, 101, 101.5, 102] and got[0].intensity == 9


def test_ply_round_trip_and_mesh(spark, points, tmp_path):
    path = str(tmp_path / "p.ply")
    ply.write_points(points, path, scalar="tree_id", offset=(1.0, 2.0, 3.5))
    got = ply.read_ply(spark, path, scalar=True).join(points.withColumnRenamed("x", "x0"), "pid")
    assert got.where((F.abs(F.col("x") - F.col("x0")) < 1e-4) & (F.col("scalar") == F.col("tree_id")) & (F.col("off_z") == 3.5)).count() == 2500
    ground = points.select(F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz")).limit(120)
    faces = ply.save_ground_surface(ground, str(tmp_path / "g.ply"))
    assert ply.read_faces(spark, str(tmp_path / "g.ply")).count() == faces > 150
    assert ply.load_ground_surface(spark, str(tmp_path / "g.ply"), (0.0, 0.0, 1.0)).count() == 120


def test_binary_ply():
    v = np.array([(1.5, 2.5, -3.0, 7)], [("x", "<f4"), ("y", "<f4"), ("z", "<f8"), ("c", "u1")])
    head = b"ply\nformat binary_little_endian 1.0\ncomment 1.0\ncomment 2.0\ncomment 3.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty double z\nproperty uchar c\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    columns, offset, faces = ply.parse(head + v.tobytes() + b"\x03" + np.array([0, 0, 0], "<i4").tobytes())
    assert columns["z"][0] == -3 and offset == [1, 2, 3] and faces == [[0, 0, 0]]


def test_delaunay_is_empty_circle():
    xy = np.random.default_rng(1).uniform(0, 10, (60, 2))
    triangles = ply.delaunay(xy)
    for t in triangles:
        a, b, c = xy[list(t)]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        inside = np.hypot(*(xy - m).T) < np.hypot(*(a - m)) - 1e-9
        assert not inside.any()
    assert ply.delaunay(xy[:2]) == [] and len(triangles) > 80


def test_text_formats(spark, points, tmp_path):
    (tmp_path / "a.asc").write_text("|1.0| 2 3 9 0.5\n4 5 6 8 0.25\n\n")
    got = tables.read_xyz(spark, str(tmp_path / "a.asc"), label=3, returns=4, other=(0,)).orderBy("pid").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, 2, 3, 0.5, 9, 1), (1, 4, 5, 6, 0.25, 8, 4)]
    (tmp_path / "a.off").write_text("2\n1 2 3\n4 5 6\n")
    assert [tuple(r)[1:] for r in tables.read_off(spark, str(tmp_path / "a.off")).orderBy("pid").collect()] == [(0, 1, 2, 3), (1, 4, 5, 6)]
    (tmp_path / "n.csv").write_text("id,x,y,r\n1,2,3,4\n5,6,7,8\n")
    head, data = tables.read_numeric(spark, str(tmp_path / "n.csv"), (0,))
    assert head.first().f == ["id", "x", "y", "r"] and data.count() == 2
    tables.write_xyz(points, str(tmp_path / "w"), ",", label="tree_id", ret="intensity")
    assert tables.read_xyz(spark, str(tmp_path / "w"), ",", returns=3, label=4, glob="part-*").agg(F.sum("label")).first()[0] == points.agg(F.sum("tree_id")).first()[0]
    assert tables.read_large_xyz(spark, str(tmp_path / "w"), ["x", "y", "z", "r", "l"], ",").select("pid").distinct().count() == 2500
    tables.write_table(points.limit(3), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).columns == points.columns


def test_annotations(spark, tmp_path):
    box = lambda n, d: f"<object><name>{n}</name><difficult>{d}</difficult><bndbox><xmin>10</xmin><ymin>20</ymin><xmax>30</xmax><ymax>60</ymax></bndbox></object>"
    (tmp_path / "a.xml").write_text(f"<annotation><size><width>100</width><height>200</height></size>{box('tree', 0)}{box('tree', 1)}{box('car', 0)}{box('shrub', 0)}</annotation>")
    got = sorted(tuple(r) for r in tables.read_voc(spark, str(tmp_path / "a.xml"), ["tree", "shrub"]).collect())
    assert got == [("a.xml", 0, 0.2, 0.2, 0.2, 0.2), ("a.xml", 1, 0.2, 0.2, 0.2, 0.2)]


def test_images_metrics_and_configs(spark, tmp_path):
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    tables.write_ppm(image, str(tmp_path / "i.ppm"))
    assert {(r.row, r.col): r.green for r in tables.read_ppm(spark, str(tmp_path / "i.ppm")).collect()}[1, 2] == image[1, 2, 1]
    tables.append_metrics(spark, str(tmp_path / "m"), 1, {"loss": 2.0})
    assert tables.append_metrics(spark, str(tmp_path / "m"), 2, {"loss": 1.0}).count() == 2
    config = RasterConfig(["vertical_density"], res=0.1)
    assert config.raster_layers[1:] == ["blank", "blank"] and config.support_window == [1, 1, 1]
    config.to_json(str(tmp_path / "c.json"))
    assert RasterConfig.from_json(str(tmp_path / "c.json")) == config
    assert tables.read_config(spark, str(tmp_path / "c.json")).first().res == 0.1
    for bad in ({"res": 1}, {"gridSize": (3, 3)}, {"normalisation": "other"}, {"raster_layers": ["unknown"]}):
        with pytest.raises(ValueError):
            RasterConfig(**({"raster_layers": ["max_height"]} | bad))
    assert json.loads((tmp_path / "c.json").read_text())["res"] == 0.1


def test_meshes(spark, tmp_path):
    rings = spark.createDataFrame([(0, k, float(k), 0.0, 1.0, float(k)) for k in range(3)], "tree_id int, cid int, x double, y double, r double, z double")
    v = meshes.ring_vertices(rings, ["tree_id", "cid"])
    faces = meshes.stem_faces(v, "tree_id", "cid")
    assert v.count() == 45 and faces.count() == 30 and meshes.ring_edges(v).count() == 45
    meshes.write_mesh(v, str(tmp_path / "m.ply"), faces)
    assert ply.read_faces(spark, str(tmp_path / "m.ply")).count() == 30
    colours = meshes.coloured_by(rings, "tree_id")
    assert colours.select("red", "green", "blue").distinct().count() == 1


def test_lines_of_split_files_are_numbered_file_by_file(spark, tmp_path):
    """Several files, many blocks, blank lines: each file's lines are counted from 0 without gaps, in order."""
    (tmp_path / "clouds").mkdir()
    for name, n in (("a b.asc", 5000), ("c.asc", 3000), ("d.asc", 1)):
        (tmp_path / "clouds" / name).write_text("".join(f" {k} {k * 2}\t{k + 0.5}\n" + "\n" * (k % 7 == 0) + "  \r\n" * (k % 11 == 0) for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = tables.read_xyz(spark, str(tmp_path / "clouds"), glob="*.asc")
        assert got.rdd.getNumPartitions() > 10
        rows = got.collect()
        for name, n in (("a b.asc", 5000), ("c.asc", 3000), ("d.asc", 1)):
            assert sorted((r.pid, r.x, r.y, r.z) for r in rows if r.cloud_id == name) == [(k, k, 2 * k, k + 0.5) for k in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_binary_parts_are_joined_as_they_are(spark, tmp_path, monkeypatch):
    """All byte values, line ends included, in order, over several tasks and files a task, and none through Python."""
    from pyspark.sql import DataFrame

    from timberline.sources import files

    blobs = [bytes([k % 256]) * (k % 5) + b"\n\r\xff\x00" * (k % 3) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(blobs)), "at long, value binary").repartition(7).orderBy("at")
    for name in ("toLocalIterator", "collect"):
        monkeypatch.setattr(DataFrame, name, None)
    files.write_blobs(df, f"{tmp_path}/b.bin", b"head")
    assert (tmp_path / "b.bin").read_bytes() == b"head" + b"".join(blobs)
    files.write_blobs(df.where("false"), f"{tmp_path}/none.bin")
    assert (tmp_path / "none.bin").read_bytes() == b""
    assert sorted(f.name for f in tmp_path.iterdir() if not f.name.startswith(".")) == ["b.bin", "none.bin"]
