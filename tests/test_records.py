"""Matrices as text, collections merged from several objects, surface points."""

import json

import pytest

from terrafold.operators import exports
from terrafold.sources import records


def truth(folder, name, units, pairs):
    m = [[1, 0, 0, 5], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    path = folder / f"{name}.json"
    path.write_text(json.dumps({"units": units, "wall_thickness": 3.5, "fragments": {"p1": {"matrix": m}, "p2": {"matrix": m}}, "object_of": {"p1": "x"}, "adjacency": pairs}))
    return str(path)


def test_merged_collections(spark, tmp_path):
    parts = {"b": truth(tmp_path, "one", "mm", [["p2", "p1"]]), "a": truth(tmp_path, "two", "mm", [])}
    f, adj = records.merged_truth(spark, parts)
    assert sorted((r["name"], r["object"], r["pose"][3]) for r in f.collect()) == [("a_p1", "a", 5.0), ("a_p2", "a", 5.0), ("b_p1", "b", 5.0), ("b_p2", "b", 5.0)]
    assert [tuple(r) for r in adj.collect()] == [("b_p1", "b_p2")]
    with pytest.raises(ValueError, match="elsewhere"):
        records.merged_truth(spark, {**parts, "c": truth(tmp_path, "three", "cm", [])})


def test_surface_points(spark, tmp_path):
    (tmp_path / "k1_Surface_in.xyz").write_text("0 1 2 9\n\n 3\t4 5\n")
    (tmp_path / "k1_Surface_out.xyz").write_text("6 7 8e-1\nword 1 2\n1 2\n")
    (tmp_path / "k2_other.xyz").write_text("0 0 0\n")
    got = sorted(tuple(r) for r in records.read_surfaces(spark, str(tmp_path)).collect())
    assert got == [("k1", 0.0, 1.0, 2.0), ("k1", 3.0, 4.0, 5.0), ("k1", 6.0, 7.0, 0.8)]
    names = spark.createDataFrame([("k1_Mesh_DS",), ("k1_Mesh",), ("k1",)], "name string")
    assert {r[0] for r in names.select(records.surface_stem("name")).collect()} == {"k1"}


def test_matrices(spark, tmp_path):
    nodes = spark.createDataFrame([("a", [1.0, 0.0, 1e-5, 2.5, 0.0, -1.0, 0.0, 1e16, 0.0, 0.0, 1.0, 0.0]), ("b", None)], "name string, pose array<double>")
    exports.write_matrices(nodes, str(tmp_path / "m"))
    files = list((tmp_path / "m").glob("name=*/*.txt"))
    assert [f.read_text() for f in files] == ["1.0 0.0 1e-05 2.5\n0.0 -1.0 0.0 1e+16\n0.0 0.0 1.0 0.0\n0.0 0.0 0.0 1.0\n"]
