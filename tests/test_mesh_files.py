"""Colours of all formats, GLB files with a tree of nodes, strides and sparse parts, and files that can't be read."""

import json
import struct

import numpy as np
import pytest

from terrafold.sources import gltf, mesh

SQUARE = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], "<f4")


def glb(doc, blob):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    body = struct.pack("<II", len(text), gltf.JSON_CHUNK) + text + struct.pack("<II", len(blob), gltf.BINARY_CHUNK) + blob
    return b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body


def tree(colours=None, mode=4, ids=(0, 1, 2)):
    """A square whose rows stand 20 bytes apart, below a node that scales, below one that turns and shifts."""
    rows = np.zeros(4, np.dtype([("p", "<f4", 3), ("rest", "<u4", 2)]))
    rows["p"] = SQUARE
    blob = rows.tobytes()
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": len(blob), "byteStride": 20}]
    accessors = [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}]
    part = {"attributes": {"POSITION": 0}, "mode": mode}
    if ids is not None:
        part["indices"] = len(accessors)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": 2 * len(ids)})
        accessors.append({"bufferView": len(views) - 1, "componentType": 5123, "count": len(ids), "type": "SCALAR"})
        blob += np.array(ids, "<u2").tobytes() + b"\0" * (-2 * len(ids) % 4)
    plain = {"attributes": {"POSITION": 0}}
    if colours is not None:
        part["attributes"]["COLOR_0"] = len(accessors)
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": colours.nbytes})
        accessors.append({"bufferView": len(views) - 1, "componentType": {"f": 5126, "u": 5123}[colours.dtype.kind], "normalized": colours.dtype.kind == "u", "count": 4, "type": "VEC3"})
        blob += colours.tobytes()
    half = float(np.sqrt(0.5))
    nodes = [{"children": [2, 1], "rotation": [0, 0, half, half], "translation": [10, 0, 0]}, {"mesh": 0, "scale": [2, 2, 2], "translation": [0, 0, 1]}, {"mesh": 1}, {"mesh": 0}]
    doc = {"scene": 1, "scenes": [{"nodes": [3]}, {"nodes": [0]}], "nodes": nodes, "meshes": [{"primitives": [part]}, {"primitives": [plain, {"attributes": {}}]}], "buffers": [{"byteLength": len(blob)}], "bufferViews": views, "accessors": accessors}
    return doc, blob


def test_nodes_below_nodes():
    v, f, c = gltf.read(glb(*tree()))
    turned = lambda p: np.column_stack([-p[:, 1] + 10, p[:, 0], p[:, 2]])
    # children in their order; the part without indices has one triangle of its four rows
    assert np.allclose(v[:4], turned(SQUARE), atol=1e-6) and np.allclose(v[4:], turned(SQUARE * 2 + [0, 0, 1]), atol=1e-5)
    assert f.tolist() == [[0, 1, 2], [4, 5, 6]] and c is None


@pytest.mark.parametrize("mode, want", [(4, [[0, 1, 2]]), (5, [[0, 1, 2], [2, 1, 3]]), (6, [[0, 1, 2], [0, 2, 3]]), (1, []), (0, [])])
def test_modes(mode, want):
    f = gltf.read(glb(*tree(mode=mode, ids=(0, 1, 2, 3))))[1]
    assert (f[1:] - 4).tolist() == want


def test_colours_round_and_parts_without_are_white():
    tint = np.array([[0.3, 0.5, 2.5 / 255], [1.2, -0.1, 1], [0, 0, 0], [1, 1, 1]], "<f4")
    c = gltf.read(glb(*tree(tint)))[2]
    assert (c[:4] == 255).all() and c[4:].tolist() == [[77, 128, 3], [255, 0, 255], [0, 0, 0], [255, 255, 255]]
    wide = np.array([[0, 32768, 65535], [257, 514, 0], [0, 0, 0], [1, 1, 1]], "<u2")
    assert gltf.read(glb(*tree(wide)))[2][4:].tolist() == [[0, 128, 255], [1, 2, 0], [0, 0, 0], [0, 0, 0]]


def test_sparse_rows_replace_others():
    doc, blob = tree()
    at = len(blob) + (-len(blob) % 4)
    blob = blob.ljust(at, b"\0") + struct.pack("<HH", 2, 0) + np.array([7, 8, 9], "<f4").tobytes()
    doc["bufferViews"] += [{"buffer": 0, "byteOffset": at, "byteLength": 2}, {"buffer": 0, "byteOffset": at + 4, "byteLength": 12}]
    doc["accessors"][0]["sparse"] = {"count": 1, "indices": {"bufferView": 2, "componentType": 5123}, "values": {"bufferView": 3}}
    assert gltf.accessor(*gltf.chunks(glb(doc, blob)), 0).tolist() == [[0, 0, 0], [1, 0, 0], [7, 8, 9], [1, 1, 0]]


def test_damaged_documents():
    doc, blob = tree()
    whole = glb(doc, blob)
    doc["nodes"][2]["children"] = [0]
    for bad, why in ((b"", "not a GLB"), (whole[:40], "cut short"), (b"glTF" + struct.pack("<II", 1, 12), "version 1"), (glb(doc, blob), "no tree"), (glb({}, b""), "no scene")):
        with pytest.raises(ValueError, match=why):
            gltf.read(bad)


def files(folder):
    three = "0 0 0 {}\n1 0 0 {}\n0 1 0 {}\n"
    (folder / "a.off").write_text("COFF\n3 1 0\n" + three.format("255 0 0 255", "0 300 0 255", "1.9 2 -3 255") + "3 0 1 2\n")
    (folder / "b.obj").write_text("v 0 0 0 1 0 0\nv 1 0 0 0 1 0\nv 0 1 0 0.5 0.75 2\nv 5 5 5\nf 1 2 3\n")
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty {t} red\nproperty {t} green\nproperty {t} blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (folder / "c.ply").write_text(head.format("ascii", t="float") + three.format("0.5 1.5 2.5", "254.4 300 -1", "7 8 9") + "3 0 1 2\n")
    row = np.zeros(3, np.dtype([("p", ">f4", 3), ("c", "u1", 3)]))
    row["p"], row["c"] = SQUARE[:3], [[1, 2, 3], [4, 5, 6], [7, 8, 9]]
    (folder / "d.PLY").write_bytes(head.format("binary_big_endian", t="uchar").encode() + row.tobytes() + struct.pack(">Biii", 3, 0, 1, 2))
    (folder / "e.stl").write_text("solid\n" + "".join(f"vertex {x} {y} 0\n" for x, y in ((0, 0), (1, 0), (0, 1))) + "endsolid\n")
    (folder / "f.glb").write_bytes(glb(*tree(np.ones((4, 3), "<f4"))))


def test_colours_of_every_format(spark, tmp_path):
    files(tmp_path)
    v, f = mesh.read_meshes(spark, str(tmp_path), colours=True, extensions=mesh.LOADABLE)
    got = {}
    for r in v.orderBy("frag", "vid").collect():
        got.setdefault(r["frag"], []).append((r["r"], r["g"], r["b"]))
    assert got["a"] == [(255, 0, 0), (0, 255, 0), (1, 2, 0)]
    assert got["b"] == [(255, 0, 0), (0, 255, 0), (128, 191, 255), (255, 255, 255)]
    assert got["c"] == [(1, 2, 3), (254, 255, 0), (7, 8, 9)]
    assert got["d"] == [(1, 2, 3), (4, 5, 6), (7, 8, 9)]
    assert got["e"] == [(None, None, None)] * 3 and got["f"] == [(255, 255, 255)] * 8
    assert {r["frag"]: r["n"] for r in f.groupBy("frag").count().withColumnRenamed("count", "n").collect()} == {**dict.fromkeys("abcde", 1), "f": 2}
    # a folder's GLB files are not found unless asked for; colours survive the writer, with white for none
    v, f = mesh.read_meshes(spark, str(tmp_path), colours=True)
    out = tmp_path / "out"
    out.mkdir()
    for r in mesh.ply_contents(v, f).collect():
        (out / f"{r['frag']}.ply").write_bytes(bytes(r["content"]))
    again = mesh.read_meshes(spark, str(out), colours=True)[0]
    rgb = lambda df: {(r["frag"], r["vid"]): tuple(255 if r[k] is None else r[k] for k in "rgb") for r in df.collect()}
    assert rgb(again) == rgb(v) and "f" not in {k[0] for k in rgb(v)}


def test_polygons_of_even_and_uneven_lists(spark, tmp_path):
    head = "ply\nformat binary_little_endian 1.0\nelement vertex 4\nproperty double x\nproperty double y\nproperty double z\nelement face {}\nproperty list uchar int vertex_indices\nend_header\n"
    v = SQUARE.astype("<f8").tobytes()
    (tmp_path / "even.ply").write_bytes(head.format(2).encode() + v + struct.pack("<BiiiiBiiii", 4, 0, 1, 3, 2, 4, 3, 2, 1, 0))
    (tmp_path / "odd.ply").write_bytes(head.format(2).encode() + v + struct.pack("<BiiiiBiii", 4, 0, 1, 3, 2, 3, 3, 2, 1))
    (tmp_path / "none.ply").write_bytes(head.format(0).encode() + v)
    f = mesh.read_meshes(spark, str(tmp_path))[1]
    got = {}
    for r in f.orderBy("frag", "fid").collect():
        got.setdefault(r["frag"], []).append((r["v0"], r["v1"], r["v2"]))
    assert got == {"even": [(0, 1, 3), (0, 3, 2), (3, 2, 1), (3, 1, 0)], "odd": [(0, 1, 3), (0, 3, 2), (3, 2, 1)]}


def test_files_that_cannot_be_read(spark, tmp_path):
    files(tmp_path)
    (tmp_path / "g.glb").write_bytes(b"nothing")
    (tmp_path / "h.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 9\n")
    (tmp_path / "notes.txt").write_text("?")
    (tmp_path / "bare").write_text("?")
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in mesh.unreadable(spark, str(tmp_path)).collect()}
    assert set(got) == {"g.glb", "h.off", "notes.txt", "bare"} and "not a GLB" in got["g.glb"] and "no vertex" in got["h.off"]
    assert got["notes.txt"] == "unsupported extension txt" and got["bare"] == "unsupported extension (none)"
    with pytest.raises(Exception, match="h.off"):
        mesh.read_meshes(spark, str(tmp_path))[0].collect()
