"""GLB files: a binary container of a JSON document and one buffer, whose tree of nodes places meshes."""

from __future__ import annotations

import json
import struct

import numpy as np

#: Component types and widths of accessors, chunk types and modes of triangles; fixed values.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
JSON_CHUNK, BINARY_CHUNK = 0x4E4F534A, 0x004E4942
TRIANGLES, STRIP, FAN = 4, 5, 6


def bytes_of(values: np.ndarray) -> np.ndarray:
    """Numbers on a scale to 255 as bytes: clamped, halves up, NaN as 0."""
    v = np.clip(np.nan_to_num(values, nan=0.0), 0, 255)
    low = np.floor(v)
    return (low + (v - low >= 0.5)).astype(np.uint8)


def chunks(data: bytes) -> tuple[dict, bytes]:
    """The document and the buffer (empty if there is none)."""
    if len(data) < 12 or data[:4] != b"glTF":
        raise ValueError("not a GLB file")
    version, total = struct.unpack_from("<II", data, 4)
    if version != 2 or total > len(data):
        raise ValueError(f"version {version}" if version != 2 else "the file is cut short")
    found, at = {}, 12
    while at + 8 <= total:
        size, kind = struct.unpack_from("<II", data, at)
        found.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size
    if JSON_CHUNK not in found:
        raise ValueError("no document")
    return json.loads(found[JSON_CHUNK]), found.get(BINARY_CHUNK, b"")


def _view(doc: dict, blob: bytes, part: dict, kind: np.dtype, width: int, n: int) -> np.ndarray | None:
    """n rows of a part of the buffer, which may be spaced by a stride; None where the buffer is elsewhere."""
    view = doc["bufferViews"][part["bufferView"]]
    buffer = view.get("buffer", 0)
    if buffer or "uri" in doc["buffers"][buffer]:
        return None
    step = view.get("byteStride") or kind.itemsize * width
    return np.ndarray((n, width), kind, blob, view.get("byteOffset", 0) + part.get("byteOffset", 0), (step, kind.itemsize))


def accessor(doc: dict, blob: bytes, index: int) -> np.ndarray | None:
    """An accessor's rows, sparse ones filled in; whole numbers that stand for 0 to 1 as floats."""
    a = doc["accessors"][index]
    kind, width, n = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]], a["count"]
    if "bufferView" not in a and "sparse" not in a:
        return None
    rows = _view(doc, blob, a, kind, width, n) if "bufferView" in a else np.zeros((n, width), kind)
    if rows is not None and (few := a.get("sparse")):
        at = _view(doc, blob, few["indices"], np.dtype(COMPONENTS[few["indices"]["componentType"]]), 1, few["count"])
        rows = rows.copy()
        rows[at[:, 0]] = _view(doc, blob, few["values"], kind, width, few["count"])
    if rows is not None and a.get("normalized") and kind.kind in "iu":
        return np.maximum(rows.astype(np.float32) / np.float32(np.iinfo(kind).max), np.float32(-1))
    return rows


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b in single precision, terms added in order."""
    return a[:, :1] * b[:1] + a[:, 1:2] * b[1:2] + a[:, 2:3] * b[2:3] + a[:, 3:] * b[3:]


def local_matrix(node: dict) -> np.ndarray:
    """Where a node stands in its parent: its matrix, or its turn, scale and shift."""
    if "matrix" in node:
        return np.array(node["matrix"], np.float32).reshape(4, 4).T
    x, y, z, w = np.array(node.get("rotation", (0, 0, 0, 1)), np.float32)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]], np.float32)
    m = np.eye(4, dtype=np.float32)
    m[:3, :3] = turn * np.array(node.get("scale", (1, 1, 1)), np.float32)
    m[:3, 3] = node.get("translation", (0, 0, 0))
    return m


def placed_nodes(doc: dict) -> list[tuple[dict, np.ndarray]]:
    """The nodes of the default scene (or the first) with where they stand in it, each before its children."""
    scenes, nodes = doc.get("scenes") or [], doc.get("nodes") or []
    if not scenes:
        raise ValueError("no scene")
    # the last is taken first, so children are put on backwards
    waiting = [(i, np.eye(4, dtype=np.float32)) for i in reversed(scenes[doc.get("scene", 0)].get("nodes", []))]
    out, seen = [], set()
    while waiting:
        i, parent = waiting.pop()
        if i in seen:
            raise ValueError("the nodes are no tree")
        seen.add(i)
        world = _product(parent, local_matrix(nodes[i]))
        out.append((nodes[i], world))
        waiting += [(k, world) for k in reversed(nodes[i].get("children", []))]
    return out


def triangles(ids: np.ndarray, mode: int) -> np.ndarray:
    """Rows of three corners; every other one of a strip is turned around. Points and lines have none."""
    if mode == TRIANGLES:
        return ids[: len(ids) // 3 * 3].reshape(-1, 3)
    k = np.arange(max(len(ids) - 2, 0))
    if mode == STRIP:
        odd = k % 2
        return np.stack([ids[k + odd], ids[k + 1 - odd], ids[k + 2]], 1)
    if mode == FAN:
        return np.stack([ids[k * 0], ids[k + 1], ids[k + 2]], 1)
    return np.empty((0, 3), np.int64)


def read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Vertices, faces and colours (None if no part has any; parts without are white). Parts without places in the file are passed over."""
    doc, blob = chunks(data)
    vs, fs, cs, coloured, n = [np.empty((0, 3))], [np.empty((0, 3), np.int64)], [np.empty((0, 3), np.uint8)], False, 0
    for node, world in placed_nodes(doc):
        for part in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else ():
            named = part["attributes"]
            p = accessor(doc, blob, named["POSITION"]) if "POSITION" in named else None
            if p is None:
                continue
            p = p.astype(np.float32)
            vs.append(np.stack([world[r, 0] * p[:, 0] + world[r, 1] * p[:, 1] + world[r, 2] * p[:, 2] + world[r, 3] for r in range(3)], 1).astype(float))
            c = np.full((len(p), 3), 255, np.uint8)
            tint = accessor(doc, blob, named["COLOR_0"]) if "COLOR_0" in named else None
            if tint is not None:
                coloured = True
                whole = np.iinfo(tint.dtype).max if tint.dtype.kind == "u" else 1
                tint = tint[: len(p), :3].astype(np.float32) / np.float32(whole)
                c[: len(tint)] = bytes_of(tint.astype(float) * 255)
            cs.append(c)
            ids = accessor(doc, blob, part["indices"])[:, 0].astype(np.int64) if "indices" in part else np.arange(len(p))
            fs.append(triangles(ids, part.get("mode", TRIANGLES)) + n)
            n += len(p)
    return np.concatenate(vs), np.concatenate(fs), np.concatenate(cs) if coloured else None
