"""Triangle meshes as tables: PLY, OBJ, STL, OFF and GLB files read by Spark, and written as OBJ text or PLY bytes.

Files are found and read by Spark's own file source, one row each; a small
parser turns a file's bytes into arrays, which are exploded into vertex and face
rows. Everything after that is DataFrame work (see operators.mesh).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.sources import gltf

#: Kinds of files that are found in a folder, and those that can be read.
EXTENSIONS = ("ply", "obj", "stl", "off")
LOADABLE = (*EXTENSIONS, "glb")
#: Scalar types of PLY headers, fixed values.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def _fan(polygons) -> np.ndarray:
    """Triangles of polygons, around the first corner of each."""
    out = [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]
    return np.array(out, np.int64).reshape(-1, 3)


def _off(data: bytes):
    words = [w for line in data.decode().splitlines() if (w := line.split("#")[0].split())]
    head = words.pop(0)
    sizes = head[1:] or words.pop(0)
    n, m = int(sizes[0]), int(sizes[1])
    v = np.array([[float(x) for x in w[:3]] for w in words[:n]]).reshape(-1, 3)
    # a colour is the whole number that its word begins with
    whole = lambda x: float(found[0]) if (found := re.match(r"[+-]?\d+", x)) else 0.0
    c = gltf.bytes_of(np.array([[whole(x) for x in w[3:6]] for w in words[:n]]).reshape(-1, 3)) if head[0].upper() == "COFF" else None
    return v, _fan([[int(x) for x in w[1 : 1 + int(w[0])]] for w in words[n : n + m]]), c


def _obj(data: bytes):
    v, c, polygons = [], {}, []
    for line in data.decode(errors="replace").splitlines():
        w = line.split()
        if w and w[0] == "v":
            if len(w) >= 7:
                c[len(v)] = [float(x) for x in w[4:7]]
            v.append([float(x) for x in w[1:4]])
        elif w and w[0] == "f":
            ids = [int(x.split("/")[0]) for x in w[1:]]
            polygons.append([i - 1 if i > 0 else len(v) + i for i in ids])
    colours = np.full((len(v), 3), 255, np.uint8)
    if c:
        # they run from 0 to 1 in single precision
        colours[list(c)] = gltf.bytes_of(np.array(list(c.values()), np.float32).astype(float) * 255)
    return np.array(v).reshape(-1, 3), _fan(polygons), colours if c else None


def _stl(data: bytes):
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack_from("<I", data, 80)[0]:
        t = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)["v"]
        v = t.reshape(-1, 3).astype(float)
    else:
        v = np.array([[float(x) for x in line.split()[1:4]] for line in data.decode().splitlines() if line.split()[:1] == ["vertex"]]).reshape(-1, 3)
    return v, np.arange(len(v), dtype=np.int64).reshape(-1, 3), None


def _ply(data: bytes):
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    kind, elements = "ascii", []
    for line in data[:end].decode().splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            kind = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[1:-1]))
    v, c, polygons = np.empty((0, 3)), None, np.empty((0, 3), np.int64)
    text = iter(data[body:].split()) if kind == "ascii" else None
    order = ">" if kind == "binary_big_endian" else "<"
    at = body

    def take(t: str):
        nonlocal at
        if text is not None:
            return float(next(text)) if PLY_TYPES[t][0] == "f" else int(next(text))
        d = np.dtype(order + PLY_TYPES[t])
        at += d.itemsize
        return np.frombuffer(data, d, 1, at - d.itemsize)[0]

    def columns(n: int, props: list):
        """The values of n rows without lists, a column each."""
        nonlocal at
        if text is not None:
            cells = np.array(list(islice(text, n * len(props)))).astype(float).reshape(n, len(props))
            return {p: cells[:, i] for i, (p, _) in enumerate(props)}
        d = np.dtype([(p, order + PLY_TYPES[t[0]]) for p, t in props])
        at += n * d.itemsize
        return np.frombuffer(data, d, n, at - n * d.itemsize)

    def even(n: int, t: list[str]):
        """Lists that all have as many items as the first, as one array, or None; only of binary files."""
        nonlocal at
        count = np.dtype(order + PLY_TYPES[t[1]])
        if text is not None or not n or at + count.itemsize > len(data):
            return None
        d = np.dtype([("n", count), ("i", order + PLY_TYPES[t[2]], int(np.frombuffer(data, count, 1, at)[0]))])
        if at + n * d.itemsize > len(data):
            return None
        rows = np.frombuffer(data, d, n, at)
        if (rows["n"] != rows["n"][0]).any():
            return None
        at += n * d.itemsize
        return rows["i"].astype(np.int64)

    for name, n, props in elements:
        if all(p[1][0] != "list" for p in props):
            rows = columns(n, props)
            if name == "vertex":
                v = np.stack([rows[k].astype(float) for k in "xyz"], 1)
                if {"red", "green", "blue"} <= {p for p, _ in props}:
                    c = gltf.bytes_of(np.stack([rows[k].astype(float) for k in ("red", "green", "blue")], 1))
            continue
        if len(props) == 1 and (lists := even(n, props[0][1])) is not None:
            if name == "face" and lists.shape[1] > 2:
                polygons = np.stack([np.stack([lists[:, 0], lists[:, i], lists[:, i + 1]], 1) for i in range(1, lists.shape[1] - 1)], 1).reshape(-1, 3)
            continue
        found = []
        for _ in range(n):
            row = {}
            for p, t in props:
                row[p] = [int(take(t[2])) for _ in range(int(take(t[1])))] if t[0] == "list" else take(t[0])
            found.append(row)
        if name == "vertex":
            v = np.array([[float(r[k]) for k in "xyz"] for r in found]).reshape(-1, 3)
        elif name == "face":
            polygons = _fan([next(x for x in r.values() if isinstance(x, list)) for r in found])
    return v, polygons, c


PARSERS = {"ply": _ply, "obj": _obj, "stl": _stl, "off": _off, "glb": gltf.read}


def find_meshes(spark: SparkSession, folder: str | list[str], excluded: DataFrame | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, name, size, ext: mesh files of a folder (any case of extension), without excluded(name).

    The name is the file's stem, or its whole name with _ for . where stems collide.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"))
    last = F.element_at(F.split("path", "/"), -1)
    f = files.select("path", "size", last.alias("last")).withColumn("ext", F.lower(F.regexp_extract("last", r"\.([^.]*)$", 1))).where(F.col("ext").isin(*extensions))
    f = f.withColumn("stem", F.regexp_replace("last", r"\.[^.]*$", ""))
    many = f.groupBy("stem").agg(F.count(F.lit(1)).alias("c"))
    f = f.join(many, "stem").select("path", F.when(F.col("c") > 1, F.replace(F.col("last"), F.lit("."), F.lit("_"))).otherwise(F.col("stem")).alias("name"), "size", "ext")
    return f.join(excluded.select("name"), "name", "left_anti") if excluded is not None else f


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, name, ext, content in zip(f.path, f.name, f.ext, f.content):
            row = {"path": path, "frag": name, "v": None, "f": None, "c": None, "error": None}
            try:
                v, t, c = PARSERS[ext](bytes(content))
                if len(t) and not 0 <= t.min() <= t.max() < len(v):
                    raise ValueError("a face has a corner that is no vertex")
                row |= {"v": v.ravel().tolist(), "f": t.ravel().tolist(), "c": None if c is None else c.ravel().tolist()}
            except Exception as e:  # noqa: BLE001  any damage of a file is told with its name
                row["error"] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame([row])


def _files(spark: SparkSession, folder: str | list[str], extensions: tuple[str, ...]) -> DataFrame:
    names = find_meshes(spark, folder, extensions=extensions).select("path", "name", "ext")
    files = spark.read.format("binaryFile").load(folder).select("path", "content").join(names, "path")
    return files.mapInPandas(_parsed, "path string, frag string, v array<double>, f array<long>, c array<int>, error string")


def read_meshes(spark: SparkSession, folder: str | list[str], colours: bool = False, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """vertices(frag, vid, x, y, z) and faces(frag, fid, v0, v1, v2) of mesh files, in a folder or named; polygons become fans.

    With ``colours``, vertices have r, g, b from 0 to 255, null where a file has
    none. GLB files are read where ``extensions`` is LOADABLE. A file that can't be
    read fails the job with its name; ``unreadable`` lists such files.
    """
    rows = _files(spark, folder, extensions)
    rows = rows.withColumn("v", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).otherwise(F.col("v")))
    three = lambda a: F.transform(F.sequence(F.lit(0), (F.size(a) / 3 - 1).cast("int")), lambda i: F.slice(F.col(a), i * 3 + 1, 3))
    at = lambda c, i: F.element_at(c, i)
    tint = [F.get("c", F.col("vid") * 3 + i).alias(k) for i, k in enumerate("rgb")] if colours else []
    v = rows.where(F.size("v") > 0).select("frag", "c", F.posexplode(three("v")).alias("vid", "p")).select("frag", "vid", *[at("p", i + 1).alias(c) for i, c in enumerate("xyz")], *tint)
    f = rows.where(F.size("v") > 0).where(F.size("f") > 0).select("frag", F.posexplode(three("f")).alias("fid", "p")).select("frag", "fid", *[at("p", i + 1).cast("int").alias(f"v{i}") for i in range(3)])
    return v, f


def unreadable(spark: SparkSession, folder: str | list[str], extensions: tuple[str, ...] = LOADABLE) -> DataFrame:
    """path, error: files of a folder that are no meshes by their extension, or that can't be read as what it says."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"\.([^.]*)$", 1))
    other = files.where(~ext.isin(*extensions)).select("path", F.concat(F.lit("unsupported extension "), F.when(ext == "", "(none)").otherwise(ext)).alias("error"))
    return other.unionByName(_files(spark, folder, extensions).where("error is not null").select("path", "error"))


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One OBJ text per fragment under path/frag=NAME; vertices come first, in order of vid."""
    v = vertices.select("frag", F.lit(0).alias("k"), F.col("vid").alias("i"), F.format_string("v %.9g %.9g %.9g", "x", "y", "z").alias("value"))
    f = faces.select("frag", F.lit(1).alias("k"), F.col("fid").alias("i"), F.format_string("f %d %d %d", F.col("v0") + 1, F.col("v1") + 1, F.col("v2") + 1).alias("value"))
    v.unionByName(f).repartition("frag").sortWithinPartitions("frag", "k", "i").select("frag", "value").write.partitionBy("frag").text(path)


def ply_contents(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """frag, content: each fragment as a binary little-endian PLY file, doubles for places and colours r, g, b if vertices has them (null: white).

    Vertices are numbered anew in order of vid. A fragment is one mesh and has
    to fit a task, as it does where its file is read.
    """
    colours = all(c in vertices.columns for c in ("r", "g", "b"))
    fields = ["vid", "x", "y", "z", *(["r", "g", "b"] if colours else [])]
    v = vertices.groupBy("frag").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("v"))
    f = faces.groupBy("frag").agg(F.sort_array(F.collect_list(F.struct("fid", "v0", "v1", "v2"))).alias("f"))
    rows = v.join(f, "frag", "left").select("frag", *[F.col(f"v.{c}").alias(c) for c in fields], *[F.coalesce(F.col(f"f.{c}"), F.array().cast("array<long>")).alias(c) for c in ("v0", "v1", "v2")])

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = [("x", "<f8"), ("y", "<f8"), ("z", "<f8")] + ([("r", "u1"), ("g", "u1"), ("b", "u1")] if colours else [])
        named = "".join(f"property double {c}\n" for c in "xyz") + ("".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) if colours else "")
        for b in frames:
            out = []
            for r in b.to_dict("records"):
                vs, fs = np.zeros(len(r["vid"]), kind), np.zeros(len(r["v0"]), [("n", "u1"), ("v", "<i4", 3)])
                for c, _ in kind:
                    vs[c] = r[c] if c in "xyz" else [255 if x is None or x != x else x for x in r[c]]
                fs["n"] = 3
                fs["v"] = np.searchsorted(np.asarray(r["vid"]), np.stack([np.asarray(r[c], np.int64) for c in ("v0", "v1", "v2")], 1)) if len(fs) else 0
                head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vs)}\n{named}element face {len(fs)}\nproperty list uchar int vertex_indices\nend_header\n"
                out.append(head.encode() + vs.tobytes() + fs.tobytes())
            yield pd.DataFrame({"frag": b["frag"], "content": out})

    return rows.mapInPandas(fill, "frag string, content binary")


def placed_meshes(vertices: DataFrame, poses: DataFrame) -> DataFrame:
    """vertices moved by poses(frag, pose); those of fragments without a pose stay away."""
    from terrafold.functions.poses import apply

    j = vertices.join(poses.select("frag", "pose"), "frag")
    moved = apply("pose", ["x", "y", "z"])
    return j.select(*[m.alias(c) if c in "xyz" else F.col(c) for c, m in [*zip("xyz", moved), *[(c, None) for c in vertices.columns if c not in ("x", "y", "z")]]]).select(*vertices.columns)


def merged_meshes(vertices: DataFrame, faces: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One mesh for each group of groups(frag, grp): vertices and faces numbered on, fragment after fragment; frag is then the group."""
    from pyspark.sql import Window

    def offsets(rows: DataFrame, ident: str) -> DataFrame:
        n = rows.groupBy("frag").agg((F.max(ident) + 1).alias("n")).join(groups, "frag")
        w = Window.partitionBy("grp").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)
        return n.select("frag", "grp", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("at"))

    ov, of = offsets(vertices, "vid"), offsets(faces, "fid")
    v = vertices.join(ov, "frag").withColumn("vid", F.col("vid") + F.col("at")).withColumn("frag", F.col("grp").cast("string")).drop("grp", "at")
    f = faces.join(ov, "frag").join(of.select("frag", F.col("at").alias("fat")), "frag")
    f = f.select(F.col("grp").cast("string").alias("frag"), (F.col("fid") + F.col("fat")).alias("fid"), *[(F.col(c) + F.col("at")).alias(c) for c in ("v0", "v1", "v2")])
    return v, f
