"""glTF by byte ranges: heads, scenes of node instances in world space, and geometry decoded from accessors."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meshlark.functions.worker import ship
from meshlark.operators.trees import matmul4
from meshlark.sources.models import BAD_HEADER, BAD_JSON, BAD_LENGTH, CORNERS, TRIANGLES, gltf_documents
from meshlark.sources.places import located

ship(__name__)

SCENE_SCHEMA = """asset struct<version string>,
    meshes array<struct<name string, primitives array<struct<attributes map<string,int>, indices int, material int, mode int>>>>,
    accessors array<struct<bufferView int, byteOffset bigint, componentType int, normalized boolean, count bigint, type string,
        min array<double>, max array<double>, sparse struct<count bigint>>>,
    bufferViews array<struct<buffer int, byteOffset bigint, byteLength bigint, byteStride bigint>>,
    buffers array<struct<byteLength bigint, uri string>>,
    materials array<struct<name string>>,
    nodes array<struct<name string, mesh int, children array<int>, translation array<double>, rotation array<double>,
        scale array<double>, matrix array<double>>>"""
UNREADABLE = "File cannot be read"

# -- heads ------------------------------------------------------------------

_HEAD = pa.schema([
    ("path", pa.string()), ("length", pa.int64()), ("json", pa.string()), ("bin_start", pa.int64()), ("bin_length", pa.int64()),
    ("bytes_read", pa.int64()), ("error_message", pa.string())])
HEAD = "path string, length long, json string, bin_start long, bin_length long, bytes_read long, error_message string"


def _head(path: str) -> tuple:
    system, name = located(path)
    with system.open_input_file(name) as file:
        size = file.size()
        if name.lower().endswith(".gltf"):
            return size, file.read_at(size, 0).decode("utf-8", "replace"), None, None, size, None
        head = file.read_at(20, 0)
        if len(head) < 20 or head[:4] != b"glTF" or head[16:] != b"JSON":
            return size, None, None, None, len(head), BAD_HEADER
        held = int.from_bytes(head[12:16], "little")
        if 20 + held > size:
            return size, None, None, None, 20, BAD_LENGTH
        text, after = file.read_at(held, 20), file.read_at(8, 20 + held)
        start, long = 28 + held, int.from_bytes(after[:4], "little")
        if after[4:] != b"BIN\0":
            start = long = None
        wrong = BAD_LENGTH if start is not None and start + long > size else None
        return size, text.decode("utf-8", "replace"), start, long, 20 + held + len(after), wrong


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                row = _head(path)
            except OSError:
                row = None, None, None, None, 0, UNREADABLE
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, *row), _HEAD, strict=True)], schema=_HEAD)


def read_heads(files: DataFrame) -> DataFrame:
    """HEAD columns of each file of ``path``: its JSON and where its binary chunk lies, read by seeking; geometry stays on disk.

    A .glb costs 28 bytes and its JSON chunk, a .gltf all of its text. Files must be where pyarrow's file systems open
    them (local, s3, hdfs, gs); where only Spark reads, take ``scan.asset_contents`` and ``content_documents``.
    """
    return files.select("path").mapInArrow(_heads, HEAD)


def documents(heads: DataFrame) -> DataFrame:
    """path, length, gltf (parsed JSON), error_message, bin_start of heads."""
    parsed = heads.withColumn("gltf", F.from_json("json", SCENE_SCHEMA))
    message = F.coalesce("error_message", F.when(F.col("gltf.asset.version").isNull(), BAD_JSON))
    return parsed.select("path", "length", "gltf", message.alias("error_message"), "bin_start")


def content_documents(files: DataFrame) -> DataFrame:
    """path, length, gltf, error_message of whole contents (path, length, content)."""
    return gltf_documents(files, SCENE_SCHEMA)


# -- scenes -----------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for the row.

    A column that a lambda names once is put into the lambda by the optimizer, and would be computed for every element.
    """
    return F.transform(F.array(value), body)[0]


def _local(node: Column) -> Column:
    """A node's own matrix, row by row: the one it states by columns, or translation, rotation and scale."""
    part = lambda name, k, default: F.coalesce(F.get(node[name], F.lit(k)), F.lit(float(default)))
    x, y, z, w = (part("rotation", k, k == 3) for k in range(4))
    sx, sy, sz = (part("scale", k, 1) for k in range(3))
    tx, ty, tz = (part("translation", k, 0) for k in range(3))
    zero, last = F.lit(0.0), [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    turned = F.array(
        (1 - 2 * (y * y + z * z)) * sx, 2 * (x * y - z * w) * sy, 2 * (x * z + y * w) * sz, tx,
        2 * (x * y + z * w) * sx, (1 - 2 * (x * x + z * z)) * sy, 2 * (y * z - x * w) * sz, ty,
        2 * (x * z - y * w) * sx, 2 * (y * z + x * w) * sy, (1 - 2 * (x * x + y * y)) * sz, tz, *last)
    straight = F.array(sx, zero, zero, tx, zero, sy, zero, ty, zero, zero, sz, tz, *last)
    stated = F.array(*[F.get(node["matrix"], F.lit(4 * j + i)) for i in range(4) for j in range(4)])
    return F.when(F.size(node["matrix"]) == 16, stated).when(node["rotation"].isNull(), straight).otherwise(turned)


def with_worlds(docs: DataFrame) -> DataFrame:
    """Adds ``worlds``: for each node its world matrix (16 numbers, row by row), null on or below a cycle.

    All in the file's row. Parents are found by sorting (child, parent) pairs; then each round replaces a node's
    matrix by its parent's times its own and its parent by the grandparent, so a chain of d nodes takes log2(d) rounds.
    """
    none = F.array().cast("array<int>")

    def pairs(nodes: Column) -> Column:
        of_child = F.flatten(F.transform(nodes, lambda n, i: F.transform(
            F.coalesce(n["children"], none), lambda c: F.struct(c.alias("c"), i.alias("p")))))
        own = F.transform(nodes, lambda _, i: F.struct(i.alias("c"), F.lit(-1).alias("p")))
        return F.sort_array(F.concat(own, F.filter(of_child, lambda x: (x["c"] >= 0) & (x["c"] < F.size(nodes)))))

    last = lambda found: F.filter(found, lambda x, i: F.coalesce(F.get(found, i + 1)["c"] != x["c"], F.lit(True)))
    start = lambda nodes: F.zip_with(nodes, _let(pairs(nodes), last), lambda n, x: F.struct(x["p"].alias("p"), _local(n).alias("m")))

    def doubled(state: Column, _) -> Column:
        above = lambda own: _let(F.get(state, own["p"]), lambda up: F.when(up.isNull(), own).otherwise(
            F.struct(up["p"].alias("p"), matmul4(up["m"], own["m"]).alias("m"))))
        return F.transform(state, above)

    rounds = lambda nodes: F.sequence(F.lit(1), F.floor(F.log2(F.size(nodes) + 1)).cast("int") + 1)
    ended = lambda nodes: F.aggregate(rounds(nodes), start(nodes), doubled)
    nodes = F.coalesce("gltf.nodes", F.array().cast(docs.schema["gltf"].dataType["nodes"].dataType))
    return docs.withColumn("worlds", F.transform(_let(nodes, ended), lambda s: F.when(s["p"] < 0, s["m"])))


def _instances() -> Column:
    """(node_id, mesh, name, world) of every node that shows a mesh."""
    paired = F.zip_with("gltf.nodes", "worlds", lambda n, w: F.struct(n["mesh"].alias("mesh"), n["name"].alias("name"), w.alias("world")))
    each = F.transform(paired, lambda x, i: F.struct(i.alias("node_id"), x["mesh"].alias("mesh"), x["name"].alias("name"), x["world"].alias("world")))
    return _let(F.size("gltf.meshes"), lambda n: F.filter(each, lambda x: (x["mesh"] >= 0) & (x["mesh"] < n)))


def gltf_instances(docs: DataFrame) -> DataFrame:
    """(path, node_id, mesh, name, world): a row for every node that shows a mesh, with its world matrix."""
    shown = F.when(F.col("error_message").isNull(), _instances())  # not a filter: that would be moved below the parsing, and parse twice
    return with_worlds(docs).select("path", F.inline(shown))


def gltf_scene(docs: DataFrame, z_up: bool = False) -> DataFrame:
    """One row a file: status, message, counts over all node instances, used materials, and the box in world space.

    A mesh that several nodes show counts once for each. The box is that of the eight moved corners of each
    instance's own box (POSITION min and max). ``materials`` are the names that shown meshes use. ``z_up`` turns the
    box from glTF's axes to those with z upwards. Broken files are error rows; nothing is exploded or shuffled.
    """
    accessor = lambda i: F.get("gltf.accessors", i)
    faces = lambda p, at: F.when(F.coalesce(p["mode"], F.lit(TRIANGLES)) == TRIANGLES, F.floor(
        F.coalesce(accessor(p["indices"])["count"], at["count"]) / 3)).otherwise(F.lit(0))
    part = lambda p, at: F.struct(
        at["count"].alias("vertices"), faces(p, at).alias("faces"), at["min"].alias("lo"), at["max"].alias("hi"),
        F.get("gltf.materials", p["material"])["name"].alias("material"))
    summed = lambda parts, c: F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[c], F.lit(0)).cast("long"))
    ends = lambda parts, side, pick: F.array(*[pick(F.transform(parts, lambda x: F.get(x[side], F.lit(k)))) for k in range(3)])

    def measured(mesh: Column) -> Column:
        parts = F.transform(mesh["primitives"], lambda p: _let(accessor(p["attributes"]["POSITION"]), lambda at: part(p, at)))
        return _let(parts, lambda found: F.struct(
            summed(found, "vertices").alias("vertices"), summed(found, "faces").alias("faces"), ends(found, "lo", F.array_min).alias("lo"),
            ends(found, "hi", F.array_max).alias("hi"), F.transform(found, lambda x: x["material"]).alias("materials")))

    wide = with_worlds(docs).withColumn("_shown", _let(F.transform("gltf.meshes", measured), lambda meshes: F.filter(
        F.zip_with("gltf.nodes", "worlds", lambda n, w: F.struct(w.alias("m"), F.get(meshes, n["mesh"]).alias("of"))), lambda x: x["of"].isNotNull())))

    def box(x: Column) -> Column:
        """Six numbers: the least and the greatest of the moved corners on each axis."""
        def reach(axis: int, pick) -> Column:
            ends = lambda j: [x["m"][4 * axis + j] * x[side][j] for side in ("lo", "hi")]
            return x["m"][4 * axis + 3] + pick(*ends(0)) + pick(*ends(1)) + pick(*ends(2))

        return F.array(*[reach(k, pick) for pick in (F.least, F.greatest) for k in range(3)])

    boxes = _let(F.transform("_shown", lambda x: _let(F.struct(x["m"].alias("m"), x["of"]["lo"].alias("lo"), x["of"]["hi"].alias("hi")), box)), lambda found: F.array(
        *[fold(F.transform(found, lambda b: b[3 * i + k])) for i, fold in enumerate((F.array_min, F.array_max)) for k in range(3)]))
    wide = wide.withColumn("_box", boxes)
    low, high = ([F.col("_box")[3 * i + k] for k in range(3)] for i in range(2))
    if z_up:
        low, high = [low[0], -high[2], low[1]], [high[0], -low[2], high[1]]
    good = F.col("error_message").isNull()
    names = F.sort_array(F.array_distinct(F.filter(F.flatten(F.transform("_shown", lambda x: x["of"]["materials"])), lambda n: n.isNotNull())))
    shown = F.coalesce("_shown", F.array().cast(wide.schema["_shown"].dataType))
    total = lambda name: F.aggregate(shown, F.lit(0).cast("long"), lambda acc, x: acc + x["of"][name])
    out = wide.select(
        "path", "length", F.when(good, "success").otherwise("error").alias("status"), "error_message",
        F.when(good, total("vertices")).alias("vertices"), F.when(good, total("faces")).alias("faces"),
        F.when(good, F.size(shown)).alias("mesh_count"), F.when(good, F.coalesce(F.size("gltf.nodes"), F.lit(0))).alias("node_count"),
        F.when(good, F.coalesce(names, F.array().cast("array<string>"))).alias("materials"),
        *[F.when(good, side[k]).alias(f"{name}_{c}") for name, side in (("min", low), ("max", high)) for k, c in enumerate("xyz")])
    return out.withColumns({"triangles": F.col("faces"), "quads": F.col("faces") * 0, "ngons": F.col("faces") * 0})


# -- geometry ---------------------------------------------------------------

PIECE = 1 << 18  # elements of an accessor that a row of ranges covers
#: Fixed values of the format: bytes of a component by its type, numbers of components by kind.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
KINDS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
OTHER_MODE, NO_DATA, SPARSE, OUTSIDE = "Not triangles", "No buffer view", "Sparse accessor", "Accessor outside its buffer view"


def _primitives(docs: DataFrame) -> DataFrame:
    """(path, mesh, prim, role, accessor, view, buffer, ...) of the POSITION and index accessors of every primitive."""
    prims = docs.filter("error_message IS NULL").select("path", "gltf", "bin_start", F.posexplode("gltf.meshes").alias("mesh", "_m")).select(
        "path", "gltf", "bin_start", "mesh", F.posexplode("_m.primitives").alias("prim", "_p"))
    roles = F.array(F.struct(F.lit("position").alias("role"), F.col("_p.attributes")["POSITION"].alias("i")), F.struct(F.lit("indices").alias("role"), F.col("_p.indices").alias("i")))
    each = prims.withColumn("_r", F.explode(F.filter(roles, lambda r: r["i"].isNotNull()))).withColumn("a", F.get("gltf.accessors", F.col("_r.i")))
    seen = each.withColumn("v", F.get("gltf.bufferViews", F.col("a.bufferView"))).withColumn("b", F.get("gltf.buffers", F.col("v.buffer")))
    known = lambda values, c: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)
    size = known({k: np.dtype(d).itemsize for k, d in COMPONENTS.items()}, F.col("a.componentType")) * known(KINDS, F.col("a.type"))
    sized = seen.select(
        "path", "mesh", "prim", "_r.role", F.coalesce("_p.mode", F.lit(TRIANGLES)).alias("mode"), F.col("a.count").alias("count"), "a.componentType",
        F.coalesce("a.normalized", F.lit(False)).alias("normalized"), known(KINDS, F.col("a.type")).alias("width"), size.alias("size"),
        F.coalesce("v.byteStride", size).alias("stride"), F.col("a.sparse").isNotNull().alias("sparse"), F.col("v").isNotNull().alias("viewed"),
        F.coalesce("a.byteOffset", F.lit(0)).alias("within"), F.coalesce("v.byteOffset", F.lit(0)).alias("at"), F.col("v.byteLength").alias("held"),
        F.col("b.uri").alias("uri"), "bin_start")
    end = F.col("within") + (F.col("count") - 1) * F.col("stride") + F.col("size")
    reason = F.when(F.col("mode") != TRIANGLES, OTHER_MODE).when(F.col("sparse"), SPARSE).when(~F.col("viewed") | F.col("size").isNull(), NO_DATA).when(
        end > F.col("held"), OUTSIDE).when(F.col("uri").isNull() & F.col("bin_start").isNull(), NO_DATA)
    return sized.withColumn("reason", reason)


def gltf_unread(docs: DataFrame) -> DataFrame:
    """(path, mesh, prim, role, reason) of the accessors that ``gltf_vertices`` and ``gltf_loops`` leave out."""
    return _primitives(docs).filter("reason IS NOT NULL").select("path", "mesh", "prim", "role", "reason")


def _ranges(docs: DataFrame, role: str, piece: int) -> DataFrame:
    """One row for each stretch of an accessor: its file (or text), byte offset and shape."""
    good = _primitives(docs).filter((F.col("role") == role) & F.col("reason").isNull() & (F.col("count") > 0))
    folder, inline = F.regexp_replace("path", "[^/]*$", ""), F.startswith("uri", F.lit("data:"))
    cut_up = good.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(piece).cast("long"))))
    return cut_up.select(
        "path", "mesh", "prim", "first", F.least(F.lit(piece), F.col("count") - F.col("first")).alias("n"), "componentType", "normalized", "width", "size", "stride",
        F.when(F.col("uri").isNull(), F.col("path")).when(~inline, F.concat(folder, F.url_decode("uri"))).alias("file"),
        F.when(inline, F.substring_index("uri", ",", -1)).alias("inline"),
        (F.when(F.col("uri").isNull(), F.col("bin_start")).otherwise(0) + F.col("at") + F.col("within") + F.col("first") * F.col("stride")).alias("offset"))


def decoded(raw: bytes, n: int, kind: int, width: int, stride: int, normalized: bool) -> np.ndarray:
    """n elements of ``width`` numbers each, ``stride`` bytes apart; normalised integers become -1 to 1 or 0 to 1."""
    dtype = np.dtype(COMPONENTS[kind])
    values = np.ndarray((n, width), dtype, raw, strides=(stride, dtype.itemsize))
    if normalized and dtype.kind in "iu":
        return np.maximum(values / np.iinfo(dtype).max, -1.0)
    return values


def _decode(names: list[str], kinds: pa.Schema):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size = (r["n"] - 1) * r["stride"] + r["size"]
                if r["inline"] is not None:
                    raw = base64.b64decode(r["inline"])[r["offset"]:r["offset"] + size]
                else:
                    system, name = located(r["file"])
                    with system.open_input_file(name) as file:
                        raw = file.read_at(size, r["offset"])
                values = decoded(raw, r["n"], r["componentType"], r["width"], r["stride"], r["normalized"])
                place = np.arange(r["first"], r["first"] + r["n"])
                same = [pa.array([r[c]] * r["n"], kinds.field(c).type) for c in ("path", "mesh", "prim")]
                numbers = [pa.array(np.ascontiguousarray(values[:, k]), safe=False).cast(kinds.field(c).type) for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(place, pa.int64()), *numbers], schema=kinds)

    return decode


_KEY = [("path", pa.string()), ("mesh", pa.int32()), ("prim", pa.int32())]


def gltf_vertices(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, mesh, prim, vert_id, x, y, z) of the triangle primitives of ``documents``, in each mesh's own space.

    Only the bytes of POSITION accessors are read, by seeking, ``piece`` elements a row, so one large mesh is read by
    many tasks. What cannot be read so is in ``gltf_unread``.
    """
    kinds = pa.schema([*_KEY, ("vert_id", pa.int64()), *((c, pa.float64()) for c in "xyz")])
    return _ranges(docs, "position", piece).mapInArrow(
        _decode(["x", "y", "z"], kinds), "path string, mesh int, prim int, vert_id long, x double, y double, z double")


def gltf_loops(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, mesh, prim, face_id, pos, vert_id, n) of the triangle primitives, by their indices or in vertex order."""
    kinds = pa.schema([*_KEY, ("k", pa.int64()), ("vert_id", pa.int64())])
    listed = _ranges(docs, "indices", piece).mapInArrow(_decode(["vert_id"], kinds), "path string, mesh int, prim int, k long, vert_id long")
    prims = _primitives(docs)
    plain = prims.filter((F.col("role") == "position") & F.col("reason").isNull() & (F.col("count") > 0)).join(
        prims.filter("role = 'indices'").select("path", "mesh", "prim"), ["path", "mesh", "prim"], "left_anti").select(
        "path", "mesh", "prim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("k")).withColumn("vert_id", F.col("k"))
    return listed.unionByName(plain).select(
        "path", "mesh", "prim", F.floor(F.col("k") / 3).alias("face_id"), (F.col("k") % 3).cast("int").alias("pos"), "vert_id", F.lit(3).alias("n"))


def world_vertices(vertices: DataFrame, instances: DataFrame) -> DataFrame:
    """``gltf_vertices`` once for each node that shows their mesh, with node_id, moved to world space."""
    m, at = F.col("world"), [F.col(c) for c in "xyz"]
    moved = [(m[4 * k + 3] + sum(m[4 * k + j] * at[j] for j in range(3))).alias(c) for k, c in enumerate("xyz")]
    return vertices.join(instances.select("path", "mesh", "node_id", "world"), ["path", "mesh"]).select("path", "node_id", "mesh", "prim", "vert_id", *moved)


# -- writing ----------------------------------------------------------------


def _glb(doc: dict, data: bytes) -> bytes:
    body = json.dumps(doc).encode()
    body += b" " * (-len(body) % 4)
    chunks = len(body).to_bytes(4, "little") + b"JSON" + body + len(data).to_bytes(4, "little") + b"BIN\0" + data
    return b"glTF" + (2).to_bytes(4, "little") + (12 + len(chunks)).to_bytes(4, "little") + chunks


def _write_glb(pdf: pd.DataFrame) -> pd.DataFrame:
    corners = pdf.sort_values("tri_id")[CORNERS].to_numpy("<f4").reshape(-1, 3)
    order = np.arange(len(corners), dtype="<u4")
    doc = {
        "asset": {"version": "2.0"}, "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "accessors": [
            {"bufferView": 0, "componentType": 5126, "type": "VEC3", "count": len(corners), "min": corners.min(0).tolist(), "max": corners.max(0).tolist()},
            {"bufferView": 1, "componentType": 5125, "type": "SCALAR", "count": len(order)}],
        "bufferViews": [{"buffer": 0, "byteLength": corners.nbytes}, {"buffer": 0, "byteOffset": corners.nbytes, "byteLength": order.nbytes}],
        "buffers": [{"byteLength": corners.nbytes + order.nbytes}],
    }
    return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [_glb(doc, corners.tobytes() + order.tobytes())]})


def glb_files_of(tris: DataFrame) -> DataFrame:
    """path, content of binary glTF files of (path, tri_id, corners); each path's triangles make one file, so keep paths to a file's size."""
    return tris.groupBy("path").applyInPandas(_write_glb, "path string, content binary")
