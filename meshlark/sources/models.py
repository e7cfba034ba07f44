"""Model files to mesh tables: glTF, OBJ and STL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from meshlark.functions.skew import rank_within, running
from meshlark.functions.worker import ship
from meshlark.session import cut

ship(__name__)

# -- glTF -------------------------------------------------------------------

GLTF_SCHEMA = """asset struct<version string>,
    meshes array<struct<name string, primitives array<struct<attributes map<string,int>, indices int, material int, mode int>>>>,
    accessors array<struct<count bigint, min array<double>, max array<double>>>,
    materials array<struct<name string>>,
    nodes array<struct<name string, mesh int, children array<int>, translation array<double>, matrix array<double>>>"""
GLB_MAGIC, JSON_CHUNK = "676C5446", "4A534F4E"  # 'glTF' and 'JSON'
BAD_HEADER, BAD_JSON, BAD_LENGTH = "Invalid header", "Invalid JSON chunk", "Chunk longer than the file"
TRIANGLES = 4  # primitive mode


def _u32(content: Column, at: int) -> Column:
    """Little-endian unsigned 32-bit number at byte ``at`` (from 1)."""
    byte = lambda i: F.hex(F.substring(content, at + i, 1))
    return F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long")


def gltf_documents(files: DataFrame, schema: str = GLTF_SCHEMA) -> DataFrame:
    """path, length, gltf (parsed JSON), error_message of .glb contents or .gltf text (path, length, content)."""
    content = F.col("content")
    text = F.endswith(F.lower("path"), F.lit(".gltf"))
    framed = (F.hex(F.substring(content, 1, 4)) == GLB_MAGIC) & (F.hex(F.substring(content, 17, 4)) == JSON_CHUNK)
    size, held = _u32(content, 13), F.length(content) - 20
    body = F.when(text, content).when(framed, F.substring(content, F.lit(21), F.least(size, held.cast("long")).cast("int")))
    parsed = files.withColumn("gltf", F.from_json(F.decode(body, "UTF-8"), schema))
    message = F.when(~text & ~F.coalesce(framed, F.lit(False)), BAD_HEADER).when(~text & (size > held), BAD_LENGTH).when(F.col("gltf.asset.version").isNull(), BAD_JSON)
    return parsed.select("path", "length", "gltf", message.alias("error_message"))


def gltf_stats(files: DataFrame) -> DataFrame:
    """One row per file: status, counts, materials, box. A broken file is an error row, never an exception.

    A file's meshes are arrays of its own row, so everything is computed in
    place with higher-order functions: no explode, join or shuffle.
    """
    docs = gltf_documents(files)
    no_primitives = F.array().cast("array<struct<attributes:map<string,int>,indices:int,material:int,mode:int>>")
    prims = F.flatten(F.transform(F.coalesce("gltf.meshes", F.array()), lambda m: F.coalesce(m["primitives"], no_primitives)))
    accessor = lambda i: F.get("gltf.accessors", i)
    position = lambda p: accessor(p["attributes"]["POSITION"])
    corners = lambda p: F.coalesce(accessor(p["indices"])["count"], position(p)["count"])
    faces = lambda p: F.when(F.coalesce(p["mode"], F.lit(TRIANGLES)) == TRIANGLES, F.floor(corners(p) / 3)).otherwise(F.lit(0))
    total = lambda f: F.aggregate("prims", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(f(p), F.lit(0)).cast("long"))
    end = lambda side, i, pick: pick(F.transform("prims", lambda p: F.get(position(p)[side], F.lit(i))))
    good = F.col("error_message").isNull()
    wide = docs.withColumn("prims", prims)
    cols = {f"min_{c}": end("min", i, F.array_min) for i, c in enumerate("xyz")} | {f"max_{c}": end("max", i, F.array_max) for i, c in enumerate("xyz")}
    names = F.array_sort(F.array_distinct(F.filter(F.transform("gltf.materials", lambda m: m["name"]), lambda n: n.isNotNull())))
    out = wide.select(
        "path", "length", F.when(good, "success").otherwise("error").alias("status"), "error_message",
        F.when(good, total(lambda p: position(p)["count"])).alias("vertices"),
        F.when(good, total(faces)).alias("faces"),
        F.when(good, F.size(F.coalesce("gltf.meshes", F.array()))).alias("mesh_count"),
        F.when(good, F.size(F.coalesce("gltf.nodes", F.array()))).alias("node_count"),
        F.when(good, F.coalesce(names, F.array().cast("array<string>"))).alias("materials"),
        *[F.when(good, e).alias(n) for n, e in cols.items()],
    )
    # every primitive that counts is triangles
    return out.withColumns({"triangles": F.col("faces"), "quads": F.col("faces") * 0, "ngons": F.col("faces") * 0})


def gltf_nodes(files: DataFrame) -> DataFrame:
    """(path, node_id, parent_id, name, mesh, tx, ty, tz): the node table of each file, for ``trees.world_offset``."""
    docs = gltf_documents(files)
    # a node names itself and, as their parent, its children; both meet in one combined aggregate
    named = docs.select("path", F.posexplode("gltf.nodes").alias("i", "n")).select(
        "path",
        F.inline(F.expr("""concat(
            array(named_struct('node_id', i, 'parent_id', CAST(NULL AS INT), 'n', n)),
            transform(coalesce(n.children, array()), c -> named_struct('node_id', c, 'parent_id', i, 'n', CAST(NULL AS STRUCT<name: STRING, mesh: INT, children: ARRAY<INT>, translation: ARRAY<DOUBLE>, matrix: ARRAY<DOUBLE>>)))
        )""")),
    )
    move = lambda i: F.coalesce(F.max(F.get("n.translation", F.lit(i))), F.lit(0.0))
    return named.groupBy("path", "node_id").agg(
        F.max("parent_id").alias("parent_id"), F.max("n.name").alias("name"), F.max("n.mesh").alias("mesh"),
        *[move(i).alias(f"t{c}") for i, c in enumerate("xyz")],
    )


# -- OBJ --------------------------------------------------------------------


BAD_VERTEX, BAD_FACE, NO_VERTEX = "Invalid vertex line", "Invalid face line", "Face of a vertex that is not there"


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, block, seq, value, nv, nf) with nv and nf, 0 or 1, summed up from the block's first row on."""
    last, sums = None, np.zeros(2, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = np.zeros(n, bool)
        for k in range(2):
            fresh[1:] |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
        first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        if first != last:
            sums = np.zeros(2, np.int64)
        since = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        out = []
        for k in range(2):
            one = batch.column(4 + k).to_numpy()
            whole = np.cumsum(one)
            out.append(whole - (whole - one)[since] + np.where(since == 0, sums[k], 0))
        last, sums = (batch.column(0)[n - 1].as_py(), batch.column(1)[n - 1].as_py()), np.array([o[-1] for o in out])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, out)], names=["path", "block", "seq", "value", "nv", "nf"])


def obj_counted(lines: DataFrame) -> DataFrame:
    """Adds nv and nf: how many vertex and face lines of its block there are up to each line.

    For lines straight from ``scan.asset_lines``, where a task has a block's lines one after the other, so none is moved.
    """
    kind = F.split(F.trim("value"), "\\s+")[0]
    marked = lines.select("path", "block", "seq", "value", *[F.when(kind == k, 1).otherwise(0).cast("long").alias(f"n{k}") for k in "vf"])
    return marked.mapInArrow(_count_blocks, "path string, block long, seq long, value string, nv long, nf long")


def _counted_through(lines: DataFrame) -> DataFrame:
    """``obj_counted`` lines with nv and nf counted from the file's first line on: one small row a later block is added to its lines."""
    sums = lines.groupBy("path", "block").agg(F.max("nv").alias("nv"), F.max("nf").alias("nf"))
    by = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("path", "block", F.sum("nv").over(by).alias("_v"), F.sum("nf").over(by).alias("_f")).filter("block > 0")
    joined = lines.join(cut(before, "blocks"), ["path", "block"], "left")
    return joined.withColumns({f"n{k}": F.col(f"n{k}") + F.coalesce(f"_{k}", F.lit(0)) for k in "vf"}).drop("_v", "_f")


def obj_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices(path, vert_id, x, y, z) and loops(path, face_id, pos, vert_id, n) of OBJ lines, ids from 0.

    Negative references count back from the vertices read so far. What is no number is null: take the lines that
    ``obj_quarantine`` calls good. Lines of ``obj_counted`` are numbered where they are read, others are moved for it.
    """
    words = F.split(F.trim("value"), "\\s+")
    args = F.slice(words, 2, 1_000_000_000)
    counted = "nv" in lines.columns
    if counted:
        lines = _counted_through(lines)
    kept = lines.select("path", "block", "seq", words[0].alias("kind"), "value", *(["nv", "nf"] if counted else []))
    # only text that is still read is numbered along: vertex lines alone for vertices, face lines and bare vertex marks for faces
    numbered = lambda rows, **counts: rows if counted else running(rows, ["path"], ["block", "seq"], counts, pieces=[F.col("block")])
    is_v, is_f = (F.when(F.col("kind") == k, 1).otherwise(0).cast("long") for k in "vf")
    at = F.col("nv") - 1
    verts = numbered(kept.filter("kind = 'v'"), nv=is_v).select(
        "path", at.alias("vert_id"), *[F.get(args, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")]
    )
    faces = kept.filter("kind IN ('v', 'f')").withColumn("value", F.when(F.col("kind") == "f", F.col("value")))
    ref = F.split("arg", "/")[0].try_cast("long")
    loops = (
        numbered(faces, nv=is_v, nf=is_f)
        .filter("kind = 'f'")
        .select("path", (F.col("nf") - 1).alias("face_id"), "nv", F.size(args).alias("n"), F.posexplode(args).alias("pos", "arg"))
        .select("path", "face_id", "pos", F.when(ref < 0, F.col("nv") + ref).otherwise(ref - 1).alias("vert_id"), "n")
    )
    return verts, loops


def obj_status(lines: DataFrame) -> DataFrame:
    """(path, status, error_message, vertices, faces) of every file that has a line; the message is of its first bad line."""
    words = F.split(F.trim("value"), "\\s+")
    kind, args = words[0], F.slice(words, 2, 1_000_000_000)
    refs = F.transform(args, lambda a: F.split(a, "/")[0].try_cast("long"))
    is_v, is_f = kind == "v", kind == "f"
    wrong = F.when(is_v & ((F.size(args) < 3) | F.exists(F.slice(args, 1, 3), lambda a: a.try_cast("double").isNull())), BAD_VERTEX).when(
        is_f & ((F.size(args) < 3) | F.exists(refs, lambda r: r.isNull() | (r == 0))), BAD_FACE)
    read = lines.select("path", "block", "seq", is_v.alias("v"), is_f.alias("f"), wrong.alias("wrong"), F.when(
        is_f, F.array_max(F.transform(refs, F.abs))).alias("far"))
    seen = read.groupBy("path").agg(
        F.count_if("v").alias("vertices"), F.count_if("f").alias("faces"), F.max("far").alias("far"),
        F.min(F.when(F.col("wrong").isNotNull(), F.struct("block", "seq", "wrong"))).alias("first"))
    message = F.coalesce(F.col("first.wrong"), F.when(F.col("far") > F.col("vertices"), NO_VERTEX))
    good = message.isNull()
    return seen.select(
        "path", F.when(good, "success").otherwise("error").alias("status"), message.alias("error_message"),
        F.when(good, F.col("vertices")).alias("vertices"), F.when(good, F.col("faces")).alias("faces"))


def obj_quarantine(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of the good files, one row for each broken file)."""
    broken = obj_status(lines).filter("status = 'error'").select("path", "status", "error_message")
    return lines.join(broken, "path", "left_anti"), broken


def obj_lines_of(vertices: DataFrame, loops: DataFrame) -> DataFrame:
    """OBJ text of tables (path, vert_id from 0, x, y, z) and (path, face_id, pos, vert_id): (path, kind, ord, value)."""
    v = vertices.select(
        "path", F.lit(0).alias("kind"), F.col("vert_id").alias("ord"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("value")
    )
    corner = F.struct("pos", (F.col("vert_id") + 1).cast("string").alias("ref"))  # one text line holds one face
    faces = loops.groupBy("path", "face_id").agg(F.array_sort(F.collect_list(corner)).alias("ring"))
    f = faces.select("path", F.lit(1).alias("kind"), F.col("face_id").alias("ord"), F.concat_ws(" ", F.lit("f"), F.array_join("ring.ref", " ")).alias("value"))
    return v.unionByName(f)


# -- STL --------------------------------------------------------------------

STL_HEADER, STL_RECORD = 84, 50
STL_BATCH = 100_000  # triangles per Arrow batch
_RECORD = np.dtype([("normal", "<f4", 3), ("corners", "<f4", 9), ("attr", "<u2")])
CORNERS = ["ax", "ay", "az", "bx", "by_", "bz", "cx", "cy", "cz"]
STL_SCHEMA = "path string, tri_id long, " + ", ".join(f"{c} double" for c in CORNERS)


def _read_stl(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            records = np.frombuffer(content, dtype=_RECORD, offset=STL_HEADER)
            for at in range(0, len(records), STL_BATCH):
                part = records["corners"][at : at + STL_BATCH].astype("float64")
                out = pd.DataFrame(part, columns=CORNERS)
                out.insert(0, "tri_id", np.arange(at, at + len(part)))
                out.insert(0, "path", path)
                yield out


def is_binary_stl() -> Column:
    """The record count in the header accounts for the file's size exactly."""
    return (F.length("content") >= STL_HEADER) & (F.length("content") == _u32(F.col("content"), 81) * STL_RECORD + STL_HEADER)


BAD_STL = "Length does not fit the header"


def stl_status(files: DataFrame) -> DataFrame:
    """(path, length, status, error_message) of every file: binary with the length that its header says, or whole text.

    Text begins with ``solid``, ends its solid and has three vertex lines a facet; a binary file whose header begins
    so is still judged by its length.
    """
    said = F.when(F.substring("content", 1, 5).cast("string") == "solid", F.col("content").cast("string"))
    lines = lambda word: F.regexp_count(said, F.lit(rf"(?m)^[ \t]*{word}\b"))
    text = (lines("endsolid") > 0) & (lines("vertex") == 3 * lines("facet"))
    good = F.coalesce(is_binary_stl(), F.lit(False)) | F.coalesce(text, F.lit(False))
    return files.select(
        "path", F.length("content").cast("long").alias("length"), F.when(good, "success").otherwise("error").alias("status"),
        F.when(~good, BAD_STL).alias("error_message"))


def stl_triangles(files: DataFrame) -> DataFrame:
    """Triangles of binary STL contents; bytes to floats is the one step Spark SQL has no function for.

    Other contents give no triangles; ``stl_status`` has a row for each.
    """
    return files.filter(is_binary_stl()).select("path", "content").mapInPandas(_read_stl, STL_SCHEMA)


def stl_text_triangles(lines: DataFrame) -> DataFrame:
    """Triangles of ASCII STL lines: every three ``vertex`` lines of a file."""
    words = F.split(F.trim("value"), "\\s+")
    corners = lines.filter(F.startswith(F.ltrim("value"), F.lit("vertex"))).select(
        "path", "block", "seq", *[F.get(words, F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate("xyz")]
    )
    numbered = rank_within(corners, ["path"], ["block", "seq"], "rn", pieces=[F.col("block")]).withColumn("i", F.col("rn") - 1)
    names = [CORNERS[0:3], CORNERS[3:6], CORNERS[6:9]]
    pick = lambda k, c: F.max(F.when(F.col("i") % 3 == k, F.col(c)))
    return numbered.groupBy("path", F.floor(F.col("i") / 3).alias("tri_id")).agg(
        *[pick(k, c).alias(names[k][j]) for k in range(3) for j, c in enumerate("xyz")]
    )


def _write_stl(pdf: pd.DataFrame) -> pd.DataFrame:
    records = np.zeros(len(pdf), dtype=_RECORD)
    records["corners"] = pdf.sort_values("tri_id")[CORNERS].to_numpy("float32")
    head = bytes(80) + len(pdf).to_bytes(4, "little")
    return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [head + records.tobytes()]})


def stl_files_of(tris: DataFrame) -> DataFrame:
    """path, content of binary STL files; each path's triangles make one file, so keep paths to a file's size."""
    return tris.groupBy("path").applyInPandas(_write_stl, "path string, content binary")
