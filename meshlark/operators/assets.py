"""Asset rows: names and paths, routing by format, reports and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


from meshlark.functions.vector import rounded

# fixed: the formats an importer exists for
SUPPORTED = [".glb", ".gltf", ".obj", ".fbx", ".stl", ".blend"]
FPS = 30


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, "([^/]+?)([.][^./]*)?$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none or a leading dot only."""
    return F.lower(F.regexp_extract(path, "[^/]([.][^./]*)$", 1))


def folder_assets(files: DataFrame, folder: str, ext: str = ".glb", limit: int | None = None) -> DataFrame:
    """Rows of files directly in ``folder`` with the extension; a limit keeps the first by path."""
    ext = ext if ext.startswith(".") else f".{ext}"
    kept = files.filter(F.endswith("path", F.lit(ext)) & (F.regexp_extract("path", "^(.*)/[^/]*$", 1) == folder.rstrip("/")))
    return kept if limit is None else kept.orderBy("path").limit(limit)


def output_path(folder: str | Column, path: Column, filename: str | None = None) -> Column:
    """folder/stem, or folder/stem/filename."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.concat_ws("/", folder, stem(path), *([F.lit(filename)] if filename else []))


def asset_items(files: DataFrame, folder: str) -> DataFrame:
    """Work-item columns of found files."""
    return files.select(stem(F.col("path")).alias("id"), F.col("path").alias("input_path"), output_path(folder, F.col("path")).alias("output_path"))


def with_collisions(files: DataFrame, folder: str, filename: str | None = None) -> DataFrame:
    """Adds output_path and how many files would write to it."""
    named = files.withColumn("output_path", output_path(folder, F.col("path"), filename))
    counts = named.groupBy("output_path").agg(F.count("*").alias("n_same"))
    return named.join(counts, ["output_path"])


def format_routing(files: DataFrame) -> DataFrame:
    """Adds format and error_message (null when an importer takes the file)."""
    ext = extension(F.col("path"))
    error = F.when(~F.col("present"), F.concat(F.lit("Model file not found: "), F.col("path"))).when(
        ~ext.isin(SUPPORTED), F.concat(F.lit("Unsupported file extension: "), ext)
    )
    return files.withColumns({"format": ext, "error_message": error})


def quarantine_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows) by ``error_message``; nothing stops the rest."""
    good = F.col("error_message").isNull()
    return rows.filter(good).drop("error_message"), rows.filter(~good)


# -- reports ----------------------------------------------------------------


def assemble_report(counts: DataFrame, topology: DataFrame, bbox: DataFrame, materials: DataFrame, meshes: DataFrame, key: str = "obj_id") -> DataFrame:
    """One row per asset: all parts are per-asset rows already, so the joins are between aggregates.

    ``materials`` holds distinct (asset, name) rows; a report lists its names.
    """
    names = materials.groupBy(key).agg(F.array_sort(F.collect_list("material")).alias("materials"))
    return (
        counts.join(topology, key, "left").join(bbox, key, "left").join(names, key, "left").join(meshes, key, "left")
        .withColumn("materials", F.coalesce("materials", F.array().cast("array<string>")))
        .withColumn("mesh_count", F.coalesce("mesh_count", F.lit(0).cast("long")))
    )


def report_document(report: DataFrame, filename: Column) -> DataFrame:
    """The report row in its nested form: filename, geometry, topology, bounding_box, materials, mesh_count."""
    triple = lambda n: F.array(*[F.col(f"{n}_{c}") for c in "xyz"])
    return report.select(
        filename.alias("filename"), F.struct("vertices", "faces").alias("geometry"), F.struct("triangles", "quads", "ngons").alias("topology"),
        F.struct(triple("center").alias("center"), triple("dim").alias("dimensions"), triple("min").alias("min"), triple("max").alias("max")).alias("bounding_box"),
        "materials", "mesh_count", stem(filename).alias("stem"),
    )


def validation_report(rows: DataFrame) -> DataFrame:
    """Success rows with stats, error rows with the message; every input row gives one row."""
    ok = F.col("error_message").isNull()
    stat = lambda c: F.when(ok, F.col(c)).alias(c)
    materials = [stat("materials")] if "materials" in rows.columns else []
    return rows.select(
        F.col("path").alias("file"), F.concat(stem(F.col("path")), F.lit("_report.json")).alias("report_name"),
        F.when(ok, "success").otherwise("error").alias("status"), "error_message",
        stat("vertices"), stat("faces"), stat("dim_x"), stat("dim_y"), stat("dim_z"), *materials,
    )


def validation_summary(reports: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status") == "error")
    return reports.agg(
        F.count("*").alias("processed"), bad.alias("errors"),
        F.concat(F.lit("Processed "), F.count("*").cast("string"), F.lit(" files. "), bad.cast("string"), F.lit(" Error.")).alias("message"),
    )


def render_metadata(items: DataFrame, bbox: DataFrame, cameras: DataFrame, resolution: tuple[int, int] = (512, 512)) -> DataFrame:
    """Per item (id, obj_id, cam_id, input_path): file, resolution, box and camera with their defaults."""
    zero = F.lit(0.0)
    joined = items.join(bbox, ["obj_id"], "left").join(
        cameras.select("cam_id", "focal_length", "pos_x", "pos_y", "pos_z"), "cam_id", "left"
    )
    return joined.select(
        "id", basename(F.col("input_path")).alias("source_file"), F.lit(resolution[0]).alias("res_x"), F.lit(resolution[1]).alias("res_y"),
        *[F.coalesce(f"{n}_{c}", zero).alias(f"{n}_{c}") for n in ("center", "dim") for c in "xyz"],
        F.coalesce("focal_length", F.lit(50.0)).alias("focal_length"), *[F.coalesce(f"pos_{c}", zero).alias(f"pos_{c}") for c in "xyz"],
        *[zero.alias(f"look_{c}") for c in "xyz"],
    )


def camera_log(control_points: DataFrame, aims: DataFrame, max_sdf: DataFrame, mode: str, seed: int | None, threshold: float, frames: int = 150, resolution: tuple[int, int] = (640, 480)) -> DataFrame:
    """One row per object; its few picked points (5 or 3) are listed in order."""
    listed = lambda df, name: df.groupBy("obj_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[rounded(c).alias(c) for c in "xyz"]))).alias(name))
    centre = aims.groupBy("obj_id").agg(*[rounded(F.avg(c)).alias(f"aim_{c}") for c in "xyz"])
    return (
        listed(control_points, "control_points").join(listed(aims, "aim_targets"), "obj_id", "left").join(centre, "obj_id", "left").join(max_sdf, "obj_id", "left")
        .withColumns({
            "mode": F.lit(mode), "seed": F.lit(seed).cast("long"), "sdf_threshold": F.lit(threshold), "frames": F.lit(frames),
            "res_x": F.lit(resolution[0]), "res_y": F.lit(resolution[1]), "fps": F.lit(FPS),
        })
    )
