"""Inspection flows: table-held scenes to reports, model files to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from meshlark.operators import assets as A, mesh as M
from meshlark.session import cut
from meshlark.sources import gltf, reports, scan
from meshlark.sources.tables import Tables


def scene_reports(t: Tables) -> DataFrame:
    """A report row per mesh object of the tables; materials come from the objects of its family (id mod 10)."""
    family = M.mesh_objects(t.objects()).withColumn("obj_id", F.col("obj_id") % 10)
    return A.assemble_report(
        M.geometry_counts(t.mesh_vertex_ids(), t.faces()),
        M.topology(t.faces(), "obj_id"),
        M.world_bbox(M.world_corners(M.local_bounds(t.vertices(), "obj_id"), t.objects()), "obj_id"),
        M.material_names(family, "obj_id"),
        family.groupBy("obj_id").agg(F.count("*").alias("mesh_count")),
    )


def _reports(docs: DataFrame) -> DataFrame:
    dims = {f"dim_{c}": F.round(F.col(f"max_{c}") - F.col(f"min_{c}"), 4) + 0.0 for c in "xyz"}
    return A.validation_report(gltf.gltf_scene(docs).withColumns(dims))


def model_reports(files: DataFrame) -> DataFrame:
    """Validation rows of glTF contents (path, length, content): counts, materials and world box over all instances."""
    return _reports(gltf.content_documents(files))


def inspect_folder(spark, folder: str, out: str, ext: str = ".glb") -> DataFrame:
    """Inspect every model below ``folder`` by its head alone and return the summary row.

    Each model's report is a file ``{stem}_report.json`` below ``out``, in the folder that it has below ``folder``.
    """
    files = scan.asset_scan(spark, folder, ext, recursive=True)
    rows = cut(_reports(gltf.documents(gltf.read_heads(files))), "reports")
    inside = F.regexp_replace(F.substring_index("file", folder.rstrip("/").split(":")[-1].rstrip("/") + "/", -1), "[^/]*$", "")
    reports.write_report_files(rows, F.concat(inside, F.col("report_name")), out)
    return A.validation_summary(rows)
