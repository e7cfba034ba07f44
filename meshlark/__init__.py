"""meshlark: 3D-asset, point-set and trajectory analytics as Spark DataFrame transformations."""
