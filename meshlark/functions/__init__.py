"""Column-level helpers and the few physical-layout helpers the operators share."""
