"""All registered queries; importing this module fills the registry."""

from voxelcohort.plans import (  # noqa: F401
    catalog_audits,
    catalog_geometry,
    catalog_masks,
    catalog_metrics,
    catalog_models,
    catalog_pixels,
    catalog_sources,
    catalog_splits,
    catalog_statistics,
    catalog_streams,
    catalog_trace,
)
from voxelcohort.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
