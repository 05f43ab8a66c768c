from voxelcohort.functions.expressions import (
    allclose,
    closed_round,
    constant_rows,
    finite,
    hash_key,
    pack_voxel,
    require_empty,
    unpack_voxel,
    violation,
    violations_of,
    violations_union,
)
from voxelcohort.functions.ordering import (
    exact_quantiles,
    order_bucket,
    prefix_sums,
    spread_bucket,
    take_lowest,
    value_bucket,
    with_rank,
)

__all__ = [
    "allclose", "closed_round", "constant_rows", "exact_quantiles", "finite", "hash_key", "pack_voxel",
    "order_bucket", "prefix_sums", "require_empty", "spread_bucket", "take_lowest", "unpack_voxel", "value_bucket",
    "violation", "violations_of", "violations_union", "with_rank",
]
