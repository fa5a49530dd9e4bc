"""Registered queries call the operators with their own defaults, and on groups that grow with the input."""

import inspect

import pytest

from groundweave.plans import adjust_queries, camera_queries, embed_queries
from groundweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
FREE = {
    "ransac_transform": (adjust_queries, {"rounds"}),
    "merge_window_affines": (adjust_queries, {"rounds"}),
    "logreg_sweep": (embed_queries, {"cs", "max_iter"}),
    "inverse_rpc_fit": (camera_queries, {"xy", "z"}),
    "bake_affine_into_rpc": (camera_queries, {"xy", "z"}),
    "multiview_residuals": (camera_queries, {"rounds"}),
    "block_adjustment": (camera_queries, {"max_iters", "tol"}),
}


class Called(Exception):
    pass


@pytest.mark.parametrize("name", sorted(FREE))
def test_operator_defaults(spark, monkeypatch, name):
    module, free = FREE[name]
    kinds = inspect.signature(getattr(module.O, name))

    def stop(*args, **given):
        raise Called(set(kinds.bind(*args, **given).arguments))

    monkeypatch.setattr(module.O, name, stop)
    with pytest.raises(Called) as found:
        QUERIES[name](spark, SF)
    assert not found.value.args[0] & free


def test_training_crops_take_every_group(spark):
    groups = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["training_crops"](spark, SF).select("group_id").distinct().count() == groups
