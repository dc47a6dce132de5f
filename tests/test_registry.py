"""Names of queries are taken once, and cut tables go to the shared folder."""

import types

import pytest

from weft.operators import lineage
from weft.plans.registry import merged, registry


def test_repeated_names():
    queries, oracles, query = registry()

    @query("select 1")
    def one(spark, sf_dir): ...

    assert list(queries) == list(oracles) == ["one"]
    with pytest.raises(ValueError, match="one"):
        query()(one)
    module = types.SimpleNamespace(QUERIES=queries, ORACLES=oracles)
    assert merged(module) == (queries, oracles)
    with pytest.raises(ValueError, match="one"):
        merged(module, module)


@pytest.mark.parametrize(("master", "named", "want"), [("local[2]", None, "weft-checkpoints"), ("yarn", "/shared/x", "/shared/x"), ("local[2]", "/y", "/y"), ("yarn", None, None), ("local-cluster[2,1,900]", None, None)])
def test_shared_folder(master, named, want):
    conf = types.SimpleNamespace(get=lambda k, d=None: named)
    context = types.SimpleNamespace(master=master, getConf=lambda: conf)
    spark = types.SimpleNamespace(conf=conf, sparkContext=context)
    if want is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.shared_folder(spark)
    else:
        assert lineage.shared_folder(spark).endswith(want)
