import pytest

import __spark_entry__

#: ways to a runbook and layers of parts, by the rest of their keys by five
RUNBOOKS = ["error_code_node", "oracle_action_plan", "ora_code_node", "fix_command_edge", "not_found"]
LAYERS = [("ASM", 1), ("OS_TRIGGERED", 2), ("NETWORK", 2), ("CLUSTER", 2), ("NEEDS_MORE_INFO", 3)]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    # 100,123 and its like are shown like 10,012
    keys = [7, *range(10_010, 10_015), *range(100_100, 100_150), 1_234_567]
    spark.createDataFrame([(k, f"part {k}", f"brand {k % 3}") for k in keys], "p_partkey long, p_name string, p_brand string").write.parquet(f"{folder}/part.parquet")
    return str(folder), keys


def test_runbooks_of_long_keys(spark, parts):
    folder, keys = parts
    first = [lambda k: f"part {k}", lambda k: f"plan part {k}", lambda k: f"part {k} own", lambda k: f"fix brand {k % 3}", lambda k: ""]
    got = __spark_entry__.queries()["runbook_priority_lookup"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted((f"ORA-{k:05}"[:9], RUNBOOKS[k % 5], first[k % 5](k)) for k in keys)


def test_layers_of_long_keys(spark, parts):
    folder, keys = parts
    got = __spark_entry__.queries()["layer_lookup"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted((f"ORA-{k:05}"[:9], *LAYERS[k % 5]) for k in keys)
