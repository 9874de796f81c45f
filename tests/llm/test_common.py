from types import SimpleNamespace

import pytest

from notesift.llm import common


def session(master, folder=None):
    """What ``shared_dir`` asks of a session."""
    made = []
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, setCheckpointDir=made.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context), made


def test_a_cluster_must_name_its_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://x", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master)[0])


def test_a_single_machine_gets_one_and_settings_are_read():
    one, made = session("local[4]")
    assert common.shared_dir(one) == made[0]
    assert common.shared_dir(session("yarn", "hdfs://shared/x/")[0]) == "hdfs://shared/x"


def test_connected_against_search(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), (None, 3), (8, None), (3, 1), (1, 2), *[(100, k) for k in range(101, 160)]]
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, **dict.fromkeys(range(100, 160), 100)}
