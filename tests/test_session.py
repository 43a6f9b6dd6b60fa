"""Where intermediate tables may be written."""

import types

import pytest

from ledgerloom import session


def fake(master, folder=None):
    conf = types.SimpleNamespace(get=lambda name, default=None: folder or default)
    return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))


def test_a_cluster_must_name_its_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs:///shared")) == "hdfs:///shared"


def test_a_local_session_has_one_folder_of_its_own():
    assert session.shared_dir(fake("local[4]")) == session.shared_dir(fake("local"))
