from types import SimpleNamespace

import pytest

from tidemark.llm.common import shared_dir


def session(setting, app, master="local[2]"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" else default), sparkContext=SimpleNamespace(applicationId=app, master=master))


def test_the_shared_folder_is_that_of_the_session():
    assert shared_dir(session("hdfs://x/y/", "a")) == "hdfs://x/y"


def test_one_own_folder_an_application_where_none_is_set():
    first = shared_dir(session(None, "b"))
    assert first.startswith("file://") and shared_dir(session(None, "b")) == first != shared_dir(session(None, "c"))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError):
        shared_dir(session(None, "d", "yarn"))
    assert shared_dir(session("s3a://x", "d", "yarn")) == "s3a://x"
