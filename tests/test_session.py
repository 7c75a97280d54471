from __future__ import annotations

from pathlib import Path

import pytest

from tidemark.session import scratch_dir


class FakeConf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class FakeSession:
    def __init__(self, **conf):
        self.conf = FakeConf({f"spark.{k}": v for k, v in conf.items()})


def test_scratch_uses_the_folder_of_the_cluster():
    session = FakeSession(**{"checkpoint.dir": "hdfs://shared/", "master": "yarn"})
    assert scratch_dir(session, "x").startswith("hdfs://shared/tidemark/x-")
    assert scratch_dir(session, "x") != scratch_dir(session, "x")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(FakeSession(master="yarn"), "x")
    assert Path(scratch_dir(FakeSession(master="local[2]"), "x")).is_absolute()
