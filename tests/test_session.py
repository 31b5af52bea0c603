"""The shared folder of a session, by master and setting."""

import pytest

from halflife.session import ensure_checkpoint_dir


class _Cluster:
    """Stands for a session on machines that mount one folder."""

    def __init__(self, master: str, checkpoint_dir: str | None, warehouse: str):
        self.sparkContext, self.master, self.conf = self, master, {"spark.sql.warehouse.dir": warehouse}
        self.setting, self.current = checkpoint_dir, None

    def getConf(self):
        return {"spark.checkpoint.dir": self.setting} if self.setting else {}

    def setCheckpointDir(self, path: str) -> None:
        self.current = f"{path if ':' in path else 'file:' + path}/app"  # as Spark qualifies it

    def getCheckpointDir(self) -> str | None:
        return self.current


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,3000]"])
@pytest.mark.parametrize("path", ["/mnt/shared", "file:///mnt/shared"])
def test_a_mounted_checkpoint_dir_is_taken_on_a_cluster(master, path):
    spark = _Cluster(master, path, "/mnt/warehouse")
    assert ensure_checkpoint_dir(spark) == f"file:{path.removeprefix('file:')}/app"
    assert ensure_checkpoint_dir(spark) == spark.current  # and stays


@pytest.mark.parametrize("master", ["spark://host:7077", "local-cluster[3,2,3000]"])
def test_without_a_checkpoint_dir_a_cluster_writes_below_its_warehouse(master):
    assert ensure_checkpoint_dir(_Cluster(master, None, "hdfs://store/warehouse/")) == "hdfs://store/warehouse/halflife-checkpoints/app"


def test_one_process_gets_a_scratch_folder():
    assert "/halflife-ckpt-" in ensure_checkpoint_dir(_Cluster("local[4]", None, "/mnt/warehouse"))
