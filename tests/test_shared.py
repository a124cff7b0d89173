import pytest

from chronomill import shared


def test_folders_go_on_release(spark):
    folder = shared.new_folder(spark, "some")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    shared.release(spark)
    fs, path = shared.file_system(spark, folder)
    assert not fs.exists(path)
    again = shared.new_folder(spark, "some")
    spark.range(2).write.parquet(again)
    assert spark.read.parquet(again).count() == 2


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod({"spark.master": "spark://host:7077", "spark.checkpoint.dir": None}.get)


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Elsewhere)
