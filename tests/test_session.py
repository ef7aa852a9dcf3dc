import glob

import pytest

from parchmill import session


def test_cuts_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    df = session.cut(spark.range(5), "mine", ["id"])
    assert df.count() == 5 and glob.glob(folder.removeprefix("file://") + "/parchmill-mine-*/*.parquet")
    assert session.cut(df.filter("id > 9"), "empty").count() == 0


def test_no_temporary_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,3000]"

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Fake())
