"""What is read from files is not taken for small."""

from axisframe.sources import formats, hdf5
from axisframe.sources.store import Frame, Matrix, Store


def test_entries_are_not_broadcast(spark, tmp_path):
    side = lambda n: Frame(spark.range(n).selectExpr("id AS pos", "concat('n', id) AS name"))
    x = spark.range(50).selectExpr("id AS i", "id % 7 AS j", "double(id + 1) AS v")
    hdf5.write(Store(side(50), side(7), {"X": Matrix(x, (50, 7), "float64")}), f"{tmp_path}/a.h5ad")
    read = formats.read(spark, f"{tmp_path}/a.h5ad").matrices["X"].data
    most = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    assert int(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most
    assert sorted((r.i, r.j, r.v) for r in read.collect()) == [(i, i % 7, i + 1.0) for i in range(50)]
