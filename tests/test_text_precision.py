"""Numbers of single precision through text."""

import __spark_entry__
from pyspark.sql import functions as F


def test_text_of_single_precision_reads_back(spark, tmp_path):
    import numpy as np

    # As texts of three and four digits these end in five; as numbers most lie a little to one side.
    given = [(i, [float(np.float32((i * 64 + k) * 10 + 5) / np.float32(10_000)) for k in range(64)]) for i in range(20)]
    spark.createDataFrame(given, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(i, k): int(np.floor(float(np.float32(x)) * 1000 + 0.5)) for i, row in given for k, x in enumerate(row)}
    got = __spark_entry__.queries()["dense_text_round_trip"](spark, str(tmp_path))
    assert {(r.i, r.j): r.v for r in got.collect()} == want
    assert got.where(F.col("v") == 0).count() == sum(v == 0 for v in want.values())
