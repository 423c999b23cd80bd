import numpy as np

from patchlane.operators.models import Mixture
from patchlane.streaming.scoring import score_stream


def test_stream_equals_batch(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, "k", v.tolist()) for i, v in enumerate(r.normal(size=(30, 2)))], "i long, key string, z array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    models = {"k": Mixture(np.zeros((1, 2)), np.eye(2)[None], np.zeros(1))}
    stream = score_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), models, 2)
    query = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = {x.i: round(x.score, 9) for x in spark.table("scored").collect()}
    assert got == {x.i: round(x.score, 9) for x in score_stream(rows, models, 2).collect()} and len(got) == 30
