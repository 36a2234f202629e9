"""How much of the texts a batch of ``stream_analyze`` puts on disk."""

import random
import string
from pathlib import Path

from mediasift.schemas import REQUEST
from mediasift.streaming import jobs

from .test_operators import SHA, request, seen


def shuffled(spark) -> int:
    """Bytes that all stages of the session have written for exchanges."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_a_batch_are_exchanged_no_more_than_needed(spark, tmp_path):
    """The checks and the choice of a cache entry move no text (2.1 times the texts when they did), and the batch itself does not stay."""
    rng = random.Random(5)
    texts = ["".join(rng.choices(string.ascii_letters + string.digits, k=9_000)) for _ in range(300)]
    artifact = [("a.png", 1, SHA, None)]
    rows = request(spark, *[{"request_id": i, "post_text": t, "artifacts": artifact} for i, t in enumerate(texts)])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(source)
    files = spark.createDataFrame([("/m/a.png", 1, SHA, True)], "path string, length long, sha256 string, is_regular boolean")
    found = seen(spark, *[{"request_id": i} for i in range(len(texts))])
    before = shuffled(spark)
    jobs.stream_analyze(spark.readStream.schema(REQUEST).parquet(source), files, found, root="/m", folder=out).awaitTermination()
    size = sum(map(len, texts))
    assert shuffled(spark) - before < 1.5 * size
    assert spark.read.parquet(f"{out}/results").filter("computed").count() == len(texts)
    assert not list(Path(out).glob("landed/*"))
