import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkstrata.llm import importance, quality_rules
from inkstrata.llm._common import Words


def docs_of(spark):
    rows = [(i, f"the cat number{i % 7} sat on the mat and ran") for i in range(60)]
    rows += [(100 + i, f"junk### x{i}*** | | junk$$$") for i in range(20)] + [(200, None), (201, ""), (None, "the cat"), (5, rows[5][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))


def test_resample_matches_brute_force(spark):
    docs = docs_of(spark)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for r in docs.collect():
        cells, _ = quality_rules.grams(Words(pa.array([r.text], pa.string()), lower=False))
        for c in cells:
            raw[c] += 1
            target[c] += r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0
    ratio = importance.log_ratio(raw, target)
    for share in (0.0, 0.3, 0.8, 1.0):
        got = importance.resample(docs, trusted, share).collect()
        assert len(got) == docs.count()
        keys = sorted((r.key for r in got), reverse=True)
        k = int(np.ceil(share * len(keys)))
        assert all(r.selected == (k > 0 and r.key >= keys[k - 1]) for r in got)
    by_id = {r.doc_id: r for r in got}
    cells, _ = quality_rules.grams(Words(pa.array([docs.where("doc_id = 7").first().text]), lower=False))
    assert abs(by_id[7].log_weight - ratio[cells].sum()) < 1e-9
    assert by_id[200].log_weight == by_id[201].log_weight == 0
    assert min(r.log_weight for r in got if r.doc_id is not None and r.doc_id < 60) > max(r.log_weight for r in got if r.doc_id in range(100, 120))


def test_no_labels_and_empty(spark):
    docs, none = docs_of(spark), spark.createDataFrame([], "doc_id long")
    assert {r.log_weight for r in importance.resample(docs, none).collect()} == {0.0}
    assert importance.resample(docs.limit(0), none).count() == 0


def test_kth_largest(spark):
    values = [-(2**63), -5, -1, 0, 0, 3, 2**40, 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "ordered long")
    assert [importance.kth_largest(rows, k) for k in range(1, 10)] == [*sorted(values, reverse=True), None]
