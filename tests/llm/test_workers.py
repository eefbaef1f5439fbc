"""What Python workers an executor has to keep: as many as its tasks have at once, and of one kind."""

import pyarrow as pa

from tracery.llm import components, packing


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_made_in_python_are_not_contracted_in_the_same_task(spark, monkeypatch):
    plans, write = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df, tag: plans.append(plan(df)) or write(df, tag))

    def next_ones(batches):
        for x in batches:
            v = x.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(v + v % 3 // 2)], names=["u", "v"])

    got = components.connected(spark.range(2, 12).mapInArrow(next_ones, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(2, 2), (3, 2), (5, 5), (6, 5), (8, 8), (9, 8), (11, 11), (12, 11)]
    assert any("MapInArrow" in p for p in plans) and max(p.count("MapInArrow") for p in plans) == 1


def test_places_come_without_a_python_worker(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    out = packing.pack(docs)
    assert "LocalRelation" in plan(out) and "LogicalRDD" not in plan(out)
    assert sorted((r["doc_id"], r["sequence_id"]) for r in out.collect()) == [(1, 0), (2, 0)]
    assert packing.pack(docs.limit(0)).collect() == []
