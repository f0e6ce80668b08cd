"""Walks over numbered nodes are those over named ones, and their pairs are sent once."""

from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.sources import workspace
from tidemark.sources.training_log import TrainingLog


def test_coded_walks_equal_named_ones(spark, sf_dir):
    edge = workspace.materialise(graph.edges(TrainingLog(spark, sf_dir).test), "edges")
    own, nodes = graph.coded(edge)
    names = {r["code"]: r["name"] for r in nodes.collect()}
    assert sorted(names.values(), key=str.encode) == [names[i] for i in range(len(names))]
    want = sorted(r["path"] for r in graph.walks(edge, 2, 7).collect())
    found = graph.walks(own, 2, 7, names=nodes)
    assert found.schema["path"].dataType.elementType.simpleString() == "int"
    assert sorted([names[c] for c in r["path"]] for r in found.collect()) == want


def test_contexts_of_numbers_are_summed_before_they_are_sent(spark):
    paths = spark.createDataFrame([([7, 3, 7, 7],)] * 500, "path array<int>").repartition(1)
    seen = graph.walk_contexts(paths, 2)
    assert {(r["row"], r["col"]): r["cnt"] for r in seen.collect()} == {(3, 7): 1500, (7, 3): 1500, (7, 7): 2000}
    empty = graph.walk_contexts(paths.where(F.size("path") == 0), 2)
    assert empty.count() == 0 and empty.columns == ["row", "col", "cnt"]


def test_embedding_names_persons(spark, sf_dir):
    rows = TrainingLog(spark, sf_dir).test
    found = {r["person"] for r in graph.walk_embedding(rows, 4, 2, 5).select("person").collect()}
    people = {r["src"].removeprefix("farmer_") for r in graph.edges(rows).where("src like 'farmer\\\\_%'").collect()}
    assert found and found <= people
