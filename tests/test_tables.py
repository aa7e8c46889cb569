import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare import model
from wayfare.operators import distribution, graph, gtfs, matrix, network
from wayfare.sources import tables


def margins(spark, n=6):
    p = spark.createDataFrame([(i, float(10 + i)) for i in range(n)], "zone_id long, production double")
    a = spark.createDataFrame([(i, float(10 + n - 1 - i)) for i in range(n)], "zone_id long, attraction double")
    return p, a


def test_ipf_meets_margins(spark):
    p, a = margins(spark)
    seed = p.select(F.col("zone_id").alias("origin")).crossJoin(a.select(F.col("zone_id").alias("destination"))).withColumn("flow", (1 + (F.col("origin") * 3 + F.col("destination")) % 5).cast("double"))
    out, report = distribution.ipf(seed, p, a, 1e-6, 200)
    assert report[-1]["error"] < 1e-6
    rows = {r.origin: r.t for r in out.groupBy("origin").agg(F.sum("flow").alias("t")).collect()}
    cols = {r.destination: r.t for r in out.groupBy("destination").agg(F.sum("flow").alias("t")).collect()}
    assert rows == pytest.approx({i: 10.0 + i for i in range(6)}, rel=1e-4)
    assert cols == pytest.approx({i: 15.0 - i for i in range(6)}, rel=1e-4)
    with pytest.raises(ValueError):
        distribution.ipf(seed, p, a.withColumn("attraction", F.col("attraction") + 1))


def test_gravity_models(spark, tmp_path):
    with pytest.raises(ValueError):
        distribution.GravityModel("EXPO", alpha=0.1)
    with pytest.raises(ValueError):
        distribution.GravityModel("LOGIT", beta=0.1)
    m = distribution.GravityModel("GAMMA", alpha=0.2, beta=0.1)
    m.save(spark, f"file://{tmp_path}/m.json")
    assert distribution.GravityModel.load(spark, f"file://{tmp_path}/m.json") == m
    p, a = margins(spark)
    cost = p.select(F.col("zone_id").alias("origin")).crossJoin(a.select(F.col("zone_id").alias("destination"))).withColumn("cost", (1 + F.abs(F.col("origin") - F.col("destination"))).cast("double"))
    seed = distribution.gravity_seed(cost, p, a, distribution.GravityModel("EXPO", beta=0.3), max_cost=4.0)
    assert seed.agg(F.sum("flow")).first()[0] == pytest.approx(75.0)
    assert seed.filter("abs(origin - destination) >= 3 AND flow > 0").count() == 0


def test_calibration_recovers_parameter(spark):
    p, a = margins(spark)
    cost = p.select(F.col("zone_id").alias("origin")).crossJoin(a.select(F.col("zone_id").alias("destination"))).withColumn("cost", (1 + F.abs(F.col("origin") - F.col("destination"))).cast("double"))
    observed, _ = distribution.apply_gravity(cost, p, a, distribution.GravityModel("EXPO", beta=0.4), fixed_iterations=8)
    fitted, report = distribution.calibrate_gravity(observed, cost, "EXPO", max_error=1e-3, max_iterations=6, fixed_iterations=4)
    assert fitted.beta == pytest.approx(0.4, abs=0.02)


def test_pairing_and_checks(spark, sf_dir):
    links = model.links(spark, sf_dir)
    with pytest.raises(ValueError):
        graph.paired_fields(links.drop("capacity_ba"))
    with pytest.raises(ValueError):
        graph.check_network(links.withColumn("a_node", F.lit(None).cast("long")))
    for bad in ([], [1, 1], [0], [1.5]):
        with pytest.raises(ValueError):
            graph.check_centroids(bad)


def test_matrix_edges(spark):
    m = spark.createDataFrame([(1, 2, 1.0, float("nan")), (2, 1, None, 0.0)], "origin long, destination long, a double, b double")
    assert {(r.origin, r.total) for r in matrix.row_totals(m, "a").collect()} == {(1, 1.0), (2, None)}
    assert {(r.a, r.b) for r in matrix.nan_to_num(m).collect()} == {(1.0, 0.0), (0.0, 0.0)}
    with pytest.raises(ValueError):
        matrix.combine([m, m])
    with pytest.raises(ValueError):
        matrix.create_empty(spark.createDataFrame([(1,)], "zone_id long"), ["x" * 51])


def test_gtfs_times_settle(spark):
    rows = spark.createDataFrame([(1, k, f"s{k}", t, t, d) for k, (t, d) in enumerate([(0, 0.0), (100, 1000.0), (0, 500.0), (160, 500.0), (160, 10.0)])], "trip_id long, seq long, stop_id string, arrival long, departure long, distance double")
    limits = pd.DataFrame({"min_distance": [0.0], "max_distance": [1e9], "speed": [10.0]})
    got = [(r.arrival, r.source_time) for r in gtfs.settle_times(rows, limits).orderBy("seq").collect()]
    times = [t for t, _ in got]
    assert times == sorted(times) and len(set(times)) == 5
    with pytest.raises(FileNotFoundError):
        gtfs.service_days(None, None)
    twice = spark.createDataFrame([(1, 1, "a", "8:00:00", "8:00:00")] * 2, "trip_id long, stop_sequence long, stop_id string, arrival_time string, departure_time string")
    with pytest.raises(ValueError):
        gtfs.parsed_stop_times(twice)


def test_normalise_twice_is_once(spark, sf_dir):
    links, nodes = model.links(spark, sf_dir), model.nodes(spark, sf_dir)
    links, once = network.normalised(links, nodes.filter("node_id <> 101"))
    assert once.filter("node_id = 101").count() == 1
    _, again = network.normalised(links, once)
    key = lambda df: sorted((r.node_id, r.modes, r.link_types) for r in df.collect())
    assert key(once) == key(again)
    with pytest.raises(ValueError):
        network.merge_nodes(links, nodes, 2, 1)
    with pytest.raises(ValueError):
        network.edit_modes(links, [1], to="")


def test_groups_and_gmns(spark):
    groups = spark.createDataFrame([("all", "cars, foot"), ("cars", "auto,truck")], "use_group string, uses string")
    assert {(r.use_group, r.use) for r in network.resolve_groups(groups).collect()} == {("all", "auto"), ("all", "truck"), ("all", "foot"), ("cars", "auto"), ("cars", "truck")}
    with pytest.raises(ValueError):
        network.resolve_groups(spark.createDataFrame([("a", "b"), ("b", "a")], "use_group string, uses string"))
    gmns = spark.createDataFrame([(1, 1, 2, 1, 1.0, 100.0, 50.0, 1.0, "a"), (2, 1, 2, 1, 2.0, 200.0, 60.0, 1.0, "a"), (3, 2, 1, 1, 1.0, 100.0, 50.0, 1.0, "b"), (4, 3, 2, 1, 1.0, 10.0, 5.0, 2.0, "a")], "link_id long, from_node_id long, to_node_id long, directed int, lanes double, capacity double, free_speed double, length double, allowed_uses string")
    got = {r.link_id: r for r in network.from_gmns(gmns).collect()}
    assert (got[1].direction, got[1].lanes_ab, got[1].lanes_ba, got[1].modes) == (0, 3.0, 1.0, "ab")
    assert (got[4].direction, got[4].a_node, got[4].b_node) == (1, 3, 2)


def test_project(spark, tmp_path, sf_dir):
    folder = f"file://{tmp_path}/p"
    project = tables.Project.new(spark, folder)
    with pytest.raises(FileExistsError):
        tables.Project.new(spark, folder)
    with pytest.raises(FileNotFoundError):
        tables.Project.open(spark, f"file://{tmp_path}/none")
    project.save("nodes", model.nodes(spark, sf_dir).unionByName(spark.createDataFrame([(999, False, 0.0, 0.0)], "node_id long, is_centroid boolean, lon double, lat double")))
    project.save("links", model.links(spark, sf_dir))
    project.clean()
    assert project.table("nodes").count() == 30
    project.add_field("links", "slope", "double", "steepness")
    assert "slope" in project.table("links").columns
    with pytest.raises(ValueError):
        project.add_field("links", "slope", "double", "again")
    project.register("od", model.demand(spark, sf_dir))
    assert project.registered("od").count() > 0
    with pytest.raises(ValueError):
        project.register("od", model.demand(spark, sf_dir))
    assert project.sql("SELECT count(*) AS n FROM links").first().n == 78
    project.forget("od")
    with pytest.raises(KeyError):
        project.registered("od")


def test_streamed_counts(spark, tmp_path):
    from wayfare.streaming.demand import windowed_counts

    path = str(tmp_path / "in")
    spark.createDataFrame([(f"2024-01-01 0{h}:10:00", k, 1.0) for h in range(5) for k in ("a", "b")], "t string, k string, value double").select(F.to_timestamp("t").alias("ts"), "k", "value").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(path)
    q = windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 10


def test_numbering_by_ranges_is_the_same(spark):
    from wayfare.plans.ranking import numbered

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    whole = {(r.k, r.n) for r in numbered(rows, ["k"], "n", 1).collect()}
    assert whole == {(r.k, r.n) for r in numbered(rows, ["k"], "n", 1, one_task_rows=10).collect()} == {(k, k + 1) for k in range(1000)}
