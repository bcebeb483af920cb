"""The built world of one folder of source tables: every derived table is
written to the shared folder once a session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import chains, components, eligibility, graph, landmarks, mapped, routes, search
from wayfold.operators.tables import stored
from wayfold.sources import world as source

PROFILES = [0, 1, 2, 3]


class World:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tiles(self) -> DataFrame:
        return source.tiles(self.spark, self.sf_dir)

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(graph.dense_ids(self.tiles))

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def walk(self) -> DataFrame:
        return stored(graph.walk_edges(self.nodes))

    @cached_property
    def steps(self) -> DataFrame:
        return stored(chains.parsed_steps(source.steps(self.spark, self.sf_dir)))

    @cached_property
    def macros(self) -> DataFrame:
        return stored(chains.macro_edges(self.steps, self.nodes))

    @cached_property
    def globals(self) -> DataFrame:
        return stored(chains.global_edges(self.steps, self.nodes))

    @cached_property
    def rings(self) -> DataFrame:
        return stored(chains.ring_nodes(source.rings(self.spark, self.sf_dir), self.nodes))

    @cached_property
    def tags(self) -> DataFrame:
        return stored(eligibility.tags(source.requirements(self.spark, self.sf_dir)))

    @cached_property
    def profiles(self) -> DataFrame:
        return source.profiles(self.spark, self.sf_dir)

    @cached_property
    def met(self) -> DataFrame:
        return stored(eligibility.satisfaction(self.tags, self.profiles, PROFILES))

    @cached_property
    def quick(self) -> DataFrame:
        return eligibility.quick_profiles(self.profiles)

    @cached_property
    def macros_ok(self) -> DataFrame:
        return stored(eligibility.priced(eligibility.allowed(self.macros, self.met, PROFILES, ["kind", "id", "backward"]), self.quick))

    @cached_property
    def globals_ok(self) -> DataFrame:
        return stored(eligibility.cheapest_globals(eligibility.priced(eligibility.allowed(self.globals, self.met, PROFILES, ["kind", "id"]), self.quick)))

    @cached_property
    def rings_ok(self) -> DataFrame:
        return stored(eligibility.allowed(self.rings, self.met, PROFILES, ["id"]))

    @cached_property
    def labels(self) -> DataFrame:
        if search.BROADCAST_EDGES < max(self.n, self.walk.count()) <= mapped.MAPPED_EDGES:
            return stored(mapped.components(self.n, self.walk))
        found = components.connected(self.walk.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        return stored(self.nodes.select(F.col("id").alias("node")).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    @cached_property
    def queries(self) -> DataFrame:
        return stored(routes.resolve(source.route_queries(self.spark, self.sf_dir), self.nodes))

    @cached_property
    def size(self) -> int:
        """Nodes or edges, whichever are more."""
        return max(self.n, self.walk.count() + max(self.macros.count(), self.macros_ok.count()))

    @property
    def small(self) -> bool:
        """Whether tasks may hold all edges."""
        return self.size <= search.BROADCAST_EDGES

    @property
    def mappable(self) -> bool:
        """Whether tasks may keep all edges in files."""
        return self.size <= mapped.MAPPED_EDGES

    def answers(self, asked: DataFrame, guided: bool = False) -> DataFrame:
        if self.small:
            return search.route(asked, self.by_profile, marks=self.marks if guided else None)
        if self.mappable:
            return search.route(asked, self.mapped)
        return search.relaxed(asked, self.walk, self.macros_ok, self.rings_ok, self.globals_ok)

    @cached_property
    def by_profile(self) -> search.Parts:
        if not self.small:
            raise ValueError("more edges than a task may hold: use answers()")
        return search.parts(self.n, self.walk, self.macros_ok, self.rings_ok, self.globals_ok)

    @cached_property
    def mapped(self) -> mapped.Mapped:
        if not self.mappable:
            raise ValueError("more edges than a task may keep in files: use answers()")
        return search.mapped_parts(self.n, self.walk, self.macros_ok, self.rings_ok, self.globals_ok)

    @cached_property
    def bound_mapped(self) -> mapped.Mapped:
        return landmarks.bound_mapped(self.n, self.walk, self.macros, self.rings)

    @cached_property
    def bound_parts(self) -> search.Parts:
        return landmarks.bound_parts(self.n, self.walk, self.macros, self.rings)

    @cached_property
    def bound_table(self) -> DataFrame:
        marks = self.globals.where("kind = 'poa_item'").select(F.col("id").alias("li"), F.col("dst").alias("node"))
        if self.small:
            return stored(landmarks.distance_tables(self.bound_parts, marks))
        if self.mappable:
            return stored(mapped.tables(self.bound_mapped, marks))
        return stored(landmarks.joined_tables(stored(landmarks.bound_edges(self.walk, self.macros, self.rings)), marks))

    @property
    def reach(self) -> landmarks.Reach:
        if self.small:
            return landmarks.searched(self.spark, self.bound_parts)
        if self.mappable:
            return lambda at: mapped.reached(self.bound_mapped, at)
        return landmarks.joined(self.spark, stored(landmarks.bound_edges(self.walk, self.macros, self.rings)))

    @cached_property
    def marks(self) -> DataFrame:
        return search.marked(self.bound_table)

    @cached_property
    def routes(self) -> DataFrame:
        """Answers to the resolvable queries; they all stay, found or not."""
        return stored(self.answers(self.queries.where("problem IS NULL").withColumn("seed", F.lit(0).cast("long"))))

    @cached_property
    def seeded_routes(self) -> DataFrame:
        return stored(self.answers(self.queries.where("problem IS NULL")))

    @cached_property
    def hops(self) -> DataFrame:
        return stored(routes.hops(self.routes))

    @cached_property
    def actions(self) -> DataFrame:
        return stored(routes.annotate(self.hops, self.macros, self.macros_ok, self.walk, self.globals_ok, self.rings_ok))


_worlds: dict[tuple[str, str], World] = {}


def world(spark: SparkSession, sf_dir: str) -> World:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _worlds:
        _worlds[key] = World(spark, sf_dir)
    return _worlds[key]
