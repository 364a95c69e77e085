"""One object over an interaction relation: load, mine, fit, recommend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, components, facets, mining, profiling, recommend, temporal
from weftline.operators.graph import GraphModel
from weftline.plans.shared import cut, scope
from weftline.sources import interactions as source
from weftline.sources.session import session
from weftline.sources.store import Store


class Engine:
    """Interactions in a caller's session, and the models fitted to them. Results are lazy frames."""

    def __init__(self, spark: SparkSession | None = None, view: str = "interactions", path: str | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.view = view
        self.store = Store(self.spark, path) if path else None
        self.tables: dict[str, DataFrame] = {}
        self._rules: DataFrame | None = None
        self._similarity: recommend.ItemSimilarity | None = None
        self._graph: GraphModel | None = None
        self._popularity: DataFrame | None = None
        if self.store:
            self._restore()

    @property
    def interactions(self) -> DataFrame | None:
        return self.tables.get(self.view)

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written once: below the engine's folder, where a later engine finds it, else in the shared folder."""
        return self.store.put(name, df) if self.store else cut(df, name)

    def _restore(self) -> None:
        """What an earlier engine left below the folder."""
        if (found := self.store.get(f"tables-{self.view}")) is None:
            return
        self.tables[self.view] = found
        found.createOrReplaceTempView(self.view)
        self._rules, self._popularity = self.store.get("rules"), self.store.get("popularity")
        if (similar := self.store.get("similarity")) is not None:
            self._similarity = recommend.ItemSimilarity(found, stored=similar)
        edges, totals = self.store.get("edges"), self.store.get("totals")
        if edges is not None and totals is not None:
            self._graph = GraphModel(found, stored_edges=edges, stored_totals=totals)

    def __enter__(self) -> Engine:
        """Inside ``with``, intermediate tables go at the end, with the engine."""
        self._scope = scope()
        self._scope.__enter__()
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
        self._scope.__exit__(None, None, None)

    def __repr__(self) -> str:
        return f"Engine(view={self.view!r}, loaded={self.interactions is not None})"

    def close(self) -> None:
        """Drops the views and the models; the session, and what is stored, stay."""
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        self.tables = {}
        self._rules = self._similarity = self._graph = self._popularity = None

    def sql(self, query: str, args: Any = None) -> DataFrame:
        return self.spark.sql(query, args=args)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def register(self, name: str, data: Any) -> None:
        source.read_source(self.spark, data).createOrReplaceTempView(name)

    def load_interactions(self, data: Any, set_col: str, node_col: str, sort_col: str | None = None, sort_callback: Callable | None = None, append: bool = False, facet_cols: list[str] | None = None, facet_mode: str = "composite", table_name: str | None = None) -> int:
        """Rows of the relation after loading. Facets go into the set key ('composite') or become nodes ('entity').

        Operators work on the engine's own relation; ``table_name`` loads another one, for SQL.
        """
        df = source.read_source(self.spark, data)
        if facet_cols:
            facets.require_disjoint(set_col=set_col, node_col=node_col, sort_col=sort_col, facet_cols=facet_cols)
            if facet_mode == "composite":
                df, set_col = facets.composite_key(df, set_col, facet_cols), "_context_key"
            elif facet_mode == "entity":
                df = facets.facet_entities(df, set_col, node_col, facet_cols, extra_cols=[sort_col] if sort_col else None)
            else:
                raise ValueError(f"Unknown facet_mode: {facet_mode}")
        return self._set(source.canonical(df, set_col, node_col, sort_col, sort_callback), append, table_name)

    def load_interaction_matrix(self, data: Any, set_col: str = "set_id", append: bool = False) -> int:
        """A wide table with a column of set ids; a pandas frame may have them as its index."""
        if hasattr(data, "reset_index") and set_col not in list(data.columns):
            data = data.rename_axis(set_col).reset_index()
        return self._set(source.from_matrix(source.read_source(self.spark, data), set_col), append)

    def _set(self, new: DataFrame, append: bool, name: str | None = None) -> int:
        """Writes the relation once, in ranges of (set, node), so that operators read Parquet pruned by set and no source is parsed again."""
        name = name or self.view
        whole = source.append(self.tables.get(name) if append else None, new)
        self.tables[name] = self._keep(f"tables-{name}", whole.repartitionByRange("set_id", "node_id").sortWithinPartitions("set_id", "node_id"))
        self.tables[name].createOrReplaceTempView(name)
        if name == self.view:
            self._rules = self._similarity = self._graph = self._popularity = None
            for stored in ("rules", "similarity", "edges", "totals", "popularity") if self.store else ():
                self.store.drop(stored)
        return self.tables[name].count()

    def save(self, path: str) -> None:
        source.write(self._loaded(), path)

    def load(self, path: str) -> int:
        return self._set(self.spark.read.parquet(path), False)

    def _loaded(self) -> DataFrame:
        if self.interactions is None:
            raise RuntimeError("Call load_interactions() first.")
        return self.interactions

    def frequent_itemsets(self, min_support: float = 0.05, max_len: int | None = None, **kw: Any) -> DataFrame:
        """By length, then falling support."""
        return mining.frequent_itemsets(self._loaded(), min_support, max_len, **kw).orderBy("length", F.desc("support"), "itemset")

    def association_rules(self, min_support: float = 0.05, min_confidence: float = 0.1, min_lift: float = 0.0, max_antecedent_len: int | None = None, itemsets: DataFrame | None = None) -> DataFrame:
        """Mined rules by falling lift; written once, since recommendations and profiles read them again."""
        found = itemsets if itemsets is not None else mining.frequent_itemsets(self._loaded(), min_support)
        self._rules = self._keep("rules", mining.association_rules(found, min_confidence, min_lift, max_antecedent_len))
        return mining.by_lift(self._rules)

    def sequential_patterns(self, **kw: Any) -> DataFrame:
        """By falling support."""
        return mining.sequential_patterns(self._loaded(), **kw).orderBy(F.desc("support"), "pattern")

    def find_sink_sccs(self, min_cooccurrence: int = 5, min_confidence: float = 0.0) -> DataFrame:
        return components.sink_components(self._loaded(), min_cooccurrence, min_confidence)

    def fit_cf(self, metric: str = "jaccard", min_cooccurrence: int = 1, top_k_similar: int = 50) -> Engine:
        """Works the similarities out and writes them; recommendations read the table."""
        model = recommend.ItemSimilarity(self._loaded(), metric, min_cooccurrence, top_k_similar)
        self._similarity = replace(model, stored=self._keep("similarity", model.table))
        return self

    def recommend_cf(self, seeds: list[str], n: int = 10, exclude_seed: bool = True) -> DataFrame:
        if self._similarity is None:
            raise RuntimeError("Call fit_cf() first.")
        return self._similarity.recommend(seeds, n, exclude_seed)

    def fit_graph(self, min_cooccurrence: int = 1, alpha: float = 0.0) -> Engine:
        """Works edges and totals out and writes them; rankings read the tables."""
        model = GraphModel(self._loaded(), min_cooccurrence, alpha)
        self._graph = replace(model, stored_edges=self._keep("edges", model.edges), stored_totals=self._keep("totals", model.totals))
        return self

    @property
    def graph(self) -> GraphModel:
        if self._graph is None:
            self.fit_graph()
        return self._graph

    def recommend_graph(self, seeds: list[str], n: int = 10, **kw: Any) -> DataFrame:
        return self.graph.recommend(seeds, n=n, **kw)

    def score_basket(self, items: list[str]) -> DataFrame:
        return self.graph.score_basket(items)

    def rank_nodes(self, seeds: list[str], steps: int = 2, scoring: str = "probability", limit: int = 10) -> DataFrame:
        return self.graph.rank_nodes(seeds, steps, scoring, limit)

    def fit_popularity(self, strategy: str = "global", timestamp_col: str | None = None, window_days: int = 30) -> Engine:
        self._popularity = self._keep("popularity", recommend.popularity(self._loaded(), strategy, timestamp_col, window_days))
        return self

    def recommend_popular(self, n: int = 10, exclude_items: list[str] | None = None) -> DataFrame:
        if self._popularity is None:
            self.fit_popularity()
        return recommend.recommend_popular(self._popularity, n, exclude_items)

    def recommend_by_rules(self, seeds: list[str], n: int = 10, metric: str = "lift") -> DataFrame:
        if self._rules is None:
            raise RuntimeError("Call association_rules() first.")
        return mining.recommend_by_rules(self._rules, seeds, n, metric)

    def recommend(self, seeds: list[str] | None = None, strategy: str = "auto", n: int = 10, **kw: Any) -> DataFrame:
        """By strategy 'rules', 'cf', 'graph' or 'popular*'; 'auto' takes the first of rules, cf that is fitted, else the graph."""
        if strategy == "auto":
            strategy = "rules" if self._rules is not None else "cf" if self._similarity else "graph"
        if strategy == "graph":
            out = self.recommend_graph(seeds or [], n, **kw)
        elif strategy == "cf":
            out = self.recommend_cf(seeds or [], n, **kw)
        elif strategy == "rules":
            out = self.recommend_by_rules(seeds or [], n, **kw)
        elif strategy.startswith("popular"):
            out = self.recommend_popular(n, **kw)
        else:
            raise ValueError(f"Unknown strategy: {strategy}")
        return out.withColumnRenamed("item_id", "recommended_item")

    def recommend_by_facet(self, seeds: list[str], data: Any, set_col: str, node_col: str, facet_cols: str | list[str], **kw: Any) -> DataFrame:
        return facets.recommend_by_facet(source.read_source(self.spark, data), seeds, set_col, node_col, facet_cols, **kw)

    def profile_rules(self, **kw: Any) -> profiling.Profile:
        if self._rules is None:
            raise RuntimeError("Call association_rules() first.")
        return profiling.profile_rules(self._rules, **kw)

    def profile_items(self, **kw: Any) -> profiling.Profile:
        if self._rules is None:
            raise RuntimeError("Call association_rules() first.")
        return profiling.profile_items(self._rules, **kw)

    def decay_graph(self, **kw: Any) -> temporal.DecayGraph:
        return temporal.DecayGraph(self._loaded(), **kw)

    def sliding_graph(self, **kw: Any) -> temporal.SlidingGraph:
        return temporal.SlidingGraph(self._loaded(), **kw)

    def directed_graph(self, **kw: Any) -> temporal.DirectedGraph:
        return temporal.DirectedGraph(self._loaded(), **kw)

    def snapshots(self, **kw: Any) -> temporal.SnapshotDiff:
        return temporal.SnapshotDiff(self._loaded(), **kw)

    def component_tracker(self, **kw: Any) -> temporal.ComponentTracker:
        return temporal.ComponentTracker(self._loaded(), **kw)

    def temporal_report(self, **kw: Any) -> dict[str, DataFrame]:
        return aggregates.temporal_report(self._loaded(), **kw)


class InteractionGraph:
    """The node-centric names over the same engine."""

    def __init__(self, spark: SparkSession | None = None):
        self.engine = Engine(spark)

    def load_interactions(self, data: Any, context_col: str, node_col: str) -> int:
        return self.engine.load_interactions(data, context_col, node_col)

    def build_topology(self, min_interactions: int = 1) -> InteractionGraph:
        self.engine.fit_graph(min_interactions)
        return self

    def rank_nodes(self, seed_nodes: list[str], steps: int = 2, scoring: str = "probability", limit: int = 10) -> DataFrame:
        return self.engine.rank_nodes(seed_nodes, steps, scoring, limit)

    def find_equilibrium_communities(self, min_cooccurrence: int = 5, min_confidence: float = 0.0) -> DataFrame:
        return self.engine.find_sink_sccs(min_cooccurrence, min_confidence)


def load(data: Any, spark: SparkSession | None = None, **kw: Any) -> Engine:
    """An engine with ``data`` loaded."""
    engine = Engine(spark)
    engine.load_interactions(data, **kw)
    return engine


def connect(database: str | None = None, memory_limit: str | None = None, threads: int | None = None) -> Engine:
    """An engine on the running session, else on a local one; below the folder ``database`` it keeps what it loads and fits, and finds it again."""
    return Engine(session(threads, memory_limit), path=None if database == ":memory:" else database)


def empty(spark: SparkSession) -> DataFrame:
    """A relation without rows."""
    return spark.createDataFrame([], source.EMPTY).withColumn("sort_column", F.lit(None).cast("timestamp_ntz"))
