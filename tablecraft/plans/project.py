"""Projects of models: Python functions that return DataFrames.

A model body takes a context and returns a lazy DataFrame:

    project = Project(spark, warehouse, sources={"raw": {"orders": ".../orders.parquet"}})

    @project.model(materialized="incremental", unique_key="o_orderkey")
    def big_orders(ctx):
        orders = ctx.source("raw", "orders")
        if ctx.is_incremental:
            orders = ctx.newer(orders, "o_orderdate")
        return orders.where(F.col("o_totalprice") > ctx.var("threshold"))

    project.run("big_orders")

Bodies in SQL use ``ctx.sql("SELECT ... FROM {orders}", orders=ctx.source(...))``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import suppress
from dataclasses import dataclass, field
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablecraft.functions import builtins as fn
from tablecraft.operators import aggregates
from tablecraft.operators import incremental as inc
from tablecraft.operators.aggregates import Aggregate
from tablecraft.operators.evolve import Consumers, columns_from_fields, evolve
from tablecraft.operators.layout import Filter, Layout, condition, scan
from tablecraft.plans.contract import check_contract
from tablecraft.plans.definition import code_text
from tablecraft.plans.schema import Field
from tablecraft.sources.warehouse import Manifest, Warehouse

# How a model can be stored.
MATERIALIZATIONS = ("table", "view", "materialized_view", "ephemeral", "incremental")
DEFAULT_REFRESH_MINUTES = 30

_DEFINITION = "definition"
_REFRESHED = "refreshed_at"


class ProjectError(ValueError):
    """An unknown name or a model configuration that is not allowed."""


@dataclass(frozen=True)
class Model:
    """A body and how its result is stored."""

    name: str
    body: Callable[["Context"], DataFrame]
    materialized: str = "table"
    unique_key: tuple[str, ...] = ()
    incremental_strategy: str = "merge"
    layout: Layout = field(default_factory=Layout)
    schema: tuple[Field, ...] | None = None
    owns_table: bool = True
    properties: Mapping[str, Any] = field(default_factory=dict)
    enable_refresh: bool = False
    refresh_interval_minutes: int | None = None
    max_staleness: dt.timedelta | None = None
    aggregate: Aggregate | None = None

    def definition(self, variables: Mapping[str, Any] | None = None) -> str:
        """Changes when the body, what it uses, or the configuration changes."""
        text = code_text(self.body, variables)
        config = (
            self.materialized, self.unique_key, self.incremental_strategy, self.layout, self.schema,
            sorted(self.properties.items(), key=str),
        ) + ((self.aggregate,) if self.aggregate is not None else ())
        return hashlib.sha256((text + repr(config)).encode()).hexdigest()

    def problems(self) -> list[str]:
        out = []
        if self.materialized not in MATERIALIZATIONS:
            out.append(f"invalid materialization '{self.materialized}'; use {', '.join(MATERIALIZATIONS)}")
        if self.materialized == "incremental" and not self.unique_key:
            out.append("an incremental model needs a unique_key")
        if self.incremental_strategy not in inc.STRATEGIES:
            out.append(f"invalid incremental_strategy '{self.incremental_strategy}'; use {', '.join(inc.STRATEGIES)}")
        if self.enable_refresh and self.materialized != "materialized_view":
            out.append("enable_refresh goes only with a materialized_view")
        if self.refresh_interval_minutes is not None and not self.enable_refresh:
            out.append("refresh_interval_minutes needs enable_refresh=True")
        return out + (self.aggregate.problems() if self.aggregate is not None else [])


class Context:
    """What a body may use: sources, other models, its own table, variables."""

    def __init__(self, project: "Project", model: Model, run: "_Run", incremental: bool):
        self._project = project
        self._model = model
        self._run = run
        self.is_incremental = incremental

    @property
    def spark(self) -> SparkSession:
        return self._project.spark

    @property
    def run_ts(self) -> dt.datetime:
        return self._run.run_ts

    def now(self) -> Column:
        """The clock of this run, the same in every model of the run."""
        return fn.now(self._run.run_ts)

    def source(self, source: str, table: str) -> DataFrame:
        return self._project.source(source, table)

    def ref(self, model: str, where: Iterable[Filter] = ()) -> DataFrame:
        """Another model's result; filters on its partition column prune it."""
        return self._run.ref(model, asking=self._model.name, where=where)

    def this(self) -> DataFrame:
        """The model's own table as it was before this run."""
        if not self._project.warehouse.exists(self._model.name):
            raise ProjectError(f"model '{self._model.name}' has no table yet; test ctx.is_incremental first")
        return self._project.warehouse.read(self._model.name, guarded=False)

    def newer(self, df: DataFrame, column: str, this_column: str | None = None) -> DataFrame:
        """Rows above the highest value stored so far, as a pushed-down literal."""
        mark = inc.high_water_mark(self._project.warehouse, self._model.name, this_column or column)
        return inc.newer_than(df, column, mark)

    def var(self, name: str) -> Column:
        return F.lit(self.var_value(name))

    def var_value(self, name: str) -> Any:
        variables = self._project.vars
        if name not in variables:
            raise ProjectError(f"unknown variable '{name}'; available: {', '.join(sorted(variables))}")
        return variables[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A SQL body: ``{name}`` stands for a frame, ``:name`` for a variable."""
        return self.spark.sql(text, args=dict(self._project.vars), **frames)


class _Run:
    """Frames of one run: every ephemeral body is evaluated at most once."""

    def __init__(self, project: "Project", run_ts: dt.datetime):
        self._project = project
        self.run_ts = run_ts
        self._frames: dict[str, DataFrame] = {}
        self.asked: set[tuple[str, str]] = set()
        self._open: list[str] = []

    def body(self, model: Model, incremental: bool = False) -> DataFrame:
        if model.name in self._open:
            raise ProjectError(f"models refer to each other in a circle: {' -> '.join([*self._open, model.name])}")
        self._open.append(model.name)
        try:
            return model.body(Context(self._project, model, self, incremental))
        finally:
            self._open.pop()

    def ref(self, name: str, asking: str, where: Iterable[Filter] = ()) -> DataFrame:
        model = self._project.find(name, asking)
        self.asked.add((asking, name))
        if model.materialized in ("ephemeral", "view"):
            if name not in self._frames:
                self._frames[name] = self.body(model)
            return _filtered(self._frames[name], where)
        if not self._project.warehouse.exists(name):
            raise ProjectError(f"model '{name}' has not been run yet (needed by '{asking}')")
        if model.aggregate is not None:
            return _filtered(model.aggregate.result(self._project.warehouse.read(name, guarded=False)), where)
        return scan(self._project.warehouse, name, where)


def _filtered(df: DataFrame, where: Iterable[Filter]) -> DataFrame:
    for column, op, value in where:
        df = df.where(condition(column, op, value, df.schema[column].dataType))
    return df


class Project:
    """Models over sources, stored in one warehouse."""

    def __init__(
        self,
        spark: SparkSession,
        warehouse: Warehouse,
        sources: Mapping[str, Mapping[str, str]] | None = None,
        vars: Mapping[str, Any] | None = None,
    ):
        self.spark = spark
        self.warehouse = warehouse
        self.sources = {s: dict(t) for s, t in (sources or {}).items()}
        self.vars = dict(vars or {})
        self.models: dict[str, Model] = {}

    # -- declaration -----------------------------------------------------------
    def model(
        self,
        materialized: str = "table",
        name: str | None = None,
        unique_key: str | Sequence[str] = (),
        incremental_strategy: str = "merge",
        partition_by: Any = None,
        cluster_by: Sequence[str] | str | None = None,
        cluster_curve: bool = False,
        require_partition_filter: bool = False,
        partition_expiration_days: float | None = None,
        schema: Sequence[Field] | None = None,
        owns_table: bool = True,
        description: str | None = None,
        friendly_name: str | None = None,
        labels: Mapping[str, str] | None = None,
        default_collation: str | None = None,
        enable_refresh: bool = False,
        refresh_interval_minutes: int | None = None,
        max_staleness: dt.timedelta | None = None,
    ) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
        """Declare a model. ``owns_table=False``: the table is managed elsewhere."""
        options = {
            "description": description,
            "friendly_name": friendly_name,
            "labels": dict(labels) if labels else None,
            "default_collation": default_collation,
        }

        def declare(body: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
            made = Model(
                name=name or body.__name__,
                body=body,
                materialized=materialized,
                unique_key=(unique_key,) if isinstance(unique_key, str) else tuple(unique_key),
                incremental_strategy=incremental_strategy,
                layout=Layout.of(partition_by, cluster_by, require_partition_filter, partition_expiration_days, cluster_curve),
                schema=tuple(schema) if schema is not None else None,
                owns_table=owns_table,
                properties={k: v for k, v in options.items() if v is not None},
                enable_refresh=enable_refresh,
                refresh_interval_minutes=refresh_interval_minutes,
                max_staleness=max_staleness,
            )
            found = made.problems()
            if found:
                raise ProjectError(f"model '{made.name}': " + "; ".join(found))
            self.models[made.name] = made
            return body

        return declare

    def aggregate_view(
        self,
        name: str,
        view: Aggregate,
        enable_refresh: bool = False,
        refresh_interval_minutes: int | None = None,
        max_staleness: dt.timedelta | None = None,
        cluster_by: Sequence[str] | str | None = None,
    ) -> None:
        """Declare a materialized view that is refreshed from what changed in its table.

        It is built whole once, when its definition changes, and when its table was
        replaced or re-declared (see :mod:`tablecraft.operators.aggregates`).
        """
        made = Model(
            name=name, body=lambda ctx: view.whole(ctx.ref(view.table)), materialized="materialized_view", layout=Layout.of(None, cluster_by, False, None),
            enable_refresh=enable_refresh, refresh_interval_minutes=refresh_interval_minutes, max_staleness=max_staleness, aggregate=view)
        found = made.problems()
        if found:
            raise ProjectError(f"model '{name}': " + "; ".join(found))
        self.models[name] = made

    # -- lookup ------------------------------------------------------------------
    def find(self, name: str, asking: str | None = None) -> Model:
        if name not in self.models:
            where = f" (needed by '{asking}')" if asking else ""
            raise ProjectError(f"unknown model '{name}'{where}; declared: {', '.join(sorted(self.models))}")
        return self.models[name]

    def source(self, source: str, table: str) -> DataFrame:
        if source not in self.sources:
            raise ProjectError(f"unknown source '{source}'; declared: {', '.join(sorted(self.sources))}")
        tables = self.sources[source]
        if table not in tables:
            raise ProjectError(f"source '{source}' has no table '{table}'; it has: {', '.join(sorted(tables))}")
        place = tables[table]
        return self.spark.read.parquet(place) if "/" in place else self.spark.table(place)

    def read(self, name: str, where: Iterable[Filter] = ()) -> DataFrame:
        """The current result of a model, stored or not."""
        return _Run(self, self._clock(None)).ref(name, asking="read", where=where)

    def _clock(self, ts: dt.datetime | None) -> dt.datetime:
        """A point in time with its zone; without one the session's is meant."""
        if ts is None:
            return dt.datetime.now(dt.UTC)
        zone = ZoneInfo(self.spark.conf.get("spark.sql.session.timeZone"))
        return ts if ts.tzinfo is not None else ts.replace(tzinfo=zone)

    # -- running -------------------------------------------------------------------
    def run(self, name: str, run_ts: dt.datetime | None = None, full_refresh: bool = False) -> Manifest | None:
        """Build one model; the models it refers to must have been run.

        The first run, a changed definition and ``full_refresh`` build it whole;
        later runs of an incremental model apply its strategy.
        """
        model = self.find(name)
        run = _Run(self, self._clock(run_ts))
        if model.materialized == "ephemeral":
            run.body(model)
            return None
        if model.materialized == "view":
            run.body(model).createOrReplaceTempView(name)
            return None
        stored = self.warehouse.exists(name)
        if not model.owns_table and not stored:
            raise ProjectError(f"model '{name}' writes a table that is managed elsewhere, and it does not exist")
        unchanged = stored and self.warehouse.manifest(name).properties.get(_DEFINITION) == model.definition(self.vars)
        if model.materialized == "incremental" and stored and not full_refresh and (unchanged or not model.owns_table):
            df = run.body(model, incremental=True)
            self._check(model, df)
            return inc.apply_strategy(self.warehouse, name, df, model.incremental_strategy, model.unique_key)
        if model.aggregate is not None:
            return self._aggregate(model, run, unchanged and not full_refresh)
        df = run.body(model)
        self._check(model, df)
        stamp = {_DEFINITION: model.definition(self.vars), _REFRESHED: run.run_ts.isoformat()}
        if not model.owns_table:
            return replace_contents(self.warehouse, name, df)
        return self.warehouse.create(
            name,
            df,
            layout=model.layout,
            properties={**model.properties, **stamp},
            columns=columns_from_fields(model.schema) if model.schema is not None else None,
            run_ts=run.run_ts,
        )

    def _aggregate(self, model: Model, run: _Run, by_change: bool) -> Manifest:
        view = model.aggregate
        if not self.warehouse.exists(view.table):
            raise ProjectError(f"model '{view.table}' has not been run yet (needed by '{model.name}')")
        stamp = {_DEFINITION: model.definition(self.vars), _REFRESHED: run.run_ts.isoformat()}
        done = aggregates.refresh(self.warehouse, model.name, view, stamp) if by_change else None
        return done or aggregates.build(self.warehouse, model.name, view, model.layout, {**model.properties, **stamp}, run.run_ts)

    def _check(self, model: Model, df: DataFrame) -> None:
        rule = model.layout.rules[0] if model.layout.rules else None
        load_time = rule is not None and rule.field == "run_ts"
        check_contract(
            df,
            declared=model.schema,
            unique_key=model.unique_key,
            partition_field=rule.field if rule is not None and not load_time else None,
            cluster_by=model.layout.cluster_by,
        )

    def refresh_if_stale(self, name: str, now: dt.datetime) -> bool:
        """Recompute a materialized view that is too old; True if it ran.

        Too old: older than the refresh interval (if refresh is enabled) or
        than ``max_staleness``.
        """
        model = self.find(name)
        if model.materialized != "materialized_view":
            raise ProjectError(f"model '{name}' is not a materialized_view")
        if not self.warehouse.exists(name):
            self.run(name, run_ts=now)
            return True
        manifest = self.warehouse.manifest(name)
        age = self._clock(now) - dt.datetime.fromisoformat(manifest.properties[_REFRESHED])
        limits = []
        if model.enable_refresh:
            limits.append(dt.timedelta(minutes=model.refresh_interval_minutes or DEFAULT_REFRESH_MINUTES))
        if model.max_staleness is not None:
            limits.append(model.max_staleness)
        if not limits or age <= min(limits):
            return False
        self.run(name, run_ts=now)
        return True

    def consumers(self, name: str) -> Consumers:
        """Key, partition and cluster columns of the models that build on a table.

        Bodies are called to see what they refer to (nothing is computed), also
        through views and ephemeral models; one that cannot be built yet counts by
        what it referred to until then.
        """
        run = _Run(self, self._clock(None))
        for model in self.models.values():
            with suppress(ProjectError, AnalysisException):
                run.body(model)
        above: dict[str, set[str]] = {}
        for asking, asked in run.asked:
            above.setdefault(asked, set()).add(asking)
        found: set[str] = set()
        todo = [name]
        while todo:
            for model in above.get(todo.pop(), set()) - found:
                found.add(model)
                if self.models[model].materialized in ("ephemeral", "view"):
                    todo.append(model)
        using = [self.models[m] for m in sorted(found)]
        return Consumers(
            unique_keys=[k for m in using for k in m.unique_key],
            partition_fields=[r.field for m in using for r in m.layout.rules],
            cluster_columns=[c for m in using for c in m.layout.cluster_by],
        )

    def evolve(self, name: str, fields: Sequence[Field]) -> Manifest:
        """Change the columns of a model's table; columns that other models rely on are not dropped."""
        return evolve(self.warehouse, name, fields, self.consumers(name))

    def drop(self, name: str) -> None:
        """Forget a model; its table goes too unless it is managed elsewhere."""
        model = self.models.pop(name)
        if model.owns_table and self.warehouse.exists(name):
            self.warehouse.drop(name)


def replace_contents(warehouse: Warehouse, name: str, df: DataFrame) -> Manifest:
    """Swap all rows of an existing table; layout, comments, options stay."""
    return warehouse.overwrite(name, df)


def create_sql_view(spark: SparkSession, name: str, query: str) -> None:
    """Create or replace a catalog view over catalog tables."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")
