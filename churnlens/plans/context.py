"""Shared per-run context: the roles and the base views computed once and passed along.

A ``Context`` memoises the lazy DataFrames of the base views, so a query that
needs the churn state three times builds one plan node and Spark sees one
sub-plan (shared exchanges are re-used).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..config import TESTDATA_CONFIG, ChurnConfig
from ..session import collecting, materialize_at
from ..sources.roles import Roles, testdata_roles
from . import state as st


class Context:
    def __init__(self, roles: Roles, cfg: ChurnConfig, sources: dict[str, DataFrame] | None = None):
        self.roles = roles
        self.cfg = cfg
        self.sources = sources  # raw tables the roles were derived from (for load reconciliation)
        self.by_account = False  # the facts are stored in buckets by account
        self._paths: list[str] = []  # tables this context materialized

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, cfg: ChurnConfig = TESTDATA_CONFIG) -> "Context":
        from ..sources.roles import read_table

        sources = {n: read_table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
        return cls(testdata_roles(spark, sf_dir), cfg, sources)

    @classmethod
    def from_parquet_roles(cls, spark: SparkSession, folder: str, cfg: ChurnConfig) -> "Context":
        """Context over roles stored by :func:`churnlens.sources.io.write_roles` (the production path:
        load once, analyse many times; fact roles are month-partitioned and pruned by windows)."""
        from ..sources.io import read_roles_parquet

        return cls(Roles(**read_roles_parquet(spark, folder)), cfg)

    @classmethod
    def from_account_buckets(cls, spark: SparkSession, prefix: str, cfg: ChurnConfig) -> "Context":
        """Context over roles stored by :func:`churnlens.sources.io.write_by_account`: what is grouped by
        account (and day) is read in place, so the daily rollups are not written a second time."""
        from ..sources.io import read_by_account

        out = cls(Roles(**read_by_account(spark, prefix)), cfg)
        out.by_account = True
        return out

    def materialize(self, df: DataFrame) -> DataFrame:
        """Write a frame that several consumers read to a parquet table in the session
        checkpoint folder (lineage cut, survives executor loss)."""
        if not self.cfg.materialize:
            return df
        with collecting(self._paths):
            return materialize_at(df)[0]

    _materialize = materialize

    def release(self, spark: SparkSession) -> int:
        """Delete the tables this context materialized (call when the analysis is done).
        Frames taken from this context before must not be used afterwards."""
        from ..session import release_materialized

        for name in [k for k in self.__dict__ if k not in ("roles", "cfg", "sources", "by_account", "_paths")]:
            del self.__dict__[name]  # cached frames; they are rebuilt on next use
        paths, self._paths = self._paths, []
        return release_materialized(spark, paths)

    @cached_property
    def state(self) -> DataFrame:
        """One row per account; read by almost every query, so written once."""
        return self.materialize(st.churn_state(self.roles.accounts, self.roles.churn_events))

    @cached_property
    def refs(self) -> DataFrame:
        return st.reference_dates(self.state, self.cfg)

    @cached_property
    def value(self) -> DataFrame:
        """(account_id, mrr, arr) at each account's value date, every account kept - for consumers
        that need the value only (no all-time usage scan)."""
        v = st.value_at_ref(self.refs, self.roles.subscriptions)
        return self.materialize(self.roles.accounts.select("account_id").join(v, "account_id", "left"))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.materialize(st.account_metrics(self.roles, self.state, self.cfg))

    @cached_property
    def usage_daily(self) -> DataFrame:
        """Usage per (account, day): the input of every per-account-reference window."""
        from .diagnosis import usage_daily

        return usage_daily(self) if self.by_account else self.materialize(usage_daily(self))

    @cached_property
    def tickets_daily(self) -> DataFrame:
        """Tickets per (account, day, midnight-or-later): input of the support windows."""
        from .diagnosis import tickets_rollup

        daily = tickets_rollup(self.roles.tickets)
        return daily if self.by_account else self.materialize(daily)

    def backtest_panel(self, cuts, state_mode: str = "final") -> DataFrame:
        """Back-test scores at ``cuts``, computed once per (cuts, state mode)."""
        cache = self.__dict__.setdefault("_backtests", {})
        key = (tuple(cuts), state_mode)
        if key not in cache:
            from .panel import backtest_panel

            cache[key] = self.materialize(backtest_panel(self, cuts, state_mode))
        return cache[key]

    def state_before(self, day) -> DataFrame:
        """Churn state built only from the events dated before ``day`` (as-of state)."""
        from pyspark.sql import functions as F

        events = self.roles.churn_events.where(F.col("churn_date") < F.lit(day))
        return st.churn_state(self.roles.accounts, events)

    # ------------------------------------------------------------ early warning
    @cached_property
    def signals(self) -> DataFrame:
        from .risk import live_at_close, risk_signals

        return self._materialize(risk_signals(self, live_at_close(self), self.cfg.close_date))

    @cached_property
    def scores(self) -> DataFrame:
        from .risk import risk_scores

        return self._materialize(risk_scores(self.signals, self.cfg, stored=self.cfg.materialize))

    @cached_property
    def priority(self) -> DataFrame:
        from .risk import priority_portfolio

        return self._materialize(priority_portfolio(self.scores, self.value, self.cfg))

    @cached_property
    def portfolio(self) -> DataFrame:
        """One row per account: its priority and the features it ever used - what the adoption gap, the
        breadth threshold and the recommender read."""
        from .recommend import used_features, with_features

        return self._materialize(with_features(self.priority, used_features(self.roles.usage)))

    @cached_property
    def catalogue(self) -> DataFrame:
        """One row per feature: its users by risk group, counted in one pass over the portfolio."""
        from .recommend import feature_counts

        return self._materialize(feature_counts(self.portfolio))

    @cached_property
    def recommendations(self) -> DataFrame:
        from .recommend import recommend

        return recommend(self.portfolio, self.catalogue, self.cfg)
