"""A panel: its rows, the frame that governs it, and whether its labels are up to date."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions.predicates import as_list
from ..functions.values import is_number, kinds
from ..operators import accounting, balance, dedup, impute, membership, normalize, smooth
from ..sources.tables import read_manifest
from .frame import Applied, SampleFrame, apply_frame


@dataclass(frozen=True)
class Panel:
    """Immutable; each verb gives a new panel with one more ledger entry.

    ``fresh`` tells whether the frame's membership labels fit the rows. Verbs that
    add or drop rows make them stale; ``filter`` then refreshes them first.
    """

    df: DataFrame
    frame: SampleFrame = field(default_factory=SampleFrame)
    fresh: bool = False
    reads: tuple = ()
    joins: tuple = ()
    source: object = None
    summary: membership.Summary | None = None

    @property
    def entity(self) -> str:
        return self.frame.entity

    @property
    def time(self) -> str:
        return self.frame.time

    def _with(self, step: str, make, stale: bool, lazy: bool = True, **args) -> Panel:
        """``make`` gives the rows after the step; ``lazy`` if it does so without running a job."""
        df = make(self.df)
        detail = "; ".join(f"{k}={','.join(map(str, as_list(v)[:3]))}" for k, v in args.items() if v is not None)
        frame = replace(self.frame, ledger=self.frame.ledger.add(step, detail, self.df, df, make if lazy else None))
        return replace(self, df=df, frame=frame, fresh=self.fresh and not stale, summary=None if stale else self.summary)

    def deduplicate(self, **args) -> Panel:
        return self._with("deduplicate", lambda df: dedup.deduplicate(df, self.entity, self.time, **args), True, **args)

    def _known(self) -> dict:
        """What ``describe`` has found out about these very rows, for verbs that would find it out again."""
        return {"classification": self.summary.classification, "years": self.summary.years} if self.summary else {}

    def impute(self, **args) -> Panel:
        return self._with("impute", lambda df: impute.impute(df, time=self.time, id=self.entity, **{**self._known(), **args}), True, lazy=False, **args)

    def complete(self, **args) -> Panel:
        return self._with("complete", lambda df: impute.complete(df, time=self.time, id=self.entity, **{**self._known(), **args}), True, lazy=False, **args)

    def balance(self, **args) -> Panel:
        observed = self.summary.years if self.summary else None
        return self._with("balance", lambda df: balance.balance(df, time=self.time, id=self.entity, **{"observed": observed, **args}).df, True, lazy=False, **args)

    def smooth(self, vars, **args) -> Panel:
        return self._with("smooth", lambda df: smooth.smooth(df, vars, time=self.time, id=self.entity, **args), False, lazy=is_number(kinds(self.df).get(self.time, "")), vars=vars, **args)

    def label(self, **args) -> Panel:
        known = {"classification": self.summary.classification} if self.summary else {}
        return self._with("label", lambda df: membership.label(df, time=self.time, id=self.entity, **{**known, **args}), False, lazy=bool(known))

    def normalize(self, **args) -> Panel:
        return self._with("normalize", lambda df: normalize.panel_normalize(df, **args).df, False, **args)

    def reconcile(self, **args) -> Panel:
        return self._with("reconcile", lambda df: accounting.reconcile(df, **args), False, **args)

    def accounting_check(self, **args) -> DataFrame:
        return accounting.accounting_check(self.df, id=self.entity, time=self.time, **args)

    def describe(self) -> tuple[Panel, membership.Summary]:
        """The panel with fresh labels, and its summary."""
        summary = membership.describe(self.df, self.time, self.entity)
        frame = self.frame.classified(self.df, summary.classification)
        frame = replace(frame, ledger=frame.ledger.add("describe", "classified panel", self.df, self.df))
        return replace(self, frame=frame, fresh=True, summary=summary), summary

    def update(self) -> Panel:
        """With labels that fit the rows; nothing is dropped."""
        summary = membership.describe(self.df, self.time, self.entity)
        frame = self.frame.classified(self.df, summary.classification)
        return replace(self, frame=replace(frame, ledger=frame.ledger.add("update", "refreshed labels", self.df, self.df)), fresh=True, summary=summary)

    def filter(self, panel_type=None, spell=None, min_obs: int | None = None, assume_fresh: bool = False) -> Panel:
        """Keep the entities of these classes; the choice becomes a rule of the frame."""
        at = self if self.fresh or assume_fresh else self.describe()[0]
        frame = at.frame
        for column, values in (("panel_type", panel_type), ("panel_spell", spell)):
            if values is not None:
                frame = govern(frame, column, as_list(values))
        known = at.summary.classification if at.summary else None

        def make(df: DataFrame) -> DataFrame:
            return membership.filter_members(df, panel_type, spell, min_obs, known, at.time, at.entity)

        out = make(at.df)
        detail = "; ".join(f"{k}={','.join(map(str, as_list(v)))}" for k, v in (("type", panel_type), ("spell", spell), ("min_obs", min_obs)) if v is not None)
        return replace(at, df=out, frame=replace(frame, ledger=frame.ledger.add("filter", detail, at.df, out, make if known is not None else None)), summary=None)

    def apply(self, **adhoc) -> Applied:
        return apply_frame(self.df, self.frame, **adhoc)

    def manifest(self) -> DataFrame:
        """The ledger with its counts."""
        return self.frame.ledger.manifest(self.df.sparkSession)

    def sources(self) -> DataFrame:
        """The table-years that the panel was built from, with their rows and columns before and after reading; none if it was made of rows."""
        return read_manifest(self.df.sparkSession, list(self.reads))

    def __repr__(self) -> str:
        return f"<panel> {self.frame.name}: {len(self.df.columns)} columns, labels {'fresh' if self.fresh else 'stale'}, {len(self.frame.ledger.entries)} steps"


def govern(frame: SampleFrame, column: str, values: list) -> SampleFrame:
    """The filter as a rule of the frame; a rule on the column with other values goes to the ledger."""
    before = [r for r in frame.rules if r.type == "filter" and r.predicate.column == column and r.predicate.expr is None]
    if before and list(before[0].predicate.values) != values:
        warnings.warn(f"overriding the filter on {column}; the previous rule is in the ledger", stacklevel=3)
        frame = replace(frame, ledger=frame.ledger.add("rule_demoted", before[0].predicate.detail()))
    return frame.add_rule("filter", f"filter:{column}", column=column, op="in", values=values)


def as_panel(df: DataFrame | Panel, frame: SampleFrame | None = None) -> Panel:
    return df if isinstance(df, Panel) else Panel(df, frame or SampleFrame(keys={"entity": "EIN2", "time": "TAX_YEAR"}))


def is_panel(x) -> bool:
    return isinstance(x, Panel)
