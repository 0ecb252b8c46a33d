"""Detectors of messages as a registry: named rules with the inputs that they declare, planned into as few passes as these allow.

An input is something known of a message: a column worked out from others, or a step that joins. A detector names the inputs it needs, a SQL
text that gives its severity (``low``, ``medium``, ``high`` or null) from them, and its weight. From the detectors that are asked for, the plan keeps
only the inputs they need, puts all columns of one depth into one projection and each join where its own inputs are ready, and works out
every severity in one projection at the end. So a detector that needs texts only costs no shuffle, and one more detector costs no further pass over inputs that
others have already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import messages as M


@dataclass(frozen=True)
class Input:
    """``column``: SQL over ``needs``; or ``step``: a function of the rows so far and of the messages, which adds what ``gives`` names."""

    name: str
    needs: tuple[str, ...] = ()
    column: str | None = None
    step: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    gives: tuple[str, ...] = ()


@dataclass(frozen=True)
class Detector:
    name: str
    needs: tuple[str, ...]
    severity: str
    weight: int


@dataclass
class Registry:
    inputs: dict[str, Input] = field(default_factory=dict)
    detectors: dict[str, Detector] = field(default_factory=dict)

    def add_input(self, own: Input) -> Registry:
        if own.name in self.inputs:
            raise ValueError(f"there is an input {own.name} already")
        if (own.column is None) == (own.step is None):
            raise ValueError(f"the input {own.name} needs either a column or a step")
        self.inputs[own.name] = own
        return self

    def add(self, own: Detector) -> Registry:
        if own.name in self.detectors:
            raise ValueError(f"there is a detector {own.name} already")
        self.detectors[own.name] = own
        return self

    def plan(self, names: Iterable[str] | None = None) -> list[list[Input]]:
        """The inputs in passes: a list of columns that are worked out together, or one step."""
        wanted, order = list(self.detectors if names is None else names), []
        pending = [n for d in wanted for n in self._known(self.detectors, d).needs]
        need: set[str] = set()
        while pending:
            n = pending.pop()
            if n not in need:
                need.add(n)
                pending += self._known(self.inputs, n).needs
        done: set[str] = set()
        while need - done:
            ready = [i for n, i in self.inputs.items() if n in need - done and set(i.needs) <= done]
            if not ready:
                raise ValueError(f"inputs need each other: {sorted(need - done)}")
            columns = [i for i in ready if i.column is not None]
            pass_ = columns or ready[:1]
            order.append(pass_)
            done |= {i.name for i in pass_}
        return order

    @staticmethod
    def _known(table: dict, name: str):
        if name not in table:
            raise ValueError(f"nothing is known of {name}")
        return table[name]

    def found(self, messages: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """``messages`` (``msg_id, lang, text``) with the inputs that are needed, without texts, and ``s_<detector>`` of each detector."""
        wanted = list(self.detectors if names is None else names)
        own = messages.select("msg_id", "lang", "text")
        rows = own
        for pass_ in self.plan(wanted):
            if pass_[0].column is not None:
                rows = rows.selectExpr("*", *(f"{i.column} AS {i.name}" for i in pass_))
            else:
                rows = pass_[0].step(rows, own)
        return rows.selectExpr("*", *(f"{self.detectors[n].severity} AS s_{n}" for n in wanted)).drop("text")

    def facts(self, messages: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
        """``msg_id, indicator, severity, points`` of each detector that fires."""
        wanted = list(self.detectors if names is None else names)

        def points(n):
            cases = " ".join(f"WHEN '{s}' THEN {t * self.detectors[n].weight}" for s, t in rules.SEVERITY_TENTHS.items())
            return F.expr(f"CAST(CASE s_{n} {cases} ELSE 0 END AS DOUBLE) / 10")

        if not wanted:
            return messages.sparkSession.createDataFrame([], "msg_id long, indicator string, severity string, points double")
        listed = F.array(*(F.struct(F.lit(n).alias("indicator"), F.col(f"s_{n}").alias("severity"), points(n).alias("points")) for n in wanted))
        return self.found(messages, wanted).select("msg_id", F.explode(listed).alias("f")).select("msg_id", "f.*").where("severity is not null")

    def scores(self, messages: DataFrame) -> DataFrame:
        """``messages.message_scores`` by all detectors: those that the fixed scores know, and the points of any other besides."""
        lacking = set(M.INDICATORS) - set(self.detectors)
        if lacking:
            raise ValueError(f"the scores need {sorted(lacking)}")
        extra = {n: d.weight for n, d in self.detectors.items() if n not in M.INDICATORS}
        return M.message_scores(self.found(messages), extra)


def _flags(rows: DataFrame, messages: DataFrame, lexicon: DataFrame | None) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("bad_url", "verbs", "otp_phrase", "safe_part", "transactional")]
    return M.with_flags(rows.select(*kept), lexicon)


def message_registry(lexicon: DataFrame | None = None) -> Registry:
    """The inputs and detectors of messages as they are fixed; more may be added."""
    out = Registry()
    out.add_input(Input("flags", (), step=lambda rows, messages: _flags(rows, messages, lexicon), gives=("bad_url", "verbs", "otp_phrase", "safe_part", "transactional")))
    out.add_input(Input("counts", ("flags",), step=lambda rows, messages: M.with_counts(rows, messages, lexicon), gives=tuple(f"n_{x}" for x in M.LISTS)))
    for name, severity in M.severities().items():
        out.add(Detector(name, ("counts",), severity, rules.MESSAGE_WEIGHTS[name]))
    return out
