"""The stage machine: one ordered chain, and the maps that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY_STATE = "discovered"
#: Each stage and the state an article is in once it is done.
CHAIN = (("acquire", "acquired"), ("classify", "classified"), ("cluster", "clustered"))

STATE_AFTER = dict(CHAIN)
SUCCESSOR = {stage: after for (stage, _), (after, _) in zip(CHAIN, CHAIN[1:])}
OWED = {before: stage for before, (stage, _) in zip((ENTRY_STATE, *STATE_AFTER.values()), CHAIN)}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def owed_stage(state: Column, terminal_reason: Column) -> Column:
    """The stage an article owes; NULL when it is terminal or done."""
    return F.when(terminal_reason.isNull(), _lookup(OWED, state))


def state_after(stage: Column) -> Column:
    return _lookup(STATE_AFTER, stage)


def successor(stage: Column) -> Column:
    return _lookup(SUCCESSOR, stage)
