"""The live form of operators.budget.deal: one key a budget, its leases in a map state, so a restarted query goes on dealing where it was.

Requests of a budget must arrive in the order of seq. The state store must be RocksDB (`runs.use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.budget import DEALT, grant

REQUEST = "budget string, seq long, kind string, request_id string, n long"


class _Held:
    """A map state as the mapping that `grant` wants."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, request: str) -> bool:
        return self.state.containsKey((request,))

    def __getitem__(self, request: str) -> int:
        return int(self.state.getValue((request,))[0])

    def get(self, request: str, default: int) -> int:
        return self[request] if request in self else default

    def __setitem__(self, request: str, n: int) -> None:
        self.state.updateValue((request,), (int(n),))


class Leases(StatefulProcessor):
    def __init__(self, cap: int, block: int):
        self.cap, self.block = cap, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.free = handle.getValueState("free", StructType().add("n", LongType()))
        self.held = handle.getMapState("held", StructType().add("request_id", StringType()), StructType().add("n", LongType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        free, held, out = int(self.free.get()[0]) if self.free.exists() else self.cap, _Held(self.held), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            granted, free, refused = grant(free, held, r.kind, r.request_id, int(r.n), self.block)
            out.append((key[0], r.request_id, r.seq, max(granted, 0), free, refused or granted < 0))
        self.free.update((free,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DEALT.split(", ")])

    def close(self) -> None:
        pass


def lease_stream(requests: DataFrame, cap: int, block: int) -> DataFrame:
    """Every request with what it is granted."""
    return requests.groupBy("budget").transformWithStateInPandas(Leases(cap, block), DEALT, "Append", "None")
