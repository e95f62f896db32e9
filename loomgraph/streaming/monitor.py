"""The behaviour monitor as a stateful stream, one small state per run."""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomgraph.operators.monitor import (CALLS_REASON, DRIFT_REASON, DRIFT_THRESHOLD, LOOP_LIMIT,
                                         LOOP_REASON, MAX_CALLS, drift_column)

OUTPUT = "run_id bigint, seq bigint, agent_name string, status string, reason string"
# workers open these without a session, so no DDL text here
_RUN = T.StructType([T.StructField("calls", T.LongType()), T.StructField("open", T.BooleanType()),
                     T.StructField("reason", T.StringType())])
_AGENT = T.StructType([T.StructField("agent_name", T.StringType())])
_SAID = T.StructType([T.StructField("responses", T.ArrayType(T.StringType()))])


class Breaker(StatefulProcessor):
    """State: the run's call count and breaker, and each agent's last responses.

    The call cap bounds the number of agents remembered; once open, a run keeps only its reason.
    """

    def __init__(self, loop_limit: int, max_calls: int, drift: float) -> None:
        self.loop_limit, self.max_calls, self.drift = loop_limit, max_calls, drift

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._run = handle.getValueState("run", _RUN)
        self._said = handle.getMapState("said", _AGENT, _SAID)

    def _violation(self, row: Row, calls: int, said: dict[str, list[str]]) -> str | None:
        if row.agent_name not in said:
            agent = (row.agent_name,)
            said[row.agent_name] = (list(self._said.getValue(agent)[0])
                                    if self._said.containsKey(agent) else [])
        last = said[row.agent_name] = [*said[row.agent_name], row.response][-self.loop_limit:]
        if calls > self.max_calls:
            return CALLS_REASON % self.max_calls
        if len(last) == self.loop_limit and len(set(last)) == 1:
            return LOOP_REASON % (row.agent_name, self.loop_limit)
        if row.similarity is not None and row.similarity < self.drift:
            return DRIFT_REASON % (f"{row.similarity:.4f}", self.drift)
        return None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._run.get()
        calls, is_open, reason = state if state else (0, False, None)
        # the cap trips at its next call at the latest, so only the earliest rows can be judged;
        # whatever falls out of this bounded heap comes after them and is rejected
        room = 0 if is_open else self.max_calls + 1 - calls
        judged: list = []
        for n, row in enumerate(rows):
            if room == 0:
                yield _out(row, "rejected")
            elif len(judged) < room:
                heapq.heappush(judged, (-row.seq, -n, row))
            else:
                yield _out(heapq.heappushpop(judged, (-row.seq, -n, row))[2], "rejected")
        said: dict[str, list[str]] = {}
        for _, _, row in sorted(judged, key=lambda entry: (-entry[0], -entry[1])):
            if is_open:
                yield _out(row, "rejected")
                continue
            calls += 1
            reason = self._violation(row, calls, said)
            is_open = reason is not None
            yield _out(row, "tripped" if is_open else "accepted", reason)
        if is_open:
            self._said.clear()
        else:
            for agent, last in said.items():
                self._said.updateValue((agent,), (last,))
        self._run.update((calls, is_open, reason))

    def close(self) -> None:
        pass


def _out(row: Row, status: str, reason: str | None = None) -> Row:
    return Row(run_id=row.run_id, seq=row.seq, agent_name=row.agent_name, status=status,
               reason=reason)


def monitor_stream(stream: DataFrame, loop_limit: int = LOOP_LIMIT, max_calls: int = MAX_CALLS,
                   drift: float = DRIFT_THRESHOLD) -> DataFrame:
    """Streaming form of ``operators.monitor.monitor``; micro-batches must arrive in run order.

    The reason stands on the tripped row; rejected rows carry none.
    """
    rows = stream.select("run_id", "seq", "agent_name", "response",
                         drift_column(stream).alias("similarity"))
    return rows.groupBy("run_id").transformWithState(
        statefulProcessor=Breaker(loop_limit, max_calls, drift), outputStructType=OUTPUT,
        outputMode="append", timeMode="none")


def rocksdb(spark) -> None:
    """The state store stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
