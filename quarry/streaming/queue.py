"""First-in-first-out queues of links, as keyed state of a stream.

A queue starts a link only after the one before it has settled.  A link that
waits or runs is not queued again; one that settled may be saved again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DISPATCHED = "queue string, dispatch_id long, url string, source string"
#: What a session needs for this kind of state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LinkQueue(StatefulProcessor):
    """State of one queue: links that wait, by number; which links wait; and the running link with the counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "n long", "url string, source string")
        self.known = handle.getMapState("known", "url string", "n long")
        self.pointer = handle.getValueState("pointer", "head long, tail long, dispatched long, running string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head, tail, dispatched, running = self.pointer.get() if self.pointer.exists() else (0, 0, 0, None)
        started = []
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):  # the batch's rows of this queue
            url = (row["url"] or "").strip()
            if row["kind"] == "settled":
                running = None if not url or url == running else running
            elif url and url != running and not self.known.containsKey((url,)):
                self.waiting.updateValue((tail,), (url, row["source"]))
                self.known.updateValue((url,), (tail,))
                tail += 1
            if running is None and head < tail:
                running, source = self.waiting.getValue((head,))
                self.waiting.removeKey((head,))
                self.known.removeKey((running,))
                head, dispatched = head + 1, dispatched + 1
                started.append(Row(queue=key[0], dispatch_id=dispatched, url=running, source=source))
        self.pointer.update((head, tail, dispatched, running))
        yield from started

    def close(self) -> None:
        pass


def dispatched(events: DataFrame) -> DataFrame:
    """Links as their queues start them, from a stream of (queue, kind, url, source, at, seq).

    kind is "save" or "settled"; a settled event without a link ends whatever
    runs, one of another link than the running one ends nothing.  Events of a
    batch count in order of at, then seq; blank links do not count.  A session
    must name the state store of STATE_STORE.
    """
    rows = events.select(F.coalesce("queue", F.lit("")).alias("queue"), "kind", "url", "source", "at", "seq")
    return rows.groupBy("queue").transformWithState(LinkQueue(), DISPATCHED, "append", "none")
