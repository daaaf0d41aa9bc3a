"""Streams over file sources: stateless preprocessing, packing, sessions and resumable jobs.

A stream has arrival order only. Operators that carry rows over from one
micro-batch to the next flush when a row that marks the end of a key comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from millrace.operators.sampling import PRIME, best_fit
from millrace.sources.workers import is_folder


GIVEN = 1000  # rows that a shuffle holds besides its buffer


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int | None = 16) -> DataFrame:
    """Parquet files of one name pattern in a folder, as they come; a name that is a folder's means the files in it.

    Without ``files_per_batch`` a micro-batch is all that is there.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; exactly-once files, and a checkpoint to go on from."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A resumable job: each micro-batch goes to ``work`` with its number, which makes repeated batches overwrite themselves."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pack_stream(stream: DataFrame, key: str, item: str, length: str, volume: int) -> DataFrame:
    """(shard, items, filled): bins of constant volume for each key; the open bin is carried over, and flushed by a row of length -1."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches))
        end = bool((rows[length] < 0).any())
        todo = [*zip(items, sizes), *rows.loc[rows[length] >= 0, [item, length]].itertuples(index=False)]
        bins = [[[int(i) for i, _ in b], sum(int(n) for _, n in b), [int(n) for _, n in b]] for b in best_fit(sorted(todo), volume)]
        bins.sort(key=lambda b: -b[1])
        last = None if end or not bins else bins.pop()
        if last:
            state.update((last[0], last[2]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"shard": [k[0]] * len(bins), "items": [b[0] for b in bins], "filled": [b[1] for b in bins]})

    return stream.groupBy(key).applyInPandasWithState(run, "shard long, items array<long>, filled long", "items array<long>, sizes array<long>", "append", "NoTimeout")


def session_stream(stream: DataFrame, key: str, order: list[str], begins: str, value: str, delay: str | None = None) -> DataFrame:
    """(key, session, n, total) of closed sessions; one closes when the next begins or at a row whose value is null.

    Rows are put in order within a micro-batch. With ``delay`` the first column
    of ``order`` is event time: a row waits in the state until the watermark has
    passed it, so rows that come late by up to ``delay`` find their place whatever
    the micro-batch; later ones go. A row without a time ends its key at once.
    """
    waits = delay is not None
    if waits:
        stream = stream.withWatermark(order[0], delay)
    fields, types = list(dict.fromkeys([*order, begins, value])), dict(stream.dtypes)
    times = {c for c in fields if types[c].startswith("timestamp")}

    def kept(c: str, x):
        """A value as the state holds it, in the type of its column: times are microseconds."""
        if pd.isna(x):
            return None
        if c in times:
            return pd.Timestamp(x).value // 1000
        if types[c] in ("tinyint", "smallint", "int", "bigint"):  # floats where a batch has nulls
            return int(x)
        return x.item() if hasattr(x, "item") else x

    def taken(c: str, x):
        return pd.Timestamp(x, unit="us") if c in times and x is not None else x

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session, n, total, *held = state.get if state.exists else (0, 0, 0.0, *[[] for _ in fields])
        rows = [r for batch in batches for r in batch[fields].to_dict("records")]
        rows += [{c: taken(c, x) for c, x in zip(fields, r)} for r in zip(*held)]
        rows.sort(key=lambda r: [(pd.isna(r[c]), 0 if pd.isna(r[c]) else r[c]) for c in order])
        ended = any(pd.isna(r[value]) for r in rows)
        later = []
        if waits and not ended:
            passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
            later = [r for r in rows if r[order[0]] > passed]
            rows = [r for r in rows if r[order[0]] <= passed]
        out = []
        for r in rows:
            end = pd.isna(r[value])
            if (r[begins] and not end) or end:
                if n:
                    out.append((k[0], session, n, total))
                session, n, total = session + 1, 0, 0.0
            if not end:
                n, total = n + 1, total + float(r[value])
        state.update((session, n, total, *[[kept(c, r[c]) for r in later] for c in fields]))
        if later:
            state.setTimeoutTimestamp(max(int(min(r[order[0]] for r in later).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "session", "n", "total"])

    held_types = ", ".join(f"held_{i} array<{'long' if c in times else types[c]}>" for i, c in enumerate(fields))
    state = f"session long, n long, total double, {held_types}"
    return stream.groupBy(key).applyInPandasWithState(run, "key long, session long, n long, total double", state, "append", "EventTimeTimeout" if waits else "NoTimeout")


def shuffle_stream(stream: DataFrame, lane: str, row: str, buffer: int = 1000, seed: int = 42) -> DataFrame:
    """(lane, place, row): a shuffle through a buffer for each lane, in the order of ``place``.

    Rows are texts (JSON of a struct, say). The first ``buffer`` rows of a lane
    fill its buffer; then every row takes the place of a drawn one, which goes
    out. A null row empties the buffer, in drawn order. Draws depend on the
    seed, the lane and the number of rows gone out, not on micro-batches.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, gone = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out: list[str] = []

        def given() -> pd.DataFrame:
            nonlocal gone
            rows = pd.DataFrame({"lane": [k[0]] * len(out), "place": range(gone, gone + len(out)), "row": out})
            gone += len(out)
            out.clear()
            return rows

        def send(at: int, new: str | None) -> None:
            out.append(held[at])
            if new is None:
                held[at] = held[-1]
                held.pop()
            else:
                held[at] = new

        for batch in batches:
            for text in batch[row]:
                if text is None:
                    while held:
                        send(_drawn(seed, k[0], gone + len(out), len(held)), None)
                elif len(held) < buffer:
                    held.append(text)
                else:
                    send(_drawn(seed, k[0], gone + len(out), len(held)), text)
                if len(out) >= GIVEN:  # rows go out as they come, whatever the size of a micro-batch
                    yield given()
        state.update((held, gone + len(out)))
        yield given()

    return stream.groupBy(lane).applyInPandasWithState(run, "lane long, place long, row string", "held array<string>, gone long", "append", "NoTimeout")


def _drawn(seed: int, lane: int, n: int, below: int) -> int:
    """A number below a bound, from a seed, a lane and a count."""
    x = (seed * 69_621 + lane * 16_807 + n * 48_271 + 11) % PRIME
    return (x * 48_271 + x // 127) % PRIME % below
