"""Revisions as they come: each is compared with the one before it of its document.

State is one row for each document: the digest and line counts of its last revision. A delivery that repeats a digest is
dropped. The result for a document does not depend on how deliveries are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "doc_id long, revision long, added long, deleted long, kept long"
STATE = "sha string, revision long, keys array<string>, counts array<long>"


def _lines(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for line in (text or "").split("\n"):
        key = " ".join(line.split())
        if key:
            out[key] = out.get(key, 0) + 1
    return out


def compare_with_last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get if state.exists else ("", -1, [], [])
    sha, revision, before = held[0], held[1], dict(zip(held[2], held[3]))
    rows = pd.concat(list(frames), ignore_index=True).sort_values("revision", kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        if r.sha == sha or r.revision <= revision:
            continue
        now = _lines(r.text)
        kept = sum(min(n, before.get(k, 0)) for k, n in now.items())
        if revision >= 0:
            out.append((key[0], int(r.revision), sum(now.values()) - kept, sum(before.values()) - kept, kept))
        sha, revision, before = r.sha, int(r.revision), now
    state.update((sha, revision, list(before), list(before.values())))
    yield pd.DataFrame(out, columns=["doc_id", "revision", "added", "deleted", "kept"])


def revision_changes(stream: DataFrame) -> DataFrame:
    """doc_id, revision, added, deleted, kept lines for each revision after a document's first. stream: doc_id, revision, text."""
    told = stream.select("doc_id", "revision", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return told.groupBy("doc_id").applyInPandasWithState(compare_with_last, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by event-time window and type, with late rows admitted up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
