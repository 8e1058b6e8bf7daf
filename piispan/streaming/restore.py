"""Streams: restoring originals in token streams, filtering documents as they come, expiring aliases.

A conversation's chunks carry a sequence number. Its state is the text held back, the next number, chunks that came too early,
and its aliases: a conversation's state is bounded by its aliases, the longest one, and its gaps. What is held back is the longest tail that may be the beginning of an alias; it goes out when it no longer can be, when the conversation's last chunk came, or when nothing came for `timeout_ms`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from piispan.operators import act, aliasing
from piispan.operators.detect import native_spans

OUTPUT = "conversation_id string, seq bigint, chunk string"
STATE = "held string, next bigint, early string, aliases string"
TIMEOUT_MS = 2000


class Matcher:
    """Finds aliases in text that comes in pieces; at each place the longest one wins."""

    def __init__(self, aliases: Iterable[tuple[str, str]]):
        self.original = {a: o for a, o in reversed(list(aliases)) if a}
        self.names = sorted(self.original, key=lambda a: (-len(a), a))
        self.longest = len(self.names[0]) if self.names else 0
        self.pattern = re.compile("|".join(map(re.escape, self.names)) or r"(?!)")

    def _open(self, tail: str, least: int = 0) -> bool:
        """Whether more text could make an alias of more than `least` characters of this tail."""
        return any(len(n) > least and n.startswith(tail) for n in self.names)

    def feed(self, held: str, chunk: str, last: bool = False) -> tuple[str, str]:
        """Text to emit and text to hold back."""
        text, out, i = held + chunk, [], 0
        while i < len(text):
            m = self.pattern.search(text, i)
            stop = m.start() if m else len(text)
            if not last:
                # only the last `longest - 1` characters can be the beginning of an alias
                for j in range(max(i, len(text) - self.longest + 1), stop):
                    if self._open(text[j:]):
                        return "".join([*out, text[i:j]]), text[j:]
                if m and len(text) - stop < self.longest and self._open(text[stop:], len(m[0])):
                    return "".join([*out, text[i:stop]]), text[stop:]
            out.append(text[i:stop])
            if m:
                out.append(self.original[m[0]])
            i = m.end() if m else stop
        return "".join(out), ""


@lru_cache(maxsize=256)
def _matcher(raw: str) -> Matcher:
    return Matcher(json.loads(raw or "{}").items())


def _advance(timeout_ms: int | None, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, nxt, early, raw = state.get if state.exists else ("", 0, "{}", "{}")
    if state.hasTimedOut:
        state.remove()
        if held:
            yield pd.DataFrame({"conversation_id": [key[0]], "seq": [nxt], "chunk": [_matcher(raw).feed(held, "", last=True)[0]]})
        return
    waiting = {int(k): v for k, v in json.loads(early).items()}
    for f in frames:
        for seq, chunk, last, names in zip(f["seq"], f["chunk"], f["last"], f["aliases"], strict=True):
            waiting[int(seq)] = [chunk or "", bool(last)]
            if isinstance(names, str) and names != "{}":
                raw = names
    matcher, out, done = _matcher(raw), [], False
    while nxt in waiting:
        chunk, last = waiting.pop(nxt)
        emitted, held = matcher.feed(held, chunk, last)
        out.append((key[0], nxt, emitted))
        nxt += 1
        done |= last
    if done and not waiting:
        state.remove()
    else:
        state.update((held, nxt, json.dumps(waiting), raw))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
    yield pd.DataFrame(out, columns=["conversation_id", "seq", "chunk"])


def restored_stream(tokens: DataFrame, aliases: DataFrame | None = None, timeout_ms: int | None = TIMEOUT_MS) -> DataFrame:
    """`tokens`: a stream of conversation_id, seq (from 0), chunk, and optionally last. `aliases`: a static table, joined by conversation.

    What is held back goes out with the chunk that is `last`, or when nothing came for `timeout_ms`. None sets no time-out: that is for
    bounded runs (trigger availableNow), which a processing-time time-out would keep asking for one more batch.
    """
    t = tokens if "last" in tokens.columns else tokens.withColumn("last", F.lit(False))
    if aliases is not None:
        maps = aliasing.reverse_map(aliases).groupBy("conversation_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("alias", "original")))).alias("aliases"))
        t = t.join(maps.withColumnRenamed("conversation_id", "__c"), F.col("conversation_id") == F.col("__c"), "left").drop("__c")
    else:
        t = t.withColumn("aliases", F.lit("{}"))
    t = t.select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("seq").cast("long").alias("seq"), "chunk", "last", F.coalesce("aliases", F.lit("{}")).alias("aliases"))
    return t.groupBy("conversation_id").applyInPandasWithState(partial(_advance, timeout_ms), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def filtered_stream(docs: DataFrame, strategy: str = "mask") -> DataFrame:
    """Documents as they come: native spans, risk, policy, redaction. Stateless, so it runs in any output mode."""
    return act.with_redaction(act.with_policy(act.with_risk(native_spans(docs))), strategy)


def filter_events(filtered: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each event of a filtered document: filtered or blocked, then done; a document that failed (`error`) has error alone."""
    first = F.when(F.col("blocked"), F.struct(F.lit("blocked").alias("event"), F.col("block_reason").alias("data"))).otherwise(F.struct(F.lit("filtered").alias("event"), F.col("redacted").alias("data")))
    events = F.array(first, F.struct(F.lit("done").alias("event"), F.lit(None).cast("string").alias("data")))
    if "error" in filtered.columns:
        failed = F.array(F.struct(F.lit("error").alias("event"), F.col("error").alias("data")))
        events = F.when(F.col("error").isNotNull(), failed).otherwise(events)
    return filtered.select(key, F.posexplode(events).alias("nth", "e")).select(key, "nth", "e.event", "e.data")


def chunk_events(chunks: DataFrame) -> DataFrame:
    """A row for each event of restored chunks: chunk with its index, then done after one marked `last`; error instead where `error` is set."""
    none = F.lit(None).cast("string")
    error = F.col("error") if "error" in chunks.columns else none
    last = F.coalesce(F.col("last"), F.lit(False)) if "last" in chunks.columns else F.lit(False)
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    chunk = event("chunk", F.col("chunk"))
    events = F.when(error.isNotNull(), F.array(event("error", error))).when(last, F.array(chunk, event("done", none))).otherwise(F.array(chunk))
    return chunks.select("conversation_id", F.col("seq").alias("index"), F.explode(events).alias("e")).select("conversation_id", "e.event", "index", "e.data")


def rewritten_lines(lines: DataFrame, original: str, replacement: str) -> DataFrame:
    """Server-sent `data:` lines: the prompt's text in the JSON payload is replaced; [DONE] and other lines pass."""
    payload = F.regexp_extract("line", r"^data:\s*(\{.*\})\s*$", 1)
    new = F.concat(F.lit("data: "), F.replace(payload, F.to_json(F.array(F.lit(original))).substr(3, len(json.dumps(original, ensure_ascii=False)) - 2), F.lit(json.dumps(replacement, ensure_ascii=False)[1:-1])))
    return lines.withColumn("line", F.when(payload != "", new).otherwise(F.col("line")))


def aliases_with_watermark(aliases: DataFrame, hours: int = aliasing.TTL_HOURS) -> DataFrame:
    """The latest alias of each (conversation, original) in a stream; state older than `hours` of event time is dropped."""
    w = aliases.withWatermark("created_at", f"{hours} hours")
    return w.groupBy(F.window("created_at", f"{hours} hours"), "conversation_id", "original").agg(F.max_by("alias", "created_at").alias("alias"))
