"""Evidence from the output of failed tests: assertions with their messages, and crashes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import test_states

CAP = 128
CLIP = 240
_LOG = re.compile(r"^[ \t]+(?!=== |--- )(.*?\.go):\+?(\d+):(.*)$")
ASSERTION = "stream_id string, Package string, Test string, file string, line long, message string, seq long"


def _clip(text: str) -> str:
    text = text.strip()
    return text if len(text) <= CLIP else text[:CLIP] + "…"


def _message(lines: list[str], i: int) -> str:
    """What follows a bare location: the line that says ``Error:``, else the first one with text, before the next location or control line."""
    first = ""
    for line in lines[i + 1 :]:
        text = line.strip()
        if text.startswith(("=== ", "--- ")) or _LOG.match(line) or (line and line[0] not in " \t"):
            break
        if text.startswith("Error:"):
            return text.removeprefix("Error:").strip() or first
        first = first or text
    return first


def _assertions(group: pd.DataFrame) -> pd.DataFrame:
    """The located messages of one test of one stream, each once, in the order in which they came."""
    group = group.sort_values("seq")
    pairs = [(s, line.rstrip("\r")) for s, out in zip(group["seq"], group["Output"], strict=True) for line in out.removesuffix("\n").split("\n")]
    lines, seen, rows = [x for _, x in pairs], set(), []
    for i, (seq, line) in enumerate(pairs):
        m = _LOG.match(line)
        if m and 0 < int(m[2]) < 1 << 63:
            message = _clip(m[3].removeprefix(" ") or _message(lines, i))
            if (m[1], m[2], message) not in seen:
                seen.add((m[1], m[2], message))
                rows.append((group["stream_id"].iloc[0], group["Package"].iloc[0], group["Test"].iloc[0], m[1], int(m[2]), message, seq))
    return pd.DataFrame(rows, columns=["stream_id", "Package", "Test", "file", "line", "message", "seq"])


def assertions(events: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(stream, assertions): the first ``cap`` located messages of the failed tests of each stream, in order. A group holds one test's output, which the stream's caps bound."""
    keys = ["stream_id", "Package", "Test"]
    output = events.where((F.col("Action") == "output") & (F.col("Test") != ""))
    mine = output.join(test_states(events).where("failed").select(*keys), keys, "left_semi")
    found = mine.select(*keys, "seq", "Output").groupBy(*keys).applyInPandas(_assertions, ASSERTION)
    once = found.groupBy("stream_id", "Test", "file", "line", "message").agg(F.min("seq").alias("seq"))
    item = F.struct("seq", "Test", "file", "line", "message")
    return once.groupBy("stream_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(item)), 1, cap), lambda x: F.struct(x["Test"].alias("test"), x["file"].alias("file"), x["line"].alias("line"), x["message"].alias("message"))).alias("assertions"))


def panics(events: DataFrame, *, cap: int = CAP) -> DataFrame:
    """(stream, panics): for each failed test its first line that begins a crash, if a trace's header comes later in its own output."""
    keys = ["stream_id", "Package", "Test"]
    output = events.where((F.col("Action") == "output") & (F.col("Test") != ""))
    lines = output.join(test_states(events).where("failed").select(*keys), keys, "left_semi").select(*keys, "seq", F.posexplode(F.split(F.regexp_replace("Output", r"\n\z", ""), "\n")).alias("pos", "line"))
    at = F.struct("seq", "pos")
    crash = F.col("line").startswith("panic: ") | F.col("line").startswith("fatal error: ")
    trace = F.col("line").startswith("goroutine ") & F.col("line").contains(" [")
    heads = lines.groupBy(*keys).agg(F.min(F.when(crash, F.struct("seq", "pos", "line"))).alias("first"), F.max(F.when(trace, at)).alias("trace"))
    real = heads.where(F.col("trace") > F.struct("first.seq", "first.pos"))
    text = F.regexp_replace("first.line", r"\s+$", "")
    clipped = F.when(F.length(text) > CLIP, F.concat(F.substring(text, 1, CLIP), F.lit("…"))).otherwise(text)
    item = F.struct(F.col("first.seq").alias("seq"), F.col("Test").alias("test"), clipped.alias("message"))
    return real.groupBy("stream_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(item)), 1, cap), lambda x: F.struct(x["test"].alias("test"), x["message"].alias("message"))).alias("panics"))


def clip_bytes(text: str, limit: int) -> str:
    """At most ``limit`` bytes of UTF-8, cut between characters."""
    raw = text.encode()
    return text if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")
