"""Event logs of assistants' runs, written in two shapes, folded into one record per run.

``items`` logs complete one item at a time: searches, openings and messages.
``messages`` logs carry tool calls inside an assistant's message and their results,
nested as they come, inside the user's.  Each event is read by itself into plain
actions; what a run did is then a matter of grouping and order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.operators import contracts

#: Characters of a result that stand for it.
SUMMARY = 500
# What stands for results that a log doesn't show.
UNSEEN, OPENED = "The log shows the action but not its result.", "Web page opened."


def _sources(value, out: list) -> None:
    """Records with an address, however deep, and the texts beside them in lists."""
    if isinstance(value, list):
        for x in value:
            if isinstance(x, str):
                if x:
                    out.append(("result", "WebSearch", x[:SUMMARY]))
            else:
                _sources(x, out)
    elif isinstance(value, dict):
        if isinstance(value.get("url"), str):
            title = value["title"] if isinstance(value.get("title"), str) else value["url"]
            out.extend([("title", value["url"], title), ("result", "WebSearch", f"{title}: {value['url']}")])
        else:
            for x in value.values():
                if isinstance(x, (dict, list)):
                    _sources(x, out)


def _item(event: dict, out: list) -> None:
    item = event.get("item")
    if event.get("type") != "item.completed" or not isinstance(item, dict):
        return
    if item.get("type") == "agent_message" and isinstance(item.get("text"), str):
        out.append(("answer", item["text"], None))
    if item.get("type") == "web_search":
        action, query = item.get("action") or {}, item.get("query")
        if action.get("type") == "search":
            if isinstance(query, str) and query:
                out.append(("query", query, None))
        elif isinstance(query, str):
            out.append(("opened in", query, None))
        if isinstance(action.get("url"), str):
            out.append(("opened", action["url"], None))
        out.append(("result", "web_search", UNSEEN))


def _message(event: dict, out: list) -> None:
    kind, result = event.get("type"), event.get("tool_use_result")
    if kind == "system" and event.get("subtype") == "init" and isinstance(event.get("model"), str):
        out.append(("model", event["model"], None))
    if kind == "assistant":
        for part in (event.get("message") or {}).get("content") or []:
            given = part.get("input") or {}
            if part.get("type") == "tool_use" and part.get("name") == "WebSearch" and isinstance(given.get("query"), str):
                out.append(("query", given["query"], None))
            if part.get("type") == "tool_use" and part.get("name") == "WebFetch" and isinstance(given.get("url"), str):
                out.append(("opened", given["url"], None))
    if kind == "user" and isinstance(result, str):
        out.append(("result", "Web", result[:SUMMARY]))
    elif kind == "user" and isinstance(result, list):
        _sources(result, out)
    elif kind == "user" and isinstance(result, dict):
        if isinstance(result.get("query"), str):
            out.append(("query", result["query"], None))
        if isinstance(result.get("results"), list):
            _sources(result["results"], out)
        if isinstance(result.get("url"), str):
            text = result["result"] if isinstance(result.get("result"), str) else OPENED
            out.extend([("opened", result["url"], None), ("result", "WebFetch", text[:SUMMARY]), ("passage", result["url"], text)])
    if kind == "result" and isinstance(event.get("result"), str):
        out.append(("answer", event["result"], None))


def actions(events: DataFrame) -> DataFrame:
    """(run, seq, pos, kind, value, text): what each event did, in order; an event that can't be read is of kind ``unreadable``.

    ``events``: run, seq, shape (items or messages), event (JSON text).
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("run", "seq")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for i, (shape, raw) in enumerate(zip(b.column("shape").to_pylist(), b.column("event").to_pylist())):
                own: list = []
                try:
                    event = json.loads(raw)
                    (_item if shape == "items" else _message)(event, own)
                except (TypeError, ValueError, AttributeError) as e:
                    own = [("unreadable", type(e).__name__, None)]
                row += [(i, k) for k in range(len(own))]
                out += own
            take = pa.array([i for i, _ in row], pa.int64())
            columns = [b.column("run").take(take), b.column("seq").take(take), pa.array([k for _, k in row], pa.int32()), *(pa.array([o[j] for o in out], pa.string()) for j in range(3))]
            yield pa.record_batch(columns, names=["run", "seq", "pos", "kind", "value", "text"])

    return events.select("run", "seq", "shape", "event").mapInArrow(run, f"run {kinds['run']}, seq {kinds['seq']}, pos int, kind string, value string, text string")


def _in_order(done: DataFrame, value, into: str) -> DataFrame:
    """(run, ``into``): the values in order."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "pos", value.alias("v")))), lambda x: x["v"])
    return done.groupBy("run").agg(listed.alias(into))


def _first_seen(done: DataFrame, into: str) -> DataFrame:
    """(run, ``into``): the distinct values in order of appearance."""
    once = done.groupBy("run", "value").agg(F.min(F.struct("seq", "pos", "k")).alias("at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return once.groupBy("run").agg(listed.alias(into))


def normalised(events: DataFrame) -> DataFrame:
    """One row per run: model, queries, tool_results, opened_urls, cited_urls, selected_sources, evidence_passages, final_answer, n_unreadable.

    Queries and addresses stand once, in order of appearance; the last answer is
    final; sources are read passages' addresses, then opened ones, then cited ones,
    each under the last title that a result gave it.
    """
    done = actions(events).withColumn("k", F.lit(0))
    opened = done.where("kind = 'opened in'").select("run", "seq", "pos", F.posexplode(contracts.urls_in(F.col("value"))).alias("k", "value"))
    opened = done.where("kind = 'opened'").select("run", "seq", "pos", "k", "value").unionByName(opened)
    last = lambda kind, name: F.max_by("value", F.when(F.col("kind") == kind, F.struct("seq", "pos"))).alias(name)
    out = done.groupBy("run").agg(last("model", "model"), last("answer", "final_answer"), F.count_if(F.col("kind") == "unreadable").alias("n_unreadable"))
    runs = events.select("run").distinct()
    result = F.struct(F.col("value").alias("tool"), F.col("text").alias("summary"))
    passage = F.struct(F.col("value").alias("url"), "text")
    for part in (
        out, _first_seen(done.where("kind = 'query'"), "queries"), _first_seen(opened, "opened_urls"), _in_order(done.where("kind = 'result'"), result, "tool_results"),
        _in_order(done.where("kind = 'passage'"), passage, "evidence_passages"), _first_seen(done.where("kind = 'passage'"), "read"),
        done.where("kind = 'title'").groupBy("run", "value").agg(F.max_by("text", F.struct("seq", "pos")).alias("title")).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("value", "title"))).alias("titles")),
    ):
        runs = runs.join(part, "run", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.coalesce(c, none)
    cited = contracts.urls_in(F.coalesce("final_answer", F.lit("")))
    # a page that was read goes by its address
    named = lambda u: F.when(F.array_contains(some(F.col("read")), u), u).otherwise(F.coalesce(F.try_element_at(F.col("titles"), u), u))
    sources = F.transform(F.array_distinct(F.concat(some(F.col("read")), some(F.col("opened_urls")), cited)), lambda u: F.struct(u.alias("url"), named(u).alias("title")))
    return runs.select(
        "run", F.coalesce("model", F.lit("unknown")).alias("model"), some(F.col("queries")).alias("queries"), F.coalesce("tool_results", F.array().cast("array<struct<tool:string,summary:string>>")).alias("tool_results"),
        some(F.col("opened_urls")).alias("opened_urls"), cited.alias("cited_urls"), sources.alias("selected_sources"), F.coalesce("evidence_passages", F.array().cast("array<struct<url:string,text:string>>")).alias("evidence_passages"),
        F.coalesce("final_answer", F.lit("")).alias("final_answer"), F.coalesce("n_unreadable", F.lit(0)).alias("n_unreadable"),
    )
