"""Extraction as table work: requests out, replies in, outcomes as rows.

A hosted model is called once per trial by the reference. Here the data side
is expressions over tables (requests, reply parsing, truncation retries, blank
prose), and a caller's own extractor runs per partition through Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribra.functions.text import has_text, is_throttled, list_size, retry_budget, token_budget
from cribra.schemas import CRITERION_KINDS

# Fixed value (ours): the instruction sent with every request.
SYSTEM_PROMPT = (
    "Split the eligibility text of one clinical trial into criteria. Each criterion "
    "states one testable condition; keep numbers, units and time windows as written. "
    "Set is_exclusion to true for criteria listed under exclusion. Give each criterion "
    "one kind from: " + ", ".join(CRITERION_KINDS) + ". Use other only when no kind fits."
)

# The strict output schema of a reply, as the request's response_format.
RESPONSE_FORMAT = {
    "type": "json_schema",
    "json_schema": {
        "name": "eligibility",
        "strict": True,
        "schema": {
            "type": "object",
            "properties": {"criteria": {"type": "array", "items": {
                "type": "object",
                "properties": {
                    "criterion_id": {"type": "string"},
                    "text": {"type": "string"},
                    "kind": {"type": "string", "enum": list(CRITERION_KINDS)},
                    "is_exclusion": {"type": "boolean"},
                },
                "required": ["criterion_id", "text", "kind", "is_exclusion"],
                "additionalProperties": False,
            }}},
            "required": ["criteria"],
            "additionalProperties": False,
        },
    },
}
RESPONSE_FORMAT_JSON = json.dumps(RESPONSE_FORMAT, separators=(",", ":"))

CRITERIA_DDL = "array<struct<criterion_id:string,text:string,kind:string,is_exclusion:boolean>>"

# Errors of the outcome classes (ours): what of the reply was at fault.
ERR_ENVELOPE = "reply:message"
ERR_NO_TEXT = "reply:text"
ERR_TRUNCATED = "reply:length"
ERR_SCHEMA = "reply:criteria"


def build_requests(pending: DataFrame, id_col: str = "nct_id", text_col: str = "eligibility",
                   max_tokens: Column | None = None) -> DataFrame:
    """One chat request per trial: system + user message, temperature 0, strict schema."""
    budget = max_tokens if max_tokens is not None else token_budget(text_col)
    messages = F.to_json(F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content")),
    ))
    body = F.concat(F.lit('{"messages":'), messages, F.lit(',"temperature":0,"max_tokens":'),
                    budget.cast("string"), F.lit(',"response_format":'),
                    F.lit(RESPONSE_FORMAT_JSON), F.lit("}"))
    return pending.select(id_col, budget.alias("max_tokens"), body.alias("request"))


def _content(env: Column) -> Column:
    return F.try_variant_get(env, "$.choices[0].message.content", "variant")


def reply_text(envelope: Column) -> Column:
    """struct<text, error>: the assistant text of a reply envelope.

    String content is the text; a list of typed parts gives the joined ``text``
    parts (reasoning dropped); anything else is an error, as is a reply with no
    first choice.
    """
    env = F.try_parse_json(envelope)
    content = _content(env)
    kind = F.schema_of_variant(content)
    has_message = F.try_variant_get(env, "$.choices[0].message", "variant").isNotNull()
    parts = F.try_variant_get(content, "$", "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"),
                        lambda p: F.coalesce(p["text"], F.lit("")))
    text = (F.when(kind == "STRING", F.try_variant_get(content, "$", "string"))
             .when(kind.startswith("ARRAY") & (F.coalesce(list_size(texts), F.lit(0)) > 0), F.array_join(texts, "")))
    error = (F.when(~F.coalesce(has_message, F.lit(False)), F.lit(ERR_ENVELOPE))
              .when(text.isNull(), F.lit(ERR_NO_TEXT)))
    return F.struct(F.when(error.isNull(), text).alias("text"), error.alias("error"))


def _valid_criteria(text: Column) -> Column:
    """True when the text is JSON with a criteria list whose items carry all four
    fields with the right types and a known kind (extra fields are ignored)."""
    v = F.try_parse_json(text)
    items = F.try_variant_get(v, "$.criteria", "array<variant>")

    def ok(e: Column) -> Column:
        def typed(path: str, name: str) -> Column:
            return F.schema_of_variant(F.try_variant_get(e, path, "variant")) == name
        check = (typed("$.criterion_id", "STRING") & typed("$.text", "STRING")
                 & typed("$.is_exclusion", "BOOLEAN")
                 & F.try_variant_get(e, "$.kind", "string").isin(list(CRITERION_KINDS)))
        return F.coalesce(check, F.lit(False))

    return F.coalesce(F.forall(items, ok), F.lit(False))


def parse_replies(replies: DataFrame, envelope_col: str = "envelope",
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Reply envelopes to outcomes: (keep..., outcome, criteria, error).

    Classes: envelope_error (no first choice), truncated (finish_reason length),
    text_error (no assistant text), schema_error (bad JSON, a missing field, a
    wrong type or an unknown kind), ok.
    """
    env = F.try_parse_json(F.col(envelope_col))
    finish = F.try_variant_get(env, "$.choices[0].finish_reason", "string")
    rt = reply_text(F.col(envelope_col))
    parsed = replies.select(*keep, rt.alias("_rt"), finish.alias("_finish"))
    text = F.col("_rt.text")
    valid = _valid_criteria(text)
    outcome = (F.when(F.col("_rt.error") == ERR_ENVELOPE, F.lit("envelope_error"))
                .when(F.col("_finish") == "length", F.lit("truncated"))
                .when(F.col("_rt.error").isNotNull(), F.lit("text_error"))
                .when(~valid, F.lit("schema_error"))
                .otherwise(F.lit("ok")))
    criteria = F.when(outcome == "ok", F.from_json(text, f"criteria {CRITERIA_DDL}")["criteria"])
    error = (F.when(outcome == "truncated", F.lit(ERR_TRUNCATED))
              .when(outcome == "schema_error", F.lit(ERR_SCHEMA))
              .otherwise(F.col("_rt.error")))
    return parsed.select(*keep, outcome.alias("outcome"), criteria.alias("criteria"),
                         error.alias("error"))


def finish_reason(envelope: Column) -> Column:
    """``choices[0].finish_reason`` of a reply envelope (NULL when absent)."""
    return F.try_variant_get(F.try_parse_json(envelope), "$.choices[0].finish_reason", "string")


def truncation_retries(truncated: DataFrame, budget_col: str = "max_tokens") -> DataFrame:
    """Truncated calls retried once at twice the budget; none when already at the ceiling."""
    r = retry_budget(budget_col)
    return truncated.withColumn("retry_tokens", r).where(F.col("retry_tokens") > F.col(budget_col))


def blank_results(docs: DataFrame, id_col: str = "nct_id", text_col: str = "eligibility") -> DataFrame:
    """Per trial: is the prose blank (ok, empty result, no call), and its non-blank lines."""
    lines = F.split(F.col(text_col), "\n", -1)
    return docs.select(
        id_col,
        (~has_text(text_col)).alias("is_blank"),
        list_size(F.filter(lines, lambda l: has_text(l))).alias("nonblank_lines"),
        list_size(F.filter(lines, lambda l: ~has_text(l))).alias("blank_lines"),
    )


def throttle_stop(attempts: DataFrame, batch_col: str = "batch_index",
                  error_col: str = "error") -> DataFrame:
    """Per batch: counters, whether it ends the run, and whether it ran.

    A batch with no success once any throttling was seen (in it or earlier)
    stops the run. "Seen so far" is ``batch >= first throttled batch``, a
    scalar subquery, so no running window over all batches is needed.
    """
    err = F.col(error_col)
    per = attempts.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(err.isNull()).alias("succeeded"),
        F.count_if(err.isNotNull()).alias("failed"),
        F.count_if(is_throttled(err) & err.isNotNull()).alias("rate_limited"),
    )
    first_throttled = per.where(F.col("rate_limited") > 0).select(F.min(batch_col)).scalar()
    stops = F.coalesce((F.col("succeeded") == 0) & (F.col(batch_col) >= first_throttled),
                       F.lit(False))
    per = per.withColumn("stops", stops)
    first_stop = per.where("stops").select(F.min(batch_col)).scalar()
    return per.withColumn("ran", F.coalesce(F.col(batch_col) <= first_stop, F.lit(True)))


Extractor = Callable[[pd.DataFrame], pd.DataFrame]


#: Trials that one extraction task takes (its Arrow batches are smaller still).
TASK_TRIALS = 200


def tasks_for(trials: int, workers: int = 1) -> int:
    """Tasks of an extraction job: they follow the number of trials.

    How many run at once is the cluster's business (its executor cores).
    """
    return max(workers, -(-trials // TASK_TRIALS))


def extract_with(pending: DataFrame, extractor: Extractor, tasks: int | None = None,
                 id_col: str = "nct_id", text_col: str = "eligibility",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Run a caller's extractor over pending trials, spread over ``tasks`` tasks.

    ``extractor(batch)`` gets a pandas frame (id, text) and returns a frame
    (nct_id, criteria, error). One failing trial never stops or fails another:
    after an exception the batch is run again trial by trial, and only a trial
    that raises by itself gets an error row. A trial the extractor left out
    gets one too. Blank prose never reaches the extractor. The outcome table is
    the return value, so no completion callback is needed. ``carry`` columns
    pass through unchanged (matched by trial id inside the batch, so no join is
    needed afterwards). Without ``tasks`` the input's partitions stay.
    """
    names = ["nct_id", "criteria", "error"]

    def failed(ids: pd.Series, error: str) -> pd.DataFrame:
        return pd.DataFrame({"nct_id": ids, "criteria": None, "error": error[:500]})

    def attempt(todo: pd.DataFrame) -> pd.DataFrame:
        try:
            got = extractor(todo)
            got = got[names] if len(got) else failed(todo["nct_id"].iloc[:0], "")
        except Exception as exc:  # noqa: BLE001 - any failure is an outcome of its trial
            if len(todo) == 1:
                return failed(todo["nct_id"], str(exc) or type(exc).__name__)
            return pd.concat([attempt(todo.iloc[[k]]) for k in range(len(todo))], ignore_index=True)
        left_out = todo.loc[~todo["nct_id"].isin(got["nct_id"]), "nct_id"]
        return pd.concat([got, failed(left_out, "extractor:no outcome")], ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blank = ~b["text"].fillna("").str.contains(r"\S", regex=True)
            out = []
            if blank.any():
                out.append(pd.DataFrame({"nct_id": b.loc[blank, "nct_id"],
                                         "criteria": [[] for _ in range(int(blank.sum()))],
                                         "error": None}))
            todo = b.loc[~blank, ["nct_id", "text"]]
            if len(todo):
                out.append(attempt(todo))
            if out:
                res = pd.concat(out, ignore_index=True)
                if carry:
                    res = res.merge(b[["nct_id", *carry]], on="nct_id", how="left")
                yield res

    src = pending.select(F.col(id_col).alias("nct_id"), F.col(text_col).alias("text"), *carry)
    extra = "".join(f", {f.name} {f.dataType.simpleString()}"
                    for f in src.schema.fields if f.name in carry)
    if tasks:
        src = src.repartition(tasks, "nct_id")
    return src.mapInPandas(run, f"nct_id string, criteria {CRITERIA_DDL}, error string{extra}")
