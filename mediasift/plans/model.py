"""Analysis with a language model inside the job: prompts, answers that are asked for once, results.

Requests that may be answered become prompts; equal prompts are one. Prompts are dealt by their hash. A task packs
those of one bucket that have no answer yet into calls of a bounded number of tokens, and writes the answers of each
call at once, in a file of its own below ``pending/bucket``. A task that runs again, or another attempt of the
job, first reads what is there and asks for the rest only. When all tasks are done the answers go into the memo, a table
keyed by prompt hash that later jobs look into before they ask.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.hashing import Engines
from ..functions.replies import reply_text
from ..operators import evidence as ev
from ..operators.plugins import model_request, user_prompt
from ..session import cut
from .analyze import analyze_content, evidence_rows, precheck

#: A model takes the requests of one call and gives an answer, or an exception, for each.
BatchModel = Callable[[list[str]], Iterable[str | Exception | None]]
#: Prompts of one bucket meet in one task.
BUCKETS = 256
CALL_TOKENS, CHARS_A_TOKEN = 32_000, 4
MEMO = "prompt_hash string, reply string, error string"


def _folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _answered(fs: pafs.FileSystem, folder: str) -> dict[str, tuple]:
    """Answers that earlier attempts have written; failures are asked again."""
    found: dict[str, tuple] = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".json"):
            with fs.open_input_stream(info.path) as file:
                found |= {r[0]: tuple(r) for r in json.loads(file.read()) if r[2] is None}
    return found


def _keep(fs: pafs.FileSystem, folder: str, answers: list[tuple]) -> None:
    """One file, whole or not at all: written under another name first."""
    fs.create_dir(folder, recursive=True)
    name = f"{folder}/{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{name}.tmp") as file:
        file.write(json.dumps(answers).encode())
    fs.move(f"{name}.tmp", f"{name}.json")


def calls_of(requests: list[tuple[str, str]], tokens: int) -> Iterator[list[tuple[str, str]]]:
    """Requests in order, as many in a call as its tokens hold; a longer one goes alone."""
    call, size = [], 0
    for key, request in requests:
        own = -(-len(request) // CHARS_A_TOKEN)
        if call and size + own > tokens:
            yield call
            call, size = [], 0
        call.append((key, request))
        size += own
    if call:
        yield call


def ask(prompts: DataFrame, factory: Callable[[], BatchModel], folder: str, call_tokens: int = CALL_TOKENS) -> DataFrame:
    """prompt_hash, reply and error of every distinct prompt (prompt_hash, model_request), asked for at most once.

    A model that fails on a call, or on one of its requests, gives the name of the exception.
    Answers are below ``folder``, so a task that runs again finds those its first run had.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A bucket is one task's; its requests are those of this micro-job, not of the history.
        fs, base = _folder(folder)
        model: BatchModel | None = None
        for frame in frames:
            for bucket, rows in frame.groupby("bucket", sort=True):
                place = f"{base}/bucket={bucket}"
                known = _answered(fs, place)
                new = [(k, r) for k, r in zip(rows["prompt_hash"], rows["model_request"], strict=True) if k not in known]
                for call in calls_of(new, call_tokens):
                    model = model or factory()
                    try:
                        replies = list(model([r for _, r in call]))
                    except Exception as failure:
                        replies = [failure] * len(call)
                    answers = [
                        (k, None, type(a).__name__) if isinstance(a, Exception) else (k, a, None)
                        for (k, _), a in zip(call, replies, strict=True)
                    ]
                    _keep(fs, place, answers)
                    known |= {a[0]: a for a in answers}
                yield pd.DataFrame([known[k] for k in rows["prompt_hash"]], columns=["prompt_hash", "reply", "error"])

    bucket = F.conv(F.left("prompt_hash", F.lit(4)), 16, 10).cast("int") % BUCKETS
    dealt = prompts.withColumn("bucket", bucket).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "prompt_hash")
    return dealt.select("bucket", "prompt_hash", "model_request").mapInPandas(run, MEMO)


def prompts_of(requests: DataFrame, observations: DataFrame, engines: Engines, images: DataFrame | None = None) -> DataFrame:
    """request_id, prompt_hash and model_request of the requests that a model may be asked about: those that ask for it
    and have not failed. ``images``: request_id, images (array of path and content), for the prompts that show some."""
    rows = precheck(evidence_rows(requests, observations, engines))
    rows = rows.filter(F.col("run_vision_model") & F.col("failure").isNull())
    if images is not None:
        rows = rows.join(images.select("request_id", "images"), "request_id", "left")
    prompt = user_prompt(F.col("language_hint"), ev.trusted_context(F.col("assets")), ev.untrusted_context(F.col("base_evidence")))
    shown = F.coalesce("images", F.array().cast("array<struct<path:string,content:binary>>")) if images is not None else None
    return rows.select("request_id", model_request(prompt, shown).alias("model_request")).withColumn(
        "prompt_hash", F.sha2("model_request", 256)
    )


def analyze_with_model(
    requests: DataFrame,
    observations: DataFrame,
    factory: Callable[[], BatchModel],
    *,
    memo: str,
    engines: Engines,
    images: DataFrame | None = None,
    call_tokens: int = CALL_TOKENS,
) -> DataFrame:
    """``analyze_content`` of valid requests, with replies asked from a model. ``memo`` is a shared folder that keeps answers.

    Without a model (``engines.vision`` disabled) nothing is asked. A prompt that the memo answers, or that
    another request of the job shares, is not asked again; failures are not kept beyond the job.
    """
    if engines.vision == fixed.VISION_DISABLED:
        return analyze_content(requests, observations, None, engines)
    spark = requests.sparkSession
    wanted = cut(prompts_of(requests, observations, engines, images))
    table = f"{memo.rstrip('/')}/answers"
    fs, base = _folder(table)
    known = None
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        known = spark.read.schema(MEMO).parquet(table).dropDuplicates(["prompt_hash"])
    distinct = wanted.select("prompt_hash", "model_request").dropDuplicates(["prompt_hash"])
    unknown = distinct if known is None else distinct.join(known, "prompt_hash", "left_anti")
    found = cut(ask(unknown, factory, f"{memo.rstrip('/')}/pending", call_tokens))
    # One commit of Spark's writer adds the new answers whole or not at all.
    found.filter("error IS NULL").write.mode("append").parquet(table)
    answers = found if known is None else found.unionByName(known.join(distinct.select("prompt_hash"), "prompt_hash", "left_semi"))
    replies = wanted.select("request_id", "prompt_hash").join(answers, "prompt_hash").select(
        "request_id", F.coalesce(reply_text("reply"), F.col("reply")).alias("reply"), "error"
    )
    return analyze_content(requests, observations, replies, engines)
