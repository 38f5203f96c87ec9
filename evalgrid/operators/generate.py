"""Batch generation: call a model function over planned attempts.

``batch_generate`` runs a user-supplied ``generate_fn(prompts, settings) ->
list[str]`` inside ``mapInPandas``: Spark partitions the plan, every Python
worker receives Arrow batches, and the function is called once per chunk of
``batch_size`` prompts. If a chunk raises, its prompts are retried one by one
so a failure marks only the attempts that fail (``error`` column), like the
per-attempt ``try/except`` of a sequential runner. No network code lives
here: the function is whatever client the caller plugs in.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

GenerateFn = Callable[[Sequence[str], dict], Sequence[str]]


def batch_generate(plan: DataFrame, generate_fn: GenerateFn, prompt: str = "prompt", settings: dict | str | None = None,
                   batch_size: int = 32, keep: Sequence[str] = ()) -> DataFrame:
    """Plan rows -> (keep..., prompt, response, latency_sec, error).

    ``settings`` is one dict for all rows, or the name of a struct column with
    each row's own (as ``attempts.with_settings`` adds); a chunk then holds
    rows with equal settings.
    """
    keep = list(keep)
    fields = [f for f in plan.schema.fields if f.name in keep]
    out_schema = StructType(
        fields + [StructField(prompt, StringType()), StructField("response", StringType()),
                  StructField("latency_sec", DoubleType()), StructField("error", StringType())]
    )
    by_row = settings if isinstance(settings, str) else None
    shared = {} if by_row else dict(settings or {})

    def run(batches):
        import pandas as pd

        for pdf in batches:
            responses, latencies, errors = [], [], []
            own = [json.dumps(dict(s or {}), sort_keys=True, default=str) for s in pdf[by_row]] if by_row else [""] * len(pdf)
            order = sorted(range(len(pdf)), key=own.__getitem__)
            pdf = pdf.iloc[order]
            prompts = pdf[prompt].tolist()
            configs = [dict(s or {}) for s in pdf[by_row]] if by_row else [shared] * len(pdf)
            own.sort()
            starts = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]]
            cuts = [i for a, b in zip(starts, [*starts[1:], len(own)]) for i in range(a, b, batch_size)]
            for i, end in zip(cuts, [*cuts[1:], len(own)]):
                chunk, cfg = prompts[i:end], configs[i]
                t0 = time.perf_counter()
                try:
                    out = list(generate_fn(chunk, cfg))
                    if len(out) != len(chunk):
                        raise ValueError(f"generate_fn returned {len(out)} responses for {len(chunk)} prompts")
                    per = (time.perf_counter() - t0) / max(len(chunk), 1)
                    responses += [None if o is None else str(o) for o in out]
                    latencies += [round(per, 3)] * len(chunk)
                    errors += [None] * len(chunk)
                except Exception:  # noqa: BLE001 - isolate the failing prompts
                    for p in chunk:
                        t1 = time.perf_counter()
                        try:
                            (o,) = list(generate_fn([p], cfg))
                            responses.append(None if o is None else str(o))
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            responses.append(None)
                            errors.append(str(e))
                        latencies.append(round(time.perf_counter() - t1, 3))
            out_pdf = pdf[keep].copy() if keep else pd.DataFrame(index=pdf.index)
            out_pdf[prompt] = prompts
            out_pdf["response"] = responses
            out_pdf["latency_sec"] = latencies
            out_pdf["error"] = errors
            yield out_pdf

    cols = list(dict.fromkeys([*keep, prompt, *([by_row] if by_row else [])]))
    return plan.select(*cols).mapInPandas(run, out_schema)


def echo_generator(prompts: Sequence[str], settings: dict) -> list[str]:
    """A deterministic stand-in model: upper-cased echo; prompts containing
    the digit 7 fail (to exercise per-attempt error isolation)."""
    out = []
    for p in prompts:
        if "7" in p:
            raise RuntimeError(f"generation failed for prompt of {len(p)} chars")
        out.append("ANSWER: " + p.upper())
    return out
