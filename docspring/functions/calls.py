"""Calls of models in batches: requests grouped by size, retried in order, and only what fails by itself becomes a note."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

#: A function of a list of requests that gives as many replies; a reply may be an exception, for that request alone.
Transport = Callable[[list], list]


@dataclass(frozen=True)
class Limits:
    """Requests of a call and their characters (or bytes) at most, how often a call is tried, and the seconds before the second
    try, which double with each further one."""

    items: int = 16
    size: int = 60_000
    tries: int = 3
    wait: float = 0.0


def batches_of(requests: list, limits: Limits) -> Iterator[list[int]]:
    """Places of requests that go together, in their order. A request over the size goes alone; None isn't sent."""
    held, size = [], 0
    for i, r in enumerate(requests):
        if r is None:
            continue
        n = len(r)
        if held and (len(held) == limits.items or size + n > limits.size):
            yield held
            held, size = [], 0
        held.append(i)
        size += n
    if held:
        yield held


def replies(requests: list, transport: Transport, limits: Limits) -> list:
    """A reply or an exception for each request, None for None. A call that fails as a whole is tried again, then halved, so that
    a request which breaks its call doesn't cost the others theirs; requests that failed by themselves are tried again without
    those that had a reply."""
    out: list = [None] * len(requests)

    def send(places: list[int]) -> None:
        left, error, whole = places, None, False
        for n in range(limits.tries):
            if n and limits.wait:
                time.sleep(limits.wait * 2 ** (n - 1))
            try:
                got = transport([requests[i] for i in left])
                if len(got) != len(left):
                    raise RuntimeError(f"{len(got)} replies to {len(left)} requests")
            except Exception as e:  # the call as a whole
                error, whole = e, True
                continue
            whole = False
            for i, r in zip(left, got, strict=True):
                out[i] = r
            left = [i for i, r in zip(left, got, strict=True) if isinstance(r, Exception)]
            if not left:
                return
        if whole and len(left) > 1:
            send(left[: len(left) // 2])
            send(left[len(left) // 2 :])
        elif whole and not isinstance(out[left[0]], Exception):
            out[left[0]] = error

    for places in batches_of(requests, limits):
        send(places)
    return out


def attempted(make: Callable[[], Transport], name: str, limits: Limits = Limits()):
    """struct(value, error) of a column of requests, for captions, summaries, judges and refinements: what fails is a note on its
    row. Each worker makes its transport once; a call holds rows of one Arrow batch."""

    @F.pandas_udf("value string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        transport = make()
        for batch in batches:
            requests = [None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x for x in batch]
            rows = [(None, f"{name}: {type(r).__name__}: {r}") if isinstance(r, Exception) else (None if r is None else str(r), None) for r in replies(requests, transport, limits)]
            yield pd.DataFrame(rows, columns=["value", "error"], dtype=object)

    return call


def each(function: Callable[[object], str]) -> Callable[[], Transport]:
    """A transport from a function of one request."""

    def one(x):
        try:
            return function(x)
        except Exception as e:  # its own request's alone
            return e

    return lambda: lambda requests: [one(x) for x in requests]
