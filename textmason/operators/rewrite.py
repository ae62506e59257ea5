"""The four fixed text rewrites, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmason.functions import patterns as P


def _substitute(content: Column, rewrite: tuple[str, str]) -> Column:
    return F.regexp_replace(content, rewrite[0], rewrite[1])


def scale_timeout(content: Column) -> Column:
    """``timeout=<n>`` becomes ``timeout=<n>*1000`` for n below 100."""
    return _substitute(content, P.REWRITE_TIMEOUT)


def payload_dumps(content: Column) -> Column:
    """``data=json.dumps(x)`` becomes ``json=x``."""
    return _substitute(content, P.REWRITE_PAYLOAD)


def self_timeout(content: Column) -> Column:
    """``self.timeout = timeout`` gains ``* 1000`` unless it has it."""
    return _substitute(content, P.REWRITE_SELF_TIMEOUT)


def data_keyword(content: Column) -> Column:
    """``requests.post(x, data=`` and ``put`` take ``json=`` instead."""
    return _substitute(content, P.REWRITE_DATA_KEYWORD)


CHAIN: tuple[Callable[[Column], Column], ...] = (
    scale_timeout,
    payload_dumps,
    self_timeout,
    data_keyword,
)


def rewrite_chain(content: Column, steps=CHAIN) -> Column:
    return reduce(lambda text, step: step(text), steps, content)
