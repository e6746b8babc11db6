"""Extractors of restaurants: functions registered by slug, run on one table in one pass, with one schema of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# A text to its deals; each is a dict with any of the fields of DEAL.
Extractor = Callable[[str], list[dict]]
DEAL = "title string, description string, days array<string>, start_time string, end_time string, confidence double"
_FIELDS = {
    "title": pa.string(), "description": pa.string(), "days": pa.list_(pa.string()), "start_time": pa.string(), "end_time": pa.string(), "confidence": pa.float64(),
}

_REGISTRY: dict[str, Extractor] = {}


def register_extractor(slug: str, extractor: Extractor | None = None):
    """Registers an extractor for a restaurant, also as a decorator; the last one counts."""
    if extractor is None:
        return lambda f: register_extractor(slug, f)
    _REGISTRY[slug] = extractor
    return extractor


def registered() -> dict[str, Extractor]:
    return dict(_REGISTRY)


def extracted(texts: DataFrame, key: Sequence[str], extractors: dict[str, Extractor] | None = None, default: Extractor | None = None, slug: str = "slug", text: str = "text") -> DataFrame:
    """key, pos, the fields of DEAL and error: the deals of each text by its restaurant's extractor, or by the default one.

    One pass over the table, whatever number of extractors: batches go through Python once, and only
    rows of restaurants with an extractor (all, with a default). An extractor that fails on a text
    gives one row with the error, and the other texts go on. Null texts have no deals. What a deal has
    besides the fields of DEAL is left out, and what is of another type is an error.
    """
    of = dict(registered() if extractors is None else extractors)
    rows = texts.select(*key, texts[slug].alias("_slug"), texts[text].cast("string").alias("_text")).filter("_text IS NOT NULL")
    if default is None:
        rows = rows.filter(rows["_slug"].isin(list(of)))
    fields = rows.select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, deals, errors = [], [], [], []
            for i, (who, what) in enumerate(zip(batch.column("_slug").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                try:
                    found = [{f: deal.get(f) for f in _FIELDS} for deal in of.get(who, default)(what)]
                    pa.array(found, pa.struct(list(_FIELDS.items())))
                    error = [None] * len(found)
                except Exception as e:  # whatever an extractor of somebody's raises is that text's result
                    found, error = [dict.fromkeys(_FIELDS)], [f"{type(e).__name__}: {e}"]
                at += [i] * len(found)
                pos += range(len(found))
                deals += found
                errors += error
            keys = [pc.take(batch.column(f.name), pa.array(at, pa.int64())) for f in fields]
            columns = [pa.array([d[f] for d in deals], kind) for f, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), *columns, pa.array(errors, pa.string())], [*fields.names, "pos", *_FIELDS, "error"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{keys}, pos int, {DEAL}, error string")
