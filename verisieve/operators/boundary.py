"""Neural calls as a plain interface: the engine plans around them, the model is given.

A model is made by a factory, once for each Python worker and name, and maps a list of
inputs to a list of outputs. Which rows to run (``relational.pending``) and what becomes of
the outputs (``arrays``, ``generations``) stay in the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[Any]], Sequence[Any]]
Factory = Callable[[str], Model]

_loaded: dict[str, Model] = {}


def loaded(name: str, factory: Factory) -> Model:
    """The worker's model; another name replaces it, so that one at most is held."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = factory(name)
    return _loaded[name]


def run_model(df: DataFrame, name: str, factory: Factory, columns: list[str], key: list[str], output: str, batch: int = 32) -> DataFrame:
    """(key, out): the model's output for every row, in batches; ``output`` is its DDL type."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.select(*key).schema)}, out {output}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, factory)
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                out = some[key].copy()
                out["out"] = list(model(list(some[columns].itertuples(index=False, name=None))))
                yield out

    return df.select(*dict.fromkeys([*key, *columns])).mapInPandas(run, schema)


def run_judge(df: DataFrame, name: str, factory: Callable[[str], Callable[[Sequence[str], float], Sequence[str]]], prompt: str, key: str, valid: Callable[[str], bool], temperatures: tuple[float, ...] = (0.0, 0.5, 1.0), batch: int = 32) -> DataFrame:
    """(key, reply, tries, ok): replies that ``valid`` rejects are asked again at the next temperature.

    Rows still rejected at the end have ok false: the dead letters.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, reply string, tries int, ok boolean"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(name, factory)
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch].reset_index(drop=True)
                reply, tries, ok = [None] * len(some), [0] * len(some), [False] * len(some)
                for heat in temperatures:
                    left = [i for i in range(len(some)) if not ok[i]]
                    if not left:
                        break
                    for i, r in zip(left, model([some[prompt][i] for i in left], heat)):
                        reply[i], tries[i], ok[i] = r, tries[i] + 1, valid(r)
                yield pd.DataFrame({key: some[key], "reply": reply, "tries": pd.Series(tries, dtype="int32"), "ok": ok})

    return df.select(key, prompt).mapInPandas(run, schema)


def prompt_text(template: str, **parts: Column) -> Column:
    """``template`` with {name} places filled by columns; nulls are empty."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def answer_span(prompt_ids: Column, full_ids: Column) -> Column:
    """Token ids after the common prefix; the last token where nothing is left."""
    from verisieve.functions.text import common_prefix

    n = common_prefix(prompt_ids, full_ids)
    return F.when(n < F.size(full_ids), F.slice(full_ids, n + 1, F.size(full_ids))).otherwise(F.slice(full_ids, -1, 1))


def recover(main: DataFrame, recovered: DataFrame, required: DataFrame, key: list[str], part: str, value: str) -> DataFrame:
    """Values of all required parts, from ``main`` or else ``recovered``; keys that lack a part are
    dropped. One row for each key and part; of repeated rows the smallest value counts."""
    a = main.select(*key, part, F.lit(0).alias("_src"), F.col(value).alias("_v"))
    b = recovered.select(*key, part, F.lit(1).alias("_src"), F.col(value).alias("_v"))
    best = a.unionByName(b).where("_v IS NOT NULL").groupBy(*key, part).agg(F.min(F.struct("_src", "_v")).alias("_b"))
    rows = required.select(*key, part).distinct().join(best, [*key, part], "left").select(*key, part, F.col("_b._v").alias(value))
    whole = rows.groupBy(*key).agg(F.count_if(F.col(value).isNull()).alias("_lacking"), F.collect_list(F.struct(part, value)).alias("_r")).where("_lacking = 0")
    return whole.select(*key, F.inline("_r"))


def token_batches(sizes: np.ndarray, budget: int) -> list[np.ndarray]:
    """Places of inputs by batches: inputs of like size together, each batch at most ``budget`` tokens
    after padding to its longest input; a longer input is a batch of its own."""
    order = np.argsort(sizes, kind="stable")
    out, begin = [], 0
    for k in range(1, len(order) + 1):
        if k == len(order) or (k + 1 - begin) * max(int(sizes[order[k]]), 1) > budget:
            out.append(order[begin:k])
            begin = k
    return out


def padded_share(sizes: np.ndarray, batches: list[np.ndarray]) -> float:
    """The share of padding among the tokens that a model is given."""
    given = sum(len(b) * int(sizes[b].max()) for b in batches)
    return 1 - float(sizes.sum()) / given if given else 0.0


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0)).cast(kind))


def _emit(df: DataFrame, key: list[str], columns: list[str], name: str, factory: Factory, fields: str, columns_of: Callable[[list[Any]], tuple[list[int], list[pa.Array]]], batch: int, tokens: str | None, budget: int) -> DataFrame:
    """(key, fields): any number of rows for each input, made of the model's output in the worker, so
    that what is large there (matrices, activations) never leaves it.

    The model gets ``batch`` inputs at a time in the order they come; with ``tokens``, a column of
    their sizes, it gets ``token_batches`` of those that come together. Which inputs share a batch
    changes no result. Outputs become Arrow arrays as they are."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.select(*key).schema)}, {fields}"
    names = [*key, *[f.split()[0] for f in fields.split(", ")]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(name, factory)
        for part in parts:
            n = part.num_rows
            if tokens is None:
                batches = [np.arange(at, min(at + batch, n)) for at in range(0, n, batch)]
            else:
                batches = token_batches(pc.fill_null(part.column("_tokens"), 0).to_numpy(zero_copy_only=False).astype(np.int64), budget) if n else []
            inputs = list(zip(*[part.column(c).to_pylist() for c in columns], strict=True))
            for some in batches:
                outs = list(model([inputs[i] for i in some]))
                if len(outs) != len(some):
                    raise ValueError(f"{len(outs)} outputs for {len(some)} inputs")
                counts, made = columns_of(outs)
                at = pa.array(np.repeat(some, counts))
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in key], *made], names)

    size = [] if tokens is None else [F.col(tokens).cast("long").alias("_tokens")]
    return df.select(*dict.fromkeys([*key, *columns]), *size).mapInArrow(run, schema)


def hidden_states(df: DataFrame, key: list[str], columns: list[str], name: str, factory: Factory, layers: Sequence[int], batch: int = 1, tokens: str | None = None, budget: int = 16_384) -> DataFrame:
    """(key, layer, vector): the forward pass. The model maps each input to {layer: vector}; an output
    that lacks a wanted layer, or whose vectors differ in width, is an error. ``tokens`` and ``budget``
    are as for ``token_batches``."""

    def columns_of(outs: list[dict[int, Sequence[float]]]) -> tuple[list[int], list[pa.Array]]:
        for out in outs:
            lacking = [n for n in layers if n not in out]
            if lacking or len({len(out[n]) for n in layers}) > 1:
                raise ValueError(f"layers lacking {lacking} or of different widths")
        vectors = [np.asarray(out[n], np.float32) for out in outs for n in layers]
        return [len(layers)] * len(outs), [pa.array(np.tile(np.array(layers, np.int32), len(outs))), _lists(vectors, pa.float32())]

    return _emit(df, key, columns, name, factory, "layer int, vector array<float>", columns_of, batch, tokens, budget)


def attention_diagonals(df: DataFrame, key: list[str], columns: list[str], name: str, factory: Factory, batch: int = 1, tokens: str | None = None, budget: int = 16_384) -> DataFrame:
    """(key, layer, head, attn_diag, lap_diag): the attention pass. The model maps each input to an
    array layers x heads x S x S; only its two diagonals are kept."""

    def columns_of(outs: list[Any]) -> tuple[list[int], list[pa.Array]]:
        counts, places, own, laplacian = [], [], [], []
        for out in outs:
            a = np.asarray(out, float)
            size = a.shape[-1]
            diagonal = np.diagonal(a, axis1=2, axis2=3)
            own += list(diagonal.reshape(-1, size))
            laplacian += list((a.sum(axis=2) / (size - np.arange(size)) - diagonal).reshape(-1, size))
            places.append(np.indices(a.shape[:2]).reshape(2, -1))
            counts.append(a.shape[0] * a.shape[1])
        at = np.concatenate(places, axis=1).astype(np.int32)
        return counts, [pa.array(at[0]), pa.array(at[1]), _lists(own, pa.float64()), _lists(laplacian, pa.float64())]

    return _emit(df, key, columns, name, factory, "layer int, head int, attn_diag array<double>, lap_diag array<double>", columns_of, batch, tokens, budget)


def value_norms(df: DataFrame, key: list[str], columns: list[str], name: str, factory: Factory, heads: int, left_out: str = "vision", batch: int = 1, tokens: str | None = None, budget: int = 16_384) -> DataFrame:
    """(key, layer, kv_head, vnorm): norms of the captured value projections. The model maps each input
    to {module name: array S x (heads * width)}; modules whose name holds ``left_out`` are not layers,
    the others are in the order of the numbers in their names."""

    def columns_of(outs: list[dict[str, Any]]) -> tuple[list[int], list[pa.Array]]:
        counts, norms = [], []
        for out in outs:
            named = sorted((n for n in out if left_out not in n), key=lambda n: ([int(x) for x in re.findall(r"\d+", n)], n))
            for module in named:
                v = np.asarray(out[module], float)
                if v.shape[1] % heads:
                    raise ValueError(f"{module}: {v.shape[1]} values for {heads} heads")
                norms += list(np.linalg.norm(v.reshape(len(v), heads, -1), axis=2).T)
            counts.append(len(named) * heads)
        layer = np.concatenate([np.arange(n) // heads for n in counts]).astype(np.int32)
        head = np.concatenate([np.arange(n) % heads for n in counts]).astype(np.int32)
        return counts, [pa.array(layer), pa.array(head), _lists(norms, pa.float64())]

    return _emit(df, key, columns, name, factory, "layer int, kv_head int, vnorm array<double>", columns_of, batch, tokens, budget)


def answer_sidecars(df: DataFrame, key: list[str], columns: list[str], name: str, factory: Factory, alpha: float = 1.0, batch: int = 1, tokens: str | None = None, budget: int = 16_384) -> DataFrame:
    """(key, n_answer_tokens, s_ext_l, s_int): the records of an answer. The model maps each input to
    (log probabilities layers x tokens, {layer: probe score}); the former are summed over the tokens
    and divided by their number to the power ``alpha``. An answer without tokens has no record."""

    def mapped(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        at = np.cumsum([0, *[len(k) for k, _ in parts]]).astype(np.int32)
        keys, values = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (0, 1))
        return pa.MapArray.from_arrays(pa.array(at), pa.array(keys.astype(np.int32)), pa.array(values.astype(float)))

    def columns_of(outs: list[tuple[Any, dict[int, float]]]) -> tuple[list[int], list[pa.Array]]:
        counts, sizes, outer, inner = [], [], [], []
        for given, probes in outs:
            lens = np.asarray(given, float)
            held = lens.ndim == 2 and lens.shape[1] > 0
            counts.append(int(held))
            if held:
                sizes.append(lens.shape[1])
                outer.append((np.arange(len(lens)), lens.sum(axis=1) / lens.shape[1] ** alpha))
                inner.append((np.array(list(probes), np.int64), np.array(list(probes.values()), float)))
        return counts, [pa.array(sizes, pa.int32()), mapped(outer), mapped(inner)]

    return _emit(df, key, columns, name, factory, "n_answer_tokens int, s_ext_l map<int,double>, s_int map<int,double>", columns_of, batch, tokens, budget)
