"""Texts masked by mappings of many entries, in tasks that hold all mappings: one pass over a text's words, however many of them are mapped."""

from __future__ import annotations

import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of originals and placeholders up to which tasks hold all mappings.
HELD = 4 << 20
#: Rows masked at a time.
BATCH = 256
_RUN = re.compile("[A-Za-z0-9_]+")


def steps(pairs: list[tuple[str, str, bool]]) -> list:
    """A mapping's pairs of original, placeholder and shade, in their order, as steps: a dictionary, or a pattern with its pair.

    Originals that are one run of word characters stand where such a run begins and ends, and placeholders are put between other characters.
    So such pairs can go together if no placeholder of the mapping holds their original; all others keep their turn.
    """
    put_in = {w for _, p, _ in pairs for w in _RUN.findall(p)}
    out: list = []
    for o, p, grey in pairs:
        if _RUN.fullmatch(o) and o not in put_in:
            if not out or not isinstance(out[-1], dict):
                out.append({})
            out[-1][o] = (p, grey)
        else:
            out.append((re.compile(f"(?<![A-Za-z0-9_]){re.escape(o)}(?![A-Za-z0-9_])"), o, p, grey))
    return out


def masked(text: str | None, done: list) -> tuple[str | None, bool, bool]:
    """Text, whether anything changed, and whether a grey one did, by steps()."""
    changed = shaded = False
    if text is None:
        return None, False, False
    for step in done:
        if isinstance(step, dict):

            def put(m, step=step):
                nonlocal changed, shaded
                new = step.get(m[0])
                if new is None:
                    return m[0]
                if new[0] != m[0]:
                    changed, shaded = True, shaded or new[1]
                return new[0]

            text = _RUN.sub(put, text)
        else:
            pattern, o, p, grey = step
            if o in text:
                new = pattern.sub(lambda _, p=p: p, text)
                if new != text:
                    text, changed, shaded = new, True, shaded or grey
    return text, changed, shaded


class _Mappings:
    """Pairs by key, told from others by name alone."""

    def __init__(self, pairs: dict):
        self.pairs, self.name = pairs, uuid.uuid4().hex

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


@functools.lru_cache(1)
def _built(mappings: _Mappings) -> dict:
    """The steps of all mappings, made once in each Python worker."""
    return {k: steps(p) for k, p in mappings.pairs.items()}


def apply(docs: DataFrame, pairs: dict, key: str, text: str) -> DataFrame:
    """docs whose key has pairs, with _m: text, changed and grey."""
    held = _Mappings(pairs)
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType()), T.StructField("grey", T.BooleanType())])
    k, t = docs.columns.index(key), docs.columns.index(text)

    def run(batches):
        own = _built(held)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                found = [own.get(x) for x in b.column(k).to_pylist()]
                b = b.filter(pa.array([f is not None for f in found], pa.bool_()))
                rows = [masked(x, f) for x, f in zip(b.column(t).to_pylist(), (f for f in found if f is not None), strict=True)]
                made = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.bool_())], ["text", "changed", "grey"])
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "_m"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_m", kind)]))
