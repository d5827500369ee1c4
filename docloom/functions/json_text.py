"""Documents as indented JSON text: two blanks a level, characters beyond ASCII as they are, nulls kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.schema import BBOX

#: Most bytes of Arrow data that are written at once: their texts and the parts of these take several times as much.
SLICE_BYTES = 2 << 20


def indented(value: Column, kind: T.StructType) -> Column:
    """``value`` of the type ``kind`` as text, in Arrow batches: what floats look like is Python's shortest form.

    A batch is written in slices of about ``SLICE_BYTES``, each column by column: no row becomes Python objects.
    """
    box = [(n, pa.float64()) for n in BBOX.names]
    most = SLICE_BYTES

    # all that workers need is nested here, so they needn't import this package
    def written(x: pa.Array, pad: str) -> pa.Array:
        """The JSON of each value, ``null`` for null; ``pad`` is the indentation of the line it begins on."""
        import json

        import numpy as np
        import pyarrow.compute as pc

        kind, inner = x.type, pad + "  "

        def joined(*parts: pa.Array | str) -> pa.Array:
            return pc.binary_join_element_wise(*[pa.scalar(p, pa.string()) if isinstance(p, str) else p for p in parts], "")

        def each(values: pa.Array, shown) -> pa.Array:
            """Different values are shown once."""
            coded = values.dictionary_encode()
            return pa.array([None if v is None else shown(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

        if pa.types.is_struct(kind):
            is_box = [(f.name, f.type) for f in kind] == box
            fields: list[pa.Array | str] = []
            for i in range(kind.num_fields):
                part = pc.struct_field(x, [i])
                fields += [(",\n" if i else "\n") + inner + ("" if is_box else json.dumps(kind.field(i).name, ensure_ascii=False) + ": ")]
                fields += [pc.fill_null(each(part, lambda v: json.dumps(round(v, 2))), "null") if is_box else written(part, inner)]
            texts = joined("[" if is_box else "{", *fields, "\n" + pad + ("]" if is_box else "}"))
            return pc.if_else(x.is_valid(), texts, "null")
        if pa.types.is_list(kind):
            lengths = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
            bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            items = pc.binary_join(pa.ListArray.from_arrays(bounds, written(x.flatten(), inner)), ",\n" + inner)
            texts = pc.if_else(pa.array(lengths > 0), joined("[\n" + inner, items, "\n" + pad + "]"), "[]")
            return pc.if_else(x.is_valid(), texts, "null")
        if pa.types.is_map(kind):
            return pa.array([json.dumps(None if v is None else dict(v), indent=2, ensure_ascii=False).replace("\n", "\n" + pad) for v in x.to_pylist()], pa.string())
        if pa.types.is_string(kind):
            texts = joined('"', x, '"')
            special = pc.fill_null(pc.match_substring_regex(x, r'[\x00-\x1f"\\]'), False)
            if special.true_count:
                escaped = [json.dumps(v, ensure_ascii=False) for v in x.filter(special).to_pylist()]
                texts = pc.replace_with_mask(texts, special, pa.array(escaped, pa.string()))
        elif pa.types.is_floating(kind):
            texts = each(x, json.dumps)
        else:  # whole numbers and flags
            texts = x.cast(pa.string())
        return pc.fill_null(texts, "null")

    @F.arrow_udf(T.StringType())
    def texts(rows: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        step = max(1, len(rows) * most // max(1, rows.nbytes))
        parts = [pc.if_else(part.is_valid(), written(part, ""), pa.scalar(None, pa.string())) for part in (rows.slice(i, step) for i in range(0, len(rows), step))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return texts(value)
