"""Nested Arrow columns to Python values and back, column by column; value by value (to_pylist, pa.array of dicts) takes many times as long."""

from __future__ import annotations

from itertools import accumulate, chain


def values(column) -> list:
    """What column.to_pylist() gives."""
    import pyarrow as pa

    kind = column.type
    if not len(column):  # its offsets may be unset
        return []
    if pa.types.is_struct(kind):
        names = [f.name for f in kind]
        out = [dict(zip(names, row, strict=True)) for row in zip(*(values(column.field(i)) for i in range(len(names))), strict=True)] if names else column.to_pylist()
    elif pa.types.is_list(kind):
        ends = column.offsets.to_numpy().tolist()
        inside = values(column.values.slice(ends[0], ends[-1] - ends[0]))
        out = [inside[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]
    elif pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    return [x if there else None for x, there in zip(out, column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)] if column.null_count else out


def array(rows: list, kind):
    """What pa.array(rows, kind) gives."""
    import pyarrow as pa

    if not (pa.types.is_list(kind) or pa.types.is_struct(kind) and kind.num_fields) or any(r is None for r in rows):
        return pa.array(rows, kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([array([r.get(f.name) for r in rows], f.type) for f in kind], fields=list(kind))
    ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, array(list(chain.from_iterable(rows)), kind.value_type), type=kind)
