"""Columns of a table as one compressed value, for what many tasks need whole."""

from __future__ import annotations

import pyarrow as pa


def array(t: pa.Table, c: str) -> pa.Array:
    a = t[c].combine_chunks()
    return pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a


def packed(t: pa.Table, columns: list[str]) -> bytes:
    """Columns as compressed bytes: equal values are written once."""
    small = pa.table({c: v if pa.types.is_nested(v.type) else v.dictionary_encode() for c in columns for v in [array(t, c)]})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, small.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(small)
    return out.getvalue().to_pybytes()


def unpacked(parts: list[bytes], columns: list[str]) -> dict[str, pa.Array]:
    """Columns of several packed tables, one after another."""
    read = [pa.ipc.open_stream(x).read_all() for x in parts]
    whole = lambda a: a.dictionary_decode() if pa.types.is_dictionary(a.type) else a
    return {c: pa.concat_arrays([whole(array(t, c)) for t in read]) for c in columns}
