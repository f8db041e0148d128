"""What the training-data operators share: tables, ids, bounded slices of texts, joins on skewed keys, ASCII word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import discard, new_path, shared_dir, spare, stored, write_table

__all__ = ["discard", "new_path", "shared_dir", "spare", "stored", "write_table"]

#: Lower-cases A-Z and turns every other ASCII byte that is neither a digit nor a letter into a blank.
ALNUM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def long_id(df: DataFrame, name: str) -> Column:
    """An id column as a long. Ids are whole numbers or null throughout this subpackage; other types are refused."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} has the type {kind.simpleString()}: ids are whole numbers; number other ids first")
    return quoted(name).cast("long")


def whole_text(column: str) -> Column:
    return F.coalesce(quoted(column).cast("string"), F.lit(""))


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split()


def slices(batches: Iterable[pa.RecordBatch], column: int = 1, most_bytes: int = 2 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in small views of at most `rows` rows and about most_bytes of text, a single longer text excepted,
    so that only few texts are Python objects at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most_bytes, "right"))))
            yield batch.slice(at, to - at)
            at = to


#: What map_texts has set in each application.
_BATCHES: dict[str, str] = {}


def map_texts(df: DataFrame, run: Callable, schema, rows: int = 2000) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of at most `rows` rows: a batch is held whole by the executor and its Python
    worker, and the default of ten thousand is meant for short rows. A session's own setting of batches is left as it is."""
    conf, app, name = df.sparkSession.conf, df.sparkSession.sparkContext.applicationId, "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = conf.getAll.get(name)
    if own is None or own == _BATCHES.get(app):
        conf.set(name, rows)
        _BATCHES[app] = str(rows)
    return df.mapInArrow(run, schema)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with keyed (one row per key, where n counts the key's rows among `total`), whatever the skew.

    Keys with over a thousandth of all rows are at most a thousand, so they are broadcast; the rows of any other key are
    few enough for one task of a shuffled join. Rows with a null key meet nothing and are not shuffled. keyed should be a
    stored table, as it is read twice.
    """
    most = total / 1000
    hot = F.broadcast(keyed.filter(F.col(n) > most).drop(n))
    cold = keyed.filter(F.col(n) <= most).drop(n)
    others = rows.join(hot.select(*keys), keys, "left_anti")
    if how == "inner":
        return rows.join(hot, keys).unionByName(others.join(cold, keys))
    there = None
    for k in keys:
        there = F.col(k).isNotNull() if there is None else there & F.col(k).isNotNull()
    out = rows.join(hot, keys).unionByName(others.filter(there).join(cold, keys, "left"))
    return out.unionByName(rows.filter(~there), allowMissingColumns=True)
