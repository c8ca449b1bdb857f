"""What the text operators share: shared folders, word rules, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spelled out as bytes: every byte but 0-9, A-Z (made lower case), a-z and those of other alphabets becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return encoded(text).translate(WORD_TABLE).split() if text else []


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


#: Folders of local sessions that have no setting, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach: under spark.checkpoint.dir, or a
    temporary folder of this machine where that is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _own[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go as soon as the write is done, and Python workers get no more
#: than so many rows at once, as rows hold texts.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock = threading.Lock()
#: By application: how many tables are being written now, and the settings from before the first of them.
_now: dict[str, tuple[int, dict[str, str | None]]] = {}
#: Paths of tables that are still there, by application.
_made: dict[str, set[str]] = {}


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The settings above, until the last of the tables that threads write together is done."""
    app = spark.sparkContext.applicationId
    with _lock:
        n, before = _now.get(app) or (0, {k: spark.conf.get(k, None) for k in _WRITING})
        if not n:
            for k, v in _WRITING.items():
                spark.conf.set(k, str(min(int(v), int(before[k]))) if v.isdigit() and before[k] else v)
        _now[app] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _now[app]
            _now[app] = n - 1, before
            if n == 1:
                del _now[app]
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what follows starts from files, which outlive executors,
    and the shuffles that led to them are no longer needed."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with _writing(spark):
        df.write.option("compression", "zstd").parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    _made.get(context.applicationId, set()).discard(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` has made, once nothing will read them again."""
    for t in tables:
        _remove(t.sparkSession, t.written_to)


def clear(spark: SparkSession) -> None:
    """Removes all tables that ``written`` has made for this application and that are still there: to be
    called once the results of its queries are saved, as results read from them lazily."""
    for path in list(_made.get(spark.sparkContext.applicationId, ())):
        _remove(spark, path)


#: The operator whose memory this process holds, and how to forget it.
_holder: list = ["", lambda: None]
#: How often ``holding`` was called here, which tells idle workers from busy ones.
_turn = [0]
_idle = threading.Lock()
IDLE_SECONDS = 5


def holding(name: str, forget: Callable[[], object] = lambda: None) -> None:
    """To be called by whatever runs in a Python worker, with how to forget what it remembers between batches:
    workers serve one stage after another, and what another operator has remembered goes. ``forget`` must be a
    function of a module: what else a worker gets is a copy, made with the code that it runs."""
    with _idle:
        _turn[0] += 1
        if _holder[0] != name:
            _holder[1]()
            _trim()
        _holder[:] = [name, forget]


def give_back() -> None:
    """To be called at the end of what began with ``holding``: what it has freed goes back to the system, and so
    does what it remembers if no more comes for some seconds, as an executor has more workers than cores."""
    _trim()
    turn = _turn[0]

    def late() -> None:
        with _idle:
            if _turn[0] == turn:
                _holder[1]()
                _holder[:] = ["", lambda: None]
                _trim()

    timer = threading.Timer(IDLE_SECONDS, late)
    timer.daemon = True
    timer.start()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def row_key(*columns: Column) -> Column:
    """16 bytes that stand for a row: two hashes, as one of 64 bits would not tell 10**10 rows apart."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(n), *columns)), 16, "0") for n in (0, 1)]))


def structs(schema: pa.StructType, columns: list) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], fields=list(schema)
    )
