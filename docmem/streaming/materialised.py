"""A materialised fold: current values kept up to date by micro-batches.

Owners are dealt into buckets by hash. A micro-batch folds its tail onto the state of
the buckets it touches and onto no others, so its cost follows the owners that it
changes, not the history.

    root/log/gen=<n>/bucket=<k>      good edits, merged by level once there are many folders
    root/state/gen=<n>/bucket=<k>    what is left of them: writes that still count
    root/bad/batch_id=<n>            edits set aside, with their fault
    root/manifest/batch=<n>          which folders hold each bucket after batch n

The manifest is written last and decides what is read. A batch that is tried again
starts from the manifest before it and replaces its own folders, so edits are neither
lost nor doubled; an edit delivered again in another batch is dropped by `(db_id, seq)`.

**State.** For each owner there is a *floor*: writes up to it are compacted (void writes
are gone, a path keeps its last write, or its list from the first list write on), later
ones are kept as they are. The floor follows the owner's newest edit at a distance of
`horizon` sequence numbers, so an edit that comes late by less than that finds all it
may interact with. One that comes even later makes the batch fold its owner anew from
the bucket's log; such owners are the only ones whose history is read. Edits of list
elements stay in the state as they came and are applied when values are read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from docmem.functions.paths import ANY_ELEMENT_PATH
from docmem.operators import fold as fo
from docmem.operators import matching, validate
from docmem.session import cut_lineage, remove

BUCKETS = 64  # so many that a bucket's state is rewritten in little time; fixed for the life of a folder
HORIZON = 1 << 16
FAN = 8  # log folders of one level and bucket before they are merged into one of the next level
SPLIT = 8  # tasks that write one bucket, so that a hot owner is no single task

_OLDEST = -(1 << 62)
_HEAD, _ELEMENT = "head", "element"
_MANIFEST = "bucket int, part string, gen string, level int"
_STATE = "seq bigint, path string, value string, kind string, implied boolean, marker boolean"


def bucket_of(buckets: int, db_id: str = "db_id") -> Column:
    return F.pmod(F.xxhash64(db_id), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, before: int | None = None) -> tuple[int | None, list[tuple]]:
    """(batch, entries) of the newest manifest, or of the newest before a batch.

    A manifest has one entry per bucket and folder: a few per bucket, whatever the size of the log.
    """
    try:
        found = spark.read.schema(f"{_MANIFEST}, batch bigint").parquet(f"{root}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None, []
    if before is not None:
        found = found.where(F.col("batch") < before)
    last = found.agg(F.max("batch")).first()[0]
    if last is None:
        return None, []
    rows = found.where(F.col("batch") == last).collect()
    return last, [(r.bucket, r.part, r.gen, r.level) for r in rows]


def _folders(root: str, entries: list[tuple], part: str, buckets: set[int] | None) -> list[str]:
    return [
        f"{root}/{p}/gen={gen}/bucket={b}" for b, p, gen, _ in entries if p == part and (buckets is None or b in buckets)
    ]


def _read(spark: SparkSession, paths: list[str], schema: StructType | None = None) -> DataFrame:
    """Exactly these folders; nothing else is listed or opened."""
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)


def _store(df: DataFrame, where: str) -> None:
    """By bucket; a bucket's rows are written by a few tasks."""
    spread = F.pmod(F.xxhash64("db_id", "path", F.floor(F.col("seq") / 4096)), F.lit(SPLIT))
    df.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(where)


def _written_buckets(spark: SparkSession, where: str) -> set[int]:
    return {r.bucket for r in spark.read.parquet(where).select("bucket").distinct().collect()}


def _with_id(edits: DataFrame, ddl: str) -> StructType:
    return StructType([StructField("db_id", edits.schema["db_id"].dataType), *StructType.fromDDL(ddl).fields])


def _once(rows: DataFrame) -> DataFrame:
    """One row per `(db_id, seq)`; of differing ones the least, so that retries agree."""
    others = [c for c in rows.columns if c not in ("db_id", "seq")]
    first = Window.partitionBy("db_id", "seq").orderBy(*others)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _writes(edits: DataFrame) -> DataFrame:
    """State rows of edits: writes as the fold takes them, edits of list elements as they came."""
    of_elements = F.col("path").rlike(ANY_ELEMENT_PATH)
    kept = edits.where(of_elements).select(
        "db_id",
        "seq",
        "path",
        F.col("data").alias("value"),
        F.lit(_ELEMENT).alias("kind"),
        F.lit(False).alias("implied"),
        F.lit(False).alias("marker"),
    )
    return fo.spread(edits.where(~of_elements)).select(kept.columns).unionByName(kept)


def _compacted(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """State rows of `owners(db_id, floor)`: writes up to the floor compacted, later ones as they are, and a head each."""
    rows = cut_lineage(rows.join(owners.select("db_id", "floor"), "db_id"))
    settled = (F.col("seq") <= F.col("floor")) & (F.col("kind") != _ELEMENT)
    old = rows.where(settled).drop("floor")
    new = rows.where(~settled).drop("floor")
    heads = owners.select(
        "db_id",
        F.col("floor").alias("seq"),
        F.lit("").alias("path"),
        F.lit(None).cast("string").alias("value"),
        F.lit(_HEAD).alias("kind"),
        F.lit(False).alias("implied"),
        F.lit(False).alias("marker"),
    )
    if old.isEmpty():
        return new.unionByName(heads)
    return fo.compact(old).unionByName(new).unionByName(heads)


def apply(batch: DataFrame, batch_id: int, root: str, buckets: int = BUCKETS, horizon: int = HORIZON) -> None:
    """Fold a micro-batch of edits `(db_id, seq, path, data)` onto the state under `root`."""
    spark = batch.sparkSession
    before, entries = _manifest(spark, root, batch_id)
    edits = batch.select("db_id", F.col("seq").cast("bigint").alias("seq"), "path", "data")
    checked = cut_lineage(validate.check_edits(edits))
    bad = validate.quarantine(checked)
    if not bad.isEmpty():
        bad.write.mode("overwrite").parquet(f"{root}/bad/batch_id={batch_id}")
    tail = cut_lineage(_once(fo.drop_na(validate.valid(checked))).withColumn("bucket", bucket_of(buckets)))
    touched = {r.bucket for r in tail.select("bucket").distinct().collect()}  # at most `buckets`
    if not touched:
        return
    _store(tail, f"{root}/log/gen={batch_id}")
    entries = entries + [(b, "log", str(batch_id), 0) for b in touched]

    state = _read(spark, _folders(root, entries, "state", touched), _with_id(tail, _STATE))
    head = state.where(F.col("kind") == _HEAD).select("db_id", F.col("seq").alias("was"))
    held = state.where(F.col("kind") != _HEAD)
    owners = cut_lineage(
        tail.groupBy("db_id")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        .join(head, "db_id", "left")
        .select(
            "db_id",
            F.greatest(F.coalesce("was", F.lit(_OLDEST)), F.col("hi") - horizon).alias("floor"),
            F.coalesce(F.col("lo") <= F.col("was"), F.lit(False)).alias("late"),
        )
    )
    on_time, late = owners.where(~F.col("late")), owners.where("late")
    kept = held.join(on_time.select("db_id"), "db_id", "left_semi")
    fresh = tail.join(on_time.select("db_id"), "db_id", "left_semi")
    # delivered again: the same (db_id, seq) among the writes still kept as they came
    fresh = fresh.join(kept.where(~F.col("implied")).select("db_id", "seq"), ["db_id", "seq"], "left_anti")
    columns = state.columns
    rows = kept.select(columns).unionByName(_writes(fresh).select(columns))
    if not late.isEmpty():
        log = _read(spark, _folders(root, entries, "log", touched), _with_id(tail, "seq bigint, path string, data string"))
        again = _once(log.join(late.select("db_id"), "db_id", "left_semi"))
        rows = rows.unionByName(_writes(again).select(columns))
    unchanged = state.join(owners.select("db_id"), "db_id", "left_anti").select(columns)
    out = _compacted(rows, owners).select(columns).unionByName(unchanged).withColumn("bucket", bucket_of(buckets))
    where = f"{root}/state/gen={batch_id}"
    _store(out, where)
    done = _written_buckets(spark, where)
    entries = [e for e in entries if e[1] != "state" or e[0] not in touched]
    entries += [(b, "state", str(batch_id), 0) for b in done]
    entries = _merge_log(spark, root, entries, batch_id, touched, buckets)
    _commit(spark, root, entries, batch_id)
    _clean(spark, root, batch_id, before, entries)


def _merge_log(
    spark: SparkSession, root: str, entries: list[tuple], batch_id: int, touched: set[int], buckets: int
) -> list[tuple]:
    """Log folders of a bucket that have come to `FAN` on one level become one folder of the next.

    An edit is rewritten once per level, so a logarithm of the number of batches many times.
    """
    level = 0
    while True:
        n = Counter(b for b, part, _, at in entries if part == "log" and at == level and b in touched)
        full = {b for b, k in n.items() if k >= FAN}
        if not full:
            return entries
        mine = lambda e: e[1] == "log" and e[3] == level and e[0] in full  # noqa: B023, E731
        paths = [f"{root}/log/gen={gen}/bucket={b}" for b, _, gen, _ in filter(mine, entries)]
        gen = f"{batch_id}-{level + 1}"
        _store(_read(spark, paths).withColumn("bucket", bucket_of(buckets)), f"{root}/log/gen={gen}")
        entries = [e for e in entries if not mine(e)] + [(b, "log", gen, level + 1) for b in full]
        level += 1


def _commit(spark: SparkSession, root: str, entries: list[tuple], batch_id: int) -> None:
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch_id}")


def _clean(spark: SparkSession, root: str, batch_id: int, before: int | None, entries: list[tuple]) -> None:
    """Remove what neither this manifest nor the one before it names: a retry may still start from there."""
    if before is None:
        return
    older, old = _manifest(spark, root, before)
    if older is None:
        return
    _, previous = _manifest(spark, root, batch_id)
    named = {(part, gen, b) for b, part, gen, _ in [*entries, *previous]}
    gone = [f"{root}/{part}/gen={gen}/bucket={b}" for b, part, gen, _ in old if (part, gen, b) not in named]
    remove(spark, *gone, f"{root}/manifest/batch={older}")


def materialise(
    edits: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, horizon: int = HORIZON, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the fold of streamed edits under `root` up to date."""
    return (
        edits.writeStream.foreachBatch(lambda batch, n: apply(batch, n, root, buckets, horizon))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def state_folders(spark: SparkSession, root: str, owners: DataFrame | None = None, buckets: int = BUCKETS) -> list[str]:
    """The folders that hold the state, or the state of `owners(db_id)`."""
    _, entries = _manifest(spark, root)
    wanted = None
    if owners is not None:
        wanted = {r.b for r in owners.select(bucket_of(buckets).alias("b")).distinct().collect()}  # at most `buckets`
    return _folders(root, entries, "state", wanted)


def current(
    spark: SparkSession, root: str, owners: DataFrame | None = None, buckets: int = BUCKETS, positions: bool = True
) -> DataFrame:
    """Current values as fold rows, of all owners or of `owners(db_id)`, from their buckets alone."""
    paths = state_folders(spark, root, owners, buckets)
    if not paths:
        raise ValueError(f"nothing has been folded under {root}")
    state = _read(spark, paths).where(F.col("kind") != _HEAD)
    if owners is not None:
        state = state.join(owners.select("db_id").distinct(), "db_id", "left_semi")
    writes = cut_lineage(state.where(F.col("kind") != _ELEMENT))
    settled = fo.settle(writes)
    folded = fo.fold_writes(settled if settled is writes else cut_lineage(settled), positions=positions)
    edits = state.where(F.col("kind") == _ELEMENT).select("db_id", "seq", "path", F.col("value").alias("data"))
    return folded if edits.isEmpty() else matching.update_any(cut_lineage(folded), edits)


def log_folders(spark: SparkSession, root: str) -> dict[int, int]:
    """How many log folders each bucket has."""
    _, entries = _manifest(spark, root)
    n: dict[int, int] = defaultdict(int)
    for b, part, _, _ in entries:
        n[b] += part == "log"
    return dict(n)


def fresh_root(base: str) -> str:
    return f"{base}/docmem-fold-{uuid.uuid4().hex}"
