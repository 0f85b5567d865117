"""The engine: declared tables over a log, SQL on them, indexes, subscriptions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.predicates import Constraint, conjunction
from .sources import index as indexing
from .sources.log import CommitLog, Receipt, Staged
from .spec import MAX_TABLES, SpecError, TableSpec
from .streaming.subscribe import LOOKAHEAD, Subscription, subscribe_sql

MAX_SQL = 65_535


@dataclass
class Engine:
    """``root`` is a folder that driver and executors share.  Tables without a log are plain views."""

    spark: SparkSession
    root: str
    specs: dict[str, TableSpec] = field(default_factory=dict)
    external: dict[str, DataFrame] = field(default_factory=dict)
    projections: dict[str, dict[str, indexing.Projection]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.log = CommitLog(self.spark, self.root)

    def register(self, spec: TableSpec, rows: DataFrame | None = None) -> None:
        """Declare a table.  With ``rows`` it is read from there, else from what insert() writes."""
        if spec.name not in self.specs and len(self.specs) >= MAX_TABLES:
            raise SpecError(f"at most {MAX_TABLES} tables")
        self.specs[spec.name] = spec
        self.projections.setdefault(spec.name, {})
        if rows is None:
            self.projections[spec.name] |= indexing.stored(self.log.store, self.spark, spec)
        else:
            if missing := {c.name for c in spec.columns} - set(rows.columns):
                raise SpecError(f"{spec.name}: no column {sorted(missing)}")
            self.external[spec.name] = rows
        self.refresh()

    def register_view(self, name: str, rows: DataFrame) -> None:
        """A table without a key, such as one whose candidate key is not unique."""
        rows.createOrReplaceTempView(name)

    def table(self, name: str, at: int | None = None) -> DataFrame:
        """A table's rows as of batch ``at``: of each primary key the last written, whatever the log retains."""
        if name in self.external:
            return self.external[name]
        spec = self.specs[name]
        found = self.log.base(name, at)
        rows = self._latest(name, found["seq"] if found else 0, at)
        if not found:
            return rows if rows is not None else self.spark.createDataFrame([], spec.schema)
        base = self.spark.read.schema(spec.schema).parquet(found["path"])
        return base if rows is None else indexing.replaced(base, rows, list(spec.primary_key))

    def _latest(self, name: str, after: int, at: int | None = None, where: Column | None = None) -> DataFrame | None:
        """Of each primary key the last row that batches in (after, at] wrote; None if they wrote none.

        With ``where`` only of keys of which some row, the last or an earlier one, satisfies it.
        """
        spec = self.specs[name]
        rows = self.log.history(name, after, at)
        if rows is None:
            return None
        if where is not None:
            rows = rows.join(rows.filter(where).select(*spec.primary_key), list(spec.primary_key), "left_semi")
        rest = [c.name for c in spec.columns if c.name not in spec.primary_key]
        last = rows.groupBy(*spec.primary_key).agg(F.max_by(F.struct(*(rest or ["_ord"])), F.struct("seq", "_ord")).alias("_l"))
        return last.select(*[F.col(c.name) if c.name in spec.primary_key else F.col(f"_l.{c.name}").alias(c.name) for c in spec.columns])

    def compact(self, *names: str) -> None:
        """Fold the named tables (default: all) into bases, dealt by ranges of their keys and sorted, and write their
        projections anew; then delete the batches that were trimmed from the log and that bases hold."""
        for name in names or [n for n in self.specs if n not in self.external]:
            key = self.specs[name].primary_key
            seq = self.log.current()
            self.log.write_base(name, self.table(name, seq).repartitionByRange(*key).sortWithinPartitions(*key), seq)
            self.reindex(name)
        self.log.reclaim()

    def refresh(self, at: int | None = None) -> None:
        """Point the SQL views at the snapshot ``at`` (default: now); other engines of the session may share names."""
        for name in self.specs:
            self.table(name, at).createOrReplaceTempView(name)

    def _checked(self, name: str, rows: DataFrame) -> DataFrame:
        spec = self.specs[name]
        if len(rows.columns) != len(spec.columns):
            raise SpecError(f"{name} has {len(spec.columns)} columns, the rows {len(rows.columns)}")
        out = rows
        for c in spec.columns:
            if c.name not in rows.columns:
                raise SpecError(f"{name}: no column {c.name}")
            if rows.schema[c.name].dataType != c.spark_type and not isinstance(rows.schema[c.name].dataType, type(c.spark_type)):
                raise SpecError(f"{name}.{c.name}: {rows.schema[c.name].dataType.simpleString()} is not {c.spark_type.simpleString()}")
        bad = F.lit(False)
        for c in spec.columns:
            if not c.nullable:
                bad = bad | F.col(c.name).isNull()
            if c.fixed_bytes:
                bad = bad | (F.length(c.name) != c.fixed_bytes)
        if out.filter(bad).limit(1).count():
            raise SpecError(f"{name}: a null in a column that has none, or bytes of a wrong length")
        return out.select(*[F.col(c.name).cast(c.spark_type) for c in spec.columns], F.monotonically_increasing_id().alias("_ord"))

    def insert(self, tables: dict[str, DataFrame]) -> Receipt:
        """Append rows to tables, all in one batch; a row with a known key replaces the old one."""
        return self.log.commit({name: self._checked(name, rows) for name, rows in tables.items()})

    def insert_sql(self, name: str, select: str) -> int:
        """INSERT INTO name <select or VALUES>, returning the number of rows."""
        self.refresh()
        rows = self.spark.sql(select)
        spec = self.specs[name]
        if len(rows.columns) != len(spec.columns):
            raise SpecError(f"{name} has {len(spec.columns)} columns, the query {len(rows.columns)}")
        rows = rows.toDF(*[c.name for c in spec.columns]).select(*[F.col(c.name).cast(c.spark_type) for c in spec.columns])
        return self.insert({name: rows}).rows[name]

    def sql(self, query: str, at: int | None = None, min_seq: int | None = None) -> DataFrame:
        """Spark SQL over the declared tables; ``at`` reads a snapshot, ``min_seq`` asks for freshness."""
        if len(query) > MAX_SQL:
            raise ValueError(f"a query has at most {MAX_SQL} characters")
        self.log.require(min_seq)
        self.refresh(at)
        return self.spark.sql(query)

    def tables(self) -> list[dict]:
        """Columns, primary key and indexes of each table, as declared."""
        return [
            {"name": s.name, "columns": [{"name": c.name, "type": c.kind, "nullable": c.nullable} for c in s.columns], "primary_key": list(s.primary_key), "indexes": [{"name": i.name, "layout": i.layout, "keys": list(i.keys), "cover": list(i.cover)} for i in s.indexes]}
            for s in self.specs.values()
        ]

    def register_function(self, name: str, function) -> None:
        """A UDF (Python, pandas, Arrow or table function) for SQL."""
        (self.spark.udtf if hasattr(function, "func") and isinstance(function.func, type) else self.spark.udf).register(name, function)

    # indexes

    def backfill(self, name: str, progress: Callable[[dict], None] | None = None, only: str | None = None, chunk_bounds: list | None = None, start_from=None) -> list[str]:
        """Write the projections that are missing; those that are there stay.  Returns the new ones' names.

        ``chunk_bounds`` cuts the work at values of the first primary key column, with an event after each cut;
        a run that broke off goes on with ``start_from`` at the last event's ``next``.
        """
        spec, done = self.specs[name], []
        tell = progress or (lambda event: None)
        key = F.col(spec.primary_key[0])
        for i in spec.indexes:
            if i.name in self.projections[name] or (only is not None and i.name != only):
                continue
            tell({"event": "started", "index": i.name})
            # a run that goes on must see the rows that the broken one saw
            path, seq = f"{self.root}/index/{name}/{i.name}/rows", self._backfill_seq(name, i.name, start_from is not None)
            rows = self.table(name, seq) if name not in self.external else self.external[name]
            cuts = [start_from, *[b for b in chunk_bounds or [] if start_from is None or b > start_from], None]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = rows if lo is None else rows.filter(key >= F.lit(lo))
                part = part if hi is None else part.filter(key < F.lit(hi))
                indexing.write(part, spec, i, path, "overwrite" if lo is None else "append")
                if hi is not None:
                    tell({"event": "progress", "index": i.name, "next": hi})
            made = indexing.Projection(self.spark.read.parquet(path), seq)
            if name not in self.external:
                indexing.publish(self.log.store, spec, i, path, seq)
            self.projections[name][i.name] = made
            done.append(i.name)
            tell({"event": "completed", "index": i.name, "rows": made.rows.count()} if progress else {})
        return done

    def _backfill_seq(self, name: str, index: str, resumed: bool) -> int:
        store = self.log.store
        begun = [json.loads(store.read(f"index/{name}/{index}/begun/{n}")) for n in store.names(f"index/{name}/{index}/begun")]
        if resumed and begun:
            return max(begun, key=lambda b: b["run"])["seq"]
        seq = self.log.current()
        store.create(f"index/{name}/{index}/begun/{len(begun) + 1}.json", json.dumps({"run": len(begun) + 1, "seq": seq}))
        return seq

    def reindex(self, name: str) -> None:
        """Write every projection of a table anew, as of now, so that less is merged when it is read."""
        spec, seq = self.specs[name], self.log.current()
        for i in spec.indexes:
            if i.name in self.projections[name]:
                path = f"{self.root}/index/{name}/{i.name}/rows-{uuid.uuid4().hex}"
                indexing.write(self.table(name, seq), spec, i, path)
                indexing.publish(self.log.store, spec, i, path, seq)
                self.projections[name][i.name] = indexing.Projection(self.spark.read.parquet(path), seq)

    def evolve(self, name: str, indexes) -> None:
        self.specs[name] = self.specs[name].evolve(tuple(indexes))

    def scan(self, name: str, constraints: list[Constraint], columns: list[str] | None = None, at: int | None = None) -> DataFrame:
        """Rows under ``constraints`` by the best path; a projection is read with what was written after it.

        A snapshot before a projection's own batch is read from the table.
        """
        spec = self.specs[name]
        ready = self._ready(name, at)
        columns = columns or [c.name for c in spec.columns]
        path = indexing.choose(spec, constraints, columns, set(ready))
        newer = written = None
        if path.mode in ("covering", "lookup") and name not in self.external:
            seq = ready[path.path].seq
            newer = self._latest(name, seq, at, conjunction(constraints) if path.mode == "covering" else None)
            written = self.log.history(name, seq, at)
        return indexing.scan(self.table(name, at), ready, spec, constraints, columns, path, newer, written)

    def _ready(self, name: str, at: int | None = None) -> dict[str, indexing.Projection]:
        """The projections that give a snapshot together with the batches after them."""
        if name in self.external:
            return self.projections[name]
        gone = self.log.reclaimed()
        return {k: p for k, p in self.projections[name].items() if (at is None or p.seq <= at) and p.seq + 1 >= gone}

    def explain_access_path(self, name: str, constraints: list[Constraint], columns: list[str] | None = None) -> indexing.AccessPath:
        spec = self.specs[name]
        return indexing.choose(spec, constraints, columns or [c.name for c in spec.columns], set(self._ready(name)))

    def explain_analyze(self, name: str, constraints: list[Constraint], columns: list[str] | None = None) -> dict:
        """Run a scan and report its path, and what it read and gave: files, bytes and rows of each table scan."""
        rows = self.scan(name, constraints, columns)
        plan = rows._jdf.queryExecution()
        given = plan.toRdd().count()
        return {"path": self.explain_access_path(name, constraints, columns), "scans": scan_counters(plan.executedPlan()), "rows": given}

    def subscribe(self, name: str, where: str, handle: Callable[[int, DataFrame], None], checkpoint: str, since: int | None = None, once: bool = False, max_batches: int = LOOKAHEAD) -> Subscription:
        spec = self.specs[name]
        return subscribe_sql(self.spark, self.root, name, spec.schema, where, handle, checkpoint, since, once, max_batches)


@dataclass
class Prepared:
    """Rows taken from a writer for one batch; ``staged`` once their files are written."""

    rows: dict[str, list[tuple]]
    staged: Staged | None = None
    state: str = "prepared"  # then staged, persisted or failed


class BatchWriter:
    """Rows of several tables gathered on the client and published together.

    flush() goes through the steps that other committers may go through one by one: prepare() takes the rows,
    stage() writes their files, commit() publishes them, and mark_persisted() or mark_failed() settles the batch.
    Failed batches keep their rows; the next flush sends them first, oldest first.
    """

    def __init__(self, engine: Engine):
        self.engine, self.rows = engine, {}
        self.failed: list[Prepared] = []

    def insert(self, table: str, cells: tuple) -> None:
        spec = self.engine.specs[table]
        if len(cells) != len(spec.columns):
            raise SpecError(f"{table} has {len(spec.columns)} columns, the row {len(cells)}")
        self.rows.setdefault(table, []).append(tuple(cells))

    def prepare(self) -> Prepared | None:
        """The rows gathered so far as a batch of their own; None if there are none."""
        if not self.rows:
            return None
        taken, self.rows = Prepared(self.rows), {}
        return taken

    def stage(self, batch: Prepared) -> Prepared:
        if batch.state not in ("prepared", "failed"):
            raise ValueError(f"a {batch.state} batch cannot be staged")
        frames = {t: self.engine.spark.createDataFrame(r, self.engine.specs[t].schema) for t, r in batch.rows.items()}
        batch.staged = self.engine.log.stage({t: self.engine._checked(t, df) for t, df in frames.items()})
        batch.state = "staged"
        return batch

    def commit(self, batch: Prepared) -> Receipt:
        if batch.state != "staged":
            raise ValueError(f"a {batch.state} batch cannot be published")
        return self.engine.log.publish(batch.staged)

    def mark_persisted(self, batch: Prepared, receipt: Receipt) -> Receipt:
        batch.state, batch.rows, batch.staged = "persisted", {}, None
        if batch in self.failed:
            self.failed.remove(batch)
        return receipt

    def mark_failed(self, batch: Prepared) -> None:
        """The batch's files go; its rows wait, in the order in which batches were prepared."""
        if batch.state == "persisted":
            raise ValueError("the batch is persisted")
        if batch.staged:
            self.engine.log.discard(batch.staged)
        batch.state, batch.staged = "failed", None
        if batch not in self.failed:
            self.failed.append(batch)

    def flush(self) -> int | None:
        receipt = self.flush_with_receipt()
        return receipt.seq if receipt else None

    def flush_with_receipt(self) -> Receipt | None:
        waiting, last = [*self.failed, *filter(None, [self.prepare()])], None
        for k, batch in enumerate(waiting):
            try:
                last = self.mark_persisted(batch, self.commit(self.stage(batch)))
            except BaseException:
                for rest in waiting[k:]:
                    self.mark_failed(rest)
                raise
        return last


def scan_counters(plan) -> list[dict]:
    """Of each file scan of an executed plan: its file, and the counters that Spark kept of it."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return scan_counters(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return scan_counters(plan.plan())
    if plan.getClass().getSimpleName() == "FileSourceScanExec":
        metrics = plan.metrics()
        of = lambda k: metrics.apply(k).value() if metrics.contains(k) else None
        return [{"files": of("numFiles"), "bytes": of("filesSize"), "rows": of("numOutputRows")}]
    out, children = [], plan.children()
    for i in range(children.size()):
        out += scan_counters(children.apply(i))
    return out


def watch(log: CommitLog) -> Iterator[dict]:
    """Manifests of the retained batches, oldest first."""
    for seq in log.sequences():
        yield log.manifest(seq)
