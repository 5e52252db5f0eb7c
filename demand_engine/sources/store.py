"""The relational store as parquet tables: items, daily sales, forecast history.

Pure DataFrame functions do the work (key assignment, upsert by key, append
with run constants, integrity checks, cascade delete); :class:`ParquetStore`
decides where the result is written and checks the constraints first.

A table is a set of data folders and a sequence of manifests. A manifest lists
the folders of one version, each under the part it holds (a month of sales, a
day of forecast runs), and the highest id handed out. A write adds folders and
then publishes a manifest; a reader takes the newest manifest that finished
(``_SUCCESS`` present), so it sees a write whole or not at all, and a failed
write leaves the last version as it was.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MONEY, TABLES, conform
from ..session import write_once


# ---------------------------------------------------------------------------
# key assignment
# ---------------------------------------------------------------------------

def with_sequential_id(df: DataFrame, order_cols: list, start: Column | int = 1,
                       id_col: str = "id") -> DataFrame:
    """Dense ids ``start, start+1, ...`` in ``order_cols`` order (a unique key).

    One plan for every size: rows are range-partitioned by the order columns,
    numbered inside each partition, and shifted by the row count of all
    earlier partitions; the per-partition counts are one row per partition
    (bounded by the partition count), the only thing broadcast. The numbered
    frame is written once so that both uses see the same partitioning.
    """
    start_col = start if isinstance(start, Column) else F.lit(start)
    ranged = (df.repartitionByRange(*order_cols)
              .withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy("__pid").orderBy(*order_cols)
    numbered = write_once(ranged.withColumn("__local", F.row_number().over(local)))
    counts = numbered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        "__pid",
        F.coalesce(F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    return (numbered.join(F.broadcast(offsets), "__pid")
            .withColumn(id_col, (F.col("__off") + F.col("__local") - 1 + start_col).cast("long"))
            .drop("__pid", "__local", "__off"))


# ---------------------------------------------------------------------------
# K-01 items, K-02 sales, K-03 forecasts
# ---------------------------------------------------------------------------

def upsert_items(existing: DataFrame | None, incoming: DataFrame,
                 now: Column | None = None) -> DataFrame:
    """Insert new codes, overwrite name/ATC of known codes, keep known ids.

    New codes get ids after the current maximum, in code order. With ``now``
    the rows carry ``created_at``: the old value for known codes, ``now`` for new.
    """
    stamp = [] if now is None else ["created_at"]
    out = ["id", "drug_code", "drug_name", "atc_code", *stamp]
    inc = incoming.select("drug_code", "drug_name", "atc_code").dropDuplicates(["drug_code"])
    fresh = (lambda df: df) if now is None else (lambda df: df.withColumn("created_at", now))
    if existing is None:
        return fresh(with_sequential_id(inc, ["drug_code"], 1)).select(*out)
    old = existing.select(*out)
    known = (old.join(inc.select("drug_code", F.col("drug_name").alias("__n"),
                                 F.col("atc_code").alias("__a")), "drug_code", "left")
             .select("id", "drug_code",
                     F.coalesce("__n", "drug_name").alias("drug_name"),
                     F.when(F.col("__n").isNotNull(), F.col("__a"))
                      .otherwise(F.col("atc_code")).alias("atc_code"), *stamp))
    new = inc.join(old.select("drug_code"), "drug_code", "left_anti")
    # the current maximum id is one scalar; new ids continue after it
    max_id = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return known.unionByName(fresh(with_sequential_id(new, ["drug_code"], int(max_id) + 1))
                             .select(*out))


def ntz(ts: _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal from wall-clock text: independent of the session
    and process time zones (a naive datetime literal would pass through both)."""
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def item_ids(items: DataFrame) -> DataFrame:
    """The ``(drug_id, drug_code)`` map used by every fact write."""
    return items.select(F.col("id").alias("drug_id"), "drug_code")


def attach_item_ids(facts: DataFrame, items: DataFrame, strict: bool = True) -> DataFrame:
    """Left join facts to the item map; unknown codes raise (with the codes).

    The item dimension is joined without a hint: it is broadcast while under
    the session's broadcast threshold and shuffled when it is not.
    """
    out = facts.join(item_ids(items), "drug_code", "left")
    if strict:
        unknown = (facts.select("drug_code").distinct()
                   .join(item_ids(items), "drug_code", "left_anti")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("drug_code").alias("first"),
                        F.max("drug_code").alias("last")).first())
        if unknown.n:
            raise ValueError(f"{unknown.n} unknown item codes, from {unknown.first!r} "
                             f"to {unknown.last!r}")
    return out


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; others are kept.

    Union with a priority column, then keep the highest priority per key (a
    window clustered by the key; ties inside one side keep the larger value so
    the result does not depend on task order).
    """
    cols = old.columns
    both = (old.select(*cols, F.lit(0).alias("__prio"))
            .unionByName(new.select(*cols, F.lit(1).alias("__prio"))))
    order = [F.col("__prio").desc()] + [F.col(c).desc() for c in cols if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (both.withColumn("__rn", F.row_number().over(w))
            .filter("__rn = 1").drop("__rn", "__prio"))


def sales_records(sales: DataFrame, items: DataFrame) -> DataFrame:
    """``(drug_id, date, quantity_sold)`` rows for the sales fact table."""
    return (attach_item_ids(sales, items)
            .select("drug_id", "date", F.col("quantity_sold").cast("int").alias("quantity_sold")))


def forecast_records(forecasts: DataFrame, items: DataFrame, model_name: str | Column,
                     run_timestamp: _dt.datetime | Column) -> DataFrame:
    """Forecast rows as stored: ids, forecast_date, run constants, NUMERIC(10,2).

    ``run_timestamp`` is one literal per run (UTC), never ``current_timestamp()``
    which a lazy plan would evaluate again at every action.
    """
    model = model_name if isinstance(model_name, Column) else F.lit(model_name)
    ts = run_timestamp if isinstance(run_timestamp, Column) else ntz(run_timestamp)
    return (attach_item_ids(forecasts, items)
            .select("drug_id", F.col("date").alias("forecast_date"),
                    ts.cast("timestamp_ntz").alias("run_timestamp"),
                    F.col("predicted_demand").cast(MONEY).alias("predicted_demand"),
                    F.col("lower_ci").cast(MONEY).alias("lower_ci"),
                    F.col("upper_ci").cast(MONEY).alias("upper_ci"),
                    model.alias("model_name")))


# ---------------------------------------------------------------------------
# K-04 constraints, K-05 cascade delete, K-07 latest view
# ---------------------------------------------------------------------------

def interval_ok() -> Column:
    """lower <= point <= upper where both bounds exist (NULL bounds are fine)."""
    p, lo, hi = F.col("predicted_demand"), F.col("lower_ci"), F.col("upper_ci")
    return F.coalesce((lo <= p) & (p <= hi), F.lit(True))


def assert_constraints(dq: DataFrame) -> None:
    """Fail a write when a hard rule is violated (informational rules excluded)."""
    bad = dq.filter((F.col("violations") > 0) & ~F.col("rule").endswith("(info)")).collect()
    if bad:
        raise ValueError("constraint violations: " + ", ".join(
            f"{r.rule}={r.violations}" for r in bad))


def write_json(df: DataFrame, path: str) -> None:
    """JSON records (one object per line), the format the forecast API returns."""
    df.write.mode("overwrite").json(path)


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Count violations of several row rules in one aggregation pass."""
    counts = df.agg(*[F.count_if(cond).alias(f"__r{i}") for i, cond in enumerate(rules.values())])
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"__r{i}").cast("long").alias("violations"))
             for i, name in enumerate(rules)]
    return counts.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


def _count_rule(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(
        F.lit(name).alias("rule"), "violations")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_rules(items: DataFrame) -> DataFrame:
    return _union([
        _rules(items, {"drugs.drug_code not null": F.col("drug_code").isNull(),
                       "drugs.drug_name not null": F.col("drug_name").isNull()}),
        _count_rule("drugs.drug_code unique",
                    items.groupBy("drug_code").count().filter("count > 1"))])


def sales_rules(sales: DataFrame, items: DataFrame) -> DataFrame:
    q, ids = F.col("quantity_sold"), items.select(F.col("id").alias("drug_id"))
    return _union([
        _count_rule("sales_daily (drug_id, date) unique",
                    sales.groupBy("drug_id", "date").count().filter("count > 1")),
        _rules(sales, {"sales_daily.quantity_sold >= 0": q < 0,
                       "sales_daily not null": q.isNull() | F.col("date").isNull()
                       | F.col("drug_id").isNull()}),
        _count_rule("sales_daily.drug_id references drugs",
                    sales.join(ids, "drug_id", "left_anti"))])


def forecast_rules(forecasts: DataFrame, items: DataFrame) -> DataFrame:
    ids = items.select(F.col("id").alias("drug_id"))
    required = ("predicted_demand", "model_name", "run_timestamp", "forecast_date", "drug_id")
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return _union([
        _count_rule("forecasts_daily.drug_id references drugs",
                    forecasts.join(ids, "drug_id", "left_anti")),
        # the interval rule is informational (the models do not prevent crossing)
        _rules(forecasts, {"forecasts_daily not null": missing,
                           "forecasts_daily lower <= predicted <= upper (info)": ~interval_ok()})])


def dq_constraints(items: DataFrame, sales: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Violation count per rule (one row per rule); see :func:`assert_constraints`.

    Row rules of a table share one aggregation pass; uniqueness is a
    group-by on the key, references are anti-joins against the item ids.
    """
    return _union([item_rules(items), sales_rules(sales, items), forecast_rules(forecasts, items)])


def cascade_delete(items: DataFrame, facts: DataFrame, deleted_codes: DataFrame) -> tuple:
    """Remove items and every fact row that references them (ON DELETE CASCADE)."""
    gone = items.join(deleted_codes.select("drug_code").distinct(), "drug_code", "left_semi")
    kept_items = items.join(gone.select("drug_code"), "drug_code", "left_anti")
    kept_facts = facts.join(gone.select(F.col("id").alias("drug_id")), "drug_id", "left_anti")
    return kept_items, kept_facts


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """Newest run per (item, forecast date); ties on the timestamp -> lowest id."""
    w = Window.partitionBy("drug_id", "forecast_date").orderBy(
        F.col("run_timestamp").desc_nulls_last(), F.col("id").asc())
    return forecasts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


# ---------------------------------------------------------------------------
# persistence
# ---------------------------------------------------------------------------

def _now() -> Column:
    return ntz(_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))


class ParquetStore:
    """Versioned parquet tables under one root folder (shared storage on a cluster)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests ---------------------------------------------------------------

    def versions(self, table: str) -> list[int]:
        base = self._Path(f"{self.root}/{table}/manifest")
        if not self._fs.exists(base):
            return []
        names = [(st.getPath(), st.getPath().getName()) for st in self._fs.listStatus(base)]
        return sorted(int(name[2:]) for path, name in names
                      if name.startswith("v=") and self._fs.exists(self._Path(path, "_SUCCESS")))

    def manifest(self, table: str) -> tuple[list[tuple[str, str]], int]:
        """(folders as (part, path), highest id) of the newest version: one entry
        per folder, so months or run days, never rows."""
        found = self.versions(table)
        if not found:
            return [], 0
        rows = self.spark.read.json(f"{self.root}/{table}/manifest/v={found[-1]}",
                                    schema="part string, path string, max_id long").collect()
        return [(r.part, r.path) for r in rows if r.path], max(r.max_id for r in rows)

    def _publish(self, table: str, entries: list[tuple[str, str]], max_id: int) -> None:
        found = self.versions(table)
        version = found[-1] + 1 if found else 1
        rows = [(part, path, max_id) for part, path in entries] or [("", None, max_id)]
        (self.spark.createDataFrame(rows, "part string, path string, max_id long").coalesce(1)
         .write.mode("errorifexists").json(f"{self.root}/{table}/manifest/v={version}"))

    def _write(self, table: str, df: DataFrame, part: Column | None) -> list[tuple[str, str]]:
        """Write new data folders, one per part; their manifest entries.

        Rows are rebalanced by part first: a part's rows meet in one task and make one
        file, and adaptive execution splits a part larger than the advisory
        partition size over several tasks (one file each).
        """
        base = f"{self.root}/{table}/data/{uuid.uuid4().hex}"
        out = conform(df, table)
        if part is None:
            out.write.parquet(base)
            return [("", base)]
        (out.withColumn("part", part).hint("rebalance", "part")
         .write.partitionBy("part").parquet(base))
        names = [st.getPath().getName() for st in self._fs.listStatus(self._Path(base))]
        return [(n[5:], f"{base}/{n}") for n in sorted(names) if n.startswith("part=")]

    def _frame(self, table: str, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(TABLES[table])
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[table])

    def read(self, table: str, parts: set[str] | None = None) -> DataFrame | None:
        """The newest version (or only some parts of it); None if never written."""
        if not self.versions(table):
            return None
        entries, _ = self.manifest(table)
        return self._frame(table, [p for part, p in entries if parts is None or part in parts])

    # -- writes --------------------------------------------------------------------

    def upsert_items(self, items: DataFrame) -> DataFrame:
        merged = write_once(upsert_items(self.read("drugs"), items, _now()))
        assert_constraints(item_rules(merged))
        max_id = merged.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        self._publish("drugs", self._write("drugs", merged, None), max_id)
        return self.read("drugs")

    def upsert_sales(self, sales: DataFrame) -> DataFrame:
        """Upsert a batch of daily sales on (drug_id, date).

        The batch itself is merged first (one row per key; of equal keys the
        larger quantity stays). Only the months it touches are read, merged and
        written again; known rows keep id and created_at, new rows get the next
        ids. Other months keep their folders.
        """
        items = self.read("drugs")
        batch = sales_records(sales, items)
        batch = write_once(upsert_by_key(batch.limit(0), batch, ["drug_id", "date"]))
        assert_constraints(sales_rules(batch, items))
        month = F.date_format("date", "yyyy-MM")
        entries, max_id = self.manifest("sales_daily")
        touched = {r[0] for r in batch.select(month).distinct().collect()}  # calendar months
        old = self._frame("sales_daily", [p for part, p in entries if part in touched])
        key = ["drug_id", "date"]
        known = old.join(batch.withColumnRenamed("quantity_sold", "__new"), key, "left").withColumn(
            "quantity_sold", F.coalesce("__new", "quantity_sold")).drop("__new")
        new = with_sequential_id(batch.join(old.select(*key), key, "left_anti"), key, max_id + 1)
        merged = known.unionByName(new.withColumn("created_at", _now()))
        max_id += new.count()
        written = self._write("sales_daily", merged, month)
        self._publish("sales_daily", [e for e in entries if e[0] not in touched] + written, max_id)
        return self.read("sales_daily")

    def append_forecasts(self, forecasts: DataFrame, model_name: str,
                         run_timestamp: _dt.datetime | None = None) -> DataFrame:
        """Append one run: new folders and the next ids; history is not read."""
        ts = run_timestamp or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        items = self.read("drugs")
        rec = forecast_records(forecasts, items, model_name, ts)
        entries, max_id = self.manifest("forecasts_daily")
        rec = with_sequential_id(rec, ["model_name", "drug_id", "forecast_date"], max_id + 1)
        assert_constraints(forecast_rules(rec, items))
        written = self._write("forecasts_daily", rec.withColumn("created_at", ntz(ts)),
                              F.to_date("run_timestamp"))
        self._publish("forecasts_daily", entries + written, max_id + rec.count())
        return self.read("forecasts_daily")

    def delete_items(self, codes: DataFrame) -> None:
        """Delete items with all of their sales and forecasts (children first,
        so that references hold at every moment). Only the months and run days
        that hold rows of the items are written again."""
        items = self.read("drugs")
        if items is None:
            return
        gone = items.join(codes.select("drug_code").distinct(), "drug_code", "left_semi").select(
            F.col("id").alias("drug_id"))
        for table, part in (("forecasts_daily", F.to_date("run_timestamp").cast("string")),
                            ("sales_daily", F.date_format("date", "yyyy-MM"))):
            rows = self.read(table)
            if rows is None:
                continue
            entries, max_id = self.manifest(table)
            touched = {r[0] for r in rows.join(gone, "drug_id", "left_semi").select(part).distinct()
                       .collect()}
            kept = self._frame(table, [p for x, p in entries if x in touched]).join(
                gone, "drug_id", "left_anti")
            written = self._write(table, kept, part) if touched else []
            self._publish(table, [e for e in entries if e[0] not in touched] + written, max_id)
        _, max_id = self.manifest("drugs")
        kept = items.join(gone.withColumnRenamed("drug_id", "id"), "id", "left_anti")
        self._publish("drugs", self._write("drugs", kept, None), max_id)
