"""Intake of report texts into a store: parsed, checked against url and store, gated in order, published by season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weekloom.functions.calendar import iso_week, iso_year, monday, monday_of, season_of, week_idx
from weekloom.operators.history import apply_revisions
from weekloom.params import Params
from weekloom.sinks.store import ProductStore
from weekloom.sources.reports import checked_reports, parse_reports, url_week

HISTORY = "series_id string, week_idx long, season int, value double, sub_value double, groups array<double>, sub_groups array<double>, change_pct double, groups_change_pct array<double>, source string, url string"
REJECTS = "series_id string, url string, week_idx long, reason string"
TAKEN = "intake long"
_REPORT = ["value", "sub_value", "groups", "sub_groups", "change_pct", "groups_change_pct"]


def gate_against_store(new: DataFrame, stored: DataFrame, p: Params) -> DataFrame:
    """new (series_id, week_idx, url, value, ...) with status: accepted, known or implausible.

    Reports are taken oldest week first, those of one week by url. One whose week is official in stored (series_id,
    week_idx, value, source), or was taken just before, is known. It is implausible if its ratio to the week before lies
    outside the gate: that is the report just taken or else what is stored there, estimates too. A week whose report was
    rejected keeps its estimate, which the next week is compared with, or is a gap, after which all is plausible. Only
    stored weeks of reports and the weeks before are looked at; a fold over each series' reports of one intake.
    """
    near = new.select("series_id", F.explode(F.array("week_idx", F.col("week_idx") - 1)).alias("week_idx")).distinct()
    old = stored.where("value is not null").join(near, ["series_id", "week_idx"], "left_semi")
    row = lambda df, kind, official: df.select("series_id", F.struct("week_idx", F.lit(kind).alias("kind"), (F.col("url") if kind else F.lit("")).alias("url"), F.col("value").cast("double").alias("value"), official.alias("official")).alias("s"))
    both = row(old, 0, F.col("source") == "official").unionByName(row(new, 1, F.lit(True)))
    steps = both.groupBy("series_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    at = F.struct(F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("official"))
    start = F.struct(at.alias("before"), at.alias("now"), F.array().cast("array<struct<week_idx:bigint,url:string,status:string>>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        moved = ~F.coalesce(a["now"]["idx"] == s["week_idx"], F.lit(False))
        before = F.when(moved, a["now"]).otherwise(a["before"])
        empty = F.struct(s["week_idx"].alias("idx"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("official"))
        now = F.when(moved, empty).otherwise(a["now"])
        own = F.struct(s["week_idx"].alias("idx"), s["value"].alias("value"), s["official"].alias("official"))
        ratio = F.when(before["idx"] == s["week_idx"] - 1, s["value"] / before["value"])
        status = F.when(now["official"], "known").when(F.coalesce(ratio.between(*p.gate), F.lit(True)), "accepted").otherwise("implausible")
        taken = F.when(s["kind"] == 0, own).when(status == "accepted", own).otherwise(now)
        said = F.when(s["kind"] == 1, F.array(F.struct(s["week_idx"].alias("week_idx"), s["url"].alias("url"), status.alias("status")))).otherwise(F.array().cast("array<struct<week_idx:bigint,url:string,status:string>>"))
        return F.struct(before.alias("before"), taken.alias("now"), F.concat(a["out"], said).alias("out"))

    told = steps.select("series_id", F.inline(F.aggregate("steps", start, step, lambda a: a["out"])))
    return new.join(told, ["series_id", "week_idx", "url"])


def judged(texts: DataFrame, pending: DataFrame, stored: DataFrame, p: Params) -> DataFrame:
    """Each text (series_id, url, text) and each pending report with what it says, its week, and status: accepted, known, implausible, unreadable or other week.

    A text whose url names a week that is official isn't parsed at all; one whose header is more than a week from its url is of another
    week; else the header's week counts. Repeated urls are taken once.
    """
    official = stored.where("source = 'official' and value is not null").select("series_id", F.col("week_idx").alias("told_idx")).distinct()
    told = texts.dropDuplicates(["series_id", "url"]).withColumn("told", url_week(F.col("url"))).withColumn("told_idx", week_idx(monday(F.col("told.year"), F.col("told.week"))))
    have = told.join(official.withColumn("have", F.lit(True)), ["series_id", "told_idx"], "left")
    unread = checked_reports(have.where("have is null").select("series_id", "url", "text", "told_idx"))
    # what checked_reports() takes away is unreadable, or of another week
    whole = parse_reports(unread.withColumnRenamed("report", "checked"))
    at = F.col("report")
    rows = whole.select(
        "series_id", "url", F.coalesce(week_idx(monday(at["year"], at["week"])), F.col("told_idx")).alias("week_idx"), *[at[c].alias(c) for c in _REPORT],
        F.when(at.isNull(), "unreadable").when(F.col("checked").isNull(), "other week").alias("status"),
    )
    known = have.where("have").select("series_id", "url", F.col("told_idx").alias("week_idx"), F.lit("known").alias("status"))
    fine = rows.where("status is null").drop("status").unionByName(pending.select("series_id", "url", "week_idx", *_REPORT)).dropDuplicates(["series_id", "url"])
    return gate_against_store(fine, stored, p).unionByName(rows.where("status is not null")).unionByName(known, allowMissingColumns=True)


class ReportIntake:
    """A store of reports under path. It keeps what was reported; revised() works out revisions when it is read, so that these don't depend on batches."""

    PENDING = HISTORY
    BY = {"history": "season", "pending": "season", "rejects": "reason", "taken": "intake"}

    def __init__(self, spark: SparkSession, path: str, p: Params):
        self.spark, self.path, self.p = spark, path, p
        self.store = ProductStore(spark, f"{path}/store")

    def table(self, name: str) -> DataFrame:
        if name in self.store.manifest():
            return self.store.read(name)
        return self.spark.createDataFrame([], {"history": HISTORY, "pending": HISTORY, "rejects": REJECTS, "taken": TAKEN}[name])

    def _with_season(self, rows: DataFrame) -> DataFrame:
        day = monday_of(F.col("week_idx"))
        return rows.withColumn("season", season_of(iso_year(day), iso_week(day)))

    def _kept(self, df: DataFrame, name: str, n: int) -> DataFrame:
        """Written before it is published, as it is read several times; a run that is done again overwrites its own."""
        path = f"{self.path}/work/{n}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def seed(self, estimates: DataFrame) -> None:
        """Estimates (series_id, week_idx, value, source) for weeks without reports."""
        self.store.publish({"history": self._like_history(estimates)}, self.BY)

    def _like_history(self, rows: DataFrame) -> DataFrame:
        empty = self.spark.createDataFrame([], HISTORY)
        return empty.drop("season").unionByName(rows, allowMissingColumns=True).transform(self._with_season).select(*empty.columns)

    def take(self, texts: DataFrame, n: int) -> None:
        """One intake: all given texts and the reports that were implausible before are judged against the store, and published. One with the number of an earlier one changes nothing."""
        taken = self.table("taken")
        if not taken.where(F.col("intake") == n).isEmpty():
            return
        history, pending, rejects = (self.table(x) for x in ("history", "pending", "rejects"))
        rows = self._kept(judged(texts, pending, history, self.p), "judged", n)
        accepted = self._like_history(rows.where("status = 'accepted'").drop("status").withColumn("source", F.lit("official")))
        whole = self._kept(history.join(accepted.select("series_id", "week_idx"), ["series_id", "week_idx"], "left_anti").unionByName(accepted), "history", n)
        waiting = self._kept(self._like_history(rows.where("status = 'implausible'").drop("status")), "pending", n)
        refused = rows.where("status in ('unreadable', 'other week')").select("series_id", "url", "week_idx", F.col("status").alias("reason"))
        refused = self._kept(rejects.unionByName(refused).dropDuplicates(["series_id", "url"]), "rejects", n)
        self.store.publish({"history": whole, "pending": waiting, "rejects": refused, "taken": taken.unionByName(self.spark.createDataFrame([(n,)], TAKEN))}, self.BY)

    def run(self, source: DataFrame) -> StreamingQuery:
        """Takes a stream of texts (series_id, url, text), what is available; a batch is one intake."""
        return source.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def revised(self) -> DataFrame:
        """The history, official weeks revised by the report of the week after."""
        r = apply_revisions(self.table("history"), self.p)
        return r.select("series_id", "week_idx", F.col("value_revised").alias("value"), "sub_value", F.col("groups_revised").alias("groups"), "source", "url", "note")
