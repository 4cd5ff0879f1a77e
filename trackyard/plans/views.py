"""Views of the given tables in the shape of collision data, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackyard.operators import build, tensors
from trackyard.sources import tables

JET_FIELDS = ("pt", "eta", "phi", "btag", "btag_L", "btag_M", "btag_T", "prov")
SAMPLES = ("TTH_Hto2B", "QCD", "TTto4Q_ttLF", "TTto4Q_ttC", "TTBBto4Q_ttB")

#: Common table expressions of the views; a query starts with the ones it needs.
JETS = """jets AS (SELECT l_orderkey AS event_id, l_extendedprice/100.0 AS pt, (l_discount-0.05)*50.0 AS eta, (l_tax-0.04)*75.0 AS phi, l_quantity/50.0 AS btag,
  CASE WHEN l_quantity>=20 THEN 1 ELSE 0 END AS btag_L, CASE WHEN l_quantity>=35 THEN 1 ELSE 0 END AS btag_M, CASE WHEN l_quantity>=45 THEN 1 ELSE 0 END AS btag_T,
  CASE l_partkey%10 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 5 WHEN 6 THEN 6 WHEN 7 THEN 6 WHEN 8 THEN 4 ELSE -1 END AS prov,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS pos FROM lineitem)"""
EV = """ev AS (SELECT o_orderkey AS event_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'TTH_Hto2B' WHEN '2-HIGH' THEN 'QCD' WHEN '3-MEDIUM' THEN 'TTto4Q_ttLF' WHEN '4-NOT SPECIFIED' THEN 'TTto4Q_ttC' ELSE 'TTBBto4Q_ttB' END AS sample,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS signal,
  CASE WHEN year(o_orderdate)<1998 THEN '2022_preEE' WHEN year(o_orderdate)<2000 THEN '2023_preBPix' ELSE '2024' END AS year,
  CASE WHEN o_orderkey%20=0 THEN -1.0 ELSE 1.0 END * o_totalprice/100000.0 AS weight, CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END AS dctr FROM orders)"""
#: Per event the number of jets and of b-jets, the targets without a cap.
PER = """per AS (SELECT ev.*, CAST(coalesce(c.njet, 0) AS INT) AS njet, CAST(coalesce(c.nb, 0) AS INT) AS nb, coalesce(c.ht, 0) AS ht FROM ev LEFT JOIN
  (SELECT event_id, count(*) AS njet, sum(btag_M) AS nb, sum(pt) AS ht FROM jets GROUP BY event_id) c ON ev.event_id = c.event_id)"""
TGT = """nth AS (SELECT event_id, prov, pos, row_number() OVER (PARTITION BY event_id, prov ORDER BY pos) AS r FROM jets),
tgt AS (SELECT ev.event_id,
  coalesce(max(pos) FILTER (prov=1 AND r=1), -1) AS b1, coalesce(max(pos) FILTER (prov=1 AND r=2), -1) AS b2,
  coalesce(max(pos) FILTER (prov=5 AND r=1), -1) AS t1q1, coalesce(max(pos) FILTER (prov=5 AND r=2), -1) AS t1q2, coalesce(max(pos) FILTER (prov=2 AND r=1), -1) AS t1b,
  coalesce(max(pos) FILTER (prov=6 AND r=1), -1) AS t2q1, coalesce(max(pos) FILTER (prov=6 AND r=2), -1) AS t2q2, coalesce(max(pos) FILTER (prov=3 AND r=1), -1) AS t2b
  FROM ev LEFT JOIN nth ON ev.event_id = nth.event_id GROUP BY ev.event_id)"""
SC = """logit AS (SELECT ev.*, i, (((event_id%97)*((i+3)*31) + (event_id%89)*((i+5)*(i+2)*17)) % 1000 + CASE WHEN signal = i THEN 500 ELSE 0 END) AS z FROM ev, (SELECT unnest(range(10)) AS i)),
sc AS (SELECT event_id, sample, signal, weight, i, exp(CAST(z AS DOUBLE)/250) / sum(exp(CAST(z AS DOUBLE)/250)) OVER (PARTITION BY event_id) AS s FROM logit),
pred AS (SELECT event_id, CAST(arg_min(i, 10*(-z) + i) AS INT) AS predicted FROM logit GROUP BY event_id),
wide AS (SELECT sc.event_id, sc.sample, signal, weight, predicted, max(s) FILTER (i=1) AS tthbb, max(s) FILTER (i=2) AS qcd, max(s) FILTER (i=3) AS ttlf, max(s) FILTER (i=4) AS ttcc, max(s) FILTER (i=5) AS ttbb,
  max(s) FILTER (i=6) AS singletop, max(s) FILTER (i=7) AS ttv, max(s) FILTER (i=8) AS vjets, max(s) FILTER (i=9) AS tthnonbb FROM sc JOIN pred ON sc.event_id = pred.event_id GROUP BY sc.event_id, sc.sample, signal, weight, predicted)"""
MET = """met AS (SELECT event_id, CAST((event_id - event_id%300)/300 AS BIGINT) AS version, event_id%300 AS step, event_type AS tag, value, CAST(epoch_us(ts) AS DOUBLE)/1000000 AS wall_time FROM events),
marks AS (SELECT version, step, CAST((step-20)/50 AS BIGINT) AS epoch FROM met WHERE step%50 = 20),
asofm AS (SELECT m.*, coalesce((SELECT max(epoch) FROM marks k WHERE k.version = m.version AND k.step <= m.step), (SELECT min(epoch) FROM marks k WHERE k.version = m.version)) AS epoch FROM met m)"""


def sql(body: str, *parts: str) -> str:
    """A query over the named views."""
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def jets(spark: SparkSession, d: str) -> DataFrame:
    """One row for each jet, in falling order of pt within its event."""
    q, p = F.col("l_quantity"), F.col("l_partkey") % 10
    prov = F.when(p <= 1, 1).when(p == 2, 2).when(p == 3, 3).when(p.isin(4, 5), 5).when(p.isin(6, 7), 6).when(p == 8, 4).otherwise(-1)
    # The key has its name before the window, so that what is grouped or joined by event later needs no second shuffle.
    order = Window.partitionBy("event_id").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "event_id")
    return rows.select(
        "event_id", (F.col("l_extendedprice") / 100.0).alias("pt"), ((F.col("l_discount") - 0.05) * 50.0).alias("eta"), ((F.col("l_tax") - 0.04) * 75.0).alias("phi"), (q / 50.0).alias("btag"),
        (q >= 20).cast("int").alias("btag_L"), (q >= 35).cast("int").alias("btag_M"), (q >= 45).cast("int").alias("btag_T"), prov.alias("prov"), (F.row_number().over(order) - 1).alias("pos"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    """One row for each event, without its jets."""
    pick = lambda values: F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), values, strict=False)], F.lit(values[4]))
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), pick(SAMPLES).alias("sample"), pick((1, 2, 3, 4, 5)).alias("signal"),
        F.when(year < 1998, "2022_preEE").when(year < 2000, "2023_preBPix").otherwise("2024").alias("year"),
        (F.when(F.col("o_orderkey") % 20 == 0, -1.0).otherwise(1.0) * F.col("o_totalprice") / 100000.0).alias("weight"), (F.col("o_orderstatus") == "F").cast("int").alias("dctr"),
    )


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Events with their jets as an array of records."""
    return build.nest_objects(events(spark, d), jets(spark, d), "jets", JET_FIELDS)


def jet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events with njet: jets are counted by event, not nested."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count("*").cast("int").alias("njet"))
    return events(spark, d).join(n, "event_id", "left").fillna(0, ["njet"])


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Nested events with njet and nb."""
    n = nested(spark, d)
    return n.withColumns({"njet": F.size("jets.pt"), "nb": F.size(F.filter("jets.btag_M", lambda x: x == 1))})


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Events with an array of ten softmax scores, written once: all figures read them from there."""
    e = F.col("event_id")
    z = [(((e % 97) * ((i + 3) * 31) + (e % 89) * ((i + 5) * (i + 2) * 17)) % 1000 + F.when(F.col("signal") == i, 500).otherwise(0)).cast("double") / 250 for i in range(10)]
    total = sum((F.exp(x) for x in z), F.lit(0.0))
    return tables.cut(events(spark, d).withColumn("scores", F.array(*[F.exp(x) / total for x in z])))


def wide(spark: SparkSession, d: str) -> DataFrame:
    """Scored events with named scores and the predicted class."""
    from trackyard.functions.columns import argmax

    return tensors.node_scores(scored(spark, d)).withColumn("predicted", argmax(F.col("scores")))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric series in long form."""
    e = F.col("event_id")
    return table(spark, d, "events").select(e, ((e - e % 300) / 300).cast("long").alias("version"), (e % 300).alias("step"), F.col("event_type").alias("tag"), "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("wall_time"))


def epoch_marks(spark: SparkSession, d: str) -> DataFrame:
    return metrics(spark, d).where("step % 50 = 20").select("version", "step", ((F.col("step") - 20) / 50).cast("long").alias("epoch"))
