"""Extension surface: registries, table functions, data sources, batched maps, cached shards."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text
from loomspark.functions import registry as reg
from loomspark.functions.grading import answer_equal, overlong_penalty
from loomspark.operators import rollouts as ro
from loomspark.operators import sampling
from loomspark.plans.q_data import _scratch
from loomspark.plans.q_rollouts import _S, rounded, seqs
from loomspark.plans.q_text import RESPONSES, responses
from loomspark.plans.registry import QUERIES, query
from loomspark.session import load
from loomspark.sources import files, generated, windows

for _name in ("grpo", "rloo", "opo", "gpg"):
    reg.ESTIMATORS.register(_name)(getattr(ro, _name))
for _loss, _query in {"vanilla": "num23_ppo_loss", "sequence_ratio": "num24_gspo_loss", "plain": "num25_gpg_loss", "clip_cov": "num26_clip_cov_loss", "kl_cov": "num27_kl_cov_loss", "geo_mean": "num28_geo_mean_loss"}.items():
    reg.LOSSES.register(_loss)(QUERIES[_query])
reg.custom_reward(lambda a, b: len(set(a.split()) & set(b.split())) / max(1, len(set(b.split()))), "word_overlap")


#: Lines of a file, bytes of a line with its end, and the windows that are read of each file.
_LINES, _LINE, _OFFSETS, _LENGTH = 4096, 64, (0, 60_000, 131_050, 200_000), 20_000
_INSIDE = " OR ".join(f"(ord % {_LINES} * {_LINE} - 1 >= {o} AND ord % {_LINES} * {_LINE} + {_LINE - 1} <= {o + _LENGTH})" for o in _OFFSETS)


@query("src1_line_windows", f"SELECT row_id FROM source_rows WHERE row_id % 5 <> 0 AND ({_INSIDE})")
def src1(spark: SparkSession, d: str) -> DataFrame:
    """Byte windows of JSON lines: cut lines at both ends are dropped, lines that cannot be decoded are skipped."""
    path = _scratch(spark, "windows")
    row = F.when(F.col("row_id") % 5 != 0, F.to_json(F.struct("row_id"))).otherwise('{"row_id": ')
    lines = load(spark, d, "source_rows").select("ord", F.floor(F.col("ord") / _LINES).alias("file"), F.rpad(row, _LINE - 1, " ").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    spark.dataSource.register(windows.WindowSource)
    read = spark.read.format("byte_windows").option("path", path).option("offsets", ",".join(map(str, _OFFSETS))).option("length", _LENGTH).load()
    return read.select(F.from_json("line", "row_id bigint").alias("x")).select("x.row_id").filter("row_id is not null").distinct()


@query("src15_tree_of_summaries", "SELECT n_regionkey AS region, n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_nationkey")
def src15(spark: SparkSession, d: str) -> DataFrame:
    """JSON files of a tree, one for each nation in the folder of its region, with what the path says."""
    root = _scratch(spark, "tree")
    n = load(spark, d, "nation")
    n.select("n_regionkey", "n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).repartition("n_nationkey").write.partitionBy("n_regionkey", "n_nationkey").text(root)
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").schema("n_nationkey int, n_name string").json(root)
    return read.select(F.regexp_extract("_metadata.file_path", r"/n_regionkey=(\d+)/", 1).cast("int").alias("region"), "n_nationkey", "n_name")


@query("src17_growing_dataset", "SELECT event_id, (event_id % 4)::INTEGER AS batch FROM events")
def src17(spark: SparkSession, d: str) -> DataFrame:
    """A table that grows by what each batch adds, until all events are in it."""
    path = _scratch(spark, "grow")
    e = load(spark, d, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("batch"))
    for k in range(4):
        e.filter(F.col("batch") == k).write.mode("append").parquet(path)
    return spark.read.parquet(path)


_SHARD = 50


@query("snk9_generation_cache", f"WITH i AS (SELECT item_id - 1 AS index FROM benchmark_items), n AS (SELECT count(*) AS n FROM i) SELECT s * {_SHARD} AS start, least((s + 1) * {_SHARD}, n) AS stop, s % 4 = 0 AS cached FROM n, range(100) t(s) WHERE s * {_SHARD} < n")
def snk9(spark: SparkSession, d: str) -> DataFrame:
    """Shards of generations with manifests: one counts if signature, range and rows all agree with what is wanted.

    Of the shards here one in four is whole, one has another signature, one lacks its first row, one is not there; the
    last is shorter than the others.
    """
    rows, manifests = _scratch(spark, "shards"), _scratch(spark, "manifests")
    i = load(spark, d, "benchmark_items").select((F.col("item_id") - 1).alias("index"), F.col("text").alias("output"))
    start = (F.floor(F.col("index") / _SHARD) * _SHARD).cast("bigint")
    wanted = i.groupBy(start.alias("start")).agg(F.count("*").alias("n"))
    wanted = wanted.select("start", (F.col("start") + F.col("n")).alias("stop"), files.signature(F.lit("v1"), F.lit("math"), F.col("start")).alias("signature"))
    kind = F.col("start") / _SHARD % 4
    i.withColumn("start", start).filter((kind != 3) & ~((kind == 2) & (F.col("index") == F.col("start")))).write.partitionBy("start").json(rows)
    wanted.filter(kind != 3).withColumn("signature", F.when(kind == 1, "other").otherwise(F.col("signature"))).write.json(manifests)
    have = spark.read.schema("index bigint, start bigint").json(rows).groupBy("start").agg(F.count("*").alias("rows"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.countDistinct("index").alias("distinct"))
    told = spark.read.schema("start bigint, stop bigint, signature string").json(manifests)
    ok = (F.col("rows") == F.col("stop") - F.col("start")) & (F.col("distinct") == F.col("rows")) & (F.col("lo") == F.col("start")) & (F.col("hi") == F.col("stop") - 1)
    return wanted.join(told.withColumn("same", F.lit(True)), ["start", "stop", "signature"], "left").join(have, "start", "left").select("start", "stop", F.coalesce(F.col("same") & ok, F.lit(False)).alias("cached"))


@query("snk2_atomic_shards", "SELECT count(*) AS rows, count(DISTINCT sample_id) AS ids FROM recovery_pool WHERE split = 'val'")
def snk2(spark: SparkSession, d: str) -> DataFrame:
    """A job's output appears whole or not at all: tasks write aside, and the committer moves their files."""
    path = _scratch(spark, "atomic")
    load(spark, d, "recovery_pool").filter("split = 'val'").write.parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), F.countDistinct("sample_id").alias("ids"))


@query("snk16_batch_save_load", f"WITH {_S} SELECT seq, uid, round(score, 7) + 0.0 AS score, length::BIGINT AS length FROM s")
def snk16(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "batch")
    seqs(spark, d).write.parquet(path)
    return rounded(spark.read.parquet(path))


@query("rew9_repeatness")
def rew9(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("boolean")
    def repeats(s: pd.Series) -> pd.Series:
        return s.map(lambda x: reg.repeatness(x) > 0.2 if isinstance(x, str) else False).astype(bool)

    return responses(spark, d).select("response_id", repeats(F.col("teacher_response")).alias("repeats"))


#: The first question of a response's messages.
_ASKED = "(SELECT response_id, min(domain) AS domain, min(teacher_response) AS said, min(list_filter(messages, lambda m: lower(trim(m.role)) = 'user')[1].content) AS asked FROM teacher_responses WHERE teacher_response IS NOT NULL AND len(messages) > 0 GROUP BY response_id)"
_WORDS = "list_distinct(list_filter(string_split_regex({x}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: w <> ''))"


def asked(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "teacher_responses").filter("teacher_response is not null and size(messages) > 0")
    return t.groupBy("response_id").agg(F.min("domain").alias("domain"), F.min("teacher_response").alias("said"), F.min(text.first_content(F.col("messages"), "user")).alias("asked"))


@query("rew17_batched_rewards", f"SELECT response_id, round(CASE WHEN asked IS NULL THEN 0 ELSE len(list_intersect({_WORDS.format(x='said')}, {_WORDS.format(x='asked')})) / greatest(1, len({_WORDS.format(x='asked')})) END::DOUBLE, 9) AS score FROM {_ASKED}")
def rew17(spark: SparkSession, d: str) -> DataFrame:
    """A scorer in Python run over batches: the share of the question's words that the response uses."""
    return asked(spark, d).select("response_id", F.round(reg.REWARDS.get("word_overlap")(F.col("said"), F.col("asked")), 9).alias("score"))


@query("udf1_custom_reward", f"SELECT response_id, domain, round(CASE domain WHEN 'math' THEN 0 WHEN 'code' THEN (trim(said) = trim(coalesce(asked, '')))::INT ELSE CASE WHEN asked IS NULL THEN 0 ELSE len(list_intersect({_WORDS.format(x='said')}, {_WORDS.format(x='asked')})) / greatest(1, len({_WORDS.format(x='asked')})) END END::DOUBLE, 9) AS score FROM {_ASKED} WHERE domain IN ('math', 'code', 'science')")
def udf1(spark: SparkSession, d: str) -> DataFrame:
    """A reward by the name that each domain is given, one of them a plain Python function."""
    r = asked(spark, d).filter("domain in ('math', 'code', 'science')")
    scored = reg.score_by(r, "domain", F.col("said"), F.col("asked"), {"math": "zero", "code": "exact", "science": "word_overlap"})
    return scored.select("response_id", "domain", F.round("score", 9).alias("score"))


@query("udf3_estimator_registry", lambda o: " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, round(sum(abs(advantage)), 3) AS size FROM ({o[q]})" for n, q in (("grpo", "num11_grpo"), ("rloo", "num16_rloo"), ("opo", "num18_opo"), ("gpg", "num21_gpg"))))
def udf3(spark: SparkSession, d: str) -> DataFrame:
    """Advantages of every estimator of the registry, by name."""
    s = seqs(spark, d)
    out = None
    for name in ("grpo", "rloo", "opo", "gpg"):
        one = rounded(reg.ESTIMATORS.get(name)(s).select("seq", "advantage")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs("advantage")), 3).alias("size")).select(F.lit(name).alias("name"), "n", "size")
        out = one if out is None else out.unionByName(one)
    return out


_LOSSES = {"vanilla": "num23_ppo_loss", "sequence_ratio": "num24_gspo_loss", "plain": "num25_gpg_loss", "clip_cov": "num26_clip_cov_loss", "kl_cov": "num27_kl_cov_loss", "geo_mean": "num28_geo_mean_loss"}


@query("udf4_loss_registry", lambda o: " UNION ALL ".join(f"SELECT '{n}' AS name, round(pg_loss, 5) AS pg_loss FROM ({o[q]})" for n, q in _LOSSES.items()))
def udf4(spark: SparkSession, d: str) -> DataFrame:
    """The policy loss of every entry of the registry; an unknown name fails."""
    out = None
    for name in reg.LOSSES.items:
        one = reg.LOSSES.get(name)(spark, d).select(F.lit(name).alias("name"), F.round("pg_loss", 5).alias("pg_loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("udf5_data_source", "SELECT i AS id, concat('prompt ', i) AS prompt FROM range(500) t(i)")
def udf5(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(generated.GeneratedSource)
    return spark.read.format("generated").option("rows", 500).option("parts", 8).load()


@query("udf8_split_run_concat", "SELECT item_id, length(text)::BIGINT AS n FROM benchmark_items")
def udf8(spark: SparkSession, d: str) -> DataFrame:
    """Batches handed to workers and their results put together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"item_id": f["item_id"], "n": f["text"].str.len()})

    return load(spark, d, "benchmark_items").select("item_id", "text").mapInPandas(run, "item_id bigint, n bigint")


@query("udf10_shingle_table_function", "WITH w AS (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark_items) SELECT item_id, i::INTEGER AS position, array_to_string(w[i + 1:i + 13], ' ') AS shingle FROM w, range(300) t(i) WHERE i + 13 <= len(w)")
def udf10(spark: SparkSession, d: str) -> DataFrame:
    view = f"items_{uuid.uuid4().hex}"
    load(spark, d, "benchmark_items").createOrReplaceTempView(view)
    spark.udtf.register("shingles", reg.Shingles)
    return spark.sql(f"select item_id, s.position, s.shingle from {view}, lateral shingles(text, 13) s")


@query("udf11_grouped_reducer", "SELECT c_mktsegment AS g, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY g")
def udf11(spark: SparkSession, d: str) -> DataFrame:
    """A reducer in Python, on partial aggregates of each group rather than on its rows."""

    @F.pandas_udf("double")
    def spread(hi: pd.Series, lo: pd.Series) -> pd.Series:
        return hi - lo

    g = load(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.max("c_acctbal").alias("hi"), F.min("c_acctbal").alias("lo"))
    return g.select("g", F.round(spread("hi", "lo"), 4).alias("spread"))


@query("str4_curriculum_update", "WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type) SELECT e.event_id, row_number() OVER (ORDER BY s.m, e.event_type, sha256(concat('c:', e.event_id)), e.event_id) - 1 AS place FROM events e JOIN s USING (event_type)")
def str4(spark: SparkSession, d: str) -> DataFrame:
    """A sampler whose state by category is updated by every micro-batch of a stream, and the order it then delivers: the
    categories by their mean so far, the rows of each at random.
    """
    source, sink = _scratch(spark, "cur"), f"curriculum_{uuid.uuid4().hex}"
    e = load(spark, d, "events").select("event_id", "event_type", "value")
    e.write.parquet(source)
    state = spark.readStream.schema("event_id bigint, event_type string, value double").parquet(source).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    state.writeStream.format("memory").queryName(sink).outputMode("complete").option("checkpointLocation", _scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    known = e.join(spark.table(sink).select("event_type", "mean"), "event_type").withColumn("draw", sampling.stable_rank("c", F.col("event_id")))
    return sampling.global_rank(known, ["mean", "event_type", "draw", "event_id"], "place").select("event_id", "place")


_RATIOS = (10, 25, 40, 55)


@query("rcp13_ratio_config", "SELECT 'r' || r AS tag, r / 100 AS ratio, CASE WHEN r < 30 THEN 'wanda' ELSE 'flap' END || '_r' || r || '_masks' AS mask_dir, CASE WHEN r = 40 THEN 'after_sft' ELSE 'after_opd' END AS stop_after, 1000 * r AS seed FROM (VALUES (10), (25), (40), (55)) v(r)")
def rcp13(spark: SparkSession, d: str) -> DataFrame:
    """Configurations of ratios in JSON files, each over a family's and that over a common base, deep-merged."""
    root = _scratch(spark, "configs")
    written = {"base": {"pruning": {"method": "wanda", "seed": 1}, "pipeline": {"stop_after": "after_opd"}}, "high": {"_base_": "base", "pruning": {"method": "flap"}}}
    for r in _RATIOS:
        written[f"r{r}"] = {"_base_": "base" if r < 30 else "high", "pruning": {"ratio": r / 100, "seed": 1000 * r}, **({"pipeline": {"stop_after": "after_sft"}} if r == 40 else {})}
    spark.createDataFrame([(name, json.dumps(c)) for name, c in written.items()], "name string, value string").repartition("name").write.partitionBy("name").text(root)
    files_ = spark.read.option("wholetext", True).text(root)
    configs = {r.name: json.loads(r.value) for r in files_.select("name", "value").collect()}  # one row for each configuration
    rows = []
    for r in _RATIOS:
        c = reg.resolve(configs, f"r{r}")
        tag = f"r{round(c['pruning']['ratio'] * 100):02d}"
        rows.append((tag, c["pruning"]["ratio"], f"{c['pruning']['method']}_{tag}_masks", c["pipeline"]["stop_after"], c["pruning"]["seed"]))
    return spark.createDataFrame(rows, "tag string, ratio double, mask_dir string, stop_after string, seed int")


def _manager(name: str):  # noqa: ANN202
    """A reward manager: (df with response, tokens) -> df with score."""
    return reg.MANAGERS.register(name)


@_manager("naive")
def _naive(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.contains("teacher_response", F.lit("\\boxed{")).cast("double"))


@_manager("overlong")
def _overlong(df: DataFrame) -> DataFrame:
    return _naive(df).withColumn("score", F.col("score") + overlong_penalty(F.coalesce("tokens", F.lit(0)), 400, 100))


@_manager("clipped")
def _clipped(df: DataFrame) -> DataFrame:
    return _overlong(df).withColumn("score", F.greatest("score", F.lit(-1.0)))


_NAIVE = "contains(teacher_response, '\\boxed{')::INT"
_LONG = f"{_NAIVE} + least(-(coalesce(tokens, 0) - 300) / 100.0, 0)"


@query("udf2_reward_managers", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, round(sum({x})::DOUBLE, 4) AS total FROM {RESPONSES} WHERE teacher_response IS NOT NULL" for n, x in (("naive", _NAIVE), ("overlong", _LONG), ("clipped", f"greatest({_LONG}, -1)"))))
def udf2(spark: SparkSession, d: str) -> DataFrame:
    """Scores by every reward manager of the registry."""
    r = responses(spark, d).filter("teacher_response is not null")
    out = None
    for name, manager in reg.MANAGERS.items.items():
        one = manager(r).agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("res9_reward_loop", f"SELECT response_id, round((CASE WHEN contains(teacher_response, '\\boxed{{') THEN 1.0 ELSE 0.0 END + least(-(coalesce(tokens, 0) - 300) / 100.0, 0))::DOUBLE, 7) AS score FROM {RESPONSES} WHERE teacher_response IS NOT NULL")
def res9(spark: SparkSession, d: str) -> DataFrame:
    """Per-sample rewards with the soft penalty for length."""
    r = responses(spark, d).filter("teacher_response is not null")
    score = F.contains("teacher_response", F.lit("\\boxed{")).cast("double") + F.least(-(F.coalesce("tokens", F.lit(0)) - 300) / 100, F.lit(0.0))
    return rounded(r.select("response_id", score.alias("score")))


#: Forms of an answer from a price and a quantity: (given, expected, whether they agree).
_FORMS = [
    ("{p}", "{p}0", True), ("{q}", "{q}.00001", True), ("{q}", "{q}.01", False), ("{q}00%", "{q}", True), ("{q}/2", "{q}*", False), ("({p}, {q}]", "( {p},{q}.0]", True), ("[{p}, {q})", "({p}, {q})", False), ("({p}, {q})", "({p}, {q}, 1)", False), ("\\frac{{q}}{4}", "\\dfrac {q}/4", False), ("${p}$", "{p}", True),
]


def _formed(which: int) -> Column:
    p, q = F.col("l_extendedprice").cast("decimal(12,2)").cast("string"), F.col("l_quantity").cast("int").cast("string")
    out = F.lit(None).cast("string")
    for i, form in enumerate(_FORMS):
        out = F.when(F.col("l_orderkey") % len(_FORMS) == i, F.replace(F.replace(F.lit(form[which]), F.lit("{p}"), p), F.lit("{q}"), q)).otherwise(out)
    return out


@query("rew8_numeric_equality", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_orderkey % {len(_FORMS)} IN ({', '.join(str(i) for i, f in enumerate(_FORMS) if f[2])}) AS same FROM lineitem")
def rew8(spark: SparkSession, d: str) -> DataFrame:
    """Answers equal within a tolerance, as fractions, percentages, tuples or intervals (no symbolic algebra)."""
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", answer_equal(_formed(0), _formed(1)).alias("same"))


@query("snk3_text_digests", "SELECT benchmark, sha256(string_agg(text, chr(10) ORDER BY benchmark_index)) AS digest FROM benchmark_items GROUP BY benchmark")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    t = F.transform(F.array_sort(F.collect_list(F.struct("benchmark_index", "text"))), lambda x: x["text"])
    return load(spark, d, "benchmark_items").groupBy("benchmark").agg(F.sha2(F.array_join(t, "\n"), 256).alias("digest"))


@query("snk4_json_rows", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || ' \u00e9\",\"user_id\":' || user_id || '}' AS line FROM events")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON text with sorted keys and unicode kept."""
    names = sorted(["user_id", "event_type", "event_id"])
    e = load(spark, d, "events").withColumn("event_type", F.concat("event_type", F.lit(" \u00e9")))
    return e.select("event_id", F.to_json(F.struct(*names)).alias("line"))


@query("snk7_typed_values", "SELECT row_id, CASE WHEN domain IS NULL THEN NULL ELSE domain END AS domain, ord::VARCHAR AS ord, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') AS fetched_at, cardinality(strata)::VARCHAR AS n_strata FROM source_rows")
def snk7(spark: SparkSession, d: str) -> DataFrame:
    """Values as JSON has them: times as ISO text, maps as objects, missing ones left out."""
    iso = F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at")
    j = load(spark, d, "source_rows").select("row_id", F.to_json(F.struct("domain", "ord", iso, F.size("strata").alias("n_strata"), "strata")).alias("j"))
    field = lambda n: F.get_json_object("j", f"$.{n}").alias(n)
    return j.select("row_id", field("domain"), field("ord"), field("fetched_at"), F.when(F.get_json_object("j", "$.strata").isNotNull(), F.get_json_object("j", "$.n_strata")).alias("n_strata"))


@query("src14_path_keys", "SELECT n_nationkey, md5(concat('hdfs://data/', n_name)) AS local_key FROM nation")
def src14(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", F.md5(F.concat(F.lit("hdfs://data/"), "n_name")).alias("local_key"))


@query("agg_text_lengths", "SELECT domain, count(*) AS n, min(length(prompt))::BIGINT AS shortest, max(length(prompt))::BIGINT AS longest FROM source_rows GROUP BY domain")
def agg_lengths(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.col("prompt"))
    return load(spark, d, "source_rows").groupBy("domain").agg(F.count("*").alias("n"), F.min(n).cast("bigint").alias("shortest"), F.max(n).cast("bigint").alias("longest"))


